import numpy as np
from pyspark.sql import functions as F

from pitchweave.streaming.windows import file_stream, live_tracks, sessions, sliding_counts


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).toPandas()


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = [(i, f"e{i % 2}", float(i)) for i in range(0, 3000, 7)] + [(9000, "e0", 1.0)]
    df = spark.createDataFrame(rows, "s long, kind string, value double").select(F.timestamp_seconds("s").alias("ts"), "kind", "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema)
    got = drain(sliding_counts(stream, time="ts", keys=["kind"], late="60 minutes"), "slide", "complete")
    want = sliding_counts(df, time="ts", keys=["kind"]).toPandas()
    key = ["kind", "start", "n"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, want[key].values))
    got = drain(sessions(stream, time="ts", keys=["kind"], gap="600 seconds", late="60 minutes"), "sess")
    assert sorted(got[got.start < 8e9].n) == sorted(sessions(df, time="ts", keys=["kind"], gap="600 seconds").where("start < 8000000000").toPandas().n)


def test_live_tracks_go_on_over_batches(spark, tmp_path):
    def part(lo, hi):
        return [("cam1", k, 0.2 * k + 5 * j, 1.0 + 6 * j) for k in range(lo, hi) for j in (0, 1)]

    for n, (lo, hi) in enumerate([(0, 20), (20, 40)]):
        spark.createDataFrame(part(lo, hi), "camera string, k long, x double, y double").coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
    schema = spark.read.parquet(str(tmp_path / "p0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p*"))
    got = drain(live_tracks(stream, keys=["camera"]), "live")
    assert len(got) == 80
    for low in (1.0, 7.0):
        assert got[np.isclose(got.y, low)].track.nunique() == 1
