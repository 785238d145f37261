"""Readers and writers of the nested documents and label files that recordings come with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTIONS = "meta struct<camera: string, fps: double>, detections array<struct<frame: int, t: double, u: double, v: double, conf: double, team: string, h_px: double, feat: array<smallint>, box: array<double>>>"
TRACKS = "version int, court struct<length: double, width: double>, fps double, start double, n_frames int, players array<struct<id: int, team: string, name: string, x: array<double>, y: array<double>>>"
CALIBRATION = "struct<`from`: double, H: array<array<double>>, rms_px: double, used: array<string>>"


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per detection of the JSON documents at ``path``; ``i`` is its place in its document."""
    docs = spark.read.schema(DETECTIONS).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    rows = docs.select("file", "meta.camera", F.posexplode("detections").alias("i", "d")).select("file", "camera", "i", "d.*")
    box = F.when(F.size("box") == 4, F.struct(*[F.col("box")[j].alias(n) for j, n in enumerate(("x1", "y1", "x2", "y2"))]))
    return rows.withColumn("box", box)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per player and seen frame of exported track documents."""
    docs = spark.read.schema(TRACKS).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    players = docs.select("file", "fps", F.explode("players").alias("p"))
    frames = players.select("file", "fps", F.col("p.id").alias("player_id"), "p.team", "p.name", F.posexplode(F.arrays_zip("p.x", "p.y")).alias("k", "xy"))
    return frames.select("file", "fps", "player_id", "team", "name", "k", "xy.x", "xy.y").where("x is not null and y is not null")


def tracks_documents(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """(match_id, document): one JSON document per match, positions rounded to centimetres, null where unseen.

    A document holds its match's whole series, so it is for matches of bounded length, as an export is.
    """
    clock = matches.select("match_id", "court_length", "court_width", "fps", "start_s", "n_frames")
    seen = tracks.where("k >= 0").groupBy("match_id", "player_id", "k").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max("team").alias("team"), F.max("name").alias("name"))
    series = seen.groupBy("match_id", "player_id").agg(F.max("team").alias("team"), F.max("name").alias("name"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("x", "y")))).alias("at")).join(clock, "match_id")

    def column(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1), lambda k: F.round(F.try_element_at("at", k)[c], 2)).alias(c)

    player = series.select("match_id", "court_length", "court_width", "fps", "start_s", "n_frames", F.struct(F.col("player_id").alias("id"), "team", "name", column("x"), column("y")).alias("p"))
    whole = player.groupBy("match_id", "court_length", "court_width", "fps", "start_s", "n_frames").agg(F.array_sort(F.collect_list("p")).alias("players"))
    document = F.struct(F.lit(1).alias("version"), F.struct(F.col("court_length").alias("length"), F.col("court_width").alias("width")).alias("court"), "fps", F.col("start_s").alias("start"), "n_frames", "players")
    return whole.select("match_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def calibration_versions(df: DataFrame, *, camera: str, text: str) -> DataFrame:
    """(camera, from_s, h, rms_px, used): versions of JSON calibrations that are one object or a list of them."""
    many = F.from_json(text, f"array<{CALIBRATION}>")
    one = F.array(F.from_json(text, CALIBRATION))
    versions = F.when(F.ltrim(text).startswith("["), many).otherwise(one)
    rows = df.select(F.col(camera).alias("camera"), F.explode(versions).alias("c"))
    return rows.select("camera", F.coalesce("c.from", F.lit(0.0)).alias("from_s"), F.flatten("c.H").alias("h"), "c.rms_px", "c.used").where("h is not null")


def read_labels(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Boxes of label files: class and normalised centre and size become pixel corners; lines of under five tokens are skipped."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.select("file", t.alias("t")).where(F.size("t") >= 5)
    c, x, y, w, h = (F.col("t")[i].cast("double") for i in range(5))
    return rows.select("file", c.cast("int").alias("cls"), ((x - w / 2) * width).alias("x1"), ((y - h / 2) * height).alias("y1"), ((x + w / 2) * width).alias("x2"), ((y + h / 2) * height).alias("y2"))


def label_lines(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """``boxes`` with ``line``: the label file line of each box."""
    parts = [(F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height]
    return boxes.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls"), *parts))


def filename_time(name: str) -> Column:
    """Time in a file name such as VID_20261008_193000.mp4; NULL if it has none."""
    stamp = F.regexp_extract(name, r"(20\d{6})_(\d{6})", 0)
    return F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def clock_text(seconds: Column) -> Column:
    """Seconds as m:ss.s."""
    return F.format_string("%d:%04.1f", F.floor(seconds / 60).cast("int"), seconds - 60 * F.floor(seconds / 60))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, values): rows of two-dimensional .npy files, such as embeddings beside a detections document."""
    import pandas as pd

    def rows(batches):
        import io

        import numpy as np

        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    yield pd.DataFrame({"file": [file] * len(part), "i": range(lo, lo + len(part)), "values": [None if np.isnan(r).any() else r for r in part]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, i long, values array<float>")
