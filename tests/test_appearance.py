import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchweave.operators.appearance import look_changes, look_distance, look_groups, track_looks

SCHEMA = "match_id string, track_id long, k int, v array<double>, n string"


def views(rng, looks, track, frames, noise=0.05):
    return [("m", track, k, (looks + rng.normal(0, noise, len(looks))).tolist(), "x") for k in frames]


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(0)
    base = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = views(rng, base[0], 1, range(200)) + views(rng, base[0], 2, range(300, 400)) + views(rng, base[1], 3, range(60))
    rows += views(rng, base[2], 4, range(50)) + views(rng, base[3], 4, range(50, 120))  # one track, two people
    rows += [("m", 1, None, [1.0] * 12, ""), ("m", 1, 5, None, ""), ("m", 1, 6, [0.0] * 12, ""), ("m", 9, 1, base[1].tolist(), "")]
    return rows


def test_looks_and_their_distances(spark, people):
    df = spark.createDataFrame(people, SCHEMA)
    looks = track_looks(df, keys=["match_id", "track_id"], order="k", vector="v").cache()
    got = {r.track_id: r for r in looks.collect()}
    assert set(got) == {1, 2, 3, 4} and len(got[1].medoids) == 10 and got[4].spread > 3 * got[1].spread
    a, b = (looks.select(F.col("track_id").alias(s), F.col("mean").alias(f"m{s}"), F.col("medoids").alias(f"t{s}")) for s in "ab")
    d = {(r.a, r.b): r.d for r in a.join(b, F.col("a") < F.col("b")).select("a", "b", look_distance("ma", "mb", "ta", "tb").alias("d")).collect()}
    assert d[1, 2] < 0.1 < 0.5 < d[1, 3]
    groups = {r.track_id: r.look for r in look_groups(looks, match="match_id", id="track_id", groups=3).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    assert track_looks(df.limit(0), keys=["match_id", "track_id"], order="k", vector="v").count() == 0


def test_a_track_of_two_people_changes_its_look(spark, people):
    out = look_changes(spark.createDataFrame(people, SCHEMA), keys=["match_id", "track_id"], order="k", vector="v").orderBy("track_id", "part").collect()
    assert [(r.track_id, r["first"], r["last"]) for r in out if r.track_id in (3, 4)] == [(3, 0, 59), (4, 0, 49), (4, 50, 119)]
    assert sum(r.track_id == 1 for r in out) == 1
