import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchweave.functions.kernels import follow
from pitchweave.operators.blocks import islands, pieces
from pitchweave.operators.graphs import components
from pitchweave.operators.joins import asof_versions, band_join, mutual_nearest, overlapping, with_margin
from pitchweave.operators.smoothing import motion_tracks


def test_islands_cross_blocks(spark):
    rng = np.random.default_rng(6)
    ks = np.unique(rng.integers(0, 500, 160))
    df = spark.createDataFrame([("a", int(k)) for k in ks] + [("b", 3), ("b", None)], "g string, k int")
    out = islands(df, keys=["g"], order="k", most=3, block=16).toPandas()
    cut = np.flatnonzero(np.diff(ks) > 3)
    want = set(zip(ks[np.r_[0, cut + 1]].tolist(), ks[np.r_[cut, len(ks) - 1]].tolist()))
    assert set(zip(out[out.g == "a"]["first"], out[out.g == "a"]["last"])) == want
    assert out[out.g == "b"].rows.tolist() == [1]
    by_column = islands(df.withColumn("m", F.lit(3)), keys=["g"], order="k", most="m", halo=8, block=16).toPandas()
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, by_column.values))


def test_pieces_count_over_blocks(spark):
    df = spark.createDataFrame([("a", k, k % 7 == 0) for k in range(100)], "g string, k int, s boolean")
    out = pieces(df, keys=["g"], order="k", starts="s", block=8).toPandas().sort_values("k")
    assert out.piece.tolist() == [k // 7 + 1 for k in range(100)]


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(7)
    a = pd.DataFrame({"m": rng.choice(["p", "q"], 60), "i": range(60), "at": rng.integers(0, 200, 60)})
    b = pd.DataFrame({"m": rng.choice(["p", "q"], 60), "j": range(60), "bt": rng.integers(0, 200, 60)})
    got = band_join(spark.createDataFrame(a), spark.createDataFrame(b), keys=["m"], left_at="at", right_at="bt", least=1, most=10).toPandas()
    want = a.merge(b, on="m").query("1 <= bt - at <= 10")
    assert set(zip(got.i, got.j)) == set(zip(want.i, want.j)) and len(got) == len(want)
    s = pd.DataFrame({"m": "p", "i": range(50), "a": rng.integers(0, 100, 50)})
    s["b"] = s.a + rng.integers(0, 30, 50)
    got = overlapping(spark.createDataFrame(s), keys=["m"], id="i", start="a", end="b", width=8).toPandas()
    want = s.merge(s, on="m").query("i_x < i_y and a_x <= b_y and a_y <= b_x")
    assert set(zip(got.a, got.b)) == set(zip(want.i_x, want.i_y)) and len(got) == len(want)


def test_asof_falls_back_to_the_first_version(spark):
    facts = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 9.0), ("b", 1.0)], "c string, t double")
    versions = spark.createDataFrame([("a", 4.0, 1), ("a", 8.0, 2)], "c string, f double, v int")
    out = asof_versions(facts, versions, keys=["c"], time="t", valid_from="f").orderBy("t").select("v").toPandas()
    assert out.v.tolist() == [1, 1, 2]


def test_mutual_and_clear_pairs(spark):
    pairs = spark.createDataFrame([("g", 1, 1, 0.1), ("g", 1, 2, 0.3), ("g", 2, 1, 0.2), ("g", 2, 2, 2.0)], "g string, a int, b int, d double")
    assert [tuple(r) for r in mutual_nearest(pairs, group=["g"], a="a", b="b", distance="d").select("a", "b").collect()] == [(1, 1)]
    assert with_margin(pairs, group=["g"], a="a", b="b", distance="d", margin=0.2).count() == 0


def test_components_of_a_long_chain(spark):
    nodes = spark.createDataFrame([("m", i) for i in range(30)], "m string, n int")
    links = spark.createDataFrame([("m", i, i + 1) for i in range(19)] + [("m", 25, 26)], "m string, a int, b int")
    out = {r.n: r.component for r in components(nodes, links, keys=["m"], node="n", a="a", b="b").collect()}
    assert all(out[i] == 0 for i in range(20)) and out[26] == 25 and out[22] == 22


def walkers(n, seed):
    """Three that pass each other, so that an order taken anew after the middle is another one."""
    rng = np.random.default_rng(seed)
    k = np.arange(n)
    rows = [pd.DataFrame({"k": k, "x": 10 * j * (1 - 2 * k / n) + rng.normal(0, 0.05, n), "y": 10 * j + rng.normal(0, 0.05, n)}) for j in range(3)]
    out = pd.concat(rows, ignore_index=True)
    return out[rng.random(len(out)) < 0.9].assign(id=lambda d: rng.permutation(len(d)))


def test_motion_tracks_go_on_over_block_edges(spark):
    a, b = walkers(4300, 8), walkers(120, 9)
    df = spark.createDataFrame(pd.concat([a.assign(g="a"), b.assign(g=None)])).repartition(5)
    out = motion_tracks(df, keys=["g"], frame="k", id="id").toPandas()
    for own, got in ((a, out[out.g == "a"]), (b, out[out.g.isna()])):
        own = own.sort_values(["k", "id"])
        want = dict(zip(own.id, follow(own.k.to_numpy(), own[["x", "y"]].to_numpy())))
        assert len(got) == len(own) and dict(zip(got.id, got.track)) == want
    over = out[out.g == "a"].groupby("track").block.nunique()
    assert (over == 2).sum() == 3


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_motion_tracks_do_not_hang_on_blocks_or_batches(spark, batch):
    a = walkers(200, 10)
    own = a.sort_values(["k", "id"])
    want = dict(zip(own.id, follow(own.k.to_numpy(), own[["x", "y"]].to_numpy())))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = motion_tracks(spark.createDataFrame(a.assign(g=1)), keys=["g"], frame="k", id="id", block=16).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert dict(zip(out.id, out.track)) == want and out.block.nunique() == 13
