import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchweave.operators.fill import fill_category, fill_numeric, stand_ins, without_stand_ins

SCHEMA = "g string, k int, x double, y double, team string, _k string, _blk int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 7) for r in rows], SCHEMA)


def filled(df, **options):
    out = fill_numeric(df, keys=["g"], order="k", values=["x", "y"], **options).toPandas()
    return out.sort_values(["g", "k"], na_position="first").reset_index(drop=True)


def test_short_gaps_are_filled_and_marked(spark):
    df = frame(spark, [("a", 0, 0.0, 0.0, "A"), ("a", 1, None, 1.0, "A"), ("a", 4, 4.0, 8.0, "A"), ("a", 4, 4.0, 8.0, "A"), ("a", 9, math.nan, None, None)])
    out = filled(df, gap_limit=2).set_index("k")
    assert out.index.tolist() == [0, 1, 4, 9] and not out.bridged.any()  # three frames are too many
    out = filled(df, gap_limit=3).set_index("k")
    assert out.index.tolist() == [0, 1, 2, 3, 4, 9]
    assert out.x.tolist()[:5] == [0, 1, 2, 3, 4] and out.y[1] == 1.0 and out.y[2] == 4.0
    assert out.bridged.tolist() == [False, True, True, True, False, False]
    assert out.x_method[1] == "linear" and out.y_method[1] == "observed" and not out.y_filled[1] and out.had_row.tolist() == [True, True, False, False, True, True]
    assert out.distance[1] == 1 and out.distance[2] == 2 and out.gap[2] == 3
    assert out.x_method[9] == "none" and pd.isna(out.x[9])  # nothing after it


def test_blocks_do_not_show(spark):
    rng = np.random.default_rng(0)
    seen = np.flatnonzero(rng.random(600) < 0.3)
    df = frame(spark, [("a", int(k), float(k) ** 2, float(-k), "A") for k in seen for _ in range(2)])
    a, b = filled(df, gap_limit=5, block=16), filled(df, gap_limit=5, block=100_000)
    pd.testing.assert_frame_equal(a, b)
    frames = {int(f) for p, q in zip(seen, seen[1:]) if q - p <= 6 for f in range(p + 1, q)}
    assert set(a[a.bridged].k) == frames


def test_null_keys_ties_and_empty_tables(spark):
    df = frame(spark, [(None, 0, 1.0, 1.0, None), (None, 2, 3.0, 3.0, None), (None, 0, 0.5, 9.0, None), ("a", None, 1.0, 1.0, None), ("a", 5, math.inf, 1.0, None)])
    out = filled(df, gap_limit=4)
    assert out[out.bridged].k.tolist() == [1] and out[out.bridged].x.tolist() == [1.75]  # the smaller of the two readings at 0
    assert out[out.g == "a"].x_method.tolist() == ["none"]
    assert filled(frame(spark, [])).empty


def test_categories_are_carried_over_blocks(spark):
    df = frame(spark, [("a", 0, 0.0, 0.0, None), ("a", 3, 0.0, 0.0, "A"), ("a", 40, 0.0, 0.0, "?"), ("a", 41, 0.0, 0.0, ""), ("a", 90, 0.0, 0.0, "B"), ("b", 1, 0.0, 0.0, None)])
    out = fill_category(df, keys=["g"], order="k", value="team", known=["A", "B"], block=16).toPandas().sort_values(["g", "k"])
    assert out.team.tolist() == ["A", "A", "A", "A", "B", None]
    assert out.team_method.tolist() == ["carry_backward", "observed", "carry_forward", "carry_forward", "observed", "none"]
    assert out.team_distance.tolist()[:4] == [3, pytest.approx(np.nan, nan_ok=True), 37, 38]
    near = fill_category(df, keys=["g"], order="k", value="team", known=["A", "B"], gap_limit=10).where(F.col("team_filled")).count()
    assert near == 1


def test_stand_ins_are_found_by_frequency(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i % 7}", i, float(x), float(y), None) for i, (x, y) in enumerate(rng.random((3000, 2)).round(4))]
    rows += [(f"t{i % 5}", 5000 + i, -99.0, -99.0, None) for i in range(20)] + [("t1", 9000 + i, 0.25, 0.25, None) for i in range(30)]
    df = frame(spark, rows)
    found = stand_ins(df, ["x", "y"], entity=["g"])
    assert [tuple(r) for r in found.collect()] == [(-99.0, -99.0)]  # the other repeats are one entity that stands still
    assert without_stand_ins(df, ["x", "y"], found).where("x is null").count() == 20
    assert stand_ins(frame(spark, []), ["x", "y"], entity=["g"]).count() == 0


@pytest.mark.parametrize("others", [500, 40_000])
def test_a_stand_in_of_one_source_is_found_however_large_the_table(spark, others):
    rng = np.random.default_rng(7)
    rows = [("m1", int(e), float(v), 1.0) for e, v in zip(rng.integers(0, 4, 400), rng.uniform(0, 40, 400))] + [("m1", e % 4, 0.0, 0.0) for e in range(12)]
    rows += [(f"m{2 + i % 50}", i % 4, float(v), 2.0) for i, v in enumerate(rng.uniform(0, 40, others))] + [("m2", 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "m string, p int, x double, y double")
    found = stand_ins(df, ["x", "y"], entity=["m", "p"], source="m")
    assert [tuple(r) for r in found[1].collect()] == [("m1", 0.0, 0.0)]
    out = without_stand_ins(df, ["x", "y"], found).groupBy("m").agg(F.count(F.when(F.col("x").isNull(), 1)).alias("n")).where("n > 0").collect()
    assert {r.m: r.n for r in out} == ({"m1": 12} if others > 500 else {"m1": 12, "m2": 1})
