import numpy as np
import pandas as pd

from pitchweave.llm.nearest_time import nearest_in_time


def run(spark, left, right, tolerance=0.05, **options):
    a = spark.createDataFrame(left, "m string, c string, f int, t double, _b int")
    b = spark.createDataFrame(right, "m string, c string, g int, t double, rt double")
    return nearest_in_time(a, b, keys=["m", "c"], left_time="t", right_time="t", left_values=["f"], right_values=["g"], tolerance=tolerance, **options).toPandas()


def brute(left, right, tolerance):
    out = set()
    for m, c, f, t, _ in left:
        if t is None or np.isnan(t) or m is None or c is None:
            continue
        near = [(abs(t - u), u, g) for n, d, g, u, _ in right if (n, d) == (m, c) and u is not None and not np.isnan(u) and abs(t - u) <= tolerance]
        if near:
            out.add((m, c, f, min(near)[2]))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    for seed, block in ((1, 60.0), (2, 1.0), (3, 0.5)):
        rng = np.random.default_rng(seed)
        left = [(rng.choice(["m", "n"]), "c1" if rng.random() < 0.8 else "c2", i, float(rng.random() * 20), 0) for i in range(400)]
        right = [(rng.choice(["m", "n"]), "c1", i, float(np.round(rng.random() * 20, 2)), 0.0) for i in range(300)]
        got = run(spark, left, right, block=block)
        assert set(map(tuple, got[["m", "c", "f", "g"]].values)) == brute(left, right, 0.05) and len(got) == len(brute(left, right, 0.05))


def test_ties_nulls_and_empty(spark):
    nan = float("nan")
    left = [("m", "c", 1, 1.0, 0), ("m", "c", 1, 1.0, 0), ("m", "c", 2, None, 0), ("m", "c", 3, nan, 0), (None, "c", 4, 1.0, 0), ("m", "c", 5, 2.0, 0), ("m", "c", 6, -0.03125, 0)]
    right = [("m", "c", 8, 1.03125, 0.0), ("m", "c", 7, 0.96875, 0.0), ("m", "c", 6, 0.96875, 0.0), ("m", "c", 5, 0.96875, 0.0), ("m", "c", 9, None, 0.0), (None, "c", 1, 1.0, 0.0), ("m", "c", 1, 2.0625, 0.0), ("m", "c", 3, 0.0, 0.0)]
    got = run(spark, left, right)
    # equal distance: the earlier; equal time: the smallest; two like left rows: two rows; 2.0625 is too far; before zero
    assert sorted(map(tuple, got[["f", "g"]].values)) == [(1, 5), (1, 5), (6, 3)]
    assert run(spark, [], right).empty and run(spark, left, []).empty
    assert isinstance(got, pd.DataFrame) and (got.distance <= 0.05).all()
