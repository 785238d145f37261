import numpy as np
import pytest

from pitchweave.operators.regrid import regrid


def run(spark, readings, sources, **options):
    r = spark.createDataFrame(readings, "s string, p double, v double, k string")
    g = spark.createDataFrame(sources, "s string, n int, status string")
    return regrid(r, g, keys=["s"], position="p", values=["v"], size="n", **options).toPandas().sort_values(["s", "k"]).reset_index(drop=True)


def test_holes_are_interpolated_or_marked(spark):
    out = run(spark, [("a", 0.2, 2.0, ""), ("a", 0.4, 9.0, ""), ("a", 3.0, 30.0, ""), ("a", 9.0, 90.0, ""), ("a", None, 1.0, ""), ("a", float("nan"), 1.0, "")], [("a", 11, ""), ("b", 2, ""), ("c", None, ""), ("d", 0, "")], gap_limit=4)
    a = out[out.s == "a"].set_index("k")
    assert a.status.tolist() == ["observed", "interpolated", "interpolated", "observed", *["missing"] * 5, "observed", "missing"]
    assert a.v[0] == 2.0 and a.v[1] == pytest.approx(2 + 0.8 / 2.8 * 28) and np.isnan(a.v[5])
    assert out[out.s == "b"].status.tolist() == ["missing", "missing"] and set(out.s) == {"a", "b"}


def test_half_goes_to_even_and_blocks_do_not_show(spark):
    assert run(spark, [("a", 0.5, 1.0, ""), ("a", 1.5, 2.0, "")], [("a", 3, ""), ("a", 2, "")])["status"].tolist() == ["observed", "interpolated", "observed"]
    rng = np.random.default_rng(5)
    readings = [("a", float(p), float(p), "") for p in rng.random(150) * 400]
    a, b = (run(spark, readings, [("a", 400, "")], gap_limit=6, block=n) for n in (16, 4096))
    assert a.equals(b)
    near = a[a.status == "interpolated"]
    assert np.allclose(near.v, near.k)
    assert run(spark, [], [("a", 3, "")])["status"].tolist() == ["missing"] * 3
