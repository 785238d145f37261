import numpy as np
import pytest

from pitchweave.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_quantiles_are_those_of_the_sorted_values(spark, bins):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=501), "b": np.r_[np.full(300, 2.0), rng.exponential(size=100)], "c": np.array([5.0]), None: np.array([1.0, 2.0]), "flat": np.full(9, 3.0), "wide": np.array([1e-9, 1.0, 1e9, 1e9])}
    rows = [(k, float(v), "x") for k, vs in groups.items() for v in vs] + [("a", None, ""), ("a", float("nan"), ""), ("none", None, ""), ("b", float("inf"), "")]
    df = spark.createDataFrame(rows, "k string, v double, n string")
    out = {r.k: r for r in exact_quantiles(df, keys=["k"], value="v", at={"median": 0.5, "p95": 0.95, "low": 0.0}, bins=bins).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        assert out[k].n == len(vs)
        assert np.allclose([out[k].median, out[k].p95, out[k].low], np.quantile(vs, [0.5, 0.95, 0.0]), rtol=1e-12, atol=1e-12), k
    assert exact_quantiles(df.limit(0), keys=["k"], value="v", at={"m": 0.5}).count() == 0
