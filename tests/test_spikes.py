import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchweave.operators.spikes import constant_runs, flag_readings, short_excursions, spike_scores


def series(rng, n=200, noise=0.1):
    t = np.arange(n)
    return 10 + 4 * np.sin(t / 25) + rng.normal(0, noise, n)


def test_planted_spikes_stand_out():
    rng = np.random.default_rng(2)
    hit = false = planted = 0
    for noise in (0.02, 0.1, 0.3):
        for _ in range(10):
            v = series(rng, noise=noise)
            at = rng.choice(np.arange(12, 185, 9), 6, replace=False)
            mark = np.zeros(len(v), bool)
            for a in at:
                n = rng.integers(1, 4)
                v[a : a + n] += rng.choice([-1, 1]) * noise * rng.uniform(12, 40)
                mark[a : a + n] = True
            v[rng.choice(200, 10)] = np.nan
            mark &= np.isfinite(v)
            _, score, _ = spike_scores(v)
            seen = np.isfinite(v)
            found = short_excursions(np.where(seen, np.nan_to_num(score), 0), seen, 8.0, 3)
            hit, false, planted = hit + (found & mark).sum(), false + (found & ~mark).sum(), planted + mark.sum()
    assert hit >= 0.95 * planted and false <= 0.03 * planted


def test_small_deviations_are_no_spikes():
    rng = np.random.default_rng(3)
    for _ in range(10):
        v = series(rng)
        v[[50, 90, 140]] += 0.4
        _, score, _ = spike_scores(v)
        assert not short_excursions(score, np.isfinite(v), 8.0, 3).any()


@pytest.mark.parametrize("run", [[9, 5.5], [5.5, 9], [8.7, 7, 5.3], [7, 12, 6], [12, 7]])
def test_each_row_of_a_short_excursion_is_judged_by_its_own_score(run):
    score = np.ones(40)
    score[20 : 20 + len(run)] = run
    assert np.flatnonzero(short_excursions(score, np.ones(40, bool), 8.0, 3)).tolist() == [20 + i for i, s in enumerate(run) if s > 8]


def test_constant_runs():
    v = np.array([1, 1, 1, 2, 2, np.nan, 2, 2, 2.0])
    assert constant_runs(v, 3).tolist() == [True, True, True, False, False, False, True, True, True]
    assert not constant_runs(np.full(20, np.nan), 3).any() and constant_runs(np.zeros(0), 3).size == 0


@pytest.mark.parametrize("block", [64, 4096])
def test_flags_on_a_table(spark, block):
    rng = np.random.default_rng(4)
    x, y = series(rng), series(rng)
    x[70] += 5
    y[120:135] = y[120]
    x[160] = 900.0
    rows = [("m", k, float(x[k]), float(y[k]), "spike") for k in range(200)] * 2 + [("m", None, 1.0, 1.0, ""), (None, 3, None, float("nan"), "")]
    df = spark.createDataFrame(rows, "id string, k int, x double, y double, spike string")
    out = flag_readings(df, keys=["id"], order="k", values=["x", "y"], impossible=F.col("x") > 100, block=block).toPandas()
    own = out[out.id == "m"].set_index("k")
    assert len(own) == 200 and own.index.is_unique
    assert own.index[own.spike].tolist() == [70]
    assert own.index[own.stuck].tolist() == list(range(120, 135))
    assert own.index[own.impossible].tolist() == [160]
    other = out[out.id.isna()]
    assert len(other) == 1 and not other[["spike", "stuck", "impossible"]].to_numpy().any()
    assert flag_readings(df.limit(0), keys=["id"], order="k", values=["x", "y"]).count() == 0
