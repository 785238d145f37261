"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.session import cut

BINS = 4096


def exact_quantiles(df: DataFrame, *, keys: list[str], value: str, at: dict[str, float], bins: int = BINS) -> DataFrame:
    """(keys, n, and a column for each name of ``at``): quantiles by linear interpolation between the values around them.

    Equal values are counted first.  A histogram of ``bins`` equal bins between a group's least and largest value tells which
    bins hold the ranks asked for, and only the values of those are ordered; so no buffer and no task ever holds a whole hot
    group.  NULL, NaN and infinite values are left out; groups without others give no row; NULL keys are a group.
    """
    names = [f"key{i}_" for i in range(len(keys))]
    v = F.col(value).cast("double")
    counts = df.where(F.abs(v) < float("inf")).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], v.alias("v_")).agg(F.count("*").alias("c_"))
    counts = cut(counts)
    ends = counts.groupBy(*names).agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), F.sum("c_").alias("n_"))

    def meet(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        """Join on keys in which NULL equals NULL."""
        renamed = other.withColumnsRenamed({c: f"{c}r" for c in on})
        return rows.join(renamed, [F.col(c).eqNullSafe(F.col(f"{c}r")) for c in on]).drop(*[f"{c}r" for c in on])

    width = F.greatest((F.col("hi_") - F.col("lo_")) / bins, F.lit(1e-300))
    binned = meet(counts, ends, names).withColumn("bin_", F.least(F.floor((F.col("v_") - F.col("lo_")) / width), F.lit(bins - 1)))
    histogram = binned.groupBy(*names, "n_", "bin_").agg(F.sum("c_").alias("h_"))
    line = W.partitionBy(*names).orderBy("bin_").rowsBetween(W.unboundedPreceding, -1)  # at most ``bins`` rows of a group
    histogram = histogram.withColumn("before_", F.coalesce(F.sum("h_").over(line), F.lit(0)))
    ranks = [r for q in at.values() for r in (F.floor((F.col("n_") - 1) * q), F.ceil((F.col("n_") - 1) * q))]
    wanted = histogram.where(F.exists(F.array(*ranks), lambda r: (r >= F.col("before_")) & (r < F.col("before_") + F.col("h_"))))
    near = meet(binned.drop("n_", "lo_", "hi_"), wanted.select(*names, "bin_", "n_", "before_"), [*names, "bin_"])
    inside = W.partitionBy(*names, "bin_").orderBy("v_").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("rank_", F.col("before_") + F.coalesce(F.sum("c_").over(inside), F.lit(0)))

    def held(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("rank_")) & (rank < F.col("rank_") + F.col("c_")), F.col("v_")))

    parts = {f"{s}{i}_": held(f((F.col("n_") - 1) * q)) for i, q in enumerate(at.values()) for s, f in (("l", F.floor), ("u", F.ceil))}
    out = near.groupBy(*names, "n_").agg(*[c.alias(n) for n, c in parts.items()])
    share = [(F.col("n_") - 1) * q - F.floor((F.col("n_") - 1) * q) for q in at.values()]
    values = [(F.col(f"l{i}_") + s * (F.col(f"u{i}_") - F.col(f"l{i}_"))).alias(name) for i, (name, s) in enumerate(zip(at, share))]
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("n_").alias("n"), *values)
