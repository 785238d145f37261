"""Pairing of records by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: list[str],
    left_time: str,
    right_time: str,
    left_values: list[str],
    right_values: list[str],
    tolerance: float,
    block: float = 60.0,
) -> DataFrame:
    """For each left record the right record of the same keys nearest in time, at most ``tolerance`` away.

    Result: keys, ``left_values``, ``right_values``, ``distance`` (seconds); left records without a partner give no row.
    Value names must differ between the sides.  A right record may serve many left ones.  Of two at equal distance the
    earlier holds; of several right records at one time the one with the smallest values.  Records with a NULL or NaN
    time, or with any NULL key, pair with nothing.  Repeated records count as often as they come on the left, once on
    the right.  Other columns are not read.  Empty tables give an empty result.

    Every right time becomes the interval in which it is the nearest one, bounded by the midpoints to its neighbours and
    by the tolerance.  Intervals are indexed by time buckets of eight tolerances; left times look up one bucket.  The
    neighbours come from blocks of ``block`` seconds with two tolerances of context.  So both exchanges are by keys and
    time, and one hot key is spread over as many tasks as it has blocks and buckets.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    width, block = 8.0 * tolerance, max(block, 8.0 * tolerance)
    names = [f"_key{i}" for i in range(len(keys))]
    present = " and ".join(f"{n} is not null" for n in names)

    def bare(df: DataFrame, time: str, values: list[str], prefix: str) -> DataFrame:
        picked = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(time).cast("double").alias(f"{prefix}t"), *[F.col(v).alias(f"{prefix}{i}") for i, v in enumerate(values)])
        return picked.where(f"{present} and {prefix}t is not null and not isnan({prefix}t)")

    reach = 2 * tolerance
    context = F.array_distinct(F.array(*[F.floor((F.col("rt") + s * reach) / block) for s in (-1, 0, 1)]))
    rights = bare(right, right_time, right_values, "r").withColumn("_blk", F.explode(context))
    line = W.partitionBy(*names, "_blk").orderBy("rt", *[F.col(f"r{i}").asc_nulls_last() for i in range(len(right_values))])
    rights = rights.withColumn("_same", F.lag("rt").over(line)).where("_same is null or _same <> rt").drop("_same")
    rights = rights.withColumns({"_p": F.lag("rt").over(line), "_n": F.lead("rt").over(line)}).where(F.floor(F.col("rt") / block) == F.col("_blk")).drop("_blk")
    low = F.greatest(F.col("rt") - tolerance, F.coalesce((F.col("_p") + F.col("rt")) / 2, F.col("rt") - tolerance))
    high = F.least(F.col("rt") + tolerance, F.coalesce((F.col("rt") + F.col("_n")) / 2, F.col("rt") + tolerance))
    slack = tolerance * 1e-6  # the exact comparison follows; an interval's rounding must not lose a pair
    rights = rights.withColumns({"_lo": low - slack, "_hi": high + slack})
    index = rights.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    lefts = bare(left, left_time, left_values, "l").withColumn("_b", F.floor(F.col("lt") / width))
    gap = F.abs(F.col("lt") - F.col("rt"))
    nearest = (
        (F.col("lt") >= F.col("_lo"))
        & (F.col("lt") <= F.col("_hi"))
        & (gap <= tolerance)
        & (F.col("_p").isNull() | (gap < F.abs(F.col("lt") - F.col("_p"))))
        & (F.col("_n").isNull() | (gap <= F.abs(F.col("lt") - F.col("_n"))))
    )
    on = [F.col(f"a.{n}") == F.col(f"b.{n}") for n in [*names, "_b"]]
    return (
        lefts.alias("a").join(index.alias("b"), [*on, nearest]).select(
            *[F.col(f"a.{n}").alias(k) for n, k in zip(names, keys)],
            *[F.col(f"l{i}").alias(v) for i, v in enumerate(left_values)],
            *[F.col(f"r{i}").alias(v) for i, v in enumerate(right_values)],
            gap.alias("distance"),
        )
    )
