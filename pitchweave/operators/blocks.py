"""Ordered operations on hot keys: series cut into blocks that carry context from their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def in_blocks(df: DataFrame, order: str, *, before: int, after: int, block: int = 4096) -> DataFrame:
    """``df`` with ``_blk`` and ``_core``: every row in its own block of ``block`` positions, and again, as context, in those
    that lie within ``before`` after it or ``after`` before it.

    A window partitioned by the keys and ``_blk`` then sees everything within ``before`` and ``after`` positions of its
    core rows, and no task holds a whole hot series.
    """
    at = F.col(order).cast("bigint")
    own = F.floor(at / block)
    spread = F.array_distinct(F.array(own, F.floor((at + before) / block), F.floor((at - after) / block)))
    return df.withColumn("_own", own).withColumn("_blk", F.explode(spread)).withColumn("_core", F.col("_blk") == F.col("_own")).drop("_own")


def core(df: DataFrame) -> DataFrame:
    """The rows of ``in_blocks`` without the context."""
    return df.where("_core").drop("_core", "_blk")


def series(keys: list[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys, "_blk").orderBy(order)


def pieces(df: DataFrame, *, keys: list[str], order: str, starts: str, block: int = 4096) -> DataFrame:
    """``df`` with ``piece``: for each row the number of rows up to it, in its series, whose column ``starts`` is true.

    Counted within blocks; what earlier blocks hold is added from a summary of one row per block.
    """
    rows = df.withColumn("_b", F.floor(F.col(order).cast("bigint") / block))
    count = F.coalesce(F.col(starts).cast("int"), F.lit(0))
    rows = rows.withColumn("_n", F.sum(count).over(W.partitionBy(*keys, "_b").orderBy(order)))
    sums = rows.groupBy(*keys, "_b").agg(F.sum(count).alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], F.col("_b").alias("_jb"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)] + [F.col("_b").eqNullSafe(F.col("_jb"))]
    joined = rows.join(sums, on)
    return joined.withColumn("piece", F.col("_n") + F.col("_before")).select(*df.columns, "piece")


def islands(df: DataFrame, *, keys: list[str], order: str, most: int | str, halo: int | None = None, block: int = 4096) -> DataFrame:
    """(keys, first, last, rows): stretches of positions of a series in which no two neighbours are more than ``most`` apart.

    ``most`` is a number, or a column that is the same within a series; then ``halo`` bounds it.  Repeated positions count
    as rows; NULL positions are left out.
    """
    far = F.lit(most) if isinstance(most, int) else F.col("_most")
    extra = [] if isinstance(most, int) else [F.col(most).alias("_most")]
    rows = df.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("bigint").alias("_k"), *extra)
    rows = in_blocks(rows, "_k", before=most if isinstance(most, int) else halo, after=0, block=block)
    behind = F.col("_k") - F.lag("_k").over(series(keys, "_k"))
    rows = core(rows.withColumn("_start", behind.isNull() | (behind > far)))
    out = pieces(rows, keys=keys, order="_k", starts="_start", block=block)
    return out.groupBy(*keys, "piece").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.count("*").alias("rows")).drop("piece")

