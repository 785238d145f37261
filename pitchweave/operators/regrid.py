"""Irregular readings onto a regular grid, by an as-of merge that sees the neighbours on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def regrid(
    readings: DataFrame,
    sources: DataFrame,
    *,
    keys: list[str],
    position: str,
    values: list[str],
    size: str,
    gap_limit: int = 20,
    block: int = 4096,
) -> DataFrame:
    """One row per source and grid frame 0 .. size - 1, observed, interpolated or missing.

    ``readings`` has ``keys``, ``position`` (DOUBLE, in grid frames) and numeric ``values``; ``sources`` has ``keys`` and
    ``size`` (frames of its grid).  A reading falls on the grid frame nearest to its position, half to even; of several
    on one frame the nearest in position holds, then the earliest, then the smallest values.

    Result: keys, ``k`` (INT), ``status`` (``observed``: a reading falls on the frame; ``interpolated``: none does, and
    the readings around it are at most ``gap_limit`` frames apart; ``missing``), ``values`` (the reading's own, or
    weighted by the two neighbours' distances, or NULL), ``before`` and ``after`` (positions used).

    Grid and readings are merged in blocks of ``block`` frames that carry ``gap_limit`` frames of context, so one hot
    source is spread over many tasks.  NULL or NaN positions are no reading; sources with NULL or no size, or absent
    from ``sources``, give no rows; a source listed twice counts once (its larger size holds); sources without any
    reading are all ``missing``.  NULL keys match NULL keys.  Other columns are not read.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    grid = (
        sources.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(size).cast("bigint").alias("_n"))
        .groupBy(*names)
        .agg(F.max("_n").alias("_n"))
        .where("_n > 0")
    )
    last = F.floor((F.col("_n") - 1) / block)
    grid = grid.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(*names, "_blk")
    frames = grid.withColumn("_k", F.explode(F.sequence(F.col("_blk") * block, F.least((F.col("_blk") + 1) * block, F.col("_n")) - 1)))
    at = F.col(position).cast("double")
    numbers = [F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)]
    cols = [f"_v{i}" for i in range(len(values))]
    nearest = F.rint(at).cast("bigint")
    seen = readings.where(at.isNotNull() & ~F.isnan(at)).select(
        *[F.col(k).alias(n) for n, k in zip(names, keys)],
        nearest.alias("_k"),
        F.struct(F.abs(at - nearest).alias("d"), at.alias("_at"), *numbers).alias("_r"),
    )
    seen = seen.groupBy(*names, "_k").agg(F.min("_r").alias("_r"))  # partial: at most one row a frame is shuffled
    context = F.array_distinct(F.array(*[F.floor((F.col("_k") + s * gap_limit) / block) for s in (-1, 0, 1)]))
    seen = seen.withColumn("_blk", F.explode(context))
    both = frames.select(*names, "_blk", "_k", F.lit(True).alias("_grid"), F.lit(None).cast(seen.schema["_r"].dataType).alias("_r")).unionByName(
        seen.select(*names, "_blk", "_k", F.lit(False).alias("_grid"), "_r")
    )
    by = W.partitionBy(*names, "_blk")
    ahead, back = by.orderBy("_k", "_grid"), by.orderBy(F.desc("_k"), "_grid")
    both = both.withColumns({
        "_p": F.last("_r", ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, 0)),
        "_pk": F.last(F.when(~F.col("_grid"), F.col("_k")), ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, 0)),
        "_q": F.last("_r", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0)),
    })
    observed = F.coalesce(F.col("_pk") == F.col("_k"), F.lit(False))
    width = F.col("_q._at") - F.col("_p._at")
    near = F.coalesce(width <= gap_limit, F.lit(False))
    weight = F.when(width > 0, (F.col("_k") - F.col("_p._at")) / width).otherwise(0.0)
    return both.where("_grid").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        F.col("_k").cast("int").alias("k"),
        F.when(observed, "observed").when(near, "interpolated").otherwise("missing").alias("status"),
        *[
            F.when(observed, F.col(f"_p.{c}")).when(near, F.col(f"_p.{c}") + weight * (F.col(f"_q.{c}") - F.col(f"_p.{c}"))).alias(v)
            for v, c in zip(values, cols)
        ],
        F.when(observed | near, F.col("_p._at")).alias("before"),
        F.when(observed, F.col("_p._at")).when(near, F.col("_q._at")).alias("after"),
    )
