"""Missing values filled from the same entity's records: interpolation for numbers, carrying for categories.

Everything is one exchange by (entity, block of frames).  A block carries ``gap_limit + 1`` frames of its neighbours,
which is all that bridging a gap within the limit can need, so an entity that holds a third of all rows is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.session import cut


def stand_ins(df: DataFrame, values: list[str], *, entity: list[str], source: str | None = None, share: float = 1e-3, own_share: float = 5e-3, least: int = 8) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Value combinations written in place of a missing one; with ``source`` also those that only one source uses.

    True measurements spread over many values, so even the favourite spot of a resting entity stays far below one in a
    thousand rows.  A combination must be in at least ``least`` rows and two entities, and in ``share`` of all rows, or in
    ``own_share`` of its source's; so a stand-in that only one source uses is found however large the table grows.  Counts are
    over all rows.  The first has at most 1 / share rows, which is the proof that it may be broadcast.
    """
    present = " and ".join(f"`{v}` is not null and not isnan(`{v}`)" for v in values)
    whole = df.where(present).select(*([source] if source else []), *values, F.xxhash64(*entity).alias("_pw_e"))
    several = (F.col("_pw_n") >= least) & (F.col("_pw_a") != F.col("_pw_b"))

    def counts(by: list[str]) -> DataFrame:  # numbers only, so that groups are hashed and not sorted
        return whole.groupBy(*by).agg(F.count("*").alias("_pw_n"), F.min("_pw_e").alias("_pw_a"), F.max("_pw_e").alias("_pw_b")).where(several)

    total = whole.agg(F.count("*").alias("_pw_total")).scalar()
    everywhere = counts(values).where(F.col("_pw_n") >= share * total).select(*values)
    if not source:
        return everywhere
    size = whole.groupBy(source).agg(F.count("*").alias("_pw_size"))
    own = counts([source, *values]).join(size, source).where(F.col("_pw_n") >= own_share * F.col("_pw_size")).select(source, *values)
    return everywhere, cut(own)


#: Stand-ins of single sources that are broadcast at most; more are joined by shuffling.
BROADCAST = 10_000


def without_stand_ins(df: DataFrame, values: list[str], found: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """``df`` with the stand-in combinations set to NULL."""
    everywhere, own = found if isinstance(found, tuple) else (found, None)
    hit = F.lit(False)
    out = df
    for n, (marks, by) in enumerate(((everywhere, []), (own, [] if own is None else own.columns[:1]))):
        if marks is None:
            continue
        if by and not (size := marks.limit(BROADCAST + 1).count()):
            continue
        names = {c: f"_pw_{n}_{i}" for i, c in enumerate([*by, *values])}
        marks = marks.select(*[F.col(c).alias(a) for c, a in names.items()], F.lit(True).alias(f"_pw_hit{n}"))
        marks = F.broadcast(marks) if not by or size <= BROADCAST else marks
        out = out.join(marks, [F.col(c) == F.col(a) for c, a in names.items()], "left")
        hit = hit | F.coalesce(f"_pw_hit{n}", F.lit(False))
    return out.select(*[(F.when(~hit, F.col(c)).alias(c) if c in values else F.col(c)) for c in df.columns])


def fill_numeric(df: DataFrame, *, keys: list[str], order: str, values: list[str], gap_limit: int = 20, block: int = 2048) -> DataFrame:
    """Every frame of every entity, with missing value vectors interpolated between the complete frames around them.

    Result: keys, ``order`` (BIGINT), per value column ``v`` the filled value, ``v_filled`` (BOOLEAN) and ``v_method``
    (``observed``, ``linear`` or ``none``), then ``complete`` (all values observed), ``bridged`` (an incomplete frame in
    a gap that was filled), ``had_row``, ``gap`` (incomplete frames in its gap) and ``distance`` (frames to the nearer
    complete neighbour).

    A frame without a row counts like a row without all values.  Gaps of more than ``gap_limit`` frames, and those at
    an entity's ends, stay as they are: their rows come out with method ``none``, and no rows are made up for them.  A
    value observed on an incomplete frame is kept.  NaN and infinity count as NULL.  Of several rows at one frame the complete one
    with the smallest values holds, so repeated rows are one record.  Rows with NULL ``order`` are left out; NULL keys
    are an entity of their own; other columns are not read.  An empty table gives an empty result.
    """
    number = F.col(order).cast("bigint")
    halo = gap_limit + 1
    clean = [F.when(F.abs(F.col(v).cast("double")) < float("inf"), F.col(v).cast("double")) for v in values]
    rows = df.where(F.col(order).isNotNull()).select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        number.alias("_k"),
        *[c.alias(f"_v{i}") for i, c in enumerate(clean)],
        F.explode(F.array_distinct(F.array(F.floor((number - halo) / block), F.floor(number / block), F.floor((number + halo) / block)))).alias("_blk"),
    )
    names, cols = [f"_key{i}" for i in range(len(keys))], [f"_v{i}" for i in range(len(values))]
    complete = " and ".join(f"{c} is not null" for c in cols)
    rows = rows.withColumn("_full", F.expr(complete))
    by = W.partitionBy(*names, "_blk")
    ahead = by.orderBy("_k", F.desc("_full"), *[F.col(c).asc_nulls_last() for c in cols])
    rows = rows.withColumn("_last", F.lag("_k").over(ahead)).where("_last is null or _last <> _k").drop("_last")
    point = F.when(F.col("_full"), F.struct("_k", *cols))
    rows = rows.withColumns({
        "_before": F.last(point, ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, -1)),
        "_until": F.lead("_k").over(ahead),
    })
    back = by.orderBy(F.desc("_k"))
    rows = rows.withColumn("_after", F.last(point, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    # a row, and the frames without a row between it and the next row, where these lie in a gap that can be bridged
    before = F.when(F.col("_full"), F.struct("_k", *cols)).otherwise(F.col("_before"))
    hole = F.when(
        (F.col("_until") - F.col("_k") > 1) & (F.col("_after._k") - before["_k"] - 1 <= gap_limit),
        F.transform(F.sequence(F.col("_k") + 1, F.col("_until") - 1), lambda f: F.struct(f.alias("f"), F.lit(False).alias("had"))),
    )
    itself = F.array(F.struct(F.col("_k").alias("f"), F.lit(True).alias("had")))
    out = rows.withColumn("_carry", before).withColumn("_at", F.explode(F.concat(itself, F.coalesce(hole, F.array().cast("array<struct<f:bigint,had:boolean>>")))))
    had, f = F.col("_at.had"), F.col("_at.f")
    left = F.when(had, F.col("_before")).otherwise(F.col("_carry"))
    right = F.col("_after")
    out = out.where(F.floor(f / block) == F.col("_blk")).withColumns({"_left": left, "_right": right, "_own": had & F.col("_full")})
    gap = F.when(~F.col("_own"), F.col("_right._k") - F.col("_left._k") - 1)
    out = out.withColumns({"_gap": gap, "_bridged": F.coalesce(gap <= gap_limit, F.lit(False))})
    weight = (f - F.col("_left._k")) / (F.col("_right._k") - F.col("_left._k"))
    result: list[Column] = [*[F.col(n).alias(k) for n, k in zip(names, keys)], f.alias(order)]
    for v, c in zip(values, cols):
        seen = F.when(had, F.col(c))
        line = F.col(f"_left.{c}") + weight * (F.col(f"_right.{c}") - F.col(f"_left.{c}"))
        filled = F.col("_bridged") & seen.isNull()
        result += [
            F.when(filled, line).otherwise(seen).alias(v),
            filled.alias(f"{v}_filled"),
            F.when(filled, "linear").when(seen.isNotNull(), "observed").otherwise("none").alias(f"{v}_method"),
        ]
    nearer = F.least(f - F.col("_left._k"), F.col("_right._k") - f)
    return out.select(*result, F.col("_own").alias("complete"), F.col("_bridged").alias("bridged"), had.alias("had_row"), F.when(F.col("_bridged"), F.col("_gap")).alias("gap"), F.when(F.col("_bridged"), nearer).alias("distance"))


def fill_category(df: DataFrame, *, keys: list[str], order: str, value: str, known: list[str] | None = None, gap_limit: int | None = None, block: int = 2048) -> DataFrame:
    """One row per entity and frame with a row: its category, carried from the nearest row that has one where missing.

    Result: keys, ``order`` (BIGINT), ``value``, ``<value>_filled``, ``<value>_method`` (``observed``, ``carry_forward``,
    ``carry_backward`` or ``none``) and ``<value>_distance`` in frames.  At equal distance the earlier row is carried.
    Values outside ``known`` (all non-NULL values, if it is None) count as missing.  ``gap_limit`` None carries over any
    distance: what crosses blocks comes from a summary of one row per block.  Of several rows at one frame the smallest
    known value holds; rows with NULL ``order`` are left out; an entity without any known value keeps NULL.
    """
    number = F.col(order).cast("bigint")
    text = F.when(F.col(value).isin(known), F.col(value)) if known is not None else F.col(value)
    rows = (
        df.where(F.col(order).isNotNull())
        .select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], number.alias("_k"), text.alias("_c"))
        .groupBy(*[f"_key{i}" for i in range(len(keys))], "_k")
        .agg(F.min("_c").alias("_c"))
        .withColumn("_blk", F.floor(F.col("_k") / block))
    )
    names = [f"_key{i}" for i in range(len(keys))]
    point = F.when(F.col("_c").isNotNull(), F.struct("_k", "_c"))
    ends = rows.groupBy(*names, "_blk").agg(F.min(point).alias("_first"), F.max(point).alias("_end"))
    line = W.partitionBy(*names).orderBy("_blk")
    ends = ends.select(
        *names, "_blk",
        F.last("_end", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(W.partitionBy(*names).orderBy(F.desc("_blk")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"),
    )
    by = W.partitionBy(*names, "_blk")
    rows = rows.withColumns({
        "_before": F.last(point, ignorenulls=True).over(by.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)),
        "_after": F.last(point, ignorenulls=True).over(by.orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, -1)),
    })
    same = [F.col(f"r.{n}").eqNullSafe(F.col(f"e.{n}")) for n in [*names, "_blk"]]
    rows = rows.alias("r").join(ends.alias("e"), same, "left").select("r.*", F.coalesce("r._before", "e._earlier").alias("_p"), F.coalesce("r._after", "e._later").alias("_n"))
    back, on = F.col("_k") - F.col("_p._k"), F.col("_n._k") - F.col("_k")
    forward = F.coalesce(back <= F.coalesce(on, back), F.lit(False))
    distance = F.when(forward, back).otherwise(on)
    usable = F.col("_c").isNull() & distance.isNotNull() & (F.lit(True) if gap_limit is None else distance <= gap_limit)
    return rows.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        F.col("_k").alias(order),
        F.when(usable, F.when(forward, F.col("_p._c")).otherwise(F.col("_n._c"))).otherwise(F.col("_c")).alias(value),
        usable.alias(f"{value}_filled"),
        F.when(F.col("_c").isNotNull(), "observed").when(~usable, "none").when(forward, "carry_forward").otherwise("carry_backward").alias(f"{value}_method"),
        F.when(usable, distance).alias(f"{value}_distance"),
    )
