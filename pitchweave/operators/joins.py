"""As-of, band, mutual-nearest and greedy one-to-one joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_versions(facts: DataFrame, versions: DataFrame, *, keys: list[str], time: str, valid_from: str) -> DataFrame:
    """Each fact with the last version valid at its time, or the first version where none is yet.

    Versions are few for each key, and become intervals; the first one's reaches back without end.  Facts without any
    version are dropped; a version with a NULL start starts first.
    """
    line = W.partitionBy(*keys).orderBy(F.col(valid_from).asc_nulls_first())
    spans = versions.withColumns({"_lo": F.when(F.row_number().over(line) == 1, float("-inf")).otherwise(F.col(valid_from)), "_hi": F.coalesce(F.lead(valid_from).over(line), F.lit(float("inf")))})
    on = [F.col(f"f.{k}") == F.col(f"v.{k}") for k in keys] + [F.col(f"f.{time}") >= F.col("v._lo"), F.col(f"f.{time}") < F.col("v._hi")]
    rest = [F.col(f"v.{c}") for c in versions.columns if c not in keys]
    return facts.alias("f").join(spans.alias("v"), on).select("f.*", *rest)


def band_join(left: DataFrame, right: DataFrame, *, keys: list[str], left_at: str, right_at: str, least: int, most: int) -> DataFrame:
    """Pairs with ``least <= right_at - left_at <= most``, of rows with equal keys; columns keep their names, which must differ.

    The band is cut into buckets as wide as itself, so a pair meets in one of two buckets and the join is an equi-join.
    """
    width = max(most - least + 1, 1)
    low = F.floor((F.col(left_at) + least) / width)
    spread = left.withColumn("_bucket", F.explode(F.array_distinct(F.array(low, F.floor((F.col(left_at) + most) / width)))))
    names = {k: f"_r_{k}" for k in keys}
    other = right.withColumnsRenamed(names).withColumn("_rb", F.floor(F.col(right_at) / width))
    on = [F.col(k) == F.col(names[k]) for k in keys] + [F.col("_bucket") == F.col("_rb"), (F.col(right_at) - F.col(left_at)).between(least, most)]
    return spread.join(other, on).drop("_bucket", "_rb", *names.values())


def overlapping(df: DataFrame, *, keys: list[str], id: str, start: str, end: str, width: int) -> DataFrame:
    """(keys, a, b, shared): pairs of intervals of a key that overlap, a < b, and by how many positions.

    Each interval goes to every bucket of ``width`` it touches; a pair is taken in the bucket of its overlap's start.
    """
    rows = df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    a, b = rows.alias("a"), rows.alias("b")
    first, last = F.greatest(f"a.{start}", f"b.{start}"), F.least(f"a.{end}", f"b.{end}")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_b"]] + [F.col(f"a.{id}") < F.col(f"b.{id}"), last >= first, F.floor(first / width) == F.col("a._b")]
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{id}").alias("a"), F.col(f"b.{id}").alias("b"), (last - first + 1).alias("shared"))


def mutual_nearest(pairs: DataFrame, *, group: list[str], a: str, b: str, distance: str) -> DataFrame:
    """Pairs in which each is the other's nearest within the group; ties go to the smaller ids."""
    mine = F.row_number().over(W.partitionBy(*group, a).orderBy(distance, b))
    yours = F.row_number().over(W.partitionBy(*group, b).orderBy(distance, a))
    return pairs.withColumns({"_m": mine, "_y": yours}).where("_m = 1 and _y = 1").drop("_m", "_y")


def with_margin(pairs: DataFrame, *, group: list[str], a: str, b: str, distance: str, margin: float) -> DataFrame:
    """Mutual-nearest pairs whose runners-up on both sides are at least ``margin`` farther."""
    wa, wb = W.partitionBy(*group, a).orderBy(distance, b), W.partitionBy(*group, b).orderBy(distance, a)
    ranked = pairs.withColumns({"_m": F.row_number().over(wa), "_y": F.row_number().over(wb), "_ma": F.lead(distance).over(wa), "_yb": F.lead(distance).over(wb)})
    clear = [F.coalesce(F.col(c) - F.col(distance) >= margin, F.lit(True)) for c in ("_ma", "_yb")]
    return ranked.where((F.col("_m") == 1) & (F.col("_y") == 1) & clear[0] & clear[1]).drop("_m", "_y", "_ma", "_yb")


def frame_pairs(boxes: DataFrame, *, gate: Column | float) -> DataFrame:
    """Boxes of two cameras of a match on the same grid frame within the gate, teams not contradicting.

    ``boxes`` has match_id, k, camera, box_id, x, y, sigma, team; a is the box of the smaller camera name.
    """
    a, b = boxes.alias("a"), boxes.alias("b")
    d = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    team = F.coalesce(~(F.col("a.team").isin("A", "B") & F.col("b.team").isin("A", "B") & (F.col("a.team") != F.col("b.team"))), F.lit(True))
    limit = F.greatest(F.lit(gate) if isinstance(gate, float) else gate, 3 * F.sqrt(F.col("a.sigma") ** 2 + F.col("b.sigma") ** 2))
    on = [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k"), F.col("a.camera") < F.col("b.camera"), d <= limit, team]
    return a.join(b, on).select("a.match_id", "a.k", F.col("a.camera").alias("camera_a"), F.col("b.camera").alias("camera_b"), F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), d.alias("d"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("a.sigma").alias("asig"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("b.sigma").alias("bsig"))
