"""Teams from the colours of shirts: two clusters a camera, matched between cameras by pairs of boxes of one player."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.kernels import two_means
from pitchweave.functions.vectors import let

#: Boxes of a camera that its clusters are fitted to at most; heights in pixels from which boxes are fitted and labelled;
#: confidence; ratio of the distances to both centres up to which a box gets a label; pairs that matching two cameras needs.
SAMPLE, FIT_PX, LABEL_PX, CONF, TIE, LEAST_PAIRS = 20_000, 40.0, 30.0, 0.4, 0.95, 50


def kit_centres(boxes: DataFrame, *, keys: list[str], vector: str = "upper", sample: int = SAMPLE) -> DataFrame:
    """(keys, c0, c1): the centres of two clusters of each camera's shirt vectors, the first the smaller by its numbers.

    At most about ``sample`` vectors of a camera, drawn by hash, are clustered; cameras with fewer than ten give no row.
    """
    rows = boxes.where(F.col(vector).isNotNull() & (F.col("h") >= FIT_PX) & (F.col("conf") >= CONF)).select(*keys, "box_id", F.col(vector).alias("v"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    drawn = rows.join(size, keys).where(F.pmod(F.xxhash64("box_id"), F.lit(1 << 30)) < F.lit((1 << 30) * float(sample)) / F.col("n_"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < 10:
            return pd.DataFrame({**{k: g[k].iloc[:1].tolist() for k in keys}, "c0": [None], "c1": [None]})
        centres = two_means(np.stack(g.sort_values("box_id")["v"].to_numpy()))[1]
        first, second = sorted(c.tolist() for c in centres)
        return pd.DataFrame({**{k: g[k].iloc[:1].tolist() for k in keys}, "c0": [first], "c1": [second]})

    return drawn.groupBy(*keys).applyInPandas(kernel, f"{fields}, c0 array<double>, c1 array<double>").where("c0 is not null")


def _apart(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) ** 2), F.lit(0.0), lambda s, x: s + x))


def assign_teams(boxes: DataFrame, pairs: DataFrame, *, match: str = "match_id", camera: str = "camera", vector: str = "upper") -> DataFrame:
    """(match, camera, box_id, team): ``A`` for the team with more boxes, ``B`` for the other, ``''`` where unclear.

    ``boxes`` has match, camera, box_id, h, conf and a shirt vector; ``pairs`` (match, a, b) are boxes of two cameras that
    show one player.  A box within 5 % of a tie, lower than 30 px, less confident than 0.4 or without a vector gets no
    team.  A camera's clusters take the names of those of the match's first camera that most pairs say they are; cameras with
    fewer than 50 votes, or none with the first one, are matched by whose centres are nearer.
    """
    key = [match, camera]
    centres = kit_centres(boxes, keys=key, vector=vector)
    near = boxes.where((F.col("h") >= LABEL_PX) & (F.col("conf") >= CONF) & F.col(vector).isNotNull()).select(*key, "box_id", F.col(vector).alias("v")).join(centres, key)
    near = near.withColumns({"d0": _apart("v", "c0"), "d1": _apart("v", "c1")})
    cluster = F.when(F.col("d0") < TIE * F.col("d1"), 0).when(F.col("d1") < TIE * F.col("d0"), 1)
    labelled = near.select(*key, "box_id", cluster.alias("cluster")).where("cluster is not null")
    first = centres.groupBy(match).agg(F.min_by(F.struct("c0", "c1", camera), camera).alias("f"))
    side = {c: labelled.select(match, F.col("box_id").alias(c), F.col(camera).alias(f"cam_{c}"), F.col("cluster").alias(f"cl_{c}")) for c in ("a", "b")}
    votes = pairs.select(match, "a", "b").join(side["a"], [match, "a"]).join(side["b"], [match, "b"])
    both = votes.select(match, F.col("cam_a").alias("c"), F.col("cam_b").alias("o"), (F.col("cl_a") != F.col("cl_b")).alias("swap")).unionByName(
        votes.select(match, F.col("cam_b").alias("c"), F.col("cam_a").alias("o"), (F.col("cl_a") != F.col("cl_b")).alias("swap"))
    )
    ref = first.select(match, F.col(f"f.{camera}").alias("o"))
    voted = both.join(ref, [match, "o"]).groupBy(match, F.col("c").alias(camera)).agg(F.count("*").alias("votes"), F.avg(F.col("swap").cast("double")).alias("share"))
    rows = centres.join(first, match).join(voted, key, "left")
    straight = _apart("c0", "f.c0") + _apart("c1", "f.c1")
    crossed = _apart("c0", "f.c1") + _apart("c1", "f.c0")
    swap = F.when(F.col("votes") >= LEAST_PAIRS, F.col("share") > 0.5).otherwise(crossed < straight)
    named = rows.select(*key, F.when(F.col(camera) == F.col(f"f.{camera}"), F.lit(False)).otherwise(swap).alias("swap"))
    out = labelled.join(named, key).select(*key, "box_id", F.when(F.col("swap"), 1 - F.col("cluster")).otherwise(F.col("cluster")).alias("kit"))
    larger = out.groupBy(match).agg((F.count(F.when(F.col("kit") == 1, 1)) > F.count(F.when(F.col("kit") == 0, 1))).cast("int").alias("larger"))
    known = out.join(larger, match).select("box_id", F.when(F.col("kit") == F.col("larger"), "A").otherwise("B").alias("team"))
    return boxes.select(*key, "box_id").join(known, "box_id", "left").select(*key, "box_id", F.coalesce("team", F.lit("")).alias("team"))


def upper_half(histogram: str, half: int = 15) -> Column:
    """Square roots of a histogram's upper half scaled to a sum of 1; NULL where it has no counts."""
    upper = F.slice(F.col(histogram), 1, half)
    total = F.aggregate(upper, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(histogram) == 2 * half) & (total > 0), let(total, lambda t: F.transform(upper, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / t))))
