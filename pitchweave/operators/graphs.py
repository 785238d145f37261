"""Connected components and chains by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchweave.session import cut, release


def components(nodes: DataFrame, links: DataFrame, *, keys: list[str], node: str, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(keys, node, component): the smallest node each node is linked with, directly or over others.

    Labels spread over links and then jump to their label's label, so the rounds grow with the logarithm of the longest
    chain; each is one join and one aggregation, cut into the checkpoint folder.
    """
    both = links.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(*keys, F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = cut(both)
    labels = cut(nodes.select(*keys, F.col(node).alias("u"), F.col(node).alias("label")).distinct())
    for _ in range(rounds):
        near = both.join(labels.select(*keys, F.col("u").alias("v"), "label"), [*keys, "v"]).select(*keys, "u", "label")
        fresh = labels.select(*keys, "u", "label").unionByName(near).groupBy(*keys, "u").agg(F.min("label").alias("label"))
        up = fresh.select(*keys, F.col("u").alias("label"), F.col("label").alias("then"))
        jumped = fresh.join(up, [*keys, "label"], "left").select(*keys, "u", F.least("label", F.coalesce("then", "label")).alias("label"))
        moved = cut(jumped.join(labels.withColumnRenamed("label", "old"), [*keys, "u"]))
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.drop("old")
        release(labels.sparkSession)
        if not changed:
            break
    return labels.select(*keys, F.col("u").alias(node), F.col("label").alias("component"))
