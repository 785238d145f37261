"""Queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchweave.llm.bpe import encode_corpus
from pitchweave.llm.knn import Neighbours, most_similar
from pitchweave.llm.leak import find_leaks
from pitchweave.llm.mcl import clusters, half_roots
from pitchweave.llm.mojibake import find_garbled, repair_encoding
from pitchweave.llm.nearest_time import nearest_in_time
from pitchweave.llm.sql import SQL  # noqa: F401
from pitchweave.sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["match_id", "camera"]
    boxes = table(spark, sf, "boxes").groupBy(*keys, "fid").agg(F.max("t").alias("t"))
    detections = table(spark, sf, "detections").groupBy(*keys, "frame").agg(F.max("t").alias("t"))
    pairs = nearest_in_time(boxes, detections, keys=keys, left_time="t", right_time="t", left_values=["fid"], right_values=["frame"], tolerance=0.05)
    return pairs.select(*keys, "fid", "frame")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for src in ("boxes", "detections"):
        top = most_similar(table(spark, sf, src), id="box_id", vector="reid", dim=512, k=3)
        parts.append(top.select(F.lit(src).alias("src"), F.least("id", "other").alias("box_id_a"), F.greatest("id", "other").alias("box_id_b")).distinct())
    return parts[0].unionByName(parts[1])


def p5_search(spark: SparkSession, sf: str) -> DataFrame:
    """The three boxes most like each detection whose id is divisible by 100, by greedy search of the boxes' graph."""
    graph = Neighbours(table(spark, sf, "boxes"), id="box_id", vector="reid", dim=512)
    found = graph.search(table(spark, sf, "detections").where(F.col("box_id") % 100 == 0), id="box_id", vector="reid", k=3)
    return found.select(F.col("id").alias("detection_id"), F.col("other").alias("box_id"), "sim")


def kit_clusters(spark: SparkSession, sf: str, *, typical: bool = False) -> DataFrame:
    boxes, tracklets = table(spark, sf, "boxes"), table(spark, sf, "tracklets")
    # a tracklet's histogram is the sum of those it has
    whole = F.filter("feats", lambda h: F.size(h) == 30)
    feats = F.aggregate(whole, F.array_repeat(F.lit(0.0), 30), lambda a, h: F.zip_with(a, h, lambda x, y: x + F.coalesce(y, F.lit(0.0))))
    return clusters(
        {
            "boxes": (boxes.where(F.size("color") == 30), "box_id", half_roots(F.col("color"), 15)),
            "tracklets": (tracklets.where(F.size("feats") > 0), "track_id", half_roots(feats, 15)),
        },
        dim=30,
        typical=typical,
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return kit_clusters(spark, sf).select("src", "id", "cluster_id")


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Size and three most typical members of each group of p6_found."""
    rank = F.row_number().over(W.partitionBy("src", "cluster_id").orderBy(F.desc("strength"), "id"))
    top = kit_clusters(spark, sf, typical=True).withColumn("r", rank).where(F.col("r") <= 3)
    return top.groupBy("src", "cluster_id").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("typical"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The pages and items of p8_found with the lines to remove."""
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_spans(spark, sf).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_garbled(table(spark, sf, "documents"))


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repair_encoding(table(spark, sf, "documents")).where("garbled").select("doc_id", "repaired", "whole")


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_search": p5_search, "p6_found": p6_found, "p6_groups": p6_groups, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans, "p9_found": p9_found, "p9_repaired": p9_repaired}
