"""Columnar caches of detections, image folders, identity files, and what belongs to a row but lies in another file."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchweave.sources.documents import read_arrays, read_detections

CACHE = "file string, i bigint, fid int, t double, x1 double, y1 double, x2 double, y2 double, conf double, reid array<float>, color array<double>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """One row per box of .npz caches (arrays fid, t, xyxy, conf and, where they are, reid as float16 and color as bytes).

    ``i`` is the box's place in its file; colours become 0 .. 1.  A file is read by one task, in pieces of 4 096 boxes.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                whole = {k: z[k] for k in ("fid", "t", "xyxy", "conf")}
                extra = {k: z[k].reshape(len(z["t"]), -1) if k in z and z[k].size else None for k in ("reid", "color")}
                for lo in range(0, len(whole["t"]), 4096):
                    part = slice(lo, lo + 4096)
                    n = len(whole["t"][part])
                    box = whole["xyxy"][part].astype(float)
                    yield pd.DataFrame(
                        {"file": [file] * n, "i": np.arange(lo, lo + n), "fid": whole["fid"][part].astype(np.int32), "t": whole["t"][part].astype(float)}
                        | {c: box[:, j] for j, c in enumerate(("x1", "y1", "x2", "y2"))}
                        | {"conf": whole["conf"][part].astype(float), "reid": [None] * n if extra["reid"] is None else list(extra["reid"][part].astype(np.float32)), "color": [None] * n if extra["color"] is None else list(extra["color"][part] / 255.0)}
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, CACHE)


def read_cache_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """The boxes of all cameras that a folder's meta.json names, with camera and offset_s, and the meta data.

    meta.json has ``videos`` by camera, ``offsets`` in seconds by camera, ``start`` and ``rate``; the boxes of a camera are in
    <camera>.npz.  Cameras without an offset have offset 0.
    """
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/meta.json", wholetext=True).collect()))
    cameras = sorted(meta["videos"])
    offsets = F.create_map(*[F.lit(v) for c in cameras for v in (c, float(meta.get("offsets", {}).get(c, 0.0)))])
    rows = read_cache(spark, [f"{folder}/{c}.npz" for c in cameras])
    camera = F.regexp_extract("file", r"([^/]+)\.npz$", 1)
    return rows.withColumn("camera", camera).withColumn("offset_s", F.try_element_at(offsets, "camera")).drop("file"), meta


def time_slice(boxes: DataFrame, *, start: float, duration: float, time: str = "t", offset: str = "offset_s") -> DataFrame:
    """Boxes whose reference time lies in a stretch; the bounds are on the camera's time, so they reach a Parquet scan where
    the offset is constant."""
    return boxes.where(F.col(time).between(F.lit(start) - F.coalesce(F.col(offset), F.lit(0.0)), F.lit(start + duration) - F.coalesce(F.col(offset), F.lit(0.0))))


def detections_with_vectors(spark: SparkSession, documents: str, arrays: str) -> DataFrame:
    """Detections of JSON documents with the row of the array file of the same name (x.json and x.reid.npy).

    A row of NaN is no vector.  An array file whose number of rows is not that of its document is left out as a whole.
    """
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"(\.reid)?\.(json|npy)$", "")
    rows = read_detections(spark, documents).withColumn("stem_", stem("file"))
    values = read_arrays(spark, arrays).select(stem("file").alias("stem_"), F.col("i").cast("int").alias("i"), F.col("values").alias("reid"))
    counts = rows.groupBy("stem_").agg(F.count("*").alias("n")).join(values.groupBy("stem_").agg(F.count("*").alias("m")), "stem_").where("n = m").select("stem_")
    return rows.join(values.join(counts, "stem_"), ["stem_", "i"], "left").drop("stem_")


def list_images(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(path, length): the images of a folder by their endings, in whatever case, sorted by path; contents are not read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length")
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds)).orderBy("path")


def read_identity_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, k, x, y, boxes): track files that list, for each track, {frame: [x, y, [[camera, box], ...]]}."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    tracks = texts.select("file", F.posexplode(F.from_json("value", "array<map<string, string>>")).alias("track", "points"))
    rows = tracks.select("file", "track", F.explode("points").alias("k", "p"))
    parts = F.from_json("p", "array<string>")
    boxes = F.transform(F.from_json(F.get(parts, F.lit(2)), "array<array<string>>"), lambda b: F.struct(b[0].alias("camera"), b[1].cast("bigint").alias("box_id")))
    return rows.select("file", "track", F.col("k").cast("int").alias("k"), F.get(parts, F.lit(0)).cast("double").alias("x"), F.get(parts, F.lit(1)).cast("double").alias("y"), boxes.alias("boxes"))
