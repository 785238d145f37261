"""Files that other programs read: identity events, identity files, player summaries, label sets, detections, courts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.court import KEYPOINTS
from pitchweave.sources.documents import clock_text


def event_lines(events: DataFrame, *, start: str | None = None) -> DataFrame:
    """(time, id, kind, x, y) of identity events (t, player_id, kind, x, y), the time as m:ss.s of the recording."""
    t = F.col("t") + (F.col(start) if start else F.lit(0.0))
    return events.orderBy("t", "player_id", "kind").select(clock_text(t).alias("time"), F.col("player_id").alias("id"), "kind", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def write_events(events: DataFrame, path: str, *, start: str | None = None) -> None:
    """Events as CSV with a header, in order of time."""
    event_lines(events, start=start).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def identity_documents(points: DataFrame, *, track: str = "track_id") -> DataFrame:
    """(match_id, document): per match, a list of tracks {frame: [x, y, [[camera, box], ...]]}, positions to the millimetre.

    The inverse of ``read_identity_file``; a document holds its match's whole tracks, as an export does.
    """
    place = F.concat(F.lit("["), F.format_string("%.3f", "x"), F.lit(","), F.format_string("%.3f", "y"), F.lit(","), F.to_json(F.transform(F.coalesce("boxes", F.array().cast("array<struct<camera:string,box_id:bigint>>")), lambda b: F.array(b["camera"], b["box_id"].cast("string")))), F.lit("]"))
    rows = points.where("k is not null and x is not null and y is not null").groupBy("match_id", track, "k").agg(F.min(place).alias("p"))
    entry = F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('":'), F.col("p"))
    one = rows.groupBy("match_id", track).agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("es"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("es", lambda e: e["e"]), ","), F.lit("}"))
    whole = one.select("match_id", track, text.alias("t")).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(track, "t"))).alias("ts"))
    return whole.select("match_id", F.concat(F.lit("["), F.array_join(F.transform("ts", lambda x: x["t"]), ","), F.lit("]")).alias("document"))


def summary_documents(metrics: DataFrame) -> DataFrame:
    """(match_id, document): one JSON document per match with each player's metrics, by player."""
    fields = [c for c in metrics.columns if c != "match_id"]
    rows = metrics.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("players"))
    return rows.select("match_id", F.to_json(F.struct("players"), {"ignoreNullFields": "false"}).alias("document"))


def report_lines(report: DataFrame, *, camera: str = "camera", warnings: str = "warnings") -> DataFrame:
    """(value): a line for each camera with what is wrong with it, or ``ok``."""
    text = F.when(F.length(F.coalesce(warnings, F.lit(""))) > 0, F.col(warnings)).otherwise("ok")
    return report.orderBy("match_id", camera).select(F.concat_ws("\t", "match_id", camera, text).alias("value"))


def ball_documents(points: DataFrame, *, video: str = "video") -> DataFrame:
    """(video, document): the ball's positions as a JSON list in order of frames."""
    rows = points.groupBy(video).agg(F.array_sort(F.collect_list(F.struct("frame", "u", "v", "conf", "source"))).alias("p"))
    return rows.select(video, F.to_json("p", {"ignoreNullFields": "false"}).alias("document"))


def dataset_description(names: list[str], *, root: str, train: str = "images/train", val: str = "images/val") -> str:
    """Text of a data set description for detector training."""
    return "\n".join([f"path: {root}", f"train: {train}", f"val: {val}", "names:", *[f"  {i}: {n}" for i, n in enumerate(names)], ""])


def write_detections(detections: DataFrame, path: str) -> None:
    """Detections as Parquet, their vectors in the row, so that no file beside them can be out of date."""
    detections.write.mode("overwrite").partitionBy("match_id").parquet(path)


def merged_labels(sets: dict[str, DataFrame], *, keep: dict[str, list[int]], split: Column | None = None) -> DataFrame:
    """(source, image, cls, x1, y1, x2, y2, part): label sets in one, of each only the classes named, which become class 0.

    ``split`` says which part an image belongs to; by default one image in five, by hash, is for validation.
    """
    parts = [df.where(F.col("cls").isin(keep[name])).select(F.lit(name).alias("source"), "image", F.lit(0).alias("cls"), "x1", "y1", "x2", "y2") for name, df in sorted(sets.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("part", split if split is not None else F.when(F.pmod(F.xxhash64("image"), F.lit(5)) == 0, "val").otherwise("train"))


def court_document(length: float, width: float) -> dict:
    """What a client needs to draw a court: size, named points, spots, goals and the lines as lists of points."""
    points = {}
    for line in KEYPOINTS.strip().splitlines():
        name, *rest = line.split()
        a, dx, b, dy = map(float, rest)
        points[name] = [round(a * length + dx, 3), round(b * width + dy, 3)]

    def arc(cx: float, cy: float, r: float, start: float, stop: float, n: int = 24) -> list[list[float]]:
        angles = [math.radians(start + (stop - start) * i / n) for i in range(n + 1)]
        return [[round(cx + r * math.cos(t), 3), round(cy + r * math.sin(t), 3)] for t in angles]

    mid = width / 2
    lines = [[[0, 0], [length, 0], [length, width], [0, width], [0, 0]], [[length / 2, 0], [length / 2, width]], arc(length / 2, mid, 3.0, 0, 360)]
    for x, inner in ((0.0, 0.0), (length, 180.0)):
        top, bottom = points["area_goalline_top_left"][1] - 6.0, points["area_goalline_bottom_left"][1] + 6.0
        turn = 1 if inner == 0 else -1
        lines.append(arc(x, top, 6.0, 90, 90 - turn * 90) + arc(x, bottom, 6.0, inner, -90 if turn == 1 else 270))
    spots = [points[n] for n in ("centre", "penalty_left", "second_penalty_left", "penalty_right", "second_penalty_right")]
    goals = [{"x": x, "y0": mid - 1.5, "y1": mid + 1.5, "depth": d} for x, d in ((0.0, -1.0), (length, 1.0))]
    return {"length": length, "width": width, "markings": lines, "spots": spots, "goals": goals, "keypoints": points}
