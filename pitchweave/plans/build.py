"""From boxes to tracks: calibrations, aligned cameras, teams, tracklets, identities, and the positions of each identity."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchweave.functions.court import court_keypoints, KEYPOINTS
from pitchweave.operators.alignment import apply_fields, fit_fields
from pitchweave.operators.appearance import look_changes, look_distance, look_groups, track_looks
from pitchweave.operators.calibration import calibrated, fit_calibrations, framing, project_by
from pitchweave.operators.graphs import components
from pitchweave.operators.identity import camera_tracklets, identities, paired_views
from pitchweave.operators.joins import mutual_nearest
from pitchweave.operators.smoothing import smooth_tracks
from pitchweave.operators.suppression import one_frame_each, stitch_tracks, suppress_overlaps
from pitchweave.operators.teams import assign_teams, upper_half
from pitchweave.plans.audits import fused_points, image_sizes
from pitchweave.plans.cameras import boxes, grid_boxes, mutual_offsets, _pairs, _track_boxes
from pitchweave.plans.cleaning import box_frames
from pitchweave.plans.tracks import relink_candidates, spans, TRACK, track_ends
from pitchweave.session import cut
from pitchweave.sources.tables import table

CAMERA = ["match_id", "camera"]


def calibrations(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).select(*CAMERA, F.col("foot_u").alias("u"), F.col("foot_v").alias("v"), F.col("x_raw").alias("x"), F.col("y_raw").alias("y"))
    return fit_calibrations(rows, keys=CAMERA)


def camera_calibrations(spark: SparkSession, sf: str) -> DataFrame:
    """Homography of each camera, fitted to its boxes' foot points and raw positions."""
    return calibrations(spark, sf).select(*CAMERA, F.transform("h", lambda x: F.round(x, 9)).alias("h"), "used", F.round("rms_m", 6).alias("rms_m"))


def calibrated_points(spark: SparkSession, sf: str) -> DataFrame:
    """Detections on the pitch by the calibration of their camera; cameras without one are left out."""
    rows = table(spark, sf, "detections").select(*CAMERA, "box_id", "u", "v").where("u is not null and v is not null").distinct()
    rows = calibrated(rows, calibrations(spark, sf), keys=CAMERA, missing="skip")
    x, y = project_by(F.col("h"), F.col("u"), F.col("v"))
    return rows.select(*CAMERA, "box_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def camera_framing(spark: SparkSession, sf: str) -> DataFrame:
    """How much of its court each camera has in its image, and in which direction the rest lies."""
    rows = calibrations(spark, sf).join(image_sizes(spark, sf), CAMERA)
    courts = table(spark, sf, "futsal_matches").dropDuplicates(["match_id"])
    out = framing(rows, courts, keys=CAMERA)
    return out.select(*CAMERA, "cells", "seen", "left", "right", "above", "below", F.round("mpp", 6).alias("mpp"))


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    court = table(spark, sf, "futsal_matches").select("match_id", F.col("court_length").alias("length"), F.col("court_width").alias("width"))
    rows = mutual_offsets(spark, sf).select("match_id", F.col("rax").alias("ax"), F.col("ray").alias("ay"), F.col("rbx").alias("bx"), F.col("rby").alias("by"))
    return fit_fields(rows.join(court, "match_id"), keys=["match_id"])


def camera_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of each match's cameras, and their median distance before and after a smooth field of shifts."""
    return _fields(spark, sf).select("match_id", "pairs", F.round("before_m", 6).alias("before_m"), F.round("after_m", 6).alias("after_m"))


def aligned_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes whose raw positions are moved by half their match's field, the first camera one way, the other the other way."""
    court = table(spark, sf, "futsal_matches").select("match_id", "court_length", "court_width")
    first = boxes(spark, sf).groupBy("match_id").agg(F.min("camera").alias("first"))
    rows = boxes(spark, sf).where("x_raw is not null and y_raw is not null").select(*CAMERA, "box_id", "x_raw", "y_raw").join(court, "match_id").join(first, "match_id")
    sign = F.when(F.col("camera") == F.col("first"), 1.0).otherwise(-1.0)
    moved = apply_fields(rows, _fields(spark, sf), keys=["match_id"], sign=sign, x="x_raw", y="y_raw", length="court_length", width="court_width")
    inside = F.col("x_aligned").between(F.lit(-1.0), F.col("court_length") + 1) & F.col("y_aligned").between(F.lit(-1.0), F.col("court_width") + 1)
    return moved.select("box_id", F.round("x_aligned", 4).alias("x"), F.round("y_aligned", 4).alias("y"), inside.alias("in_court"))


def team_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Team of each box with a colour histogram, by the clusters of shirts of its match."""
    colour = table(spark, sf, "boxes").where("size(color) = 30").select(*CAMERA, "box_id", "h", "conf", upper_half("color").alias("upper")).dropDuplicates(["box_id"])
    pairs = mutual_nearest(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", distance="d").select("match_id", "a", "b")
    return assign_teams(colour, pairs)


def _tracklets(spark: SparkSession, sf: str) -> DataFrame:
    """(match_id, camera, piece, box_id, k, x, y, sigma, team, h, conf): boxes on the grid and the tracklet each lies in, named by its smallest box."""
    look = table(spark, sf, "boxes").select("box_id", "reid").dropDuplicates(["box_id"])
    rows = grid_boxes(spark, sf).where("in_court and conf >= 0.3").join(look, "box_id")
    tracks = cut(camera_tracklets(rows))
    name = tracks.groupBy(*CAMERA, "track").agg(F.min("box_id").alias("piece"))
    return tracks.join(name, [*CAMERA, "track"]).select("box_id", "piece").join(rows.select(*CAMERA, "box_id", "k", "x", "y", "sigma", "team", "h", "conf"), "box_id")


def view_tracklets(spark: SparkSession, sf: str) -> DataFrame:
    """Careful tracklets of each camera: frames, boxes, and the first and last position."""
    rows = _tracklets(spark, sf)
    return rows.groupBy(*CAMERA, "piece").agg(F.count("*").alias("boxes"), F.min("k").alias("first"), F.max("k").alias("last"), F.round(F.min_by("x", "k"), 4).alias("hx"), F.round(F.max_by("x", "k"), 4).alias("tx"))


def track_identities(spark: SparkSession, sf: str) -> DataFrame:
    """The given tracklets linked into identities by their histograms, teams and how fast a player would have to run."""
    whole = F.filter("feats", lambda h: F.size(h) == 30)
    look = F.when(F.size(whole) > 0, F.aggregate(whole, F.array_repeat(F.lit(0.0), 30), lambda a, h: F.zip_with(a, h, lambda x, y: x + F.coalesce(y, F.lit(0.0)))))
    feats = table(spark, sf, "tracklets").dropDuplicates(TRACK).select(*TRACK, "team", F.transform(look, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))).alias("look"))
    ends = track_ends(spark, sf).join(feats, TRACK, "left").join(table(spark, sf, "futsal_matches").select("match_id", "fps"), "match_id")
    pieces = ends.select("match_id", F.col("track_id").alias("piece"), F.col("first").alias("start"), F.col("last").alias("end"), F.col("fx").alias("hx"), F.col("fy").alias("hy"), F.col("lx").alias("tx"), F.col("ly").alias("ty"), "team", "look", F.col("n").alias("boxes"), "fps")
    return identities(pieces).select("match_id", F.col("piece").alias("track_id"), "identity")


def built_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes to tracks: tracklets of each camera, views of one player joined, linked into identities; one fused position a frame.

    The least standard deviation of a position is a micrometre; boxes without one count as half a metre.
    """
    rows = cut(_tracklets(spark, sf))
    named = components(rows.select("match_id", "piece").distinct(), paired_views(rows), keys=["match_id"], node="piece", a="a", b="b")
    rows = cut(rows.join(named, ["match_id", "piece"]).drop("piece").withColumnRenamed("component", "piece"))
    look = table(spark, sf, "boxes").where("size(reid) = 512 and exists(reid, v -> v <> 0)").select("box_id", "reid").dropDuplicates(["box_id"])
    mean = rows.select("match_id", "piece", "box_id").join(look, "box_id").groupBy("match_id", "piece").agg(vector_to_array(Summarizer.mean(array_to_vector("reid"))).alias("look"))
    label = F.when(F.col("team") == "A", F.col("h")), F.when(F.col("team").isin("A", "B") & (F.col("h") >= 40) & (F.col("conf") >= 0.4), F.col("h"))
    share = F.sum(F.when(label[1].isNotNull(), label[0])) / F.sum(label[1])
    ends = rows.groupBy("match_id", "piece").agg(
        F.min("k").alias("start"), F.max("k").alias("end"), F.min_by(F.struct("x", "y"), "k").alias("a"), F.max_by(F.struct("x", "y"), "k").alias("b"),
        F.when(share >= 0.7, "A").when(share <= 0.3, "B").otherwise("U").alias("team"), F.count("*").alias("boxes"),
    )
    fps = table(spark, sf, "futsal_matches").select("match_id", "fps")
    pieces = ends.join(mean, ["match_id", "piece"], "left").join(fps, "match_id")
    pieces = pieces.select("match_id", "piece", "start", "end", F.col("a.x").alias("hx"), F.col("a.y").alias("hy"), F.col("b.x").alias("tx"), F.col("b.y").alias("ty"), "team", "look", "boxes", "fps")
    own = identities(pieces)
    weight = 1 / F.greatest(F.coalesce("sigma", F.lit(0.5)), F.lit(1e-6)) ** 2
    out = rows.join(own, ["match_id", "piece"]).withColumn("w", weight).groupBy("match_id", "identity", "k")
    return out.agg(F.count("*").alias("boxes"), F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 4).alias("x"), F.round(F.sum(F.col("y") * F.col("w")) / F.sum("w"), 4).alias("y"))


def placed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Source frames of each camera on grid frames of their own; a frame that collides goes to the next one if that is near."""
    return one_frame_each(box_frames(spark, sf).select(*CAMERA, "fid", "position"), keys=CAMERA)


def distinct_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of each source frame without those that overlap a surer one by over half."""
    return suppress_overlaps(boxes(spark, sf), keys=CAMERA, frame="fid")


def stitched_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks joined end to start, those that need the least speed first."""
    ends = track_ends(spark, sf).join(spans(spark, sf).select(*TRACK, "team"), TRACK, "left").join(table(spark, sf, "futsal_matches").select("match_id", "fps"), "match_id")
    return stitch_tracks(ends)


def _colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colour roots of the boxes of each track point."""
    roots = F.transform("color", lambda c: F.sqrt(F.greatest(c, F.lit(0.0))))
    colour = table(spark, sf, "boxes").where("size(color) = 30 and h >= 40").select("box_id", roots.alias("v")).dropDuplicates(["box_id"])
    return _track_boxes(spark, sf).join(colour, "box_id").select(*TRACK, "k", "v")


def track_appearance(spark: SparkSession, sf: str) -> DataFrame:
    """How each track looks: views, spread, and the group of tracks of its match that look alike (ten at most)."""
    looks = cut(track_looks(_colours(spark, sf), keys=TRACK, order="k", vector="v"))
    groups = look_groups(looks, match="match_id", id="track_id", groups=10)
    return looks.join(groups, TRACK).select(*TRACK, "n", F.size("medoids").alias("medoids"), F.round("spread", 6).alias("spread"), "look")


def look_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of the looks of two tracks of a match that a player could have gone between."""
    looks = cut(track_looks(_colours(spark, sf), keys=TRACK, order="k", vector="v"))
    a, b = (looks.select("match_id", F.col("track_id").alias(s), F.col("mean").alias(f"m{s}"), F.col("medoids").alias(f"t{s}")) for s in "ab")
    pairs = relink_candidates(spark, sf).join(a, ["match_id", "a"], "left").join(b, ["match_id", "b"], "left")
    return pairs.select("match_id", "a", "b", "gap", F.round(look_distance("ma", "mb", "ta", "tb"), 6).alias("distance"))


def look_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of each track in which it looks alike."""
    return look_changes(_colours(spark, sf), keys=TRACK, order="k", vector="v")


def refined_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Track positions fused from boxes and smoothed by their own variances; gaps of up to three seconds are bridged."""
    rows = fused_points(spark, sf).join(table(spark, sf, "futsal_matches").select("match_id", (1 / F.col("fps")).alias("dt")), "match_id")
    out = smooth_tracks(rows, keys=TRACK, order="k", dt="dt", method="gated", gap_s=3.0)
    return out.select(*TRACK, "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def court_points(spark: SparkSession, sf: str) -> DataFrame:
    """Named points of each match's court."""
    return court_keypoints(table(spark, sf, "futsal_matches").dropDuplicates(["match_id"]), keys=["match_id"])


QUERIES = {f.__name__: f for f in (camera_calibrations, calibrated_points, camera_framing, camera_fields, aligned_boxes, team_labels, view_tracklets, track_identities, built_tracks, placed_frames, distinct_boxes, stitched_tracks, track_appearance, look_distances, look_stretches, refined_tracks, court_points)}
SQL = {
    "court_points": "SELECT match_id, n.name, n.a * court_length + n.b AS x, n.c * court_width + n.d AS y FROM (SELECT DISTINCT match_id, court_length, court_width FROM futsal_matches), (VALUES "
    + ", ".join("('{}', {}, {}, {}, {})".format(*(line.split()[:1] + [float(v) for v in line.split()[1:]])) for line in KEYPOINTS.strip().splitlines())
    + ") n(name, a, b, c, d)",
}
