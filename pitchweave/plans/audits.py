"""Audits of boxes, cameras and tracks: coverage by appearance vectors, image sizes, votes, fusion, views, identities, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.functions.clock import camera_time, reference_time
from pitchweave.functions.geometry import clipped, hue_of, hypot, mahalanobis2
from pitchweave.functions.vectors import cosine, dequantise, normalise, quantise
from pitchweave.operators.blocks import core, in_blocks, islands, pieces, series
from pitchweave.operators.joins import band_join
from pitchweave.plans.cameras import _BOXES, boxes, clean_boxes, frame_timing, _GRID, grid_boxes, mutual_offsets, _PAIRS, _pairs, _TB, _track_boxes
from pitchweave.plans.cleaning import box_frames
from pitchweave.plans.players import encounters, PLAYER, player_team, _SEEN, seen, _TEAM, with_clock
from pitchweave.plans.tracks import _ENDS, _POINTS, points, state_jumps, TRACK, track_ends
from pitchweave.sources.tables import table

FULL_HD, ULTRA_HD = (1920, 1080), (3840, 2160)


def reid_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Per match, whether every camera has detections and at least one appearance vector."""
    held = table(spark, sf, "detections").groupBy("match_id", "camera").agg(F.countDistinct("box_id").alias("n"), F.max(F.col("reid").isNotNull()).alias("any_reid"))
    rows = table(spark, sf, "camera_sync").select("match_id", "camera").distinct().join(held, ["match_id", "camera"], "left")
    return rows.groupBy("match_id").agg(F.coalesce(F.min((F.col("n") > 0) & F.col("any_reid")), F.lit(False)).alias("least"), F.count("*").alias("cameras"), F.min(F.coalesce("n", F.lit(0))).alias("fewest")).select(
        "match_id", "cameras", "fewest", (F.col("least") & (F.col("fewest") > 0)).alias("has_reid")
    )


def _image_size() -> tuple[Column, Column]:
    wide, high = F.max("x2"), F.max("y2")
    sizes = [((wide <= w) & (high <= h), w, h) for w, h in (FULL_HD, ULTRA_HD)]
    return tuple(F.when(sizes[0][0], sizes[0][i]).when(sizes[1][0], sizes[1][i]).otherwise(F.ceil(v)).cast("int") for i, v in ((1, wide), (2, high)))


def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Width and height of each camera's image: the smallest usual format that holds all its boxes, else what they need."""
    w, h = _image_size()
    return boxes(spark, sf).groupBy("match_id", "camera").agg(w.alias("width"), h.alias("height"))


def fit_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """``clean_boxes`` that also keep a fiftieth of the image's width from every edge but the top one."""
    rows = boxes(spark, sf).select("match_id", "camera", "box_id", "x1", "x2", "y2").join(image_sizes(spark, sf), ["match_id", "camera"])
    edge = 0.02 * F.col("width")
    inside = (F.col("x1") >= edge) & (F.col("x2") <= F.col("width") - edge) & (F.col("y2") <= F.col("height") - edge)
    return clean_boxes(spark, sf).join(rows, "box_id").select("box_id", inside.alias("inside"), (F.col("clean") & inside).alias("fit"))


def majority_team(spark: SparkSession, sf: str) -> DataFrame:
    """Team of each track by the share of its labelled boxes: at least three, and seven tenths of them."""
    label = boxes(spark, sf).where("team in ('A', 'B')").select("box_id", (F.col("team") == "A").cast("double").alias("is_a"))
    rows = _track_boxes(spark, sf).join(label, "box_id").groupBy(*TRACK).agg(F.count("*").alias("labels"), F.avg("is_a").alias("share"))
    enough = F.col("labels") >= 3
    return rows.select(*TRACK, "labels", F.when(enough & (F.col("share") >= 0.7), "A").when(enough & (F.col("share") <= 1 - 0.7), "B").otherwise("").alias("team"))


def point_team(spark: SparkSession, sf: str) -> DataFrame:
    """Commonest known team of each track point's boxes; of equally common ones the first."""
    label = boxes(spark, sf).where("team in ('A', 'B')").select("box_id", "team")
    return _track_boxes(spark, sf).join(label, "box_id").groupBy(*TRACK, "k").agg(F.mode("team", True).alias("team"), F.count("*").alias("labels"))


def fused_points(spark: SparkSession, sf: str) -> DataFrame:
    """Track points fused anew from their boxes by inverse covariance; the covariance of a point without boxes is 0.25 I."""
    own = boxes(spark, sf).where("sigma is not null and x is not null and y is not null").select("box_id", "x", "y", (F.greatest("sigma", F.lit(1e-6)) ** 2).alias("var"), ((F.col("w") / F.greatest("h", F.lit(1.0))) * 0.5 * F.col("sigma") ** 2).alias("cov"))
    det = F.col("var") ** 2 - F.col("cov") ** 2
    own = own.withColumns({"a": F.col("var") / det, "b": -F.col("cov") / det})
    sums = _track_boxes(spark, sf).join(own, "box_id").groupBy(*TRACK, "k").agg(
        F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"),
        F.sum(F.col("a") * F.col("x") + F.col("b") * F.col("y")).alias("u"), F.sum(F.col("b") * F.col("x") + F.col("a") * F.col("y")).alias("v"),
    )
    rows = points(spark, sf).join(sums.withColumnRenamed("n", "boxes"), [*TRACK, "k"], "left")
    inv = F.col("a") ** 2 - F.col("b") ** 2
    held = F.col("boxes").isNotNull()
    return rows.select(
        *TRACK, "k", F.coalesce("boxes", F.lit(0)).alias("boxes"),
        F.round(F.when(held, (F.col("a") * F.col("u") - F.col("b") * F.col("v")) / inv).otherwise(F.col("x")), 5).alias("x"),
        F.round(F.when(held, (F.col("a") * F.col("v") - F.col("b") * F.col("u")) / inv).otherwise(F.col("y")), 5).alias("y"),
        F.round(F.when(held, F.col("a") / inv).otherwise(F.lit(0.25)), 6).alias("var"), F.round(F.when(held, -F.col("b") / inv).otherwise(F.lit(0.0)), 6).alias("cov"),
    )


def largest_view(spark: SparkSession, sf: str) -> DataFrame:
    """The highest box of each track point; of equally high ones that of the first camera."""
    rows = _track_boxes(spark, sf).join(boxes(spark, sf).where("h >= 60 and conf >= 0.5").select("box_id", "h"), "box_id")
    order = F.struct((-F.col("h")).alias("h"), F.col("camera"), F.col("box_id"))
    return rows.groupBy(*TRACK, "k").agg(F.min(order).alias("b")).select(*TRACK, "k", "b.camera", "b.box_id", (-F.col("b.h")).alias("h"))


def point_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per match: track points, points with two boxes of one camera, boxes of several tracks, boxes that don't exist."""
    rows = _track_boxes(spark, sf)
    twice = rows.groupBy(*TRACK, "k", "camera").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.count(F.when(F.col("n") > 1, 1)).alias("twice"))
    shared = rows.groupBy("match_id", "box_id").agg(F.countDistinct("track_id").alias("n")).groupBy("match_id").agg(F.count("*").alias("boxes"), F.count(F.when(F.col("n") > 1, 1)).alias("shared"))
    lost = rows.select("match_id", "box_id").distinct().join(boxes(spark, sf).select("box_id"), "box_id", "left_anti").groupBy("match_id").agg(F.count("*").alias("unknown"))
    return shared.join(twice, "match_id").join(lost, "match_id", "left").select("match_id", "boxes", "twice", "shared", F.coalesce("unknown", F.lit(0)).alias("unknown"))


def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per match: tracks, those over half of the match and over 2 s, mean length, length-weighted mean length, share with boxes."""
    length = points(spark, sf).groupBy(*TRACK).agg(F.count("*").cast("double").alias("n"))
    rows = with_clock(spark, sf, length)
    return rows.groupBy("match_id").agg(
        F.count("*").alias("ids"), F.count(F.when(F.col("n") > F.col("n_frames") / 2, 1)).alias("over_half"), F.count(F.when(F.col("n") > 2 * F.col("fps"), 1)).alias("over_2s"),
        F.round(F.avg("n"), 6).alias("mean"), F.round(F.sum(F.col("n") * F.col("n")) / F.sum("n"), 6).alias("weighted"),
    )


def five_a_side(spark: SparkSession, sf: str) -> DataFrame:
    """Per match, the share of all its frames in which exactly five players of each team are seen."""
    per = seen(spark, sf).join(player_team(spark, sf), PLAYER).groupBy("match_id", "k").agg(F.count(F.when(F.col("team") == "A", 1)).alias("a"), F.count(F.when(F.col("team") == "B", 1)).alias("b"))
    exact = per.groupBy("match_id").agg(F.count(F.when((F.col("a") == 5) & (F.col("b") == 5), 1)).alias("exact"), F.max(F.col("a") + F.col("b")).alias("most"))
    rows = table(spark, sf, "futsal_matches").join(exact, "match_id")
    return rows.select("match_id", "exact", "most", F.round(F.col("exact") / F.col("n_frames"), 6).alias("share"))


def jump_events(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of consecutive states whose velocity differs by over 6 m/s from the one five frames before: one event each."""
    return islands(state_jumps(spark, sf).select(*TRACK, "k"), keys=TRACK, order="k", most=1)


def view_support(spark: SparkSession, sf: str) -> DataFrame:
    """Per match: points seen by two cameras, and how often a track's set of cameras changes from one of its frames to the next."""
    sets = _track_boxes(spark, sf).groupBy(*TRACK, "k").agg(F.concat_ws(",", F.array_sort(F.collect_set("camera"))).alias("cams"), F.countDistinct("camera").alias("n"))
    rows = in_blocks(sets, "k", before=1, after=0)
    line = series(TRACK, "k")
    flip = (F.col("k") - F.lag("k").over(line) == 1) & (F.col("cams") != F.lag("cams").over(line))
    rows = core(rows.withColumn("flip", F.coalesce(flip, F.lit(False))))
    return rows.groupBy("match_id").agg(F.count("*").alias("points"), F.count(F.when(F.col("n") > 1, 1)).alias("both"), F.count(F.when(F.col("flip"), 1)).alias("flips"))


def colour_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Two-second chunks of a track whose mean colour histogram is unlike that of the chunk before: cosine below 0.9."""
    colour = table(spark, sf, "boxes").where("size(color) = 30 and exists(color, c -> c > 0)").select("box_id", "color").dropDuplicates(["box_id"])
    rows = with_clock(spark, sf, _track_boxes(spark, sf).join(colour, "box_id")).withColumn("chunk", F.floor(F.col("k") / F.rint(2 * F.col("fps"))))
    mean = rows.groupBy(*TRACK, "chunk").agg(*[F.avg(F.col("color")[i]).alias(f"c{i}") for i in range(30)])
    mean = mean.select(*TRACK, "chunk", F.array(*[f"c{i}" for i in range(30)]).alias("v"))
    past = mean.select(*TRACK, (F.col("chunk") + 1).alias("chunk"), F.col("v").alias("p"))
    both = mean.join(past, [*TRACK, "chunk"]).withColumn("cosine", cosine(F.col("v"), F.col("p")))
    return both.select(*TRACK, "chunk", F.round("cosine", 6).alias("cosine"), (F.col("cosine") < 0.9).alias("broken"))


def coassignment(df: DataFrame, *, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, pairs_a, pairs_b, both, f1): agreement of two labellings of the same rows on which of them belong together."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, a, b).agg(F.count("*").cast("double").alias("_n"))

    def pairs(by: list[str], name: str) -> DataFrame:
        return n.groupBy(*keys, *by).agg(F.sum("_n").alias("_m")).groupBy(*keys).agg(F.sum(F.col("_m") * (F.col("_m") - 1) / 2).alias(name))

    out = pairs([a], "pairs_a").join(pairs([b], "pairs_b"), keys).join(pairs([a, b], "both"), keys)
    return out.select(*keys, "pairs_a", "pairs_b", "both", F.round(2 * F.col("both") / F.nullif(F.col("pairs_a") + F.col("pairs_b"), F.lit(0.0)), 6).alias("f1"))


def track_team_agreement(spark: SparkSession, sf: str) -> DataFrame:
    label = boxes(spark, sf).where("team in ('A', 'B')").select("box_id", "team")
    return coassignment(_track_boxes(spark, sf).join(label, "box_id"), keys=["match_id"], a="track_id", b="team")


def id_overlaps(spark: SparkSession, sf: str, radius: float = 1.0) -> DataFrame:
    """Frames in which a player and a track of a match are within a metre, and their mean distance there."""
    a, b = seen(spark, sf).alias("a"), points(spark, sf).alias("b")
    d = hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    pairs = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k"), d <= radius])
    return pairs.groupBy("a.match_id", "a.player_id", "b.track_id").agg(F.count("*").alias("frames"), F.round(F.avg(d), 6).alias("mean_m"))


def position_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each track point to the nearest player of its frame: median, mean and 95th percentile, per match."""
    a, b = seen(spark, sf).alias("a"), points(spark, sf).alias("b")
    pairs = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k")])
    near = pairs.groupBy("b.match_id", "b.track_id", "b.k").agg(F.min(hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("d"))
    return near.groupBy("match_id").agg(F.count("*").alias("n"), F.round(F.percentile("d", 0.5), 6).alias("median_m"), F.round(F.avg("d"), 6).alias("mean_m"), F.round(F.percentile("d", 0.95), 6).alias("p95_m"))


def quantile_gate(spark: SparkSession, sf: str, gate: float = 0.5) -> DataFrame:
    """The gate on corrected distances that lets as large a share of mutual pairs through as 0.5 m on raw ones."""
    rows = mutual_offsets(spark, sf)
    share = rows.agg(F.avg((F.col("raw_m") <= gate).cast("double"))).first()[0]
    return rows.agg(F.count("*").alias("n"), F.round(F.lit(share), 6).alias("share"), F.round(F.percentile("d", F.lit(share or 0.0)), 6).alias("gate"))


def alignment_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual pairs of each two cameras, and their median distance before and after the correction of positions."""
    return mutual_offsets(spark, sf).groupBy("match_id", "camera_a", "camera_b").agg(F.count("*").alias("pairs"), F.round(F.median("raw_m"), 6).alias("before_m"), F.round(F.median("d"), 6).alias("after_m"))


def clock_shift(spark: SparkSession, sf: str, most: int = 5) -> DataFrame:
    """The shift in frames between two cameras of a match at which their boxes lie nearest, refined by a parabola.

    Only each box's nearest one of the other camera counts, within 2.5 m, and only shifts with at least 30 pairs.
    """
    rows = grid_boxes(spark, sf).where("in_court and conf >= 0.5 and x is not null and y is not null").select("match_id", "camera", "k", "box_id", "x", "y")
    a = rows.withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("at", F.col("k") + F.col("shift")).alias("a")
    b = rows.alias("b")
    d = hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    pairs = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.at") == F.col("b.k"), F.col("a.camera") < F.col("b.camera"), d < 2.5])
    near = pairs.groupBy(F.col("a.match_id").alias("match_id"), F.col("a.camera").alias("camera_a"), F.col("b.camera").alias("camera_b"), "a.shift", "a.box_id").agg(F.min(d).alias("d"))
    by = near.groupBy("match_id", "camera_a", "camera_b", "shift").agg(F.count("*").alias("pairs"), F.avg("d").alias("d")).where("pairs >= 30")
    line = W.partitionBy("match_id", "camera_a", "camera_b").orderBy("shift")  # at most 2 * most + 1 rows
    low, high = (F.when(F.abs(f("shift").over(line) - F.col("shift")) == 1, f("d").over(line)) for f in (F.lag, F.lead))
    by = by.withColumns({"low": low, "high": high, "r": F.row_number().over(W.partitionBy("match_id", "camera_a", "camera_b").orderBy(F.round("d", 9), F.abs("shift"), "shift"))}).where("r = 1")
    bend = F.col("low") - 2 * F.col("d") + F.col("high")
    fine = F.coalesce(F.when(bend > 1e-12, F.greatest(F.least(0.5 * (F.col("low") - F.col("high")) / bend, F.lit(0.5)), F.lit(-0.5))), F.lit(0.0))
    return by.select("match_id", "camera_a", "camera_b", "shift", "pairs", F.round("d", 6).alias("mean_m"), F.round(F.col("shift") + fine, 4).alias("fine"))


def clock_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Linear clock of each camera's grid frames against its own clock: residuals beyond three scatters left out, with the error of the offset."""
    rows = box_frames(spark, sf).where("position is not null").select("match_id", "camera", "fid", "t", (F.rint("position") / F.col("fps") + F.col("start_s") - F.col("t")).alias("d"))
    key = ["match_id", "camera"]
    mid = rows.groupBy(*key).agg(F.median("d").alias("m"))
    rows = rows.join(mid, key).withColumn("e", F.abs(F.col("d") - F.col("m")))
    mad = rows.groupBy(*key).agg((1.4826 * F.median("e")).alias("s"))
    kept = rows.join(mad, key).where(F.col("e") <= 3 * F.greatest("s", F.lit(1e-6)))
    out = kept.groupBy(*key).agg(F.count("*").alias("n"), F.median("d").alias("offset"), F.regr_slope("d", "t").alias("slope"), F.stddev_samp("d").alias("sd"), (F.max("t") - F.min("t")).alias("span"))
    return out.where("n >= 10").select(*key, "n", F.round("offset", 5).alias("offset_s"), F.round(F.col("sd") / F.sqrt("n"), 6).alias("stderr"), F.round(F.when(F.col("span") > 600, F.col("slope")).otherwise(F.lit(0.0)), 9).alias("drift"))


def camera_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each camera: small or upright image, irregular frames, dropped frames, drift, an odd name."""
    sync = table(spark, sf, "camera_sync").groupBy("match_id", "camera").agg(F.max(F.coalesce("drift", F.lit(0.0))).alias("drift"))
    rows = sync.join(image_sizes(spark, sf), ["match_id", "camera"], "left").join(frame_timing(spark, sf), ["match_id", "camera"], "left")
    rules = [("upright", F.col("height") > F.col("width")), ("small", F.col("height") < FULL_HD[1]), ("irregular", F.col("irregular") > 0.05), ("dropped", F.col("dropped") > 0), ("drift", F.abs("drift") > 300e-6), ("no boxes", F.col("width").isNull()), ("name", ~F.col("camera").rlike("^cam[0-9]+$"))]
    return rows.select("match_id", "camera", F.concat_ws(", ", *[F.when(rule, name) for name, rule in rules]).alias("warnings"))


def frame_sampling(spark: SparkSession, sf: str, rate_hz: float = 2.0, every: int = 3) -> DataFrame:
    """Frames sampled at about two a second, and every third of these for appearance; frames count from 0 in each camera."""
    frames = table(spark, sf, "detections").groupBy("match_id", "camera", "frame").agg(F.max("t").alias("t"))
    fps = table(spark, sf, "futsal_matches").select("match_id", F.greatest(F.rint(F.col("fps") / rate_hz), F.lit(1.0)).try_cast("int").alias("stride"))
    rows = frames.join(fps, "match_id").where(F.pmod("frame", "stride") == 0)
    return rows.select("match_id", "camera", "frame", (F.pmod(F.floor(F.col("frame") / F.col("stride")), F.lit(every)) == 0).alias("appearance"))


def held_out_frames(spark: SparkSession, sf: str, share: float = 0.2) -> DataFrame:
    """Frames of each camera, the last fifth of them for validation."""
    rows = table(spark, sf, "detections").select("match_id", "camera", "frame").distinct().withColumn("one", F.lit(True))
    rows = pieces(rows, keys=["match_id", "camera"], order="frame", starts="one")
    total = rows.groupBy("match_id", "camera").agg(F.count("*").alias("n"))
    return rows.join(total, ["match_id", "camera"]).select("match_id", "camera", "frame", (F.col("piece") > F.rint(F.col("n") * (1 - share))).alias("validation"))


def blind_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks under codes that tell nothing of them, and their order."""
    path = F.concat_ws("/", "match_id", F.col("track_id").cast("string"))
    return table(spark, sf, "tracklets").select(*TRACK).distinct().select(*TRACK, F.substring(F.sha1(path), 1, 10).alias("code"))


def merged_points(spark: SparkSession, sf: str) -> DataFrame:
    """Players' and tracks' positions in one table by number; where both have a frame the track's holds."""
    a = seen(spark, sf).select("match_id", F.col("player_id").cast("bigint").alias("id"), "k", "x", "y", F.lit(0).alias("rank"))
    b = points(spark, sf).select("match_id", F.col("track_id").alias("id"), "k", "x", "y", F.lit(1).alias("rank"))
    best = a.unionByName(b).groupBy("match_id", "id", "k").agg(F.max(F.struct("rank", "x", "y")).alias("p"))
    return best.select("match_id", "id", "k", "p.x", "p.y")


def perimeter(spark: SparkSession, sf: str, step: float = 1.0) -> DataFrame:
    """Places for a camera around each court: metre marks of all four edges without the goal mouths."""
    rows = table(spark, sf, "futsal_matches").select("match_id", F.col("court_length").alias("l"), F.col("court_width").alias("w")).distinct()

    def marks(size: str, at: list[tuple[Column, Column]]) -> list[DataFrame]:
        along = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.floor(F.col(size) / step).cast("int")))).withColumn("s", F.least(F.col("s") * step, F.col(size)))
        return [along.select("match_id", "w", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.lit(size == "w").alias("end")) for x, y in at]

    s, zero = F.col("s"), F.lit(0.0)
    parts = marks("l", [(s, zero), (s, F.col("w"))]) + marks("w", [(zero, s), (F.col("l"), s)])
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where(~F.col("end") | (F.abs(F.col("y") - F.col("w") / 2) > 1.5)).select("match_id", "x", "y").distinct()


def tile_boxes(spark: SparkSession, sf: str, tile: int = 640, overlap: float = 0.2) -> DataFrame:
    """Boxes of each tile of a full-HD image, clipped to it, of which at least six tenths are inside.

    Tiles lie ``tile * (1 - overlap)`` apart, the last one flush with the edge.  A box is only sent to the tiles it touches.
    """
    def origins(size: int) -> list[int]:
        stride = int(tile * (1 - overlap))
        return [*range(0, max(size - tile, 0), stride), max(size - tile, 0)]

    rows = boxes(spark, sf).where("x2 > x1 and y2 > y1").select("match_id", "camera", "box_id", "x1", "y1", "x2", "y2")
    xs, ys = (F.array(*[F.lit(float(o)) for o in origins(n)]) for n in FULL_HD)
    touched = F.filter(xs, lambda o: (o < F.col("x2")) & (o + tile > F.col("x1"))), F.filter(ys, lambda o: (o < F.col("y2")) & (o + tile > F.col("y1")))
    rows = rows.withColumn("tx", F.explode(touched[0])).withColumn("ty", F.explode(touched[1]))
    box, share = clipped(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), (F.col("tx"), F.col("ty"), F.col("tx") + tile, F.col("ty") + tile))
    out = rows.withColumns({"share": share, **{f"c{i}": c for i, c in enumerate(box)}}).where("share >= 0.6")
    return out.select("box_id", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), *[F.round(f"c{i}", 4).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.round("share", 6).alias("share"))


def junctions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the boxes of a camera pass from one track to another within a metre and ten frames: the last of one, the first of the next."""
    ends = track_ends(spark, sf)
    a = ends.select("match_id", F.col("track_id").alias("a"), F.col("last").alias("ak"), "lx", "ly")
    b = ends.select("match_id", F.col("track_id").alias("b"), F.col("first").alias("bk"), "fx", "fy")
    pairs = band_join(a, b, keys=["match_id"], left_at="ak", right_at="bk", least=-5, most=10).where("a <> b")
    d = hypot(F.col("fx") - F.col("lx"), F.col("fy") - F.col("ly"))
    one = pairs.withColumn("d", d).where("d <= 1.0")
    na, nb = F.count("*").over(W.partitionBy("match_id", "a")), F.count("*").over(W.partitionBy("match_id", "b"))
    return one.withColumns({"na": na, "nb": nb}).select("match_id", "a", "b", (F.col("bk") - F.col("ak")).alias("gap"), F.round("d", 6).alias("d"), ((F.col("na") == 1) & (F.col("nb") == 1)).alias("only"))


def end_velocities(spark: SparkSession, sf: str, window: int = 5) -> DataFrame:
    """Velocity of each track around each of its frames, in m/s: between its first and last position within five frames either way."""
    rows = with_clock(spark, sf, in_blocks(points(spark, sf), "k", before=window, after=window))
    near = series(TRACK, "k").rangeBetween(-window, window)
    first, last = (f(F.struct("k", "x", "y")).over(near) for f in (F.first, F.last))
    rows = core(rows.withColumns({"a": first, "b": last}))
    dt = (F.col("b.k") - F.col("a.k")) / F.col("fps")
    return rows.where("b.k > a.k").select(*TRACK, "k", F.round((F.col("b.x") - F.col("a.x")) / dt, 4).alias("vx"), F.round((F.col("b.y") - F.col("a.y")) / dt, 4).alias("vy"))


def on_court_cap(spark: SparkSession, sf: str, most: int = 5) -> DataFrame:
    """Track points that are too many: beyond five of a team in a frame, points without boxes go, the highest numbers first."""
    held = table(spark, sf, "track_points").groupBy(*TRACK, "k").agg(F.max(F.size("boxes") > 0).alias("held"))
    team = table(spark, sf, "tracklets").where("team in ('A', 'B')").groupBy(*TRACK).agg(F.min("team").alias("team"))
    rows = points(spark, sf).join(held, [*TRACK, "k"]).join(team, TRACK)
    rank = F.row_number().over(W.partitionBy("match_id", "k", "team").orderBy(F.desc("held"), "track_id"))
    return rows.withColumn("rank", rank).select(*TRACK, "k", ((F.col("rank") > most) & ~F.col("held")).alias("drop"))


def label_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one team label in each player's rows; a new run starts where the label changes or over three frames are missing."""
    rows = table(spark, sf, "tracks").groupBy(*PLAYER, "k").agg(F.coalesce(F.min(F.when(F.col("team").isin("A", "B"), F.col("team"))), F.lit("")).alias("label"))
    rows = in_blocks(rows, "k", before=4, after=0)
    line = series(PLAYER, "k")
    start = F.coalesce((F.col("k") - F.lag("k").over(line) > 4) | (F.col("label") != F.lag("label").over(line)), F.lit(True))
    rows = pieces(core(rows.withColumn("start", start)), keys=PLAYER, order="k", starts="start")
    return rows.groupBy(*PLAYER, "piece").agg(F.first("label").alias("label"), F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("rows")).drop("piece")


def team_flips(spark: SparkSession, sf: str, run: int = 15) -> DataFrame:
    """Where a player's label most clearly changes from one team to the other: the share before and after of 15 labelled rows each."""
    rows = table(spark, sf, "tracks").where("team in ('A', 'B')").groupBy(*PLAYER, "k").agg(F.min(F.when(F.col("team") == "A", 1.0).otherwise(0.0)).alias("is_a"))
    rows = pieces(rows.withColumn("one", F.lit(True)), keys=PLAYER, order="k", starts="one").withColumnRenamed("piece", "i")
    near = in_blocks(rows, "i", before=run, after=run)
    line = series(PLAYER, "i")
    before, after = F.avg("is_a").over(line.rangeBetween(-run, -1)), F.avg("is_a").over(line.rangeBetween(0, run - 1))
    near = core(near.withColumns({"b": before, "a": after, "n": F.count("*").over(line.rangeBetween(-run, run - 1))})).where(F.col("n") == 2 * run)
    score = F.greatest(F.least("b", 1 - F.col("a")), F.least(1 - F.col("b"), F.col("a")))
    best = near.withColumn("score", score).groupBy(*PLAYER).agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("m"))
    return best.select(*PLAYER, (-F.col("m.k")).alias("k"), F.round("m.score", 6).alias("score"))


def match_document(spark: SparkSession, sf: str) -> DataFrame:
    """One document a match: its cameras in order, whether it has tracks, and how many detections each camera has."""
    cams = table(spark, sf, "camera_sync").select("match_id", "camera").distinct()
    n = table(spark, sf, "detections").groupBy("match_id", "camera").agg(F.countDistinct("box_id").alias("n"))
    cams = cams.join(n, ["match_id", "camera"], "left").groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("camera", F.coalesce("n", F.lit(0)).alias("n")))).alias("c"))
    tracks = table(spark, sf, "tracklets").select("match_id").distinct().withColumn("t", F.lit(True))
    rows = table(spark, sf, "futsal_matches").join(cams, "match_id", "left").join(tracks, "match_id", "left")
    listed = F.array_join(F.transform("c", lambda e: F.concat_ws(":", e["camera"], e["n"].cast("string"))), ",")
    return rows.select("match_id", "status", F.coalesce(listed, F.lit("")).alias("cameras"), F.coalesce("t", F.lit(False)).alias("has_tracks"))


def clock_strings(spark: SparkSession, sf: str) -> DataFrame:
    """First sighting of each player as m:ss.s, and the hue their number is drawn in."""
    rows = with_clock(spark, sf, seen(spark, sf).groupBy(*PLAYER).agg(F.min("k").alias("k")))
    t = F.col("k") / F.col("fps")
    tenths = F.floor(t * 10 + 0.5)
    text = F.format_string("%d:%02d.%d", F.floor(tenths / 600), F.floor(F.pmod(tenths, F.lit(600)) / 10), F.pmod(tenths, F.lit(10)))
    return rows.select(*PLAYER, text.alias("clock"), F.round(hue_of(F.col("player_id")), 6).alias("hue"))


def clock_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Reference time of each detection frame, and its camera time back from it."""
    frames = table(spark, sf, "detections").groupBy("match_id", "camera", "frame").agg(F.max("t").alias("t")).where("t is not null")
    sync = table(spark, sf, "camera_sync").groupBy("match_id", "camera").agg(F.max("offset_s").alias("offset_s"), F.max("drift").alias("drift"))
    rows = frames.join(sync, ["match_id", "camera"]).withColumn("ref", reference_time("t", "offset_s", "drift"))
    return rows.select("match_id", "camera", "frame", F.round("ref", 6).alias("ref"), F.round(camera_time("ref", "offset_s", "drift"), 6).alias("back"))


def sampled_encounters(spark: SparkSession, sf: str, step: int = 3, most: int = 10) -> DataFrame:
    """Every third encounter of each match, ten at most, for review by eye."""
    order = W.partitionBy("match_id").orderBy("first", "a", "b")
    rows = encounters(spark, sf).withColumn("r", F.row_number().over(order) - 1)
    return rows.where((F.pmod("r", F.lit(step)) == 0) & (F.col("r") < step * most)).select("match_id", "a", "b", "first", "last")


def gated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of boxes of two cameras within 1.5 m whose distance is likely under both their errors: below 9.21 squared deviations."""
    var = F.col("asig") ** 2 + F.col("bsig") ** 2
    d2 = mahalanobis2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), var, F.lit(0.0), var)
    rows = _pairs(spark, sf).where("d < 1.5 and asig > 0 and bsig > 0").withColumn("d2", d2).where("d2 < 9.21")
    return rows.select("match_id", "k", "a", "b", F.round("d2", 4).alias("d2"))


def quantised_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colour histograms as whole numbers of 255ths: their sum, and the largest error of going there and back."""
    rows = table(spark, sf, "boxes").where("size(color) = 30").select("box_id", "color").dropDuplicates(["box_id"])
    whole = quantise(F.col("color"))
    error = F.array_max(F.zip_with(dequantise(whole), "color", lambda a, b: F.abs(a - b)))
    return rows.select("box_id", F.aggregate(whole, F.lit(0), lambda s, x: s + x.cast("int")).alias("total"), F.round(error, 6).alias("error"))


def mixed_features(spark: SparkSession, sf: str, weight: float = 0.5) -> DataFrame:
    """Unit vectors that join a box's appearance and, at half weight, its colours: the first number of either part."""
    rows = table(spark, sf, "boxes").where("size(color) = 30 and size(reid) = 512").select("box_id", "reid", "color").dropDuplicates(["box_id"])
    colour = normalise(F.transform("color", lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))))
    mixed = normalise(F.concat(normalise(F.col("reid")), F.transform(colour, lambda c: weight * c)))
    return rows.select("box_id", mixed.alias("v")).select("box_id", F.round(F.col("v")[0], 6).alias("appearance"), F.round(F.col("v")[512], 6).alias("colour"))


_NAMES = (
    gated_pairs, quantised_colours, mixed_features, reid_presence, image_sizes, fit_boxes, majority_team, point_team, fused_points, largest_view, point_invariants, source_summary, five_a_side, jump_events, view_support, colour_breaks,
    track_team_agreement, id_overlaps, position_errors, quantile_gate, alignment_summary, clock_shift, clock_fit, camera_warnings, frame_sampling, held_out_frames, blind_codes, merged_points,
    perimeter, tile_boxes, junctions, end_velocities, on_court_cap, label_runs, team_flips, match_document, clock_strings, clock_round_trip, sampled_encounters,
)
QUERIES = {f.__name__: f for f in _NAMES}

_SIZE = _BOXES + """,
size AS (SELECT match_id, camera, CASE WHEN max(x2) <= 1920 AND max(y2) <= 1080 THEN 1920 WHEN max(x2) <= 3840 AND max(y2) <= 2160 THEN 3840 ELSE CAST(ceil(max(x2)) AS INT) END AS width,
  CASE WHEN max(x2) <= 1920 AND max(y2) <= 1080 THEN 1080 WHEN max(x2) <= 3840 AND max(y2) <= 2160 THEN 2160 ELSE CAST(ceil(max(y2)) AS INT) END AS height FROM b0 GROUP BY ALL)"""
_LABEL = _BOXES + ", " + _TB + ", lab AS (SELECT tb.*, team FROM tb JOIN b0 USING (box_id) WHERE team IN ('A', 'B'))"
_LABEL = _LABEL.replace("tb JOIN b0 USING (box_id)", "tb JOIN (SELECT box_id, team FROM b0) USING (box_id)")
_MUTUAL = _PAIRS + """,
mo AS (SELECT mu.*, sqrt((p.x_raw - q.x_raw) ** 2 + (p.y_raw - q.y_raw) ** 2) raw_m FROM mu JOIN b0 p ON p.box_id = a JOIN b0 q ON q.box_id = b WHERE p.x_raw IS NOT NULL AND q.x_raw IS NOT NULL AND p.y_raw IS NOT NULL AND q.y_raw IS NOT NULL)"""

SQL = {
    "gated_pairs": f"WITH {_PAIRS} SELECT match_id, k, a, b, round(d * d / (asig ** 2 + bsig ** 2), 4) AS d2 FROM pr WHERE d < 1.5 AND asig > 0 AND bsig > 0 AND d * d / (asig ** 2 + bsig ** 2) < 9.21",
    "quantised_colours": """SELECT DISTINCT box_id, CAST(list_sum(list_transform(color, lambda c: round_even(c * 255, 0))) AS INT) AS total,
  round(list_max(list_transform(color, lambda c: abs(round_even(c * 255, 0) / 255 - c))), 6) AS error FROM boxes WHERE len(color) = 30""",
    "mixed_features": """WITH b AS (SELECT DISTINCT ON (box_id) box_id, reid, list_transform(color, lambda c: sqrt(greatest(c, 0))) c FROM boxes WHERE len(color) = 30 AND len(reid) = 512),
n AS (SELECT *, greatest(sqrt(list_sum(list_transform(reid, lambda r: CAST(r AS DOUBLE) * r))), 1e-9) nr, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-9) nc FROM b),
m AS (SELECT *, greatest(sqrt(list_sum(list_transform(reid, lambda r: (r / nr) * (r / nr))) + 0.25 * list_sum(list_transform(c, lambda x: (x / nc) * (x / nc)))), 1e-9) nm FROM n)
SELECT box_id, round(reid[1] / nr / nm, 6) AS appearance, round(0.5 * c[1] / nc / nm, 6) AS colour FROM m""",
    "reid_presence": """WITH d AS (SELECT match_id, camera, count(DISTINCT box_id) n, bool_or(reid IS NOT NULL) r FROM detections GROUP BY ALL),
c AS (SELECT DISTINCT match_id, camera FROM camera_sync)
SELECT match_id, count(*) AS cameras, min(coalesce(n, 0)) AS fewest, bool_and(coalesce(n > 0 AND r, FALSE)) AS has_reid FROM c LEFT JOIN d USING (match_id, camera) GROUP BY ALL""",
    "image_sizes": f"WITH {_SIZE} SELECT match_id, camera, width, height FROM size",
    "fit_boxes": f"""WITH {_SIZE},
o AS (SELECT a.box_id, max(i / greatest((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i, 1e-9)) iou FROM b0 a JOIN b0 b ON a.match_id = b.match_id AND a.camera = b.camera AND a.fid = b.fid AND a.box_id <> b.box_id AND b.conf >= 0.25,
  LATERAL (SELECT greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) i) GROUP BY ALL),
r AS (SELECT b0.box_id, h >= 60 AND conf >= 0.5 AND coalesce(iou, 0) < 0.1 clean, x1 >= 0.02 * width AND x2 <= width - 0.02 * width AND y2 <= height - 0.02 * width inside FROM b0 JOIN size USING (match_id, camera) LEFT JOIN o USING (box_id))
SELECT box_id, inside, clean AND inside AS fit FROM r""",
    "majority_team": f"""WITH {_LABEL}, s AS (SELECT match_id, track_id, count(*) n, avg(CAST(team = 'A' AS INT)) v FROM lab GROUP BY ALL)
SELECT match_id, track_id, n AS labels, CASE WHEN n >= 3 AND v >= 0.7 THEN 'A' WHEN n >= 3 AND v <= CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE) THEN 'B' ELSE '' END AS team FROM s""",
    "point_team": f"""WITH {_LABEL}, n AS (SELECT match_id, track_id, k, team, count(*) n FROM lab GROUP BY ALL)
SELECT match_id, track_id, k, arg_min(team, (-n, team)) AS team, CAST(sum(n) AS BIGINT) AS labels FROM n GROUP BY ALL""",
    "fused_points": f"""WITH {_BOXES}, {_TB}, {_POINTS},
o AS (SELECT box_id, x, y, greatest(sigma, 1e-6) ** 2 va, (w / greatest(h, 1.0)) * 0.5 * sigma ** 2 co FROM b0 WHERE sigma IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
i AS (SELECT box_id, x, y, va / (va ** 2 - co ** 2) a, -co / (va ** 2 - co ** 2) b FROM o),
s AS (SELECT match_id, track_id, k, count(*) n, sum(a) a, sum(b) b, sum(a * x + b * y) u, sum(b * x + a * y) v FROM tb JOIN i USING (box_id) GROUP BY ALL)
SELECT match_id, track_id, k, coalesce(n, 0) AS boxes, round(coalesce((a * u - b * v) / (a ** 2 - b ** 2), x), 5) AS x, round(coalesce((a * v - b * u) / (a ** 2 - b ** 2), y), 5) AS y,
  round(coalesce(a / (a ** 2 - b ** 2), 0.25), 6) AS var, round(coalesce(-b / (a ** 2 - b ** 2), 0.0), 6) AS cov FROM pts LEFT JOIN s USING (match_id, track_id, k)""",
    "largest_view": f"""WITH {_BOXES}, {_TB}, r AS (SELECT tb.*, h, row_number() OVER (PARTITION BY tb.match_id, track_id, tb.k ORDER BY h DESC, tb.camera, box_id) r FROM tb JOIN (SELECT box_id, h FROM b0 WHERE h >= 60 AND conf >= 0.5) USING (box_id))
SELECT match_id, track_id, k, camera, box_id, h FROM r WHERE r = 1""",
    "point_invariants": f"""WITH {_BOXES}, {_TB},
t AS (SELECT match_id, count(*) FILTER (WHERE n > 1) twice FROM (SELECT match_id, track_id, k, camera, count(*) n FROM tb GROUP BY ALL) GROUP BY ALL),
s AS (SELECT match_id, count(*) boxes, count(*) FILTER (WHERE n > 1) shared FROM (SELECT match_id, box_id, count(DISTINCT track_id) n FROM tb GROUP BY ALL) GROUP BY ALL),
l AS (SELECT match_id, count(DISTINCT box_id) unknown FROM tb WHERE box_id NOT IN (SELECT box_id FROM b0) GROUP BY ALL)
SELECT match_id, boxes, twice, shared, coalesce(unknown, 0) AS unknown FROM s JOIN t USING (match_id) LEFT JOIN l USING (match_id)""",
    "source_summary": f"""WITH {_POINTS}, n AS (SELECT match_id, track_id, CAST(count(*) AS DOUBLE) n FROM pts GROUP BY ALL)
SELECT match_id, count(*) AS ids, count(*) FILTER (WHERE n > n_frames / 2) AS over_half, count(*) FILTER (WHERE n > 2 * fps) AS over_2s, round(avg(n), 6) AS mean, round(sum(n * n) / sum(n), 6) AS weighted FROM n JOIN futsal_matches USING (match_id) GROUP BY ALL""",
    "five_a_side": f"""WITH {_SEEN}, {_TEAM}, p AS (SELECT match_id, k, count(*) FILTER (WHERE team = 'A') a, count(*) FILTER (WHERE team = 'B') b FROM seen JOIN team USING (match_id, player_id) GROUP BY ALL),
e AS (SELECT match_id, count(*) FILTER (WHERE a = 5 AND b = 5) exact, max(a + b) most FROM p GROUP BY ALL) SELECT match_id, exact, most, round(exact / n_frames, 6) AS share FROM e JOIN futsal_matches USING (match_id)""",
    "jump_events": """WITH s AS (SELECT DISTINCT match_id, track_id, k, vx, vy FROM track_states WHERE vx IS NOT NULL AND vy IS NOT NULL),
j AS (SELECT DISTINCT a.match_id, a.track_id, a.k FROM s a JOIN s b ON a.match_id = b.match_id AND a.track_id = b.track_id AND a.k = b.k + 5 WHERE sqrt((a.vx - b.vx) ** 2 + (a.vy - b.vy) ** 2) > 6),
g AS (SELECT *, k - row_number() OVER (PARTITION BY match_id, track_id ORDER BY k) g FROM j)
SELECT match_id, track_id, CAST(min(k) AS BIGINT) AS first, CAST(max(k) AS BIGINT) AS last, count(*) AS rows FROM g GROUP BY match_id, track_id, g""",
    "view_support": f"""WITH {_TB}, s AS (SELECT match_id, track_id, k, string_agg(DISTINCT camera, ',' ORDER BY camera) cams, count(DISTINCT camera) n FROM tb GROUP BY ALL),
f AS (SELECT *, coalesce(k - lag(k) OVER w = 1 AND cams <> lag(cams) OVER w, FALSE) flip FROM s WINDOW w AS (PARTITION BY match_id, track_id ORDER BY k))
SELECT match_id, count(*) AS points, count(*) FILTER (WHERE n > 1) AS both, count(*) FILTER (WHERE flip) AS flips FROM f GROUP BY ALL""",
    "colour_breaks": f"""WITH {_TB}, c AS (SELECT DISTINCT ON (box_id) box_id, color FROM boxes WHERE len(color) = 30 AND list_max(color) > 0),
m AS (SELECT tb.match_id, track_id, CAST(floor(tb.k / round_even(2 * fps, 0)) AS BIGINT) chunk, i, avg(color[i]) v FROM tb JOIN c USING (box_id) JOIN futsal_matches USING (match_id), range(1, 31) r(i) GROUP BY ALL),
v AS (SELECT match_id, track_id, chunk, list(v ORDER BY i) v FROM m GROUP BY ALL)
SELECT a.match_id, a.track_id, a.chunk, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, list_cosine_similarity(a.v, b.v) < 0.9 AS broken FROM v a JOIN v b ON a.match_id = b.match_id AND a.track_id = b.track_id AND a.chunk = b.chunk + 1""",
    "track_team_agreement": f"""WITH {_LABEL}, n AS (SELECT match_id, track_id, team, CAST(count(*) AS DOUBLE) n FROM lab GROUP BY ALL),
a AS (SELECT match_id, sum(m * (m - 1) / 2) p FROM (SELECT match_id, track_id, sum(n) m FROM n GROUP BY ALL) GROUP BY ALL),
b AS (SELECT match_id, sum(m * (m - 1) / 2) p FROM (SELECT match_id, team, sum(n) m FROM n GROUP BY ALL) GROUP BY ALL),
c AS (SELECT match_id, sum(n * (n - 1) / 2) p FROM n GROUP BY ALL)
SELECT match_id, a.p AS pairs_a, b.p AS pairs_b, c.p AS both, round(2 * c.p / nullif(a.p + b.p, 0), 6) AS f1 FROM a JOIN b USING (match_id) JOIN c USING (match_id)""",
    "id_overlaps": f"""WITH {_SEEN}, {_POINTS}, p AS (SELECT a.match_id, player_id, track_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM seen a JOIN pts b ON a.match_id = b.match_id AND a.k = b.k)
SELECT match_id, player_id, track_id, count(*) AS frames, round(avg(d), 6) AS mean_m FROM p WHERE d <= 1.0 GROUP BY ALL""",
    "position_errors": f"""WITH {_SEEN}, {_POINTS}, p AS (SELECT b.match_id, b.track_id, b.k, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) d FROM seen a JOIN pts b ON a.match_id = b.match_id AND a.k = b.k GROUP BY ALL)
SELECT match_id, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median_m, round(avg(d), 6) AS mean_m, round(quantile_cont(d, 0.95), 6) AS p95_m FROM p GROUP BY ALL""",
    "quantile_gate": f"""WITH {_MUTUAL}, s AS (SELECT avg(CAST(raw_m <= 0.5 AS DOUBLE)) s, count(*) n FROM mo),
o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 i FROM mo), e AS (SELECT n, s, s * (n - 1) p FROM s)
SELECT n, round(s, 6) AS share, round((SELECT d FROM o WHERE i = floor(p)) + (p - floor(p)) * ((SELECT d FROM o WHERE i = ceil(p)) - (SELECT d FROM o WHERE i = floor(p))), 6) AS gate FROM e""",
    "alignment_summary": f"WITH {_MUTUAL} SELECT match_id, ca AS camera_a, cb AS camera_b, count(*) AS pairs, round(median(raw_m), 6) AS before_m, round(median(d), 6) AS after_m FROM mo GROUP BY ALL",
    "clock_shift": f"""WITH {_GRID}, c AS (SELECT match_id, camera, k, box_id, x, y FROM g WHERE in_court AND conf >= 0.5 AND x IS NOT NULL AND y IS NOT NULL),
p AS (SELECT a.match_id, a.camera ca, b.camera cb, s shift, a.box_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) d FROM c a, range(-5, 6) r(s) JOIN c b ON a.match_id = b.match_id AND a.k + s = b.k AND a.camera < b.camera AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 2.5 GROUP BY ALL),
m AS (SELECT match_id, ca, cb, shift, count(*) pairs, avg(d) d FROM p GROUP BY ALL HAVING count(*) >= 30),
l AS (SELECT *, CASE WHEN shift - lag(shift) OVER w = 1 THEN lag(d) OVER w END lo, CASE WHEN lead(shift) OVER w - shift = 1 THEN lead(d) OVER w END hi, row_number() OVER (PARTITION BY match_id, ca, cb ORDER BY round(d, 9), abs(shift), shift) r FROM m WINDOW w AS (PARTITION BY match_id, ca, cb ORDER BY shift))
SELECT match_id, ca AS camera_a, cb AS camera_b, CAST(shift AS INT) AS shift, pairs, round(d, 6) AS mean_m, round(shift + coalesce(CASE WHEN lo - 2 * d + hi > 1e-12 THEN greatest(least(0.5 * (lo - hi) / (lo - 2 * d + hi), 0.5), -0.5) END, 0.0), 4) AS fine FROM l WHERE r = 1""",
    "clock_fit": """WITH f AS (SELECT match_id, camera, fid, max(t) t FROM boxes GROUP BY ALL HAVING max(t) IS NOT NULL),
p AS (SELECT f.match_id, f.camera, t, round_even((t + offset_s + coalesce(drift, 0) * t - start_s) * fps, 0) / fps + start_s - t d FROM f JOIN camera_sync s ON s.match_id = f.match_id AND s.camera = f.camera JOIN futsal_matches m ON m.match_id = f.match_id),
m AS (SELECT match_id, camera, median(d) m FROM p GROUP BY ALL), e AS (SELECT p.*, abs(d - m) e FROM p JOIN m USING (match_id, camera)), a AS (SELECT match_id, camera, 1.4826 * median(e) s FROM e GROUP BY ALL),
k AS (SELECT * FROM e JOIN a USING (match_id, camera) WHERE e <= 3 * greatest(s, 1e-6))
SELECT match_id, camera, count(*) AS n, round(median(d), 5) AS offset_s, round(stddev_samp(d) / sqrt(count(*)), 6) AS stderr, round(CASE WHEN max(t) - min(t) > 600 THEN regr_slope(d, t) ELSE 0.0 END, 9) AS drift FROM k GROUP BY ALL HAVING count(*) >= 10""",
    "camera_warnings": f"""WITH {_SIZE}, f AS (SELECT match_id, camera, frame, max(t) t FROM detections GROUP BY ALL HAVING max(t) IS NOT NULL),
l AS (SELECT match_id, camera, t - lag(t) OVER (PARTITION BY match_id, camera ORDER BY frame) dt FROM f), m AS (SELECT match_id, camera, median(dt) m FROM l WHERE dt IS NOT NULL GROUP BY ALL),
i AS (SELECT match_id, camera, avg(CAST(abs(dt - m) > 0.25 * m AS INT)) irr, sum(greatest(round_even(dt / m, 0) - 1, 0)) dropped FROM l JOIN m USING (match_id, camera) WHERE dt IS NOT NULL GROUP BY ALL),
s AS (SELECT match_id, camera, max(coalesce(drift, 0)) drift FROM camera_sync GROUP BY ALL)
SELECT match_id, camera, concat_ws(', ', CASE WHEN height > width THEN 'upright' END, CASE WHEN height < 1080 THEN 'small' END, CASE WHEN round(irr, 6) > 0.05 THEN 'irregular' END, CASE WHEN dropped > 0 THEN 'dropped' END,
  CASE WHEN abs(drift) > 300e-6 THEN 'drift' END, CASE WHEN width IS NULL THEN 'no boxes' END, CASE WHEN NOT regexp_matches(camera, '^cam[0-9]+$') THEN 'name' END) AS warnings FROM s LEFT JOIN size USING (match_id, camera) LEFT JOIN i USING (match_id, camera)""",
    "frame_sampling": """WITH f AS (SELECT DISTINCT match_id, camera, frame, CAST(greatest(round_even(fps / 2.0, 0), 1) AS INT) s FROM detections JOIN futsal_matches USING (match_id))
SELECT match_id, camera, frame, (frame // s) % 3 = 0 AS appearance FROM f WHERE frame % s = 0""",
    "held_out_frames": """WITH f AS (SELECT DISTINCT match_id, camera, frame FROM detections)
SELECT match_id, camera, frame, row_number() OVER (PARTITION BY match_id, camera ORDER BY frame) > round_even(count(*) OVER (PARTITION BY match_id, camera) * 0.8, 0) AS validation FROM f""",
    "blind_codes": "SELECT DISTINCT match_id, track_id, substr(sha1(match_id || '/' || track_id), 1, 10) AS code FROM tracklets",
    "merged_points": f"""WITH {_SEEN}, {_POINTS}, u AS (SELECT match_id, CAST(player_id AS BIGINT) id, k, x, y, 0 r FROM seen UNION ALL SELECT match_id, track_id, k, x, y, 1 FROM pts),
q AS (SELECT *, row_number() OVER (PARTITION BY match_id, id, k ORDER BY r DESC) n FROM u) SELECT match_id, id, k, x, y FROM q WHERE n = 1""",
    "perimeter": """WITH m AS (SELECT DISTINCT match_id, court_length l, court_width w FROM futsal_matches),
p AS (SELECT match_id, w, least(CAST(s AS DOUBLE), l) x, u.y, FALSE e FROM m, unnest(range(0, CAST(floor(l) AS BIGINT) + 1)) r(s), unnest([0.0, w]) u(y)
UNION ALL SELECT match_id, w, u.x, least(CAST(s AS DOUBLE), w), TRUE FROM m, unnest(range(0, CAST(floor(w) AS BIGINT) + 1)) r(s), unnest([0.0, l]) u(x))
SELECT DISTINCT match_id, round(x, 2) AS x, round(y, 2) AS y FROM p WHERE NOT e OR abs(round(y, 2) - w / 2) > 1.5""",
    "tile_boxes": f"""WITH {_BOXES}, t AS (SELECT x tx, y ty FROM unnest([0, 512, 1024, 1280]) a(x), unnest([0, 440]) b(y)),
c AS (SELECT box_id, tx, ty, greatest(x1, tx) - tx a, greatest(y1, ty) - ty b, least(x2, tx + 640) - tx c, least(y2, ty + 640) - ty d, (x2 - x1) * (y2 - y1) area FROM b0, t WHERE x2 > x1 AND y2 > y1)
SELECT box_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, round(a, 4) AS x1, round(b, 4) AS y1, round(c, 4) AS x2, round(d, 4) AS y2, round(greatest(c - a, 0) * greatest(d - b, 0) / area, 6) AS share FROM c WHERE c > a AND d > b AND greatest(c - a, 0) * greatest(d - b, 0) / area >= 0.6""",
    "junctions": f"""WITH {_ENDS}, p AS (SELECT a.match_id, a.track_id a, b.track_id b, b.a.k - a.b.k gap, sqrt((b.a.x - a.b.x) ** 2 + (b.a.y - a.b.y) ** 2) d FROM ends a JOIN ends b ON a.match_id = b.match_id AND a.track_id <> b.track_id AND b.a.k - a.b.k BETWEEN -5 AND 10),
q AS (SELECT * FROM p WHERE d <= 1.0) SELECT match_id, a, b, gap, round(d, 6) AS d, count(*) OVER (PARTITION BY match_id, a) = 1 AND count(*) OVER (PARTITION BY match_id, b) = 1 AS only FROM q""",
    "end_velocities": f"""WITH {_POINTS}, v AS (SELECT match_id, track_id, k, first(struct_pack(k := k, x := x, y := y)) OVER w a, last(struct_pack(k := k, x := x, y := y)) OVER w b FROM pts WINDOW w AS (PARTITION BY match_id, track_id ORDER BY k RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT v.match_id, track_id, k, round((b.x - a.x) / ((b.k - a.k) / fps), 4) AS vx, round((b.y - a.y) / ((b.k - a.k) / fps), 4) AS vy FROM v JOIN futsal_matches USING (match_id) WHERE b.k > a.k""",
    "on_court_cap": f"""WITH {_POINTS}, h AS (SELECT match_id, track_id, k, max(CAST(len(boxes) > 0 AS INT)) h FROM track_points GROUP BY ALL), t AS (SELECT match_id, track_id, min(team) team FROM tracklets WHERE team IN ('A', 'B') GROUP BY ALL),
r AS (SELECT pts.match_id, track_id, k, h, row_number() OVER (PARTITION BY pts.match_id, k, team ORDER BY h DESC, track_id) r FROM pts JOIN h USING (match_id, track_id, k) JOIN t USING (match_id, track_id)) SELECT match_id, track_id, k, r > 5 AND h = 0 AS drop FROM r""",
    "label_runs": """WITH l AS (SELECT match_id, player_id, k, coalesce(min(team) FILTER (WHERE team IN ('A', 'B')), '') label FROM tracks GROUP BY ALL),
s AS (SELECT *, CAST(coalesce(k - lag(k) OVER w > 4 OR label <> lag(label) OVER w, TRUE) AS INT) s FROM l WINDOW w AS (PARTITION BY match_id, player_id ORDER BY k)), g AS (SELECT *, sum(s) OVER (PARTITION BY match_id, player_id ORDER BY k) g FROM s)
SELECT match_id, player_id, any_value(label) AS label, min(k) AS first, max(k) AS last, count(*) AS rows FROM g GROUP BY match_id, player_id, g""",
    "team_flips": """WITH l AS (SELECT match_id, player_id, k, min(CAST(team = 'A' AS DOUBLE)) v FROM tracks WHERE team IN ('A', 'B') GROUP BY ALL),
w AS (SELECT *, avg(v) OVER (PARTITION BY match_id, player_id ORDER BY k ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) b, avg(v) OVER (PARTITION BY match_id, player_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) a, count(*) OVER (PARTITION BY match_id, player_id ORDER BY k ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) n FROM l),
s AS (SELECT *, greatest(least(b, 1 - a), least(1 - b, a)) s FROM w WHERE n = 30), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY s DESC, k) r FROM s) SELECT match_id, player_id, k, round(s, 6) AS score FROM r WHERE r = 1""",
    "match_document": """WITH c AS (SELECT DISTINCT match_id, camera FROM camera_sync), d AS (SELECT match_id, camera, count(DISTINCT box_id) n FROM detections GROUP BY ALL),
l AS (SELECT match_id, string_agg(camera || ':' || coalesce(n, 0), ',' ORDER BY camera) c FROM c LEFT JOIN d USING (match_id, camera) GROUP BY ALL)
SELECT match_id, status, coalesce(c, '') AS cameras, match_id IN (SELECT match_id FROM tracklets) AS has_tracks FROM futsal_matches LEFT JOIN l USING (match_id)""",
    "clock_strings": f"""WITH {_SEEN}, f AS (SELECT match_id, player_id, min(k) k FROM seen GROUP BY ALL), t AS (SELECT f.*, CAST(floor(k / fps * 10 + 0.5) AS BIGINT) t FROM f JOIN futsal_matches USING (match_id))
SELECT match_id, player_id, printf('%d:%02d.%d', t // 600, (t % 600) // 10, t % 10) AS clock, round(player_id * CAST(0.618034 AS DOUBLE) - floor(player_id * CAST(0.618034 AS DOUBLE)), 6) AS hue FROM t""",
    "clock_round_trip": """WITH f AS (SELECT match_id, camera, frame, max(t) t FROM detections GROUP BY ALL HAVING max(t) IS NOT NULL), s AS (SELECT match_id, camera, max(offset_s) o, max(drift) d FROM camera_sync GROUP BY ALL)
SELECT match_id, camera, frame, round(t + o + coalesce(d, 0) * t, 6) AS ref, round(t, 6) AS back FROM f JOIN s USING (match_id, camera)""",
    "sampled_encounters": f"""WITH {_SEEN}, c AS (SELECT a.match_id, a.player_id a, b.player_id b, a.k FROM seen a JOIN seen b ON a.match_id = b.match_id AND a.k = b.k AND a.player_id < b.player_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.5),
g AS (SELECT *, sum(CASE WHEN gap > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, a, b ORDER BY k) g FROM (SELECT *, k - lag(k) OVER (PARTITION BY match_id, a, b ORDER BY k) gap FROM c)),
e AS (SELECT match_id, a, b, min(k) first, max(k) last FROM g GROUP BY match_id, a, b, g), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY first, a, b) - 1 r FROM e)
SELECT match_id, a, b, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM r WHERE r % 3 = 0 AND r < 30""",
}
