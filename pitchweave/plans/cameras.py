"""Camera queries: projection, uncertainty, frame grid, clean boxes, calibration versions, fusion, votes, timing, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.functions.clock import grid_position
from pitchweave.functions.geometry import box_covariance, inverse_3x3, jacobian, largest_eigenvalue, metres_per_pixel, overlap, project
from pitchweave.operators.blocks import core, in_blocks, series
from pitchweave.operators.joins import asof_versions, frame_pairs, mutual_nearest, overlapping, with_margin
from pitchweave.operators.quantiles import exact_quantiles
from pitchweave.sources.tables import table

#: A camera above the halfway line: image to pitch, row-major; an example calibration for cameras that bring none.
H = [0.021, 0.0013, -2.5, -0.0006, 0.062, -24.0, 0.000011, 0.0011, 1.0]


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """``boxes`` with repeated rows taken once."""
    return table(spark, sf, "boxes").drop("reid", "color").dropDuplicates(["box_id"])


def geo_project(spark: SparkSession, sf: str) -> DataFrame:
    """Detections on the pitch, back in the image, and the ground distance of a pixel there."""
    rows = table(spark, sf, "detections").select("box_id", "u", "v").distinct()
    x, y = project(H, F.col("u"), F.col("v"))
    back_u, back_v = project(inverse_3x3(H), F.col("px"), F.col("py"))
    rows = rows.withColumns({"px": x, "py": y, "mpp": metres_per_pixel(H, F.col("u"), F.col("v"))})
    return rows.select("box_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), F.round("mpp", 6).alias("mpp"), F.round(back_u, 3).alias("back_u"), F.round(back_v, 3).alias("back_v"))


def box_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """Ground covariance of each box's foot point and its largest standard deviation."""
    xx, xy, yy = box_covariance(jacobian(H, F.col("foot_u"), F.col("foot_v")), F.col("w"), F.col("h"))
    rows = boxes(spark, sf).withColumns({"xx": xx, "xy": xy, "yy": yy})
    return rows.select("box_id", F.round("xx", 6).alias("xx"), F.round("xy", 6).alias("xy"), F.round("yy", 6).alias("yy"), F.round(F.sqrt(largest_eigenvalue(F.col("xx"), F.col("xy"), F.col("yy"))), 6).alias("sd"))


def foot_points(spark: SparkSession, sf: str) -> DataFrame:
    """Foot, height and width of detections; boxes that are missing are rebuilt from the foot and the height."""
    half = 0.2 * F.col("h_px")
    rows = table(spark, sf, "detections").select("box_id", "u", "v", "h_px", "box").dropDuplicates(["box_id"])
    return rows.select(
        "box_id",
        F.round(F.coalesce((F.col("box.x1") + F.col("box.x2")) / 2, F.col("u")), 6).alias("foot_u"),
        F.round(F.coalesce("box.y2", "v"), 6).alias("foot_v"),
        F.round(F.coalesce(F.col("box.x2") - F.col("box.x1"), 2 * half), 6).alias("w"),
        F.round(F.coalesce(F.col("box.y2") - F.col("box.y1"), F.col("h_px")), 6).alias("h"),
        F.col("box").isNull().alias("rebuilt"),
    )


def grid_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes with the grid frame their camera clock gives, NULL times taken from other boxes of the source frame."""
    rows = boxes(spark, sf)
    times = rows.groupBy("match_id", "camera", "fid").agg(F.max("t").alias("ft"))
    sync = table(spark, sf, "camera_sync").dropDuplicates(["match_id", "camera"])
    grid = table(spark, sf, "futsal_matches").select("match_id", "fps", "start_s", "n_frames")
    placed = times.join(sync, ["match_id", "camera"]).join(grid, "match_id").withColumn("grid_k", F.rint(grid_position("ft", "offset_s", "drift", "start_s", "fps")).cast("int"))
    placed = placed.where("grid_k between 0 and n_frames - 1").select("match_id", "camera", "fid", "grid_k")
    return rows.drop("k").join(placed, ["match_id", "camera", "fid"]).withColumnRenamed("grid_k", "k")


def grid_frames(spark: SparkSession, sf: str) -> DataFrame:
    return grid_boxes(spark, sf).select("box_id", "k")


def clean_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes fit for appearance: at least 60 px high, confident, and hardly covered by another box of the frame."""
    rows = boxes(spark, sf).select("match_id", "camera", "fid", "box_id", "x1", "y1", "x2", "y2", "h", "conf")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("match_id", "camera", "fid")] + [F.col("a.box_id") != F.col("b.box_id"), F.col("b.conf") >= 0.25]
    cover = rows.alias("a").join(rows.alias("b"), on).groupBy(F.col("a.box_id").alias("box_id")).agg(F.max(overlap("a", "b")).alias("iou"))
    rows = rows.join(cover, "box_id", "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    return rows.select("box_id", F.round("iou", 6).alias("iou"), ((F.col("h") >= 60) & (F.col("conf") >= 0.5) & (F.col("iou") < 0.1)).alias("clean"))


def calibration_at(spark: SparkSession, sf: str) -> DataFrame:
    """Detections with the calibration version of their time: a version every 200 s of each camera's clock."""
    cameras = table(spark, sf, "camera_sync").select("match_id", "camera").distinct()
    versions = cameras.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("from_s", F.col("version") * 200.0 + 100.0)
    facts = table(spark, sf, "detections").where("t is not null").select("match_id", "camera", "box_id", "t").distinct()
    return asof_versions(facts, versions, keys=["match_id", "camera"], time="t", valid_from="from_s").select("box_id", "t", "version", "from_s")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = grid_boxes(spark, sf).where("in_court and sigma is not null and x is not null and y is not null")
    return frame_pairs(rows.select("match_id", "k", "camera", "box_id", "x", "y", "sigma", "team"), gate=1.0)


def pair_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("match_id", "k", "a", "b", F.round("d", 6).alias("d"))


def mutual_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = mutual_nearest(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", distance="d")
    return rows.select("match_id", "k", "a", "b", F.round("d", 6).alias("d"))


def clear_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_margin(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", distance="d", margin=0.7)
    return rows.select("match_id", "k", "a", "b", F.round("d", 6).alias("d"))


def fused_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual pairs merged by inverse variance."""
    rows = mutual_nearest(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", distance="d")
    wa, wb = (1 / F.greatest(F.col(c), F.lit(1e-6)) ** 2 for c in ("asig", "bsig"))
    return rows.select("match_id", "k", "a", "b", F.round((F.col("ax") * wa + F.col("bx") * wb) / (wa + wb), 6).alias("x"), F.round((F.col("ay") * wa + F.col("by") * wb) / (wa + wb), 6).alias("y"), F.round(F.sqrt(1 / (wa + wb)), 6).alias("sigma"))


def unpaired_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in court that no other camera's box comes near."""
    pairs = _pairs(spark, sf)
    met = pairs.select(F.col("a").alias("box_id")).unionByName(pairs.select(F.col("b").alias("box_id")))
    return grid_boxes(spark, sf).where("in_court and sigma is not null").select("box_id").join(met, "box_id", "left_anti")


def camera_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """Median distance and mean offset of mutual pairs by zone of 8 by 10 m, for zones with over 30 pairs."""
    rows = mutual_nearest(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", distance="d")
    rows = rows.withColumns({"zx": F.floor(F.col("ax") / 8).cast("int"), "zy": F.floor(F.col("ay") / 10).cast("int")})
    middle = exact_quantiles(rows, keys=["zx", "zy"], value="d", at={"median": 0.5}).where("n > 30").drop("n")
    zones = rows.groupBy("zx", "zy").agg(F.count("*").alias("n"), F.round(F.avg(F.col("bx") - F.col("ax")), 6).alias("dx"), F.round(F.avg(F.col("by") - F.col("ay")), 6).alias("dy"))
    return zones.join(middle, ["zx", "zy"]).select("zx", "zy", "n", F.round("median", 6).alias("median_m"), "dx", "dy")


def mutual_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual pairs with their distance ``d`` and that of the uncorrected positions, ``raw_m``."""
    rows = mutual_nearest(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", distance="d")
    raw = boxes(spark, sf).select("box_id", "x_raw", "y_raw")
    rows = rows.join(raw.withColumnsRenamed({"box_id": "a", "x_raw": "rax", "y_raw": "ray"}), "a").join(raw.withColumnsRenamed({"box_id": "b", "x_raw": "rbx", "y_raw": "rby"}), "b")
    return rows.withColumn("raw_m", F.sqrt((F.col("rax") - F.col("rbx")) ** 2 + (F.col("ray") - F.col("rby")) ** 2)).where("raw_m is not null")


def _track_boxes(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "track_points").select("match_id", "track_id", "k", F.explode("boxes").alias("b"))
    return points.select("match_id", "track_id", "k", F.col("b.camera").alias("camera"), F.col("b.box_id").alias("box_id")).distinct()


def team_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Team of each track by the height-weighted share of its boxes' labels; U where unclear or where cameras disagree."""
    label = boxes(spark, sf).where("h >= 40 and conf >= 0.4 and team in ('A', 'B')").select("box_id", "h", (F.col("team") == "A").cast("double").alias("is_a"))
    rows = _track_boxes(spark, sf).join(label, "box_id")
    per = rows.groupBy("match_id", "track_id", "camera").agg(F.sum("h").alias("h"), F.sum(F.col("h") * F.col("is_a")).alias("ha"), F.count("*").alias("n"), F.avg("is_a").alias("plain"))
    firm = F.when(F.col("n") >= 10, F.col("plain"))
    track = per.groupBy("match_id", "track_id").agg(F.sum("n").alias("labels"), (F.sum("ha") / F.sum("h")).alias("share"), F.max(firm).alias("hi"), F.min(firm).alias("lo"))
    conflict = F.coalesce((F.col("hi") >= 0.7) & (F.col("lo") <= 0.3), F.lit(False))
    return track.select("match_id", "track_id", "labels", F.round("share", 6).alias("share"), F.when(conflict, "U").when(F.col("share") >= 0.7, "A").when(F.col("share") <= 0.3, "B").otherwise("U").alias("team"))


def shared_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that more than one track claims."""
    return _track_boxes(spark, sf).groupBy("match_id", "box_id").agg(F.countDistinct("track_id").alias("tracks"), F.min("track_id").alias("first_track")).where("tracks > 1")


def box_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each match's confident boxes in court that some track uses."""
    used = _track_boxes(spark, sf).select("box_id").distinct().withColumn("used", F.lit(1))
    rows = boxes(spark, sf).where("in_court and conf >= 0.5").join(used, "box_id", "left")
    return rows.groupBy("match_id").agg(F.count("*").alias("boxes"), F.count("used").alias("used"), F.round(F.count("used") / F.count("*"), 6).alias("share"))


def frame_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals between detection frames: median, longest, irregular share and frames dropped, per camera."""
    frames = table(spark, sf, "detections").groupBy("match_id", "camera", "frame").agg(F.max("t").alias("t")).where("t is not null")
    rows = in_blocks(frames, "frame", before=100_000, after=0, block=1_000_000)
    rows = core(rows.withColumn("dt", F.col("t") - F.lag("t").over(series(["match_id", "camera"], "frame")))).where("dt is not null")
    mid = exact_quantiles(rows, keys=["match_id", "camera"], value="dt", at={"m": 0.5}).drop("n")
    rows = rows.join(mid, ["match_id", "camera"])
    return rows.groupBy("match_id", "camera").agg(
        F.count("*").alias("n"), F.round(F.max("m"), 6).alias("median_s"), F.round(F.max("dt"), 6).alias("longest_s"),
        F.round(F.avg((F.abs(F.col("dt") - F.col("m")) > 0.25 * F.col("m")).cast("int")), 6).alias("irregular"),
        F.sum(F.greatest(F.rint(F.col("dt") / F.col("m")) - 1, F.lit(0.0))).cast("bigint").alias("dropped"),
    )


def confidence_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Confident boxes and detections per camera, and the mean in the far half of the image."""
    rows = boxes(spark, sf).where("conf >= 0.5")
    own = rows.groupBy("match_id", "camera").agg(F.count("*").alias("boxes"), F.count(F.when(F.col("in_court"), 1)).alias("in_court"), F.round(F.avg(F.when(F.col("foot_v") < 540, F.col("conf"))), 6).alias("far_conf"))
    other = table(spark, sf, "detections").where("conf >= 0.5").groupBy("match_id", "camera").agg(F.countDistinct("box_id").alias("detections"))
    return own.join(other, ["match_id", "camera"], "full").select("match_id", "camera", F.coalesce("boxes", F.lit(0)).alias("boxes"), F.coalesce("in_court", F.lit(0)).alias("in_court"), "far_conf", F.coalesce("detections", F.lit(0)).alias("detections"))


def track_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracklets of a match whose spans overlap."""
    spans = table(spark, sf, "tracklets").select("match_id", "track_id", "k0", "k1").distinct().where("k0 <= k1")
    return overlapping(spans, keys=["match_id"], id="track_id", start="k0", end="k1", width=256)


def clique_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Most tracklets that exist at once, per match."""
    spans = table(spark, sf, "tracklets").select("match_id", "track_id", "k0", "k1").distinct().where("k0 <= k1")
    ends = spans.select("match_id", F.col("k0").alias("k"), F.lit(1).alias("d")).unionByName(spans.select("match_id", (F.col("k1") + 1).alias("k"), F.lit(-1).alias("d")))
    net = ends.groupBy("match_id", "k").agg(F.sum("d").alias("d"))
    depth = net.withColumn("n", F.sum("d").over(W.partitionBy("match_id").orderBy("k")))
    return depth.groupBy("match_id").agg(F.max("n").alias("most"), F.countDistinct(F.when(F.col("n") > 0, F.col("k"))).alias("changes"))


def newest_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Match list, newest first, with cameras and tidied titles."""
    cameras = table(spark, sf, "camera_sync").groupBy("match_id").agg(F.count("*").alias("cameras"), F.round(F.max(F.coalesce(F.abs("drift"), F.lit(0.0))) * 1e6, 3).alias("drift_ppm"))
    rows = table(spark, sf, "futsal_matches").join(cameras, "match_id", "left")
    title = F.nullif(F.trim(F.regexp_replace(F.lower("title"), " +", " ")), F.lit(""))
    return rows.select("match_id", title.alias("title"), "status", F.round(F.col("n_frames") / F.col("fps"), 6).alias("duration_s"), F.coalesce("cameras", F.lit(0)).alias("cameras"), "drift_ppm").orderBy(F.desc("match_id"))


_NAMES = (geo_project, box_uncertainty, foot_points, grid_frames, clean_boxes, calibration_at, pair_candidates, mutual_pairs, clear_pairs, fused_positions, unpaired_boxes, camera_disagreement, team_vote, shared_boxes, box_coverage, frame_timing, confidence_profile, track_overlaps, clique_depth, newest_matches)
QUERIES = {f.__name__: f for f in _NAMES}


def _sql_project(h: list[float], u: str, v: str) -> tuple[str, str]:
    w = f"({h[6]!r} * ({u}) + {h[7]!r} * ({v}) + {h[8]!r})"
    return f"(({h[0]!r} * ({u}) + {h[1]!r} * ({v}) + {h[2]!r}) / {w})", f"(({h[3]!r} * ({u}) + {h[4]!r} * ({v}) + {h[5]!r}) / {w})"


def _geo_sql() -> str:
    (x, y), (xu, yu), (xv, yv) = _sql_project(H, "u", "v"), _sql_project(H, "u + 1", "v"), _sql_project(H, "u", "v + 1")
    bu, bv = _sql_project(inverse_3x3(H), "px", "py")
    return f"""WITH r AS (SELECT DISTINCT box_id, CAST(u AS DOUBLE) u, CAST(v AS DOUBLE) v FROM detections),
p AS (SELECT *, {x} px, {y} py, {xu} - {x} a, {xv} - {x} b, {yu} - {y} c, {yv} - {y} d FROM r),
s AS (SELECT *, a * a + b * b + c * c + d * d s, a * d - b * c det FROM p)
SELECT box_id, round(px, 6) AS px, round(py, 6) AS py, round(sqrt((s + sqrt(greatest(s * s - 4 * det * det, 0.0))) / 2), 6) AS mpp, round({bu}, 3) AS back_u, round({bv}, 3) AS back_v FROM s"""


def _cov_sql() -> str:
    (xr, yr), (xl, yl) = _sql_project(H, "foot_u + 1", "foot_v"), _sql_project(H, "foot_u - 1", "foot_v")
    (xd, yd), (xu, yu) = _sql_project(H, "foot_u", "foot_v + 1"), _sql_project(H, "foot_u", "foot_v - 1")
    return f"""WITH b AS (SELECT DISTINCT ON (box_id) box_id, CAST(foot_u AS DOUBLE) foot_u, CAST(foot_v AS DOUBLE) foot_v, w, h FROM boxes),
j AS (SELECT box_id, greatest(0.03 * w, 1.0) su, greatest(0.05 * h, 1.0) sv, ({xr} - {xl}) / 2 a, ({xd} - {xu}) / 2 b, ({yr} - {yl}) / 2 c, ({yd} - {yu}) / 2 d FROM b),
m AS (SELECT box_id, a * a * su * su + b * b * sv * sv + 0.0225 xx, a * c * su * su + b * d * sv * sv xy, c * c * su * su + d * d * sv * sv + 0.0225 yy FROM j)
SELECT box_id, round(xx, 6) AS xx, round(xy, 6) AS xy, round(yy, 6) AS yy, round(sqrt(0.5 * (xx + yy) + sqrt(0.25 * (xx - yy) ** 2 + xy * xy)), 6) AS sd FROM m"""


_BOXES = "b0 AS (SELECT DISTINCT ON (box_id) * EXCLUDE (reid, color) FROM boxes)"
_GRID = _BOXES + """,
tm AS (SELECT match_id, camera, fid, max(t) ft FROM b0 GROUP BY ALL),
fr AS (SELECT tm.match_id, tm.camera, fid, n_frames, CAST(round_even((ft + offset_s + coalesce(drift, 0) * ft - start_s) * fps, 0) AS INT) k FROM tm JOIN camera_sync s ON s.match_id = tm.match_id AND s.camera = tm.camera JOIN futsal_matches m ON m.match_id = tm.match_id),
g AS (SELECT b0.* EXCLUDE (k), fr.k FROM b0 JOIN fr USING (match_id, camera, fid) WHERE fr.k BETWEEN 0 AND n_frames - 1)"""
_PAIRS = _GRID + """,
c AS (SELECT * FROM g WHERE in_court AND sigma IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
pr AS (SELECT a.match_id, a.k, a.camera ca, b.camera cb, a.box_id a, b.box_id b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d, a.x ax, a.y ay, a.sigma asig, b.x bx, b.y "by", b.sigma bsig
  FROM c a JOIN c b ON a.match_id = b.match_id AND a.k = b.k AND a.camera < b.camera AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= greatest(1.0, 3 * sqrt(a.sigma ** 2 + b.sigma ** 2))
  AND NOT coalesce(a.team IN ('A', 'B') AND b.team IN ('A', 'B') AND a.team <> b.team, FALSE)),
rk AS (SELECT *, row_number() OVER wa m, row_number() OVER wb y, lead(d) OVER wa ma, lead(d) OVER wb yb FROM pr
  WINDOW wa AS (PARTITION BY match_id, k, ca, cb, a ORDER BY d, b), wb AS (PARTITION BY match_id, k, ca, cb, b ORDER BY d, a)),
mu AS (SELECT * FROM rk WHERE m = 1 AND y = 1)"""
_TB = "tb AS (SELECT DISTINCT match_id, track_id, k, b.camera AS camera, b.box_id AS box_id FROM (SELECT match_id, track_id, k, unnest(boxes) b FROM track_points))"

SQL = {
    "geo_project": _geo_sql(),
    "box_uncertainty": _cov_sql(),
    "foot_points": """SELECT DISTINCT ON (box_id) box_id, round(coalesce((box.x1 + box.x2) / 2, u), 6) AS foot_u, round(coalesce(box.y2, v), 6) AS foot_v,
round(coalesce(box.x2 - box.x1, 2 * (0.2 * h_px)), 6) AS w, round(coalesce(box.y2 - box.y1, h_px), 6) AS h, box IS NULL AS rebuilt FROM detections""",
    "grid_frames": f"WITH {_GRID} SELECT box_id, k FROM g",
    "clean_boxes": f"""WITH {_BOXES},
i AS (SELECT a.box_id, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) n, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) s
  FROM b0 a JOIN b0 b ON a.match_id = b.match_id AND a.camera = b.camera AND a.fid = b.fid AND a.box_id <> b.box_id AND b.conf >= 0.25),
m AS (SELECT box_id, max(n / greatest(s - n, 1e-9)) iou FROM i GROUP BY ALL)
SELECT b0.box_id, round(coalesce(iou, 0.0), 6) AS iou, h >= 60 AND conf >= 0.5 AND coalesce(iou, 0.0) < 0.1 AS clean FROM b0 LEFT JOIN m USING (box_id)""",
    "calibration_at": """WITH v AS (SELECT DISTINCT match_id, camera, i AS version, CAST(i * 200.0 + 100.0 AS DOUBLE) from_s FROM camera_sync, (VALUES (0), (1), (2), (3), (4)) x(i)),
f AS (SELECT DISTINCT match_id, camera, box_id, t FROM detections WHERE t IS NOT NULL)
SELECT f.box_id, f.t, coalesce(v.version, 0) AS version, coalesce(v.from_s, 100.0) AS from_s FROM f ASOF LEFT JOIN v ON f.match_id = v.match_id AND f.camera = v.camera AND f.t >= v.from_s""",
    "pair_candidates": f"WITH {_PAIRS} SELECT match_id, k, a, b, round(d, 6) AS d FROM pr",
    "mutual_pairs": f"WITH {_PAIRS} SELECT match_id, k, a, b, round(d, 6) AS d FROM mu",
    "clear_pairs": f"WITH {_PAIRS} SELECT match_id, k, a, b, round(d, 6) AS d FROM mu WHERE coalesce(ma - d >= 0.7, TRUE) AND coalesce(yb - d >= 0.7, TRUE)",
    "fused_positions": f"""WITH {_PAIRS}, w AS (SELECT *, 1 / greatest(asig, 1e-6) ** 2 wa, 1 / greatest(bsig, 1e-6) ** 2 wb FROM mu)
SELECT match_id, k, a, b, round((ax * wa + bx * wb) / (wa + wb), 6) AS x, round((ay * wa + "by" * wb) / (wa + wb), 6) AS y, round(sqrt(1 / (wa + wb)), 6) AS sigma FROM w""",
    "unpaired_boxes": f"WITH {_PAIRS} SELECT box_id FROM g WHERE in_court AND sigma IS NOT NULL AND box_id NOT IN (SELECT a FROM pr UNION SELECT b FROM pr)",
    "camera_disagreement": f"""WITH {_PAIRS} SELECT CAST(floor(ax / 8) AS INT) AS zx, CAST(floor(ay / 10) AS INT) AS zy, count(*) AS n, round(median(d), 6) AS median_m, round(avg(bx - ax), 6) AS dx, round(avg("by" - ay), 6) AS dy FROM mu GROUP BY ALL HAVING count(*) > 30""",
    "team_vote": f"""WITH {_BOXES}, {_TB},
r AS (SELECT tb.*, b0.h, CAST(b0.team = 'A' AS DOUBLE) is_a FROM tb JOIN b0 USING (box_id) WHERE b0.h >= 40 AND b0.conf >= 0.4 AND b0.team IN ('A', 'B')),
p AS (SELECT match_id, track_id, camera, sum(h) h, sum(h * is_a) ha, count(*) n, avg(is_a) plain FROM r GROUP BY ALL),
t AS (SELECT match_id, track_id, CAST(sum(n) AS BIGINT) labels, sum(ha) / sum(h) share, max(plain) FILTER (WHERE n >= 10) hi, min(plain) FILTER (WHERE n >= 10) lo FROM p GROUP BY ALL)
SELECT match_id, track_id, labels, round(share, 6) AS share, CASE WHEN hi >= 0.7 AND lo <= 0.3 THEN 'U' WHEN share >= 0.7 THEN 'A' WHEN share <= 0.3 THEN 'B' ELSE 'U' END AS team FROM t""",
    "shared_boxes": f"WITH {_TB} SELECT match_id, box_id, count(DISTINCT track_id) AS tracks, min(track_id) AS first_track FROM tb GROUP BY ALL HAVING count(DISTINCT track_id) > 1",
    "box_coverage": f"WITH {_BOXES}, {_TB}, u AS (SELECT DISTINCT box_id, 1 used FROM tb) SELECT match_id, count(*) AS boxes, count(used) AS used, round(count(used) / count(*), 6) AS share FROM b0 LEFT JOIN u USING (box_id) WHERE in_court AND conf >= 0.5 GROUP BY ALL",
    "frame_timing": """WITH f AS (SELECT match_id, camera, frame, max(t) t FROM detections GROUP BY ALL HAVING max(t) IS NOT NULL),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY match_id, camera ORDER BY frame) dt FROM f),
e AS (SELECT * FROM d WHERE dt IS NOT NULL), m AS (SELECT match_id, camera, median(dt) m FROM e GROUP BY ALL)
SELECT match_id, camera, count(*) AS n, round(max(m), 6) AS median_s, round(max(dt), 6) AS longest_s, round(avg(CAST(abs(dt - m) > 0.25 * m AS INT)), 6) AS irregular, CAST(sum(greatest(round_even(dt / m, 0) - 1, 0)) AS BIGINT) AS dropped
FROM e JOIN m USING (match_id, camera) GROUP BY ALL""",
    "confidence_profile": f"""WITH {_BOXES},
o AS (SELECT match_id, camera, count(*) boxes, count(*) FILTER (WHERE in_court) in_court, round(avg(conf) FILTER (WHERE foot_v < 540), 6) far_conf FROM b0 WHERE conf >= 0.5 GROUP BY ALL),
d AS (SELECT match_id, camera, count(DISTINCT box_id) detections FROM detections WHERE conf >= 0.5 GROUP BY ALL)
SELECT match_id, camera, coalesce(boxes, 0) AS boxes, coalesce(in_court, 0) AS in_court, far_conf, coalesce(detections, 0) AS detections FROM o FULL JOIN d USING (match_id, camera)""",
    "track_overlaps": """WITH s AS (SELECT DISTINCT match_id, track_id, k0, k1 FROM tracklets WHERE k0 <= k1)
SELECT a.match_id, a.track_id AS a, b.track_id AS b, least(a.k1, b.k1) - greatest(a.k0, b.k0) + 1 AS shared FROM s a JOIN s b ON a.match_id = b.match_id AND a.track_id < b.track_id AND least(a.k1, b.k1) >= greatest(a.k0, b.k0)""",
    "clique_depth": """WITH s AS (SELECT DISTINCT match_id, track_id, k0, k1 FROM tracklets WHERE k0 <= k1),
e AS (SELECT match_id, k, sum(d) d FROM (SELECT match_id, k0 k, 1 d FROM s UNION ALL SELECT match_id, k1 + 1, -1 FROM s) GROUP BY ALL),
n AS (SELECT match_id, k, sum(d) OVER (PARTITION BY match_id ORDER BY k) n FROM e)
SELECT match_id, CAST(max(n) AS BIGINT) AS most, count(DISTINCT k) FILTER (WHERE n > 0) AS changes FROM n GROUP BY ALL""",
    "newest_matches": """WITH c AS (SELECT match_id, count(*) cameras, round(max(coalesce(abs(drift), 0.0)) * 1e6, 3) drift_ppm FROM camera_sync GROUP BY ALL)
SELECT match_id, nullif(trim(regexp_replace(lower(title), ' +', ' ', 'g')), '') AS title, status, round(n_frames / fps, 6) AS duration_s, coalesce(cameras, 0) AS cameras, drift_ppm FROM futsal_matches LEFT JOIN c USING (match_id)""",
}
