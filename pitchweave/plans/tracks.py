"""Track and tracklet queries: chains, components, appearance, similarity, physics, concurrency, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchweave.functions.geometry import hypot
from pitchweave.functions.vectors import dot, norm, two_part_distance
from pitchweave.operators.blocks import core, in_blocks, series
from pitchweave.operators.graphs import components
from pitchweave.operators.joins import band_join
from pitchweave.operators.smoothing import assign_pairs, motion_tracks, smooth_tracks
from pitchweave.plans.cameras import _pairs, grid_boxes
from pitchweave.plans.players import PLAYER, court_sql, on_court, seen, with_clock
from pitchweave.sources.tables import table

TRACK = ["match_id", "track_id"]


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks' positions on court."""
    return on_court(spark, sf, "track_points", TRACK)


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tracklets").select(*TRACK, "k0", "k1", "team").dropDuplicates(TRACK)


def track_ends(spark: SparkSession, sf: str) -> DataFrame:
    """First and last position of each track."""
    rows = points(spark, sf).groupBy(*TRACK).agg(F.min(F.struct("k", "x", "y")).alias("a"), F.max(F.struct("k", "x", "y")).alias("b"), F.count("*").alias("n"))
    return rows.select(*TRACK, F.col("a.k").alias("first"), F.col("a.x").alias("fx"), F.col("a.y").alias("fy"), F.col("b.k").alias("last"), F.col("b.x").alias("lx"), F.col("b.y").alias("ly"), "n")


def relink_candidates(spark: SparkSession, sf: str, most: int = 60, vmax: float = 9.0, slack: float = 1.5) -> DataFrame:
    """Track ends and later track starts of a match within 60 frames that a player can reach."""
    ends = with_clock(spark, sf, track_ends(spark, sf))
    a = ends.select("match_id", "fps", F.col("track_id").alias("a"), F.col("last").alias("ak"), F.col("lx").alias("ax"), F.col("ly").alias("ay"))
    b = ends.select("match_id", F.col("track_id").alias("b"), F.col("first").alias("bk"), F.col("fx").alias("bx"), F.col("fy").alias("by"))
    pairs = band_join(a, b, keys=["match_id"], left_at="ak", right_at="bk", least=1, most=most)
    d = hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    near = pairs.where(d <= vmax * (F.col("bk") - F.col("ak")) / F.col("fps") + slack)
    return near.select("match_id", "a", "b", (F.col("bk") - F.col("ak")).alias("gap"), F.round(d, 6).alias("d"))


def linked_components(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks that relink candidates connect, by the smallest track."""
    return components(track_ends(spark, sf), relink_candidates(spark, sf), keys=["match_id"], node="track_id", a="a", b="b")


def relinks(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that are both ends' nearest, and clearly so: the next one on either side is 0.5 m farther."""
    pairs = relink_candidates(spark, sf)
    wa, wb = W.partitionBy("match_id", "a").orderBy("d", "b"), W.partitionBy("match_id", "b").orderBy("d", "a")
    r = pairs.withColumns({"ra": F.row_number().over(wa), "rb": F.row_number().over(wb), "na": F.lead("d").over(wa), "nb": F.lead("d").over(wb)})
    clear = F.coalesce(F.col("na") - F.col("d") >= 0.5, F.lit(True)) & F.coalesce(F.col("nb") - F.col("d") >= 0.5, F.lit(True))
    return r.where((F.col("ra") == 1) & (F.col("rb") == 1) & clear).select("match_id", "a", "b", "gap", "d")


def tracklet_appearance(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each tracklet's first and last histogram, 0.3 upper body and 0.7 lower."""
    rows = table(spark, sf, "tracklets").select(*TRACK, "feats").dropDuplicates(TRACK).where("size(feats) > 0")
    d = two_part_distance(F.element_at("feats", 1), F.element_at("feats", -1), 15)
    return rows.select(*TRACK, F.size("feats").alias("n"), F.round(d, 4).alias("distance"))


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of each label, as rows of component and value."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def centroid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector and its label's mean."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    mean = rows.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))  # one entry a dimension
    both = table(spark, sf, "embeddings").join(centre, "label")
    return both.select("vec_id", "label", F.round(dot(F.col("embedding"), F.col("c")) / (norm(F.col("embedding")) * norm(F.col("c"))), 6).alias("cosine"))


def separation_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the ROC curve of confidence for being in court, per camera, from average ranks."""
    rows = table(spark, sf, "boxes").select("match_id", "camera", "box_id", "conf", "in_court").distinct().where("conf is not null and in_court is not null")
    # ranks from counts of equal values, so a hot camera is never ordered in one task row by row
    counts = rows.groupBy("match_id", "camera", "conf").agg(F.count("*").alias("n"), F.sum(F.col("in_court").cast("int")).alias("pos"))
    below = F.sum("n").over(W.partitionBy("match_id", "camera").orderBy("conf").rowsBetween(W.unboundedPreceding, -1))
    ranked = counts.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2)
    out = ranked.groupBy("match_id", "camera").agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.where("p > 0 and q > 0").select("match_id", "camera", F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"))


def concurrency(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks seen at once, per match: mean, most, and the share of positions that the ten longest tracks have."""
    per = points(spark, sf).groupBy("match_id", "k").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))
    long = points(spark, sf).groupBy(*TRACK).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("match_id").orderBy(F.desc("n"), "track_id"))
    share = long.withColumn("r", rank).groupBy("match_id").agg(F.round(F.sum(F.when(F.col("r") <= 10, F.col("n"))) / F.sum("n"), 6).alias("top10"), F.count("*").alias("tracks"))
    return per.join(share, "match_id")


def speed_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of at most three frames faster than 9 m/s, per match."""
    rows = with_clock(spark, sf, in_blocks(points(spark, sf), "k", before=3, after=0))
    line = series(TRACK, "k")
    gap = F.col("k") - F.lag("k").over(line)
    v = hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line)) * F.col("fps") / gap
    rows = core(rows.withColumns({"gap": gap, "v": v})).where("gap <= 3")
    return rows.groupBy("match_id").agg(F.count("*").alias("steps"), F.sum((F.col("v") > 9).cast("int")).alias("fast"), F.round(F.max("v"), 4).alias("top"))


def state_jumps(spark: SparkSession, sf: str, jump: float = 6.0, frames: int = 5) -> DataFrame:
    """States whose velocity differs by over 6 m/s from the one five frames before."""
    rows = table(spark, sf, "track_states").where("vx is not null and vy is not null").select(*TRACK, "k", "vx", "vy").distinct()
    past = rows.select(*TRACK, (F.col("k") + frames).alias("k"), F.col("vx").alias("px"), F.col("vy").alias("py"))
    d = hypot(F.col("vx") - F.col("px"), F.col("vy") - F.col("py"))
    return rows.join(past, [*TRACK, "k"]).where(d > jump).select(*TRACK, "k", F.round(d, 4).alias("jump"))


def pair_views(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracks of a match that share at least ten frames at a median distance of at most 1 m, seven tenths of them within 2 m."""
    a, b = points(spark, sf).alias("a"), points(spark, sf).alias("b")
    d = hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    pairs = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k"), F.col("a.track_id") < F.col("b.track_id")])
    out = pairs.groupBy(F.col("a.match_id").alias("match_id"), F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b")).agg(F.count("*").alias("shared"), F.round(F.median(d), 6).alias("median_m"), F.round(F.avg((d <= 2).cast("int")), 6).alias("near"))
    return out.where("shared >= 10 and median_m <= 1 and near >= 0.7")


def frames_both(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with tracks and with players."""
    return points(spark, sf).select("match_id", "k").intersect(seen(spark, sf).select("match_id", "k"))


def frames_either(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("match_id", "k").union(seen(spark, sf).select("match_id", "k")).distinct()


def frames_tracks_only(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("match_id", "k").exceptAll(seen(spark, sf).select("match_id", "k").distinct()).distinct()


def id_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of tracks in each match: team A, team B, others, then by first frame."""
    order = W.partitionBy("match_id").orderBy(F.when(F.col("team") == "A", 0).when(F.col("team") == "B", 1).otherwise(2), "k0", "track_id")
    return spans(spark, sf).select(*TRACK, F.row_number().over(order).alias("number"))


def hermite_fill(spark: SparkSession, sf: str, longest: int = 20) -> DataFrame:
    """Positions in gaps of up to 20 frames on a cubic through both ends with the speeds of the frames next to them."""
    rows = in_blocks(points(spark, sf), "k", before=longest + 3, after=longest + 3)
    line = series(TRACK, "k")
    prev, nxt, over = {}, {}, {}
    for c in ("k", "x", "y"):
        prev[f"p{c}"], nxt[f"n{c}"], over[f"m{c}"] = F.lag(c).over(line), F.lead(c).over(line), F.lead(c, 2).over(line)
    rows = rows.withColumns(prev | nxt | over).where(F.col("nk") - F.col("k") > 1).where(F.col("nk") - F.col("k") - 1 <= longest)
    gap = F.col("nk") - F.col("k")
    rows = rows.withColumn("f", F.explode(F.sequence(F.col("k") + 1, F.col("nk") - 1))).where("_core")
    s = (F.col("f") - F.col("k")) / gap
    out = {}
    for c in ("x", "y"):
        v0 = F.when(F.col("k") - F.col("pk") == 1, F.col(c) - F.col(f"p{c}")).otherwise((F.col(f"n{c}") - F.col(c)) / gap)
        v1 = F.when(F.col("mk") - F.col("nk") == 1, F.col(f"m{c}") - F.col(f"n{c}")).otherwise((F.col(f"n{c}") - F.col(c)) / gap)
        out[c] = (2 * s**3 - 3 * s**2 + 1) * F.col(c) + (s**3 - 2 * s**2 + s) * gap * v0 + (3 * s**2 - 2 * s**3) * F.col(f"n{c}") + (s**3 - s**2) * gap * v1
    return rows.select(*TRACK, F.col("f").cast("int").alias("k"), F.round(out["x"], 4).alias("x"), F.round(out["y"], 4).alias("y"))


def smoothed_players(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_clock(spark, sf, seen(spark, sf)).withColumn("dt", 1 / F.col("fps"))
    return smooth_tracks(rows, keys=PLAYER, order="k", dt="dt")


def polynomial_players(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_clock(spark, sf, seen(spark, sf)).withColumn("dt", 1 / F.col("fps"))
    return smooth_tracks(rows, keys=PLAYER, order="k", dt="dt", method="polynomial")


def box_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of each camera linked by motion."""
    return motion_tracks(grid_boxes(spark, sf).where("in_court"), keys=["match_id", "camera"], frame="k", id="box_id")


def assigned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of two cameras paired one to one at least total distance."""
    rows = assign_pairs(_pairs(spark, sf), group=["match_id", "k", "camera_a", "camera_b"], a="a", b="b", cost="d", unpaired=0.75)
    return rows.select("match_id", "k", "a", "b", F.round("d", 6).alias("d"))


_NAMES = (track_ends, relink_candidates, linked_components, relinks, tracklet_appearance, label_centroids, centroid_similarity, separation_auc, concurrency, speed_violations, state_jumps, pair_views, frames_both, frames_either, frames_tracks_only, id_numbers, hermite_fill, smoothed_players, polynomial_players, box_tracks, assigned_pairs)
QUERIES = {f.__name__: f for f in _NAMES}

_POINTS, _SEEN = court_sql("track_points", "match_id, track_id", "pts"), court_sql("tracks", "match_id, player_id", "seen")
_ENDS = _POINTS + """,
ends AS (SELECT match_id, track_id, min(struct_pack(k := k, x := x, y := y)) a, max(struct_pack(k := k, x := x, y := y)) b, count(*) n FROM pts GROUP BY ALL)"""
_RELINK = _ENDS + """,
cand AS (SELECT a.match_id, a.track_id a, b.track_id b, b.a.k - a.b.k gap, sqrt((b.a.x - a.b.x) ** 2 + (b.a.y - a.b.y) ** 2) d, fps FROM ends a JOIN ends b ON a.match_id = b.match_id AND b.a.k - a.b.k BETWEEN 1 AND 60 JOIN futsal_matches m ON m.match_id = a.match_id),
rel AS (SELECT match_id, a, b, gap, round(d, 6) d FROM cand WHERE d <= 9.0 * gap / fps + 1.5)"""

SQL = {
    "track_ends": f"WITH {_ENDS} SELECT match_id, track_id, a.k AS first, a.x AS fx, a.y AS fy, b.k AS last, b.x AS lx, b.y AS ly, n FROM ends",
    "relink_candidates": f"WITH {_RELINK} SELECT * FROM rel",
    "linked_components": f"""WITH RECURSIVE {_RELINK},
l AS (SELECT match_id, a u, b v FROM rel UNION SELECT match_id, b, a FROM rel),
w AS (SELECT match_id, track_id, track_id r FROM ends UNION SELECT w.match_id, w.track_id, l.v FROM w JOIN l ON l.match_id = w.match_id AND l.u = w.r)
SELECT match_id, track_id, min(r) AS component FROM w GROUP BY ALL""",
    "relinks": f"""WITH {_RELINK},
r AS (SELECT *, row_number() OVER wa ra, row_number() OVER wb rb, lead(d) OVER wa na, lead(d) OVER wb nb FROM rel WINDOW wa AS (PARTITION BY match_id, a ORDER BY d, b), wb AS (PARTITION BY match_id, b ORDER BY d, a))
SELECT match_id, a, b, gap, d FROM r WHERE ra = 1 AND rb = 1 AND coalesce(na - d >= 0.5, TRUE) AND coalesce(nb - d >= 0.5, TRUE)""",
    "tracklet_appearance": """WITH t AS (SELECT DISTINCT ON (match_id, track_id) match_id, track_id, feats FROM tracklets WHERE len(feats) > 0),
s AS (SELECT match_id, track_id, len(feats) n, list_transform(list_zip(feats[1], feats[-1]), lambda p: sqrt(p[1] * p[2])) z FROM t)
SELECT match_id, track_id, CAST(n AS INT) AS n, round(0.3 * sqrt(greatest(1 - list_sum(z[1:15]), 0)) + (1 - 0.3) * sqrt(greatest(1 - list_sum(z[16:30]), 0)), 4) AS distance FROM s""",
    "label_centroids": "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY ALL",
    "centroid_similarity": """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) v FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
c AS (SELECT label, list(v ORDER BY i) c FROM m GROUP BY ALL)
SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS cosine FROM embeddings JOIN c USING (label)""",
    "separation_auc": """WITH r AS (SELECT DISTINCT match_id, camera, box_id, conf, in_court FROM boxes WHERE conf IS NOT NULL AND in_court IS NOT NULL),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY match_id, camera, conf) - 1) / 2 rk FROM r WINDOW w AS (PARTITION BY match_id, camera ORDER BY conf)),
a AS (SELECT match_id, camera, sum(rk) FILTER (WHERE in_court) s, count(*) FILTER (WHERE in_court) p, count(*) FILTER (WHERE NOT in_court) q FROM k GROUP BY ALL)
SELECT match_id, camera, round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM a WHERE p > 0 AND q > 0""",
    "concurrency": f"""WITH {_POINTS},
n AS (SELECT match_id, k, count(*) n FROM pts GROUP BY ALL), p AS (SELECT match_id, round(avg(n), 6) mean, max(n) most FROM n GROUP BY ALL),
l AS (SELECT match_id, track_id, count(*) n FROM pts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, track_id) r FROM l),
s AS (SELECT match_id, round(sum(n) FILTER (WHERE r <= 10) / sum(n), 6) top10, count(*) tracks FROM r GROUP BY ALL) SELECT * FROM p JOIN s USING (match_id)""",
    "speed_violations": f"""WITH {_POINTS},
d AS (SELECT match_id, k - lag(k) OVER w gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) d FROM pts WINDOW w AS (PARTITION BY match_id, track_id ORDER BY k)),
v AS (SELECT match_id, d * fps / gap v FROM d JOIN futsal_matches USING (match_id) WHERE gap <= 3)
SELECT match_id, count(*) AS steps, CAST(sum(CAST(v > 9 AS INT)) AS BIGINT) AS fast, round(max(v), 4) AS top FROM v GROUP BY ALL""",
    "state_jumps": """WITH s AS (SELECT DISTINCT match_id, track_id, k, vx, vy FROM track_states WHERE vx IS NOT NULL AND vy IS NOT NULL),
j AS (SELECT a.match_id, a.track_id, a.k, sqrt((a.vx - b.vx) ** 2 + (a.vy - b.vy) ** 2) d FROM s a JOIN s b ON a.match_id = b.match_id AND a.track_id = b.track_id AND a.k = b.k + 5)
SELECT match_id, track_id, k, round(d, 4) AS jump FROM j WHERE d > 6""",
    "pair_views": f"""WITH {_POINTS},
p AS (SELECT a.match_id, a.track_id a, b.track_id b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM pts a JOIN pts b ON a.match_id = b.match_id AND a.k = b.k AND a.track_id < b.track_id)
SELECT match_id, a, b, count(*) AS shared, round(median(d), 6) AS median_m, round(avg(CAST(d <= 2 AS INT)), 6) AS near FROM p GROUP BY ALL HAVING count(*) >= 10 AND round(median(d), 6) <= 1 AND round(avg(CAST(d <= 2 AS INT)), 6) >= 0.7""",
    "frames_both": f"WITH {_POINTS}, {_SEEN} SELECT match_id, k FROM pts INTERSECT SELECT match_id, k FROM seen",
    "frames_either": f"WITH {_POINTS}, {_SEEN} SELECT match_id, k FROM pts UNION SELECT match_id, k FROM seen",
    "frames_tracks_only": f"WITH {_POINTS}, {_SEEN} SELECT DISTINCT match_id, k FROM (SELECT match_id, k FROM pts EXCEPT ALL SELECT DISTINCT match_id, k FROM seen)",
    "id_numbers": """WITH t AS (SELECT DISTINCT match_id, track_id, team, k0 FROM tracklets)
SELECT match_id, track_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY CASE team WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, k0, track_id) AS INT) AS number FROM t""",
    "hermite_fill": f"""WITH {_POINTS},
w AS (SELECT *, lag(k) OVER w pk, lag(x) OVER w px, lag(y) OVER w py, lead(k) OVER w nk, lead(x) OVER w nx, lead(y) OVER w ny, lead(k, 2) OVER w mk, lead(x, 2) OVER w mx, lead(y, 2) OVER w my FROM pts WINDOW w AS (PARTITION BY match_id, track_id ORDER BY k)),
g AS (SELECT *, nk - k g, CASE WHEN k - pk = 1 THEN x - px ELSE (nx - x) / (nk - k) END vx0, CASE WHEN k - pk = 1 THEN y - py ELSE (ny - y) / (nk - k) END vy0,
  CASE WHEN mk - nk = 1 THEN mx - nx ELSE (nx - x) / (nk - k) END vx1, CASE WHEN mk - nk = 1 THEN my - ny ELSE (ny - y) / (nk - k) END vy1 FROM w WHERE nk - k BETWEEN 2 AND 21),
f AS (SELECT *, (f - k) / g s FROM g, unnest(range(k + 1, nk)) u(f))
SELECT match_id, track_id, CAST(f AS INT) AS k, round((2 * s ** 3 - 3 * s ** 2 + 1) * x + (s ** 3 - 2 * s ** 2 + s) * g * vx0 + (3 * s ** 2 - 2 * s ** 3) * nx + (s ** 3 - s ** 2) * g * vx1, 4) AS x,
  round((2 * s ** 3 - 3 * s ** 2 + 1) * y + (s ** 3 - 2 * s ** 2 + s) * g * vy0 + (3 * s ** 2 - 2 * s ** 3) * ny + (s ** 3 - s ** 2) * g * vy1, 4) AS y FROM f""",
}
