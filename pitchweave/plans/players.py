"""Player metrics: distance, speed, sprints, presence, heat maps, noise, events and runs of presence."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchweave.functions.geometry import contains, hypot
from pitchweave.operators.blocks import core, in_blocks, islands, pieces, series
from pitchweave.operators.fill import stand_ins, without_stand_ins
from pitchweave.operators.quantiles import exact_quantiles
from pitchweave.operators.smoothing import smooth_tracks
from pitchweave.session import cut
from pitchweave.sources.tables import table

SPRINT_MS, SPRINT_S, SPAN_S, GAP_S = 5.5, 1.0, 0.5, 2.0
#: Bounds the context of windows that are given in seconds; speeds take the largest fps there is where that is more.
MAX_FPS = 60
#: Frames in which a player crosses any hall, so that no step over more of them is too fast.
FAR_FRAMES = 8 * MAX_FPS
PLAYER = ["match_id", "player_id"]
#: Metres beyond the lines where a position still counts.
COURT_MARGIN_M = 1.0


def on_court(spark: SparkSession, sf: str, name: str, keys: list[str]) -> DataFrame:
    """One row per series and frame of ``tracks`` or ``track_points`` with a true position up to a metre beyond its match's lines.

    Positions written for missing ones are learned from the table; frames before the match's start are left out.
    """
    rows = table(spark, sf, name).where("k >= 0")
    rows = without_stand_ins(rows, ["x", "y"], stand_ins(rows, ["x", "y"], entity=keys, source="match_id"))
    court = table(spark, sf, "futsal_matches").groupBy("match_id").agg(F.max("court_length").alias("len_"), F.max("court_width").alias("wid_"))
    rows = rows.join(court, "match_id").where(contains("x", "y", "len_", "wid_", COURT_MARGIN_M))
    return rows.groupBy(*keys, "k").agg(F.min_by("x", F.struct("x", "y")).alias("x"), F.min_by("y", F.struct("x", "y")).alias("y"))


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """Players' positions on court."""
    return on_court(spark, sf, "tracks", PLAYER)


def with_clock(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    return df.join(table(spark, sf, "futsal_matches").select("match_id", "fps", "n_frames", "court_length", "court_width"), "match_id")


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Distance from the previous frame; NULL where that frame is not seen."""
    rows = in_blocks(seen(spark, sf), "k", before=1, after=0)
    line = series(PLAYER, "k")
    rows = core(rows.withColumns({"pk": F.lag("k").over(line), "px": F.lag("x").over(line), "py": F.lag("y").over(line)}))
    return rows.select(*PLAYER, "k", F.when(F.col("k") - F.col("pk") == 1, hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("step"))


def _fastest(spark: SparkSession, sf: str) -> int:
    """The largest fps of any match, rounded up, ``MAX_FPS`` at least."""
    fps = table(spark, sf, "futsal_matches").where(F.col("fps") < float("inf")).agg(F.max("fps")).first()[0]
    return max(MAX_FPS, ceil(fps or 0))


def speeds(spark: SparkSession, sf: str) -> DataFrame:
    """Speed over half a second around a frame: from n div 2 frames before it to n - n div 2 after it, n = rint(fps / 2)."""
    return _speeds_of(spark, sf, seen(spark, sf))


def _speeds_of(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Two equi-joins on the frame; each moves a row to the frame whose speed it takes part in."""
    rows = with_clock(spark, sf, rows)
    n = F.greatest(F.rint(F.col("fps") * SPAN_S), F.lit(1.0)).try_cast("int")
    back = F.floor(n / 2)
    a = rows.select(*PLAYER, (F.col("k") + back).cast("bigint").alias("k"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = rows.select(*PLAYER, (F.col("k") + back - n).cast("bigint").alias("k"), F.col("x").alias("bx"), F.col("y").alias("by"))
    both = rows.select(*PLAYER, F.col("k").cast("bigint").alias("k"), "fps", n.alias("n")).join(a, [*PLAYER, "k"], "left").join(b, [*PLAYER, "k"], "left")
    return both.select(*PLAYER, F.col("k").cast(rows.schema["k"].dataType).alias("k"), "fps", (hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) * F.col("fps") / F.col("n")).alias("speed"))


def track_steps(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select(*PLAYER, "k", F.round("step", 6).alias("step"))


def track_speeds(spark: SparkSession, sf: str) -> DataFrame:
    return speeds(spark, sf).where("speed is not null").select(*PLAYER, "k", F.round("speed", 6).alias("speed"))


def sprint_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at least a second at sprint speed."""
    fast = speeds(spark, sf).where(F.col("speed") >= SPRINT_MS)
    runs = islands(fast.select(*PLAYER, "k"), keys=PLAYER, order="k", most=1)
    fps = table(spark, sf, "futsal_matches").select("match_id", "fps")
    return runs.join(fps, "match_id").where(F.col("rows") >= F.rint(F.col("fps") * SPRINT_S)).select(*PLAYER, "first", "last", "rows")


def player_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Distance, top and mean speed, sprints and share of frames seen, per player."""
    distance = steps(spark, sf).groupBy(*PLAYER).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("d"), F.count("*").alias("n"))
    speed = speeds(spark, sf).groupBy(*PLAYER).agg(F.max("speed").alias("top"), F.avg("speed").alias("mean"))
    sprints = sprint_runs(spark, sf).groupBy(*PLAYER).agg(F.count("*").alias("sprints"))
    frames = table(spark, sf, "futsal_matches").select("match_id", "n_frames")
    out = distance.join(speed, PLAYER, "left").join(sprints, PLAYER, "left").join(frames, "match_id")
    return out.select(
        *PLAYER,
        F.round("d", 4).alias("distance_m"),
        F.round("top", 4).alias("max_speed_ms"),
        F.round("mean", 4).alias("mean_speed_ms"),
        F.coalesce("sprints", F.lit(0)).cast("bigint").alias("sprints"),
        F.round(F.col("n") / F.col("n_frames"), 6).alias("seen_ratio"),
    )


def player_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """``player_summary`` from smoothed positions, so that jitter is no running; gaps of up to two seconds are bridged."""
    rows = with_clock(spark, sf, seen(spark, sf)).withColumn("dt", 1 / F.col("fps"))
    line = cut(smooth_tracks(rows, keys=PLAYER, order="k", dt="dt", gap_s=GAP_S))
    reach = _fastest(spark, sf) // 4 + 1
    near = with_clock(spark, sf, in_blocks(line, "k", before=reach, after=reach))
    by = series(PLAYER, "k")
    step = F.when(F.col("k") - F.lag("k").over(by) == 1, hypot(F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)))
    walked = core(near.withColumn("step", step)).groupBy(*PLAYER).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance_m"))
    fast = cut(_speeds_of(spark, sf, line))
    speed = fast.groupBy(*PLAYER).agg(F.max("speed").alias("max_speed_ms"), F.avg("speed").alias("mean_speed_ms"))
    runs = islands(fast.where(F.col("speed") >= SPRINT_MS).select(*PLAYER, "k"), keys=PLAYER, order="k", most=1)
    fps = table(spark, sf, "futsal_matches").select("match_id", "fps", "n_frames")
    sprints = runs.join(fps, "match_id").where(F.col("rows") >= F.rint(F.col("fps") * SPRINT_S)).groupBy(*PLAYER).agg(F.count("*").alias("sprints"))
    share = seen(spark, sf).groupBy(*PLAYER).agg(F.count("*").alias("n")).join(fps, "match_id").select(*PLAYER, F.round(F.col("n") / F.col("n_frames"), 6).alias("seen_ratio"))
    out = share.join(walked, PLAYER).join(speed, PLAYER, "left").join(sprints, PLAYER, "left")
    return out.select(*PLAYER, *[F.round(c, 4).alias(c) for c in ("distance_m", "max_speed_ms", "mean_speed_ms")], F.coalesce("sprints", F.lit(0)).alias("sprints"), "seen_ratio")


def heatmap(spark: SparkSession, sf: str, cell: float = 1.0) -> DataFrame:
    """Share of each player's positions in each cell; cells are length / ceil(length / cell) wide, the far edges inclusive."""
    rows = with_clock(spark, sf, seen(spark, sf)).where("x between 0 and court_length and y between 0 and court_width")
    nx, ny = F.ceil(F.col("court_length") / cell), F.ceil(F.col("court_width") / cell)
    rows = rows.withColumns({"ix": F.least(F.floor(F.col("x") / (F.col("court_length") / nx)), nx - 1), "iy": F.least(F.floor(F.col("y") / (F.col("court_width") / ny)), ny - 1)})
    cells = rows.groupBy(*PLAYER, "ix", "iy").agg(F.count("*").alias("n"))
    total = cells.groupBy(*PLAYER).agg(F.sum("n").alias("total"))
    return cells.join(total, PLAYER).select(*PLAYER, F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def heatmap_blur(spark: SparkSession, sf: str) -> DataFrame:
    """Occupancy of two-metre cells per match, spread to the eight neighbours at half weight, clamped into the court."""
    rows = with_clock(spark, sf, seen(spark, sf))
    ix = F.greatest(F.least(F.floor(F.col("x") / 2), F.ceil(F.col("court_length") / 2) - 1), F.lit(0))
    iy = F.greatest(F.least(F.floor(F.col("y") / 2), F.ceil(F.col("court_width") / 2) - 1), F.lit(0))
    cells = rows.groupBy("match_id", ix.alias("ix"), iy.alias("iy"), F.ceil(F.col("court_length") / 2).alias("nx"), F.ceil(F.col("court_width") / 2).alias("ny")).agg(F.count("*").alias("n"))
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(1.0 if dx == dy == 0 else 0.5).alias("w")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    spread = cells.withColumn("o", F.explode(offsets)).select("match_id", "nx", "ny", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("n") * F.col("o.w")).alias("w"))
    return spread.where("ix between 0 and nx - 1 and iy between 0 and ny - 1").groupBy("match_id", F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy")).agg(F.round(F.sum("w"), 4).alias("heat"))


def noise_level(spark: SparkSession, sf: str) -> DataFrame:
    """Measurement noise per player: 1.4826 MAD of second differences over the root of six, at least 3 cm."""
    rows = in_blocks(seen(spark, sf), "k", before=2, after=0)
    line = series(PLAYER, "k")
    rows = core(rows.withColumns({f"{c}{i}": F.lag(c, i).over(line) for c in ("k", "x", "y") for i in (1, 2)}))
    d = rows.where("k - k1 = 1 and k - k2 = 2").select(*PLAYER, F.explode(F.array(F.col("x") - 2 * F.col("x1") + F.col("x2"), F.col("y") - 2 * F.col("y1") + F.col("y2"))).alias("d"))
    d = cut(d)
    mid = exact_quantiles(d, keys=PLAYER, value="d", at={"m": 0.5}).drop("n")
    off = d.join(mid, PLAYER).select(*PLAYER, F.abs(F.col("d") - F.col("m")).alias("e"))
    return exact_quantiles(off, keys=PLAYER, value="e", at={"mad": 0.5}).select(*PLAYER, F.round(F.greatest(F.col("mad") * (1.4826 / 6**0.5), F.lit(0.03)), 6).alias("noise"))


def presence_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs in which a player is never unseen for more than two seconds."""
    rows = with_clock(spark, sf, seen(spark, sf)).withColumn("most", F.floor(F.col("fps") * GAP_S))
    return islands(rows, keys=PLAYER, order="k", most="most", halo=int(MAX_FPS * GAP_S))


def first_and_last(spark: SparkSession, sf: str, settle_s: float = 2.0, edge_m: float = 2.5) -> DataFrame:
    """Players who appear or vanish in mid-pitch and not near the match's start or end."""
    ends = seen(spark, sf).groupBy(*PLAYER).agg(F.min(F.struct("k", "x", "y")).alias("new"), F.max(F.struct("k", "x", "y")).alias("lost"))
    rows = with_clock(spark, sf, ends).select(*PLAYER, "fps", "n_frames", "court_length", "court_width", F.explode(F.array(F.struct(F.lit("new").alias("kind"), F.col("new").alias("p")), F.struct(F.lit("lost").alias("kind"), F.col("lost").alias("p")))).alias("e"))
    k, x, y = F.col("e.p.k"), F.col("e.p.x"), F.col("e.p.y")
    inside = (x >= edge_m) & (x <= F.col("court_length") - edge_m) & (y >= edge_m) & (y <= F.col("court_width") - edge_m)
    settle = settle_s * F.col("fps")
    late = F.when(F.col("e.kind") == "new", k > settle).otherwise(k < F.col("n_frames") - 1 - settle)
    return rows.where(inside & late).select(*PLAYER, F.col("e.kind").alias("kind"), k.alias("k"), F.round(k / F.col("fps"), 6).alias("t"), x.alias("x"), y.alias("y"))


def jump_pieces(spark: SparkSession, sf: str, vmax: float = 9.0, slack: float = 0.5) -> DataFrame:
    """Tracks cut where a step is faster than a player: first and last frame and rows of each piece."""
    rows = in_blocks(with_clock(spark, sf, seen(spark, sf)), "k", before=FAR_FRAMES, after=0)
    line = series(PLAYER, "k")
    far = hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line)) > vmax * (F.col("k") - F.lag("k").over(line)) / F.col("fps") + slack
    rows = pieces(core(rows.withColumn("far", far)), keys=PLAYER, order="k", starts="far")
    return rows.groupBy(*PLAYER, "piece").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("rows"))


def player_team(spark: SparkSession, sf: str) -> DataFrame:
    """Known team of each player, the commoner one."""
    return table(spark, sf, "tracks").where(F.col("team").isin("A", "B")).groupBy(*PLAYER).agg(F.mode("team", True).alias("team"))


def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of players of a match, of no two known teams, at the same spot: at least 3 shared frames, median distance below
    0.8 m, four fifths of them below 1.5 m; with the share of the shorter one's frames that they share."""
    rows = seen(spark, sf).join(player_team(spark, sf), PLAYER, "left")
    a, b = rows.alias("a"), rows.alias("b")
    same = F.coalesce(F.col("a.team") == F.col("b.team"), F.lit(True))
    pairs = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k"), F.col("a.player_id") < F.col("b.player_id"), same])
    d = hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    out = pairs.groupBy(F.col("a.match_id").alias("match_id"), F.col("a.player_id").alias("a"), F.col("b.player_id").alias("b")).agg(F.count("*").alias("shared"), F.median(d).alias("median"), F.avg((d < 1.5).cast("int")).alias("share_near"))
    size = seen(spark, sf).groupBy(*PLAYER).agg(F.count("*").alias("n"))
    out = out.where("shared >= 3 and median < 0.8 and share_near >= 0.8")
    for side in ("a", "b"):
        out = out.join(size.select("match_id", F.col("player_id").alias(side), F.col("n").alias(f"n{side}")), ["match_id", side])
    return out.select("match_id", "a", "b", "shared", F.round("median", 6).alias("median_m"), F.round("share_near", 6).alias("near"), F.round(F.col("shared") / F.least("na", "nb"), 6).alias("of_shorter"))


def encounters(spark: SparkSession, sf: str, near_m: float = 1.5) -> DataFrame:
    """Stretches in which two players are within 1.5 m, joined over gaps of up to 10 frames, with the closest distance."""
    a, b = seen(spark, sf).alias("a"), seen(spark, sf).alias("b")
    d = hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    close = a.join(b, [F.col("a.match_id") == F.col("b.match_id"), F.col("a.k") == F.col("b.k"), F.col("a.player_id") < F.col("b.player_id"), d < near_m])
    close = close.select(F.col("a.match_id").alias("match_id"), F.col("a.player_id").alias("a"), F.col("b.player_id").alias("b"), F.col("a.k").alias("k"))
    return islands(close, keys=["match_id", "a", "b"], order="k", most=10)


def team_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per match, the frames with exactly five, with more and with fewer than five seen players of each known team."""
    team = table(spark, sf, "tracks").where(F.col("team").isin("A", "B")).groupBy(*PLAYER).agg(F.mode("team", True).alias("team"))
    per = seen(spark, sf).join(team, PLAYER).groupBy("match_id", "team", "k").agg(F.count("*").alias("n"))
    return per.groupBy("match_id", "team").agg(F.sum((F.col("n") == 5).cast("int")).alias("exact"), F.sum((F.col("n") > 5).cast("int")).alias("over"), F.sum((F.col("n") < 5).cast("int")).alias("under"), F.round(F.avg("n"), 6).alias("mean"))


def team_zone_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Positions by team and third of the pitch with all subtotals."""
    team = table(spark, sf, "tracks").where(F.col("team").isin("A", "B")).groupBy(*PLAYER).agg(F.mode("team", True).alias("team"))
    rows = with_clock(spark, sf, seen(spark, sf)).join(team, PLAYER).withColumn("zone", F.least(F.greatest(F.floor(F.col("x") * 3 / F.col("court_length")), F.lit(0)), F.lit(2)).cast("int"))
    return rows.cube("team", "zone").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


QUERIES = {f.__name__: f for f in (track_steps, track_speeds, sprint_runs, player_summary, player_metrics, heatmap, heatmap_blur, noise_level, presence_runs, first_and_last, jump_pieces, duplicate_pairs, encounters, team_counts, team_zone_cube)}



def court_sql(source: str, keys: str, name: str) -> str:
    """SQL of ``on_court``."""
    return f"""{name}_all AS (SELECT * FROM {source} WHERE k >= 0 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)),
{name}_fake AS (SELECT x, y FROM {name}_all GROUP BY x, y HAVING count(*) >= 8 AND count(*) >= 0.001 * (SELECT count(*) FROM {name}_all) AND count(DISTINCT ({keys})) > 1),
{name}_own AS (SELECT match_id, x, y FROM (SELECT *, count(*) OVER (PARTITION BY match_id) size FROM {name}_all) GROUP BY match_id, x, y HAVING count(*) >= 8 AND count(*) >= 0.005 * max(size) AND count(DISTINCT ({keys})) > 1),
{name} AS (SELECT {keys}, k, min(struct_pack(x := x, y := y)).x AS x, min(struct_pack(x := x, y := y)).y AS y
  FROM {name}_all a JOIN futsal_matches m USING (match_id) WHERE x BETWEEN -1 AND court_length + 1 AND y BETWEEN -1 AND court_width + 1
  AND NOT EXISTS (SELECT 1 FROM {name}_fake f WHERE f.x = a.x AND f.y = a.y)
  AND NOT EXISTS (SELECT 1 FROM {name}_own o WHERE o.match_id = a.match_id AND o.x = a.x AND o.y = a.y) GROUP BY ALL)"""


_SEEN = court_sql("tracks", "match_id, player_id", "seen") + """,
clock AS (SELECT match_id, fps, n_frames, court_length, court_width FROM futsal_matches)"""
_STEPS = _SEEN + """,
steps AS (SELECT match_id, player_id, k, CASE WHEN k - lag(k) OVER w = 1 THEN sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) END AS step
  FROM seen WINDOW w AS (PARTITION BY match_id, player_id ORDER BY k))"""
_SPEEDS = _STEPS + """,
span AS (SELECT match_id, fps, CAST(greatest(round_even(fps * 0.5, 0), 1) AS INT) AS n FROM clock),
speeds AS (SELECT s.match_id, s.player_id, s.k, p.fps, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) * p.fps / p.n AS speed
  FROM seen s JOIN span p ON s.match_id = p.match_id
  JOIN seen a ON a.match_id = s.match_id AND a.player_id = s.player_id AND a.k = s.k - p.n // 2
  JOIN seen b ON b.match_id = s.match_id AND b.player_id = s.player_id AND b.k = s.k - p.n // 2 + p.n)"""


def _islands(source: str, keys: str, most: str, name: str = "runs") -> str:
    return f"""{name}_m AS (SELECT *, sum(CASE WHEN gap > {most} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY k) AS g
  FROM (SELECT *, k - lag(k) OVER (PARTITION BY {keys} ORDER BY k) AS gap FROM {source})),
{name} AS (SELECT {keys}, CAST(min(k) AS BIGINT) AS first, CAST(max(k) AS BIGINT) AS last, count(*) AS rows FROM {name}_m GROUP BY {keys}, g)"""


_SPRINTS = _SPEEDS + ",\nfast AS (SELECT * FROM speeds WHERE speed >= 5.5),\n" + _islands("fast", "match_id, player_id", "1") + """,
sprints AS (SELECT match_id, player_id, first, last, rows FROM runs JOIN clock USING (match_id) WHERE rows >= round_even(fps * 1.0, 0))"""
_TEAM = "team AS (SELECT match_id, player_id, arg_min(team, (-n, team)) AS team FROM (SELECT match_id, player_id, team, count(*) n FROM tracks WHERE team IN ('A', 'B') GROUP BY ALL) GROUP BY ALL)"

SQL = {
    "track_steps": f"WITH {_STEPS} SELECT match_id, player_id, k, round(step, 6) AS step FROM steps",
    "track_speeds": f"WITH {_SPEEDS} SELECT match_id, player_id, k, round(speed, 6) AS speed FROM speeds",
    "sprint_runs": f"WITH {_SPRINTS} SELECT * FROM sprints",
    "player_summary": f"""WITH {_SPRINTS},
d AS (SELECT match_id, player_id, coalesce(sum(step), 0.0) d, count(*) n FROM steps GROUP BY ALL),
v AS (SELECT match_id, player_id, max(speed) top, avg(speed) mean FROM speeds GROUP BY ALL),
c AS (SELECT match_id, player_id, count(*) sprints FROM sprints GROUP BY ALL)
SELECT match_id, player_id, round(d, 4) AS distance_m, round(top, 4) AS max_speed_ms, round(mean, 4) AS mean_speed_ms, coalesce(sprints, 0) AS sprints, round(n / n_frames, 6) AS seen_ratio
FROM d LEFT JOIN v USING (match_id, player_id) LEFT JOIN c USING (match_id, player_id) JOIN clock USING (match_id)""",
    "heatmap": f"""WITH {_SEEN},
c AS (SELECT match_id, player_id, CAST(least(floor(x / (court_length / ceil(court_length))), ceil(court_length) - 1) AS INT) ix, CAST(least(floor(y / (court_width / ceil(court_width))), ceil(court_width) - 1) AS INT) iy, count(*) n
  FROM seen JOIN clock USING (match_id) WHERE x BETWEEN 0 AND court_length AND y BETWEEN 0 AND court_width GROUP BY ALL)
SELECT match_id, player_id, ix, iy, n, round(n / sum(n) OVER (PARTITION BY match_id, player_id), 6) AS share FROM c""",
    "heatmap_blur": f"""WITH {_SEEN},
c AS (SELECT match_id, greatest(least(floor(x / 2), ceil(court_length / 2) - 1), 0) ix, greatest(least(floor(y / 2), ceil(court_width / 2) - 1), 0) iy, ceil(court_length / 2) nx, ceil(court_width / 2) ny, count(*) n
  FROM seen JOIN clock USING (match_id) GROUP BY ALL),
o AS (SELECT dx, dy, CASE WHEN dx = 0 AND dy = 0 THEN 1.0 ELSE 0.5 END w FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))
SELECT match_id, CAST(ix + dx AS INT) AS ix, CAST(iy + dy AS INT) AS iy, round(CAST(sum(n * w) AS DOUBLE), 4) AS heat FROM c, o WHERE ix + dx BETWEEN 0 AND nx - 1 AND iy + dy BETWEEN 0 AND ny - 1 GROUP BY ALL""",
    "noise_level": f"""WITH {_SEEN},
l AS (SELECT *, lag(k, 1) OVER w k1, lag(k, 2) OVER w k2, lag(x, 1) OVER w x1, lag(x, 2) OVER w x2, lag(y, 1) OVER w y1, lag(y, 2) OVER w y2 FROM seen WINDOW w AS (PARTITION BY match_id, player_id ORDER BY k)),
d AS (SELECT match_id, player_id, unnest([x - 2 * x1 + x2, y - 2 * y1 + y2]) d FROM l WHERE k - k1 = 1 AND k - k2 = 2),
m AS (SELECT match_id, player_id, median(d) m FROM d GROUP BY ALL)
SELECT match_id, player_id, round(greatest(median(abs(d - m)) * (1.4826 / sqrt(6)), 0.03), 6) AS noise FROM d JOIN m USING (match_id, player_id) GROUP BY ALL""",
    "presence_runs": f"WITH {_SEEN},\nr AS (SELECT seen.*, fps FROM seen JOIN clock USING (match_id)),\n" + _islands("r", "match_id, player_id", "CAST(floor(fps * 2) AS INT)") + " SELECT * FROM runs",
    "first_and_last": f"""WITH {_SEEN},
e AS (SELECT match_id, player_id, 'new' kind, min(struct_pack(k := k, x := x, y := y)) p FROM seen GROUP BY ALL UNION ALL SELECT match_id, player_id, 'lost', max(struct_pack(k := k, x := x, y := y)) FROM seen GROUP BY ALL)
SELECT match_id, player_id, kind, p.k AS k, round(p.k / fps, 6) AS t, p.x AS x, p.y AS y FROM e JOIN clock USING (match_id)
WHERE p.x BETWEEN 2.5 AND court_length - 2.5 AND p.y BETWEEN 2.5 AND court_width - 2.5 AND CASE WHEN kind = 'new' THEN p.k > 2.0 * fps ELSE p.k < n_frames - 1 - 2.0 * fps END""",
    "jump_pieces": f"""WITH {_SEEN},
f AS (SELECT match_id, player_id, k, coalesce(CAST(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) > 9.0 * (k - lag(k) OVER w) / fps + 0.5 AS INT), 0) far FROM seen JOIN clock USING (match_id) WINDOW w AS (PARTITION BY match_id, player_id ORDER BY k)),
g AS (SELECT *, sum(far) OVER (PARTITION BY match_id, player_id ORDER BY k) piece FROM f)
SELECT match_id, player_id, CAST(piece AS BIGINT) AS piece, min(k) AS first, max(k) AS last, count(*) AS rows FROM g GROUP BY match_id, player_id, piece""",
    "duplicate_pairs": f"""WITH {_SEEN}, {_TEAM},
t AS (SELECT seen.*, team FROM seen LEFT JOIN team USING (match_id, player_id)), n AS (SELECT match_id, player_id, count(*) n FROM seen GROUP BY ALL),
p AS (SELECT a.match_id, a.player_id a, b.player_id b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM t a JOIN t b ON a.match_id = b.match_id AND a.k = b.k AND a.player_id < b.player_id AND coalesce(a.team = b.team, TRUE)),
g AS (SELECT match_id, a, b, count(*) shared, median(d) m, avg(CAST(d < 1.5 AS INT)) near FROM p GROUP BY ALL)
SELECT g.match_id, a, b, shared, round(m, 6) AS median_m, round(near, 6) AS near, round(shared / least(na.n, nb.n), 6) AS of_shorter FROM g
JOIN n na ON na.match_id = g.match_id AND na.player_id = a JOIN n nb ON nb.match_id = g.match_id AND nb.player_id = b WHERE shared >= 3 AND m < 0.8 AND near >= 0.8""",
    "encounters": f"""WITH {_SEEN},
c AS (SELECT a.match_id, a.player_id a, b.player_id b, a.k FROM seen a JOIN seen b ON a.match_id = b.match_id AND a.k = b.k AND a.player_id < b.player_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.5),
""" + _islands("c", "match_id, a, b", "10") + " SELECT * FROM runs",
    "team_counts": f"""WITH {_SEEN}, {_TEAM},
n AS (SELECT match_id, team, k, count(*) n FROM seen JOIN team USING (match_id, player_id) GROUP BY ALL)
SELECT match_id, team, CAST(sum(CAST(n = 5 AS INT)) AS BIGINT) AS exact, CAST(sum(CAST(n > 5 AS INT)) AS BIGINT) AS over, CAST(sum(CAST(n < 5 AS INT)) AS BIGINT) AS under, round(avg(n), 6) AS mean FROM n GROUP BY ALL""",
    "team_zone_cube": f"""WITH {_SEEN}, {_TEAM},
z AS (SELECT team, CAST(least(greatest(floor(x * 3 / court_length), 0), 2) AS INT) zone FROM seen JOIN team USING (match_id, player_id) JOIN clock USING (match_id))
SELECT team, zone, count(*) AS n, CAST(grouping_id(team, zone) AS BIGINT) AS level FROM z GROUP BY CUBE (team, zone)""",
}
