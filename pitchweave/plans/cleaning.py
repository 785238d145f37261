"""Queries p1, p2 and p4: filled positions and teams, implausible readings, holes of the frame grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchweave.functions.clock import grid_position
from pitchweave.operators.fill import fill_category, fill_numeric, stand_ins, without_stand_ins
from pitchweave.operators.regrid import regrid
from pitchweave.operators.spikes import flag_readings
from pitchweave.sources.tables import table

TEAMS = ["A", "B"]
#: Metres beyond the lines where a player can still stand, and the fastest a player can run in m/s.
RUN_OFF_M, MAX_SPEED_MS = 4.0, 12.5


def filled_positions(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """``tracks`` or ``track_points`` with every bridgeable position filled, per player or track."""
    entity = {"tracks": "player_id", "track_points": "track_id"}[name]
    rows = table(spark, sf, name)
    keys = ["match_id", entity]
    rows = without_stand_ins(rows, ["x", "y"], stand_ins(rows, ["x", "y"], entity=keys, source="match_id"))
    return fill_numeric(rows, keys=keys, order="k", values=["x", "y"], gap_limit=20)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, entity in (("tracks", "player_id"), ("track_points", "track_id")):
        parts.append(filled_positions(spark, sf, name).where("bridged").select(F.lit(name).alias("src"), "match_id", F.col(entity).cast("bigint").alias("id"), F.col("k").cast("int").alias("k"), F.lit("xy").alias("what")))
    teams = fill_category(table(spark, sf, "tracks"), keys=["match_id", "player_id"], order="k", value="team", known=TEAMS)
    parts.append(teams.where("team_filled").select(F.lit("tracks").alias("src"), "match_id", F.col("player_id").cast("bigint").alias("id"), F.col("k").cast("int").alias("k"), F.lit("team").alias("what")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_filled(spark: SparkSession, sf: str) -> DataFrame:
    """The complete series of ``tracks`` with each filled value marked."""
    xy = filled_positions(spark, sf, "tracks").alias("p")
    teams = fill_category(table(spark, sf, "tracks"), keys=["match_id", "player_id"], order="k", value="team", known=TEAMS).alias("t")
    same = [F.col("p.match_id").eqNullSafe(F.col("t.match_id")), F.col("p.player_id").eqNullSafe(F.col("t.player_id")), F.col("p.k") == F.col("t.k")]
    xy_ = [F.round(f"p.{c}", 6).alias(c) if c in ("x", "y") else F.col(f"p.{c}") for c in xy.columns]
    return xy.join(teams, same, "left").select(*xy_, "t.team", F.coalesce("t.team_filled", F.lit(False)).alias("team_filled"), F.coalesce("t.team_method", F.lit("none")).alias("team_method"), "t.team_distance")


def flagged_tracks(spark: SparkSession, sf: str) -> DataFrame:
    courts = table(spark, sf, "futsal_matches").groupBy("match_id").agg(F.max("court_length").alias("len"), F.max("court_width").alias("wid"))
    rows = table(spark, sf, "tracks").select("match_id", "player_id", "k", "x", "y").join(courts, "match_id", "left")
    m = F.lit(RUN_OFF_M)
    off = (F.col("x") < -m) | (F.col("x") > F.col("len") + m) | (F.col("y") < -m) | (F.col("y") > F.col("wid") + m)
    return flag_readings(rows, keys=["match_id", "player_id"], order="k", values=["x", "y"], impossible=off)


def flagged_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "track_states").select("match_id", "track_id", "k", "vx", "vy")
    speed = F.sqrt(F.coalesce(F.col("vx"), F.lit(0.0)) ** 2 + F.coalesce(F.col("vy"), F.lit(0.0)) ** 2)
    return flag_readings(rows, keys=["match_id", "track_id"], order="k", values=["vx", "vy"], impossible=speed > MAX_SPEED_MS)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    def found(df: DataFrame, src: str, entity: str) -> DataFrame:
        return df.where("spike or stuck or impossible").select(F.lit(src).alias("src"), "match_id", F.col(entity).cast("bigint").alias("id"), F.col("k").cast("int").alias("k"))

    return found(flagged_tracks(spark, sf), "tracks", "player_id").unionByName(found(flagged_states(spark, sf), "track_states", "track_id"))


def box_frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per box frame with a known time, and its position on the frame grid."""
    frames = table(spark, sf, "boxes").groupBy("match_id", "camera", "fid").agg(F.max("t").alias("t"), F.count("*").alias("boxes"))
    sync = table(spark, sf, "camera_sync").dropDuplicates(["match_id", "camera"])
    grid = table(spark, sf, "futsal_matches").select("match_id", "fps", "start_s")
    return frames.join(sync, ["match_id", "camera"]).join(grid, "match_id").withColumn("position", grid_position("t", "offset_s", "drift", "start_s", "fps"))


def p4_grid(spark: SparkSession, sf: str) -> DataFrame:
    """One row per match, camera and grid frame, with the camera clock and the source frame interpolated into holes."""
    sources = table(spark, sf, "camera_sync").join(table(spark, sf, "futsal_matches").select("match_id", "n_frames"), "match_id")
    out = regrid(box_frames(spark, sf), sources, keys=["match_id", "camera"], position="position", values=["t", "fid"], size="n_frames")
    return out.select("match_id", "camera", "k", "status", *[F.round(c, 6).alias(c) for c in ("t", "fid", "before", "after")])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_grid(spark, sf).where("status <> 'observed'").select("match_id", "camera", "k")


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p2_found": p2_found, "p4_found": p4_found, "p4_grid": p4_grid}

_BLANK = """
pts AS (
  SELECT 'tracks' src, match_id, CAST(player_id AS BIGINT) id, k, x, y FROM tracks
  UNION ALL SELECT 'track_points', match_id, track_id, k, x, y FROM track_points),
fake AS (
  SELECT src, x, y FROM (SELECT *, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER (PARTITION BY src) total FROM pts)
  WHERE x IS NOT NULL AND y IS NOT NULL
  GROUP BY src, x, y HAVING count(*) >= 8 AND count(*) >= 0.001 * max(total) AND count(DISTINCT (match_id, id)) > 1),
own AS (
  SELECT src, match_id, x, y FROM (SELECT *, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER (PARTITION BY src, match_id) size FROM pts)
  WHERE x IS NOT NULL AND y IS NOT NULL
  GROUP BY src, match_id, x, y HAVING count(*) >= 8 AND count(*) >= 0.005 * max(size) AND count(DISTINCT id) > 1),
full_ AS (
  SELECT DISTINCT src, match_id, id, k FROM pts p WHERE x IS NOT NULL AND y IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fake f WHERE f.src = p.src AND f.x = p.x AND f.y = p.y)
  AND NOT EXISTS (SELECT 1 FROM own o WHERE o.src = p.src AND o.match_id = p.match_id AND o.x = p.x AND o.y = p.y)),
gaps AS (SELECT *, lead(k) OVER (PARTITION BY src, match_id, id ORDER BY k) nxt FROM full_)"""

SQL = {
    "p1_found": f"""WITH {_BLANK}
SELECT src, match_id, id, CAST(f AS INT) AS k, 'xy' AS what FROM gaps, unnest(range(k + 1, nxt)) AS u(f) WHERE nxt - k BETWEEN 2 AND 21
UNION ALL
SELECT DISTINCT 'tracks', match_id, CAST(player_id AS BIGINT), k, 'team' FROM (
  SELECT *, max(team IN ('A', 'B')) OVER (PARTITION BY match_id, player_id) any_known,
    max(coalesce(team IN ('A', 'B'), FALSE)) OVER (PARTITION BY match_id, player_id, k) here FROM tracks)
WHERE any_known AND NOT here""",
    "p1_filled": f"""WITH {_BLANK},
r0 AS (SELECT match_id, player_id, k, CASE WHEN bad THEN NULL WHEN isfinite(x) THEN x END x, CASE WHEN bad THEN NULL WHEN isfinite(y) THEN y END y FROM (
  SELECT *, EXISTS (SELECT 1 FROM fake f WHERE f.src = 'tracks' AND f.x = t.x AND f.y = t.y) OR EXISTS (SELECT 1 FROM own o WHERE o.src = 'tracks' AND o.match_id = t.match_id AND o.x = t.x AND o.y = t.y) bad FROM tracks t)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, player_id, k ORDER BY (x IS NOT NULL AND y IS NOT NULL) DESC, x NULLS LAST, y NULLS LAST) n FROM r0) WHERE n = 1),
f AS (SELECT match_id, player_id, k, x, y FROM r WHERE x IS NOT NULL AND y IS NOT NULL),
h AS (SELECT match_id, player_id, k, lead(k) OVER (PARTITION BY match_id, player_id ORDER BY k) nxt FROM f),
e AS (SELECT match_id, player_id, k, x, y, TRUE had FROM r UNION ALL
  SELECT h.match_id, h.player_id, CAST(u.f AS INT), NULL, NULL, FALSE FROM h, unnest(range(h.k + 1, h.nxt)) AS u(f) WHERE h.nxt - h.k BETWEEN 2 AND 21 AND NOT EXISTS (SELECT 1 FROM r WHERE r.match_id = h.match_id AND r.player_id = h.player_id AND r.k = u.f)),
n AS (SELECT e.*, a.k ak, a.x ax, a.y ay, b.k bk, b.x bx, b."y" by_, coalesce(NOT (e.x IS NOT NULL AND e.y IS NOT NULL) AND b.k - a.k - 1 <= 20, FALSE) bridged
  FROM e ASOF LEFT JOIN f a ON e.match_id = a.match_id AND e.player_id = a.player_id AND e.k > a.k ASOF LEFT JOIN f b ON e.match_id = b.match_id AND e.player_id = b.player_id AND e.k < b.k),
t AS (SELECT match_id, player_id, k, min(team) FILTER (WHERE team IN ('A', 'B')) c FROM tracks GROUP BY ALL), kn AS (SELECT * FROM t WHERE c IS NOT NULL),
m AS (SELECT t.*, p.c pc, q.c qc, t.k - p.k back, q.k - t.k ahead FROM t ASOF LEFT JOIN kn p ON t.match_id = p.match_id AND t.player_id = p.player_id AND t.k > p.k ASOF LEFT JOIN kn q ON t.match_id = q.match_id AND t.player_id = q.player_id AND t.k < q.k),
w AS (SELECT *, coalesce(back <= coalesce(ahead, back), FALSE) forward FROM m), z AS (SELECT *, c IS NULL AND coalesce(back, ahead) IS NOT NULL usable FROM w)
SELECT n.match_id, n.player_id, CAST(n.k AS BIGINT) AS k, round(CASE WHEN bridged AND x IS NULL THEN ax + (n.k - ak) / (bk - ak) * (bx - ax) ELSE x END, 6) AS x, bridged AND x IS NULL AS x_filled,
  CASE WHEN bridged AND x IS NULL THEN 'linear' WHEN x IS NOT NULL THEN 'observed' ELSE 'none' END AS x_method, round(CASE WHEN bridged AND y IS NULL THEN ay + (n.k - ak) / (bk - ak) * (by_ - ay) ELSE y END, 6) AS y, bridged AND y IS NULL AS y_filled,
  CASE WHEN bridged AND y IS NULL THEN 'linear' WHEN y IS NOT NULL THEN 'observed' ELSE 'none' END AS y_method, x IS NOT NULL AND y IS NOT NULL AS complete, bridged, had AS had_row, CAST(CASE WHEN bridged THEN bk - ak - 1 END AS BIGINT) AS gap, CAST(CASE WHEN bridged THEN least(n.k - ak, bk - n.k) END AS BIGINT) AS distance,
  CASE WHEN usable AND forward THEN pc WHEN usable THEN qc ELSE c END AS team, coalesce(usable, FALSE) AS team_filled, CASE WHEN c IS NOT NULL THEN 'observed' WHEN NOT coalesce(usable, FALSE) THEN 'none' WHEN forward THEN 'carry_forward' ELSE 'carry_backward' END AS team_method,
  CAST(CASE WHEN usable AND forward THEN back WHEN usable THEN ahead END AS BIGINT) AS team_distance FROM n LEFT JOIN z ON z.match_id = n.match_id AND z.player_id = n.player_id AND z.k = n.k""",
    "p4_grid": """WITH f AS (SELECT match_id, camera, fid, max(t) t FROM boxes GROUP BY ALL HAVING max(t) IS NOT NULL),
p AS (SELECT f.match_id, f.camera, CAST(fid AS DOUBLE) fid, t, (t + offset_s + coalesce(drift, 0) * t - start_s) * fps pos FROM f JOIN camera_sync s ON s.match_id = f.match_id AND s.camera = f.camera JOIN futsal_matches m ON m.match_id = f.match_id),
q AS (SELECT *, CAST(round_even(pos, 0) AS BIGINT) k FROM p), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, camera, k ORDER BY abs(pos - k), pos, t, fid) r FROM q) WHERE r = 1),
g AS (SELECT DISTINCT c.match_id, c.camera, CAST(u.k AS BIGINT) k FROM camera_sync c JOIN futsal_matches m USING (match_id), unnest(range(m.n_frames)) AS u(k)),
n AS (SELECT g.*, b.k bk, b.pos b_at, b.t bt, b.fid bf, a.pos a_at, a.t at_, a.fid af, coalesce(b.k = g.k, FALSE) o, coalesce(a.pos - b.pos <= 20, FALSE) i, CASE WHEN a.pos > b.pos THEN (g.k - b.pos) / (a.pos - b.pos) ELSE 0.0 END w
  FROM g ASOF LEFT JOIN s b ON g.match_id = b.match_id AND g.camera = b.camera AND g.k >= b.k ASOF LEFT JOIN s a ON g.match_id = a.match_id AND g.camera = a.camera AND g.k <= a.k)
SELECT match_id, camera, CAST(k AS INT) AS k, CASE WHEN o THEN 'observed' WHEN i THEN 'interpolated' ELSE 'missing' END AS status, round(CASE WHEN o THEN bt WHEN i THEN bt + w * (at_ - bt) END, 6) AS t, round(CASE WHEN o THEN bf WHEN i THEN bf + w * (af - bf) END, 6) AS fid,
  round(CASE WHEN o OR i THEN b_at END, 6) AS before, round(CASE WHEN o THEN b_at WHEN i THEN a_at END, 6) AS after FROM n""",
    "p4_found": """WITH frames AS (
  SELECT match_id, camera, fid, max(t) t FROM boxes GROUP BY ALL HAVING max(t) IS NOT NULL),
held AS (
  SELECT DISTINCT s.match_id, s.camera, CAST(round_even((t + offset_s + coalesce(drift, 0) * t - start_s) * fps, 0) AS BIGINT) k
  FROM frames JOIN camera_sync s USING (match_id, camera) JOIN futsal_matches m USING (match_id))
SELECT s.match_id, s.camera, CAST(f AS INT) AS k
FROM camera_sync s JOIN futsal_matches m USING (match_id), unnest(range(m.n_frames)) AS u(f)
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.match_id = s.match_id AND h.camera = s.camera AND h.k = f)""",
}
