import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchweave.operators.alignment import apply_fields, fit_fields
from pitchweave.operators.calibration import calibrated, fit_calibrations, framing, inverse_by, moves_timeline, project_by, shifted_by
from pitchweave.operators.identity import LinkParams, TrackletParams, TrackletBuilder, camera_tracklets, expanded_overlap, identities, link_pieces, paired_views
from pitchweave.operators.teams import assign_teams

H = np.array([[0.02, 0.001, -2.0], [-0.0005, 0.05, -20.0], [0.00001, 0.0009, 1.0]])


def apply(h, p):
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def test_calibrations_are_fitted_joined_and_shifted(spark):
    rng = np.random.default_rng(0)
    uv = rng.uniform([0, 400], [1920, 1080], (300, 2))
    xy = apply(H, uv) + rng.normal(0, 0.02, (300, 2))
    xy[::7] += 5  # wrong taps
    rows = [("m", "cam1", *map(float, u), *map(float, x), "clash") for u, x in zip(uv, xy)] + [("m", "cam2", 1.0, 1.0, 1.0, 1.0, ""), ("m", "cam1", None, 1.0, 1.0, float("nan"), "")]
    df = spark.createDataFrame(rows, "match_id string, camera string, u double, v double, x double, y double, h string")
    cal = fit_calibrations(df, keys=["match_id", "camera"])
    (r,) = cal.collect()
    assert r.camera == "cam1" and r.used == 300 - 43 and r.rms_m < 0.05
    points = spark.createDataFrame([("m", "cam1", 900.0, 700.0)], "match_id string, camera string, u double, v double")
    out = calibrated(points, cal, keys=["match_id", "camera"])
    moved = out.select(*project_by(F.col("h"), F.col("u"), F.col("v")), *project_by(shifted_by(F.col("h"), F.lit(-41.0), F.lit(-19.0)), F.col("u") - 41, F.col("v") - 19)).first()
    assert np.allclose(moved[:2], apply(H, np.array([[900.0, 700.0]]))[0], atol=0.05) and np.allclose(moved[:2], moved[2:], atol=1e-9)
    other = points.withColumn("camera", F.lit("cam9"))
    with pytest.raises(ValueError, match="cam9"):
        calibrated(other, cal, keys=["match_id", "camera"])
    assert calibrated(other, cal, keys=["match_id", "camera"], missing="skip").count() == 0
    assert fit_calibrations(df.limit(0), keys=["match_id", "camera"]).count() == 0


def test_moves_add_up(spark):
    moves = spark.createDataFrame([("c", 200.0, 3.0, 0.0), ("c", 160.0, -41.0, -19.0)], "camera string, t double, dx double, dy double")
    got = sorted(tuple(r) for r in moves_timeline(moves, keys=["camera"]).collect())
    assert got == [("c", float("-inf"), 0.0, 0.0), ("c", 160.0, -41.0, -19.0), ("c", 200.0, -38.0, -19.0)]


def test_warped_cameras_are_aligned_and_few_pairs_leave_them(spark):
    rng = np.random.default_rng(1)
    true = rng.uniform([0, 0], [40, 20], (600, 2))
    warp = lambda p: 0.5 * np.c_[np.sin(p[:, 1] / 9), np.cos(p[:, 0] / 15)]
    a, b = true - warp(true), true + warp(true)
    b[::20] += 2.0  # wrong pairs
    rows = [("m", *map(float, p), *map(float, q), 40.0, 20.0) for p, q in zip(a, b)] + [("few", 1.0, 1.0, 1.2, 1.0, 40.0, 20.0)] * 50
    pairs = spark.createDataFrame(rows, "match_id string, ax double, ay double, bx double, by double, length double, width double")
    fields = fit_fields(pairs, keys=["match_id"])
    (f,) = fields.collect()
    assert f.match_id == "m" and f.before_m > 0.4 and f.after_m < 0.1
    boxes = spark.createDataFrame([(m, i, *map(float, p), s) for m in ("m", "few") for i, p in enumerate(true[:100]) for p, s in ((a[i], 1.0), (b[i], -1.0)) if i % 20], "match_id string, i int, x double, y double, s double").withColumns({"l": F.lit(40.0), "w": F.lit(20.0)})
    out = apply_fields(boxes, fields, keys=["match_id"], sign=F.col("s"), x="x", y="y", length="l", width="w").toPandas()
    own = out[out.match_id == "m"].sort_values(["i", "s"])[["x_aligned", "y_aligned"]].to_numpy().reshape(-1, 2, 2)
    assert np.median(np.hypot(*(own[:, 0] - own[:, 1]).T)) < 0.1
    still = out[out.match_id == "few"]
    assert (still.x == still.x_aligned).all()


def test_two_kits_are_told_apart_across_cameras(spark):
    rng = np.random.default_rng(2)
    kits = rng.dirichlet(np.ones(15), 2)
    rows, pairs, truth = [], [], {}
    for i in range(600):
        player = i % 10
        kit = int(player >= 4)  # six of the one, four of the other
        for c in (0, 1):
            v = kits[kit] * rng.uniform(0.9, 1.1, 15)
            box = 2 * i + c
            rows.append(("m", f"cam{c}", box, 80.0 if i else 20.0, 0.9, np.sqrt(v / v.sum()).tolist()))
            truth[box] = "A" if kit else "B"
        pairs.append(("m", 2 * i, 2 * i + 1))
    rows += [("m", "cam1", 9000, 80.0, 0.9, None), ("m", "cam1", 9001, 80.0, 0.9, ((np.sqrt(kits[0]) + np.sqrt(kits[1])) / 2).tolist())]
    boxes = spark.createDataFrame(rows, "match_id string, camera string, box_id long, h double, conf double, upper array<double>")
    out = {r.box_id: r.team for r in assign_teams(boxes, spark.createDataFrame(pairs, "match_id string, a long, b long")).collect()}
    assert len(out) == len(rows) and out[0] == out[1] == out[9000] == "" and all(out[b] == t for b, t in truth.items() if b > 1)
    assert out[9001] == ""


def test_expanded_overlap():
    a = np.array([[0, 0, 10, 10.0]])
    assert expanded_overlap(a, a, 0.5)[0, 0] == 1 and expanded_overlap(a, a + 20, 0.0)[0, 0] == 0 and expanded_overlap(a, a + [12, 0, 12, 0], 1.0)[0, 0] > 0


def scene(rng, players=6, frames=120):
    """Players on slow paths, seen by two cameras, with appearance vectors; the second camera misses frames."""
    t = np.arange(frames) / 10
    at = np.stack([np.c_[5 + 5 * p + 1.5 * np.sin(t / 2 + p), 10 + 6 * np.sin(t / 3 + 2 * p)] for p in range(players)])
    looks = rng.normal(size=(players, 512))
    rows = []
    for c in range(2):
        for p in range(players):
            for k in range(frames):
                if c and (k + 7 * p) % 60 < 5:
                    continue
                x, y = at[p, k] + rng.normal(0, 0.05, 2)
                u, v, h = 40 * at[p, k, 0] + 100 * c, 300 + 20 * at[p, k, 1], 80.0
                look = looks[p] + rng.normal(0, 0.3, 512)
                u, v = float(u), float(v)
                rows.append(("m", f"cam{c}", len(rows), k, u - 15, v - h, u + 15, v, float(x), float(y), 0.1, "A" if p % 2 else "B", look.astype(np.float32).tolist(), p, h, 0.9))
    return rows


SCHEMA = "match_id string, camera string, box_id long, k int, x1 double, y1 double, x2 double, y2 double, x double, y double, sigma double, team string, reid array<float>, player int, h double, conf double"


def test_tracklets_are_pure_and_use_each_box_once(spark):
    rows = scene(np.random.default_rng(3))
    df = spark.createDataFrame(rows, SCHEMA)
    out = camera_tracklets(df, fps=10.0).toPandas().merge(pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])[["box_id", "player"]], on="box_id")
    assert len(out) == len(rows) and out.box_id.is_unique
    groups = out.groupby(["camera", "track"])
    assert groups.player.nunique().max() == 1 and len(groups) < 6 * 2 * 4
    assert camera_tracklets(df.limit(0)).count() == 0


def test_doubt_ends_a_tracklet():
    b = TrackletBuilder(TrackletParams(), 10.0, 2)
    frame = lambda boxes: pd.DataFrame([(*box, box[0] / 50, 1.0, None) for box in boxes], columns=["x1", "y1", "x2", "y2", "x", "y", "reid"])
    first = b.feed(np.zeros(2, int), frame([(0, 0, 30, 80), (200, 0, 230, 80)]))
    again = b.feed(np.ones(2, int), frame([(2, 0, 32, 80), (202, 0, 232, 80)]))
    assert again.tolist() == first.tolist()
    split = b.feed(np.full(3, 2), frame([(3, 0, 33, 80), (4, 2, 34, 82), (203, 0, 233, 80)]))
    assert split[2] == first[1] and first[0] not in split[:2].tolist()


def test_views_of_one_player_are_joined(spark):
    pts = pd.DataFrame(scene(np.random.default_rng(4), players=4), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    pts["piece"] = pts.player + 100 * (pts.camera == "cam1")
    out = paired_views(spark.createDataFrame(pts[["match_id", "camera", "piece", "k", "x", "y"]])).collect()
    assert {(r.a, r.b) for r in out} == {(p, 100 + p) for p in range(4)}


def test_pieces_become_players():
    rng = np.random.default_rng(5)
    looks, pieces = rng.normal(size=(5, 16)), []
    for p in range(5):
        k, x = 0, 5.0 * p
        while k < 600:
            n = int(rng.integers(20, 80))
            pieces.append((k, min(k + n, 599), x, x + 0.5, "A" if p < 3 else "B", looks[p] + rng.normal(0, 0.2, 16), p))
            k, x = k + n + int(rng.integers(1, 15)), x + 0.5
    order = rng.permutation(len(pieces))
    pieces = [pieces[i] for i in order]
    start, end = np.array([q[0] for q in pieces]), np.array([q[1] for q in pieces])
    head, tail = np.array([[q[2], 5.0] for q in pieces]), np.array([[q[3], 5.0] for q in pieces])
    label = link_pieces(start, end, head, tail, [q[4] for q in pieces], np.array([q[5] for q in pieces]), (end - start + 1).astype(float), 10.0)
    truth = np.array([q[6] for q in pieces])
    assert len(set(label)) == 5 and all(len(set(truth[label == i])) == 1 for i in set(label))
    for i in set(label):
        own = sorted(zip(start[label == i], end[label == i]))
        assert all(b[0] >= a[1] for a, b in zip(own, own[1:]))


def test_windows_are_chained(spark):
    rng = np.random.default_rng(6)
    looks, rows = rng.normal(size=(4, 16)), []
    for p in range(4):
        for n in range(40):
            k = 100 * n
            rows.append(("m", 1000 * p + n, k, k + 95, 5.0 * p, 3.0, 5.0 * p + 0.2, 3.0, "A" if p < 2 else "B", (looks[p] + rng.normal(0, 0.2, 16)).tolist(), 96, 10.0))
    rows += [("m", 9999, None, 5, 1.0, 1.0, 1.0, 1.0, "", None, 1, 10.0), ("o", 1, 0, 5, 1.0, 1.0, 1.0, 1.0, None, None, 6, 10.0)]
    df = spark.createDataFrame(rows, "match_id string, piece long, start int, end int, hx double, hy double, tx double, ty double, team string, look array<double>, boxes long, fps double")
    out = identities(df, params=LinkParams(window_s=120.0, overlap_s=40.0)).toPandas()
    own = out[out.match_id == "m"]
    assert len(own) == 160 and (own.identity == own.piece // 1000 * 1000).all() and len(out) == 161


def test_what_a_camera_has_in_its_image(spark):
    h = (np.diag([0.02, 0.02, 1.0])).ravel().tolist()  # 50 pixels a metre, no perspective
    cal = spark.createDataFrame([("m", "cam1", h, 1000, 1000), ("m", "cam2", [0.0] * 9, 10, 10)], "match_id string, camera string, h array<double>, width int, height int")
    courts = spark.createDataFrame([("m", 40.0, 20.0)], "match_id string, court_length double, court_width double")
    (r,) = framing(cal, courts, keys=["match_id", "camera"]).collect()
    assert (r.camera, r.cells, r.seen, r.left, r.right, r.above, r.below) == ("cam1", 800, 400, 0, 400, 0, 0) and r.mpp == pytest.approx(0.02)
    back = spark.createDataFrame([(H.ravel().tolist(),)], "h array<double>").select(inverse_by(F.col("h"))).first()[0]
    assert np.allclose(np.array(back).reshape(3, 3) @ H / (np.array(back).reshape(3, 3) @ H)[2, 2], np.eye(3), atol=1e-6)
