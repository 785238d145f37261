"""Small tables on which queries that the test data leave empty must find what was put there."""

import numpy as np
import pytest

from pitchweave.plans import audits, cameras, players, tracks

MATCH = "match_id string, court_length double, court_width double, fps double, start_s double, n_frames int"
TRACKS = "match_id string, player_id int, team string, name string, k int, x double, y double"
POINTS = "match_id string, track_id long, k int, x double, y double, boxes array<struct<camera:string,box_id:long>>"


@pytest.fixture()
def folder(spark, tmp_path):
    def write(**tables):
        spark.createDataFrame([("m", 40.0, 20.0, 10.0, 0.0, 200)], MATCH).write.mode("overwrite").parquet(f"{tmp_path}/futsal_matches.parquet")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def walk(player, team, first, last, x, y, speed=0.05):
    return [("m", player, team, None, k, x + speed * (k - first), y) for k in range(first, last)]


def test_sightings_that_begin_or_end_in_mid_pitch(spark, folder):
    rows = walk(1, "A", 0, 120, 10.0, 10.0) + walk(2, "A", 50, 200, 10.0, 12.0) + walk(3, "B", 60, 200, 0.5, 10.0) + walk(4, "B", 0, 200, 20.0, 5.0)
    out = {(r.player_id, r.kind, r.k) for r in players.first_and_last(spark, folder(tracks=(rows, TRACKS))).collect()}
    assert out == {(1, "lost", 119), (2, "new", 50)}


def test_two_numbers_for_one_player(spark, folder):
    rng = np.random.default_rng(0)
    rows = walk(1, "A", 0, 100, 10.0, 10.0) + [("m", 2, "A", None, r[4], r[5] + float(rng.normal(0, 0.2)), r[6]) for r in walk(1, "A", 20, 60, 11.0, 10.0)]
    rows += [("m", 3, "B", None, r[4], r[5], r[6] + 0.1) for r in walk(1, "A", 0, 100, 10.0, 10.0)]  # the other team's marker
    (r,) = players.duplicate_pairs(spark, folder(tracks=(rows, TRACKS))).collect()
    assert (r.a, r.b, r.shared) == (1, 2, 40) and r.median_m < 0.8 and r.near >= 0.8 and r.of_shorter == 1.0


def test_a_sprint_is_one_run(spark, folder):
    speeds = [2.0] * 50 + [6.5] * 20 + [2.0] * 80
    x = np.cumsum([0.0, *np.array(speeds) / 10])
    rows = [("m", 1, "A", None, k, float(v), 10.0) for k, v in enumerate(x) if k < 120]
    sf = folder(tracks=(rows, TRACKS))
    assert players.sprint_runs(spark, sf).count() == 1
    (m,) = players.player_metrics(spark, sf).collect()
    assert m.sprints == 1 and 6 < m.max_speed_ms < 7


def test_jitter_is_no_running(spark, folder):
    rng = np.random.default_rng(1)
    rows = [("m", 1, "A", None, k, 10 + float(rng.normal(0, 0.4)), 10 + float(rng.normal(0, 0.4))) for k in range(600)]
    sf = folder(tracks=(rows, TRACKS))
    raw, smooth = players.player_summary(spark, sf).first(), players.player_metrics(spark, sf).first()
    assert raw.distance_m > 250 and smooth.distance_m < 0.1 * raw.distance_m and smooth.max_speed_ms < 2


def test_views_of_a_player_and_boxes_of_two_tracks(spark, folder):
    pts = [("m", t, k, 5.0 + 0.1 * k + 0.2 * t, 8.0, [("cam1", 7 if k == 3 else 100 * t + k)]) for t in (1, 2) for k in range(30)] + [("m", 3, k, 30.0, 8.0, []) for k in range(30)]
    sf = folder(track_points=(pts, POINTS))
    (pair,) = tracks.pair_views(spark, sf).collect()
    assert (pair.a, pair.b, pair.shared) == (1, 2, 30) and pair.median_m == pytest.approx(0.2)
    (box,) = cameras.shared_boxes(spark, sf).collect()
    assert (box.box_id, box.tracks) == (7, 2)


def test_two_labellings_agree_as_far_as_they_share_pairs(spark):
    rows = [("m", "a", 1), ("m", "a", 1), ("m", "a", 2), ("m", "b", 2), ("m", None, 2)]
    (r,) = audits.coassignment(spark.createDataFrame(rows, "m string, p string, q int"), keys=["m"], a="p", b="q").collect()
    assert (r.pairs_a, r.pairs_b, r.both, r.f1) == (3.0, 2.0, 1.0, 0.4)
