import pytest

from pitchweave.plans.players import player_summary, sprint_runs, track_speeds


@pytest.mark.parametrize("fps", [12.5, 60.0, 67.0, 120.0, 240.0])
def test_speeds_and_sprints_at_any_frame_rate(spark, tmp_path, fps):
    n = int(4 * fps)
    matches = spark.createDataFrame([("m", fps, n, 40.0, 20.0), ("o", 10.0, 40, 40.0, 20.0), ("p", float("nan"), 40, 40.0, 20.0)], "match_id string, fps double, n_frames int, court_length double, court_width double")
    matches.write.parquet(f"{tmp_path}/futsal_matches.parquet")
    rows = [("m", 1, k, 6.0 * k / fps, 5.0) for k in range(n)] + [("o", 1, k, 0.2 * k, 5.0) for k in range(40)]
    spark.createDataFrame(rows, "match_id string, player_id int, k int, x double, y double").write.parquet(f"{tmp_path}/tracks.parquet")
    span = round(fps / 2)
    speeds = track_speeds(spark, str(tmp_path)).toPandas()
    own, other = speeds[speeds.match_id == "m"], speeds[speeds.match_id == "o"]
    assert len(own) == n - span and own.speed.between(5.999, 6.001).all()
    assert len(other) == 35 and other.speed.between(1.999, 2.001).all()
    runs = sprint_runs(spark, str(tmp_path)).collect()
    assert [(r.match_id, r["first"], r["last"]) for r in runs] == [("m", span // 2, n - 1 - span + span // 2)]
    summary = {r.match_id: (r.max_speed_ms, r.sprints) for r in player_summary(spark, str(tmp_path)).collect()}
    assert summary == {"m": (6.0, 1), "o": (2.0, 0)}
