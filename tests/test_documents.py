import json

import numpy as np
from pyspark.sql import functions as F

from pitchweave.sources import documents as D


def test_detections_and_arrays(spark, tmp_path):
    doc = {"meta": {"camera": "cam1", "fps": 30}, "detections": [{"frame": 3, "t": 0.1, "u": 1, "v": 2, "conf": 0.9, "box": [1, 2, 3, 4]}, {"frame": 4, "t": 0.2, "u": 1, "v": 2}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    rows = D.read_detections(spark, str(tmp_path / "a.json")).orderBy("i").collect()
    assert [r.frame for r in rows] == [3, 4] and rows[0].box.x2 == 3.0 and rows[1].box is None and rows[0].camera == "cam1"
    np.save(tmp_path / "a.npy", np.array([[1, 2], [np.nan, 0]], np.float16))
    assert [r["values"] for r in D.read_arrays(spark, str(tmp_path / "a.npy")).orderBy("i").collect()] == [[1.0, 2.0], None]


def test_tracks_round_trip(spark, tmp_path):
    tracks = spark.createDataFrame([("m", 1, "A", None, 0, 1.234, 5.0), ("m", 1, "A", None, 2, 2.0, 6.0), ("m", 1, "A", None, 2, 2.0, 6.0), ("m", 2, None, "Bo", 1, 3.0, 7.0)], "match_id string, player_id int, team string, name string, k int, x double, y double")
    matches = spark.createDataFrame([("m", 40.0, 20.0, 10.0, 0.0, 3)], "match_id string, court_length double, court_width double, fps double, start_s double, n_frames int")
    text = D.tracks_documents(tracks, matches).collect()[0].document
    doc = json.loads(text)
    assert doc["players"][0]["x"] == [1.23, None, 2.0] and doc["players"][0]["name"] is None and doc["n_frames"] == 3
    (tmp_path / "t.json").write_text(text)
    back = D.read_tracks(spark, str(tmp_path / "t.json")).select("player_id", "k", "x", "y").orderBy("player_id", "k").collect()
    assert [tuple(r) for r in back] == [(1, 0, 1.23, 5.0), (1, 2, 2.0, 6.0), (2, 1, 3.0, 7.0)]


def test_calibrations_labels_and_times(spark, tmp_path):
    h = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    df = spark.createDataFrame([("a", json.dumps({"H": h, "rms_px": 1.5})), ("b", json.dumps([{"H": h, "from": 7.0}, {"H": h}])), ("c", None), ("d", "broken")], "cam string, j string")
    out = D.calibration_versions(df, camera="cam", text="j").orderBy("camera", "from_s").collect()
    assert [(r.camera, r.from_s, len(r.h)) for r in out] == [("a", 0.0, 9), ("b", 0.0, 9), ("b", 7.0, 9)]
    (tmp_path / "i.txt").write_text("0 0.5 0.5 0.1 0.2\nshort line\n")
    boxes = D.read_labels(spark, str(tmp_path / "i.txt"), 100, 200)
    r = boxes.collect()
    assert len(r) == 1 and np.allclose([r[0].x1, r[0].y1, r[0].x2, r[0].y2], [45, 80, 55, 120])
    assert D.label_lines(boxes, 100, 200).collect()[0].line == "0 0.500000 0.500000 0.100000 0.200000"
    names = spark.createDataFrame([("VID_20261008_193000.mp4", 75.25), ("x.mp4", 5.0)], "n string, s double")
    out = names.select(F.unix_seconds(D.filename_time("n")).alias("t"), D.clock_text(F.col("s")).alias("c")).collect()
    assert out[0].t == 1791487800 and out[1].t is None and [r.c for r in out] == ["1:15.3", "0:05.0"]
