import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchweave import hooks
from pitchweave.operators.suppression import suppress_overlaps
from pitchweave.sources import caches, exports


def cache_file(path, n, seed, reid=True):
    rng = np.random.default_rng(seed)
    extra = {"reid": rng.normal(size=(n, 8)).astype(np.float16), "color": rng.integers(0, 256, (n, 30)).astype(np.uint8)} if reid else {}
    arrays = {"fid": np.arange(n), "t": np.arange(n) / 10, "xyxy": rng.uniform(0, 900, (n, 4)).astype(np.float32), "conf": rng.uniform(0, 1, n).astype(np.float32)} | extra
    np.savez(path, **arrays)
    return arrays


def test_caches_of_a_folder(spark, tmp_path):
    a, _ = cache_file(tmp_path / "cam1.npz", 5000, 0), cache_file(tmp_path / "cam2.npz", 3, 1, reid=False)
    (tmp_path / "meta.json").write_text(json.dumps({"videos": {"cam1": "a.mp4", "cam2": "b.mp4"}, "offsets": {"cam1": -2.5}, "start": 10.0, "rate": 10}))
    rows, meta = caches.read_cache_folder(spark, str(tmp_path))
    got = rows.where("camera = 'cam1' and i = 4321").first()
    assert meta["rate"] == 10 and got.fid == 4321 and got.offset_s == -2.5 and got.x1 == pytest.approx(float(a["xyxy"][4321, 0])) and got.color[3] == pytest.approx(a["color"][4321, 3] / 255)
    assert np.allclose(got.reid, a["reid"][4321].astype(float))
    other = rows.where("camera = 'cam2'").collect()
    assert len(other) == 3 and other[0].reid is None and other[0].offset_s == 0.0
    part = caches.time_slice(rows.where("camera = 'cam1'"), start=10.0, duration=5.0)
    assert part.agg(F.min("t"), F.max("t")).first() == (12.5, 17.5)


def test_vectors_beside_documents(spark, tmp_path):
    det = {"frame": 1, "t": 0.1, "u": 1.0, "v": 2.0, "conf": 0.9, "team": "A", "h_px": 80.0}
    for name in ("good", "short"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"meta": {"camera": name, "fps": 10.0}, "detections": [det, det | {"frame": 2}]}))
    np.save(tmp_path / "good.reid.npy", np.array([[1, 2], [np.nan, np.nan]], np.float32))
    np.save(tmp_path / "short.reid.npy", np.ones((1, 2), np.float32))
    out = {(r.camera, r.frame): r.reid for r in caches.detections_with_vectors(spark, f"{tmp_path}/*.json", f"{tmp_path}/*.npy").collect()}
    assert out == {("good", 1): [1.0, 2.0], ("good", 2): None, ("short", 1): None, ("short", 2): None}


def test_images_are_listed_by_ending(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in caches.list_images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]


def test_identity_files_make_the_round_trip(spark, tmp_path):
    rows = [("m", 1, 5, 1.23456, 2.0, [("cam1", 7)]), ("m", 1, 6, 1.5, 2.5, []), ("m", 2, 5, 3.0, 4.0, None), ("m", 2, 6, None, 1.0, None)]
    pts = spark.createDataFrame(rows, "match_id string, track_id long, k int, x double, y double, boxes array<struct<camera:string,box_id:long>>")
    (doc,) = exports.identity_documents(pts).collect()
    assert json.loads(doc.document) == [{"5": [1.235, 2.0, [["cam1", "7"]]], "6": [1.5, 2.5, []]}, {"5": [3.0, 4.0, []]}]
    (tmp_path / "t.json").write_text(doc.document)
    back = caches.read_identity_file(spark, f"{tmp_path}/t.json").orderBy("track", "k").collect()
    assert [(r.track, r.k, r.x, r.y, [tuple(b) for b in r.boxes]) for r in back] == [(0, 5, 1.235, 2.0, [("cam1", 7)]), (0, 6, 1.5, 2.5, []), (1, 5, 3.0, 4.0, [])]


def test_event_files_reports_and_documents(spark, tmp_path):
    events = spark.createDataFrame([(65.25, 2, "lost", 1.234, 5.0), (3.0, 1, "new", 2.0, 3.0)], "t double, player_id int, kind string, x double, y double")
    exports.write_events(events, f"{tmp_path}/events")
    got = spark.read.option("header", True).csv(f"{tmp_path}/events").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("0:03.0", "1", "new", "2.0", "3.0"), ("1:05.3", "2", "lost", "1.23", "5.0")]
    lines = exports.report_lines(spark.createDataFrame([("m", "b", "drift"), ("m", "a", "")], "match_id string, camera string, warnings string")).collect()
    assert [r.value for r in lines] == ["m\ta\tok", "m\tb\tdrift"]
    (doc,) = exports.summary_documents(spark.createDataFrame([("m", 2, None), ("m", 1, 3.0)], "match_id string, player_id int, distance_m double")).collect()
    assert json.loads(doc.document) == {"players": [{"player_id": 1, "distance_m": 3.0}, {"player_id": 2, "distance_m": None}]}
    ball = spark.createDataFrame([("v", 2, 1.0, 2.0, 0.0, "interpolated"), ("v", 1, 1.0, 2.0, 0.9, "detected")], "video string, frame int, u double, v double, conf double, source string")
    assert [p["frame"] for p in json.loads(exports.ball_documents(ball).first().document)] == [1, 2]
    assert "  1: goal" in exports.dataset_description(["ball", "goal"], root="/data")
    court = exports.court_document(40.0, 20.0)
    assert court["keypoints"]["centre"] == [20.0, 10.0] and len(court["spots"]) == 5
    assert all(-1e-9 <= x <= 40 + 1e-9 and -1e-9 <= y <= 20 + 1e-9 for line in court["markings"] for x, y in line)
    exports.write_detections(spark.createDataFrame([("m", 1, [0.5])], "match_id string, box_id int, reid array<float>"), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").first().reid == [0.5]


def test_label_sets_are_merged(spark):
    schema = "image string, cls int, x1 double, y1 double, x2 double, y2 double"
    a, b = spark.createDataFrame([("i1", 32, 0.0, 0.0, 1.0, 1.0), ("i1", 0, 0.0, 0.0, 1.0, 1.0)], schema), spark.createDataFrame([("i2", 1, 0.0, 0.0, 1.0, 1.0)], schema)
    out = exports.merged_labels({"a": a, "b": b}, keep={"a": [32], "b": [1]}).collect()
    assert {(r.source, r.image, r.cls) for r in out} == {("a", "i1", 0), ("b", "i2", 0)} and {r.part for r in out} <= {"train", "val"}


def make_detector():
    return lambda image: [((0.0, 0.0, float(len(image)), 10.0, 0.9), "A")] * image.count(b"x")


def make_embedder():
    return lambda image, boxes: np.c_[boxes[:, 2], np.full(len(boxes), 4.0)]


def make_tile_detector():
    return lambda tile: [(600.0, 10.0, 640.0, 30.0, 0.8)] if tile == b"left" else [(88.0, 10.0, 130.0, 30.0, 0.7)]


def test_hooks_run_on_images(spark):
    images = spark.createDataFrame([("a", bytearray(b"xx")), ("b", bytearray(b"none")), ("c", None)], "path string, content binary")
    # the test module is not importable on workers: closures are sent by value
    detector, embedder, tiler = make_detector(), make_embedder(), make_tile_detector()
    found = hooks.detect(images, lambda: detector, keys=["path"]).collect()
    assert [(r.path, r.i, r.x2, r.team) for r in found] == [("a", 0, 2.0, "A"), ("a", 1, 2.0, "A")]
    with pytest.raises(ValueError, match="no detector"):
        hooks.detect(images, keys=["path"])
    boxes = images.withColumn("boxes", F.array(F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(3.0).alias("x2"), F.lit(1.0).alias("y2"))))
    vectors = {r.path: r.vectors for r in hooks.embed(boxes, lambda: embedder, keys=["path"]).collect()}
    assert np.allclose(vectors["a"], [[0.6, 0.8]]) and vectors["c"] == []
    tiles = spark.createDataFrame([("a", 1, 0, 0, bytearray(b"left")), ("a", 1, 512, 0, bytearray(b"right"))], "camera string, fid int, tx int, ty int, content binary")
    found = hooks.detect_tiles(tiles, lambda: tiler, keys=["camera", "fid"], size=(1920, 1080))
    kept = found.join(suppress_overlaps(found, keys=["camera"], frame="fid", id="id"), "id").collect()
    assert [(r.x1, r.x2, r.conf) for r in kept] == [(600.0, 642.0, 0.7)]  # the cut box of the left tile loses


def test_trackers_are_known_by_name(spark):
    rows = [("m", "c", i, i, 0.1 * i, 1.0, 0.0, 0.0, 10.0, 20.0, None) for i in range(5)]
    df = spark.createDataFrame(rows, "match_id string, camera string, box_id long, k int, x double, y double, x1 double, y1 double, x2 double, y2 double, reid array<float>")
    assert {hooks.tracker(n)(df).select("track").distinct().count() for n in ("motion", "careful")} == {1}
    with pytest.raises(KeyError, match="motion"):
        hooks.tracker("none")
