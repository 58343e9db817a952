import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinprint.functions import hashes
from kinprint.sources import artefacts, media
from kinprint.streaming import incremental


def png(path, raster):
    raster = np.asarray(raster, np.uint8)
    h, w = raster.shape[:2]
    kind = 0 if raster.ndim == 2 else {3: 2, 4: 6, 2: 4}[raster.shape[2]]
    raw = b"".join(b"\0" + raster[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "sub").mkdir()
    png(tmp_path / "gray.png", rng.integers(0, 256, (8, 9)))
    png(tmp_path / "sub" / "color.PNG", rng.integers(0, 256, (20, 30, 3)))
    png(tmp_path / "alpha.png", rng.integers(0, 256, (8, 9, 4)))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "clip.MP4").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_scan_orders_images_before_videos(spark, folder):
    rows = media.with_index(media.scan(spark, str(folder), "all")).orderBy("file_idx").collect()
    assert [r["file"].split("/")[-1] for r in rows] == ["alpha.png", "broken.png", "gray.png", "color.PNG", "clip.MP4"]
    assert media.scan(spark, str(folder), "videos").count() == 1
    assert media.scan(spark, str(folder), "images", recursive=False).count() == 3
    with pytest.raises(ValueError):
        media.scan(spark, str(folder), "sounds")


def test_image_hashes(spark, folder):
    got = {r["file"].split("/")[-1]: r["words"] for r in media.hash_images(spark, str(folder), "dhash", 8).collect()}
    assert set(got) == {"gray.png", "color.PNG", "alpha.png"}
    raster = np.random.default_rng(0).integers(0, 256, (8, 9)).astype(np.uint8)
    want = hashes.words_of(np.array([raster[y, x] > raster[y, x + 1] for y in range(8) for x in range(8)]).astype(np.uint8))
    assert got["gray.png"] == want
    for algorithm in ("phash", "whash"):
        assert all(len(r["words"]) == 2 for r in media.hash_images(spark, str(folder), algorithm, 8).collect())


def test_resize_keeps_flat_pictures_and_size():
    assert (media.resize(np.full((30, 50), 77, np.uint8), 9, 8) == 77).all()
    assert (media.resize(np.full((3, 5), 77, np.uint8), 32, 32) == 77).all()
    ramp = np.tile(np.arange(0, 250, 5, dtype=np.uint8), (10, 1))
    assert (np.diff(media.resize(ramp, 9, 8).astype(int), axis=1) > 0).all()


def test_frames_probe_and_info(spark):
    frames = spark.createDataFrame([("v", 0, 0.5), ("v", 1, None)], "path string, frame int, t double")
    got = media.hash_frames(frames, lambda p, t: None if t is None or t != t else np.arange(72, dtype=np.uint8).reshape(8, 9)).collect()
    assert got[0]["words"] == [0, 0] and got[1]["words"] is None
    assert media.probe(spark.createDataFrame([("v",)], "path string"), "no-such-program").first()["duration"] == 0.0
    raw = spark.createDataFrame([("a", 3.0, 500.0, 4, 5), ("b", 0.0, 25.0, 4, 5)], "path string, duration double, fps double, width int, height int")
    assert [tuple(r)[1:] for r in media.video_info(raw).orderBy("path").collect()] == [(3.0, 120.0, 4, 5), (0.0, 0.0, 0, 0)]


def test_hash_json_round_trip(spark, tmp_path):
    names = ['q"uote.png', "back\\slash.png", "br{ace}.png", "日本.png"]
    h = spark.createDataFrame([(k, n, [(k * 77) << 16]) for k, n in enumerate(sorted(names))], "file_idx long, file string, words array<long>")
    path = tmp_path / "h.json"
    path.write_text(artefacts.hashes_json(h, "dhash", 4))
    back, head = artefacts.read_hashes(spark, str(path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, h.collect())) and head["hash_bits"] == 16
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        artefacts.read_hashes(spark, str(tmp_path / "e.json"))


def test_group_and_projection_json(spark, tmp_path):
    matrix = [[0, 2, 9], [2, 0, 9], [9, 9, 0]]
    path = tmp_path / "g.json"
    path.write_text(artefacts.groups_json(["a", "b", "c"], matrix, [(0, 0), (1, 0), (2, 1)], "dhash", 8, "threshold", {"threshold": 2}))
    r = artefacts.read_groups(spark, str(path)).first()
    assert r["stats"]["total_ungrouped"] == 1 and r["ungrouped"] == [2] and r["params"] == {"threshold": "2"}
    assert r["groups"][0]["member_files"] == ["a", "b"] and r["groups"][0]["avg_internal_distance"] == 2.0
    assert r["distance_matrix"] == matrix and r["dendrogram"] is None
    (tmp_path / "p.json").write_text(artefacts.projection_json(["a"], [[0.1 + 0.2, 1.0]], "dhash", 8, "pca", [0.5, 0.25]))
    p = artefacts.read_projection(spark, str(tmp_path / "p.json")).first()
    assert p["points"] == [[0.1 + 0.2, 1.0]] and p["dims"] == 2
    assert json.loads(artefacts.find_json([("a", 1)])) == [{"file": "a", "distance": 1}]


def test_cache_and_move_plan(spark, tmp_path):
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)], "file_idx long, leader long")
    files = spark.createDataFrame([(k, f"/in/f{k}.png") for k in range(5)], "file_idx long, file string")
    plan = media.move_plan(members, files, "/out/")
    assert {tuple(r) for r in plan.collect()} == {("/in/f0.png", "/out/group_1/f0.png"), ("/in/f1.png", "/out/group_1/f1.png"), ("/in/f3.png", "/out/group_2/f3.png"), ("/in/f4.png", "/out/group_2/f4.png")}
    assert media.restore_plan(plan).columns == ["src", "dst"]
    artefacts.save_cache(str(tmp_path), "/in", members=members)
    assert artefacts.load_cache(spark, str(tmp_path), "/in", "members")["members"].count() == 5


def test_stream_hashes_new_files_once(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    make = lambda content: F.array(F.crc32(content))
    for _ in range(2):
        q = incremental.hash_stream(incremental.new_media(spark, str(folder)), make, out, state)
        q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 4
