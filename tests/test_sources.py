"""File sources and sinks on folders made by the test."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage, raster
from tidemark.sources import files


def png(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    pixels = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    (tmp_path / "dawn").mkdir()
    (tmp_path / "dawn" / "a.png").write_bytes(png(pixels))
    (tmp_path / "b.PNG").write_bytes(png(pixels)[:40])
    (tmp_path / "c.jpg").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path, pixels


def test_scan_files_ignores_case_and_other_files(spark, folder):
    got = files.scan_files(spark, str(folder[0]))
    assert sorted(r["ext"] for r in got.collect()) == ["jpg", "png", "png"]
    assert "content" not in got.columns


def test_scan_images_flags_unreadable_files(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.scan_images(spark, str(folder[0])).collect()}
    assert {k: r["is_corrupted"] for k, r in got.items()} == {"a.png": False, "b.PNG": True, "c.jpg": True}
    assert (got["a.png"]["h"], got["a.png"]["w"], got["a.png"]["channels"]) == (2, 3, 3)


def test_planes(spark, folder):
    _, pixels = folder
    row = files.planes(files.scan_images(spark, str(folder[0])).filter("not is_corrupted")).first()
    for name, i in (("r", 0), ("g", 1), ("b", 2)):
        assert row[name] == pixels[:, :, i].ravel().tolist()


def test_feature_vector_of_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    shots = {f"{i}.png": rng.integers(0, 256, (6 + i, 8, 3), dtype=np.uint8) for i in range(3)}
    for name, pixels in shots.items():
        (tmp_path / name).write_bytes(png(pixels))
    got = {r["path"].rsplit("/", 1)[1]: r for r in raster.feature_vector(files.planes(files.scan_images(spark, str(tmp_path)))).collect()}
    for name, pixels in shots.items():
        p = pixels.astype(float)
        level = np.floor(p @ [0.299, 0.587, 0.114] + 0.5)
        top, low = p.max(axis=2), p.min(axis=2)
        assert got[name]["brightness"] == pytest.approx(level.mean()) and got[name]["contrast"] == pytest.approx(level.std())
        assert got[name]["saturation"] == pytest.approx(np.floor((top - low) * 255 / np.maximum(top, 1) + 0.5).mean())
        for c, i in (("r", 0), ("g", 1), ("b", 2)):
            assert got[name][f"hist_{c}_std"] == pytest.approx(np.histogram(p[:, :, i], 32, (0, 256))[0].std())


def test_scan_arrays_refuses_pickles(spark, tmp_path):
    (tmp_path / "good").mkdir()
    a = np.random.default_rng(0).uniform(size=(3, 4)).astype(np.float32)
    np.save(tmp_path / "good" / "d.npy", a)
    row = files.scan_arrays(spark, str(tmp_path / "good")).first()
    assert (row["h"], row["w"]) == (3, 4) and np.allclose(row["px"], a.ravel())
    (tmp_path / "bad").mkdir()
    np.save(tmp_path / "bad" / "p.npy", np.array([{"x": 1}], dtype=object), allow_pickle=True)
    (tmp_path / "bad" / "cut.npy").write_bytes((tmp_path / "good" / "d.npy").read_bytes()[:100])
    assert [(r["h"], r["w"], r["px"]) for r in files.scan_arrays(spark, str(tmp_path / "bad")).collect()] == [(None,) * 3] * 2


def test_documents(spark, tmp_path):
    good = {"stage_name": "depth", "timestamp": "2024-01-05T10:00:00", "status": "completed",
            "data": {"processed_items": 3, "quality_scores": [0.5], "output_paths": []}, "metadata": {"test": True}}
    (tmp_path / "docs").mkdir()
    for name, doc in (("a", good), ("b", good | {"status": "running"}), ("c", good | {"timestamp": "yesterday"}),
                      ("d", {k: v for k, v in good.items() if k != "data"})):
        (tmp_path / "docs" / f"{name}.json").write_text(json.dumps(doc, indent=2))
    df = files.read_documents(spark, str(tmp_path / "docs"), files.STAGE_SCHEMA)
    got = files.valid_stage_docs(df, F.lit("depth"))
    assert got.count() == 4 and got.filter("is_valid").count() == 1
    none = files.read_documents(spark, str(tmp_path / "absent"), files.STAGE_SCHEMA)
    assert none.count() == 0 and none.columns == df.columns


def test_reports_stages_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    for fmt in ("parquet", "json", "text"):
        files.write_report(df, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert {json.loads(r[0])["name"] for r in spark.read.text(str(tmp_path / "text")).collect()} == {"x", "y"}
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "z"), "xls")
    files.save_stage(df, str(tmp_path / "run"), "clean")
    (tmp_path / "run" / "broken").mkdir()
    assert [r[0] for r in files.completed_stages(spark, str(tmp_path / "run")).collect()] == ["clean"]
    assert files.completed_stages(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.json").write_text('{"ts":"2024-01-01T00:00:00Z","component":"depth","duration_ms":5.5}\n')
    row = files.read_log(spark, str(tmp_path / "log")).first()
    assert row["component"] == "depth" and row["duration_ms"] == 5.5 and row["error_occurred"] is None
    assert files.read_log(spark, str(tmp_path / "log"), stream=True).isStreaming


def test_lineage_tables(spark, tmp_path):
    heads, versions = str(tmp_path / "heads"), str(tmp_path / "versions")
    row = spark.createDataFrame([("d1", "/x", None, [], {}, "c1", "1")], lineage.LINEAGE_SCHEMA)
    lineage.register_dataset(row.withColumn("created", F.to_timestamp(F.lit("2024-01-01"))), heads)
    lineage.register_dataset(row.withColumns({"created": F.to_timestamp(F.lit("2024-01-02")), "checksum": F.lit("c2")}), heads)
    got = lineage.latest(spark.read.parquet(heads), ["dataset_id"], ["created"]).collect()
    assert [r["checksum"] for r in got] == ["c2"]
    new = spark.createDataFrame([("d1", "", None, "first", ["x"], {"q": 0.5}, "c")], lineage.VERSION_SCHEMA).drop("version")
    lineage.create_versions(new, versions)
    lineage.create_versions(new, versions)
    assert sorted(r["version"] for r in spark.read.parquet(versions).collect()) == ["1.0.0", "1.0.1"]


def grey_png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_features_of_good_and_bad_files(spark, tmp_path):
    """Bad files give null features and a reason; the good ones agree with the features of their planes."""
    rng = np.random.default_rng(1)
    (tmp_path / "good.png").write_bytes(png(rng.integers(0, 256, (6, 8, 3), dtype=np.uint8)))
    (tmp_path / "grey.PNG").write_bytes(grey_png(rng.integers(0, 256, (5, 7), dtype=np.uint8)))
    (tmp_path / "cut.png").write_bytes(png(rng.integers(0, 256, (6, 8, 3), dtype=np.uint8))[:60])
    (tmp_path / "one.png").write_bytes(png(np.full((1, 1, 3), 9, np.uint8)))
    (tmp_path / "flat.png").write_bytes(png(np.full((1, 9, 3), 9, np.uint8)))
    (tmp_path / "photo.webp").write_bytes(b"RIFF....WEBP")
    (tmp_path / "notes.txt").write_text("no image")
    images = files.scan_images(spark, str(tmp_path))
    out = raster.image_features(images)
    got = {r["path"].rsplit("/", 1)[1]: r for r in out.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"good.png": None, "grey.PNG": None, "cut.png": "unreadable", "one.png": "too small",
                                                        "flat.png": "too small", "photo.webp": "unreadable"}
    assert all((r["brightness"] is None) == (r["reason"] is not None) for r in got.values()) and "data" not in out.columns
    wide = {r["path"].rsplit("/", 1)[1]: r for r in raster.feature_vector(files.planes(images)).collect()}
    for name in ("good.png", "grey.PNG"):
        assert all(got[name][c] == pytest.approx(wide[name][c]) for c in raster.FEATURES)
    assert all(wide[n]["brightness"] is None for n in ("cut.png", "one.png", "flat.png", "photo.webp"))
    plan = images._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
