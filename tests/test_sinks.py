"""Guards, atomic writes, synchronisation and picture files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from sievework.sources import sinks


def test_guard_refuses_foreign_content(spark, tmp_path):
    out = tmp_path / "out"
    assert sinks.guarded(spark, str(out)) == str(out) and out.is_dir()
    (out / "a.jpg").write_bytes(b"x")
    sinks.guarded(spark, str(out))
    with pytest.raises(ValueError, match="a.jpg"):
        sinks.guarded(spark, str(out), numbered=True)
    (out / "notes.txt").write_text("x")
    with pytest.raises(ValueError, match="notes.txt"):
        sinks.guarded(spark, str(out))
    link = tmp_path / "link"
    link.symlink_to(out)
    with pytest.raises(ValueError, match="not a folder"):
        sinks.guarded(spark, str(link))


def test_sync_actions(spark):
    existing = spark.createDataFrame([("0001.jpg",), ("0002.jpg",)], "output string")
    expected = spark.createDataFrame([("0001.jpg",), ("0003.jpg",)], "output string")
    assert sorted(map(tuple, sinks.sync_actions(existing, expected, ["output"]).collect())) == [("0001.jpg", "write"), ("0002.jpg", "delete"), ("0003.jpg", "write")]


def test_write_and_delete(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", bytearray(b"1")), ("b.png", None), ("../c.png", bytearray(b"2"))], "name string, content binary")
    done = {r["name"]: r["written"] for r in sinks.write_files(rows, str(tmp_path)).collect()}
    assert done == {"a.png": True, "b.png": False, "../c.png": False}
    assert [p.name for p in tmp_path.iterdir()] == ["a.png"] and (tmp_path / "a.png").read_bytes() == b"1"
    assert not sinks.delete_file(str(tmp_path / "a.png"), set())
    assert sinks.delete_file(str(tmp_path / "a.png"), {str(tmp_path)}) and not sinks.delete_file(str(tmp_path / "a.png"), {str(tmp_path)})


def test_pictures_round_trip(spark, tmp_path):
    picture = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(sinks.png(picture))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    rows = sinks.read_pictures(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and (rows[0]["width"], rows[0]["height"]) == (7, 5)
    assert bytes(rows[0]["data"]) == picture.tobytes()


def with_orientation(file: bytes, value: int, order: str) -> bytes:
    block = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIHHHIHHI", 42, 8, 1, 0x0112, 3, 1, value, 0, 0)
    chunk = b"eXIf" + block
    return file[:33] + struct.pack(">I", len(block)) + chunk + struct.pack(">I", zlib.crc32(chunk)) + file[33:]


def test_pictures_are_made_upright(spark, tmp_path):
    picture = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    for k in range(10):
        (tmp_path / f"{k}.png").write_bytes(with_orientation(sinks.png(picture), k, "<>"[k % 2]))
    rows = {int(r["path"][-5]): np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) for r in sinks.read_pictures(spark, str(tmp_path)).collect()}
    quarter = np.rot90(picture, -1)
    upright = {2: np.fliplr(picture), 3: np.rot90(picture, 2), 4: np.flipud(picture), 5: np.fliplr(quarter), 6: quarter, 7: np.flipud(quarter), 8: np.rot90(picture, 1)}
    assert len(rows) == 10
    for k, found in rows.items():
        assert np.array_equal(found, upright.get(k, picture)), k


def test_orientation_of_a_jpeg_and_of_broken_fields():
    block = b"Exif\0\0MM" + struct.pack(">HIHHHIHHI", 42, 8, 1, 0x0112, 3, 1, 6, 0, 0)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda"
    assert sinks.orientation(jpeg) == 6
    assert [sinks.orientation(jpeg[:k]) for k in (0, 2, 5, 14, 20, 28)] == [1] * 6
    assert sinks.orientation(b"GIF89a") == 1


def smooth(h: int, w: int) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    waves = [128 + 90 * np.cos(x / 9 + y / 13), 128 + 70 * np.cos(x / 17) * np.cos(y / 7), (2 * x + 3 * y) % 256 / 2 + 60]
    return np.clip(np.dstack(waves), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(8, 8), (45, 61), (320, 320), (1, 3)])
def test_jpeg_is_read_back(spark, tmp_path, shape):
    picture = smooth(*shape)
    content = sinks.encoded(picture, "a.JPG", 92)
    assert content[:2] == b"\xff\xd8" and content[6:10] == b"JFIF" and sinks.encoded(picture, "a.png", 92)[:4] == b"\x89PNG"
    (tmp_path / "a.jpg").write_bytes(content)
    (row,) = sinks.read_pictures(spark, str(tmp_path)).collect()
    got = np.frombuffer(row["data"], np.uint8).reshape(shape[0], shape[1], 3).astype(int)
    assert np.abs(got - picture).mean() < 2.5


def test_jpeg_codes_runs_and_noise(spark, tmp_path):
    """Long runs of zeros, large steps and noise: every kind of code."""
    flat = np.zeros((32, 32, 3), np.uint8)
    flat[::8, ::8] = 255
    noise = np.random.default_rng(1).integers(0, 256, (40, 24, 3)).astype(np.uint8)
    for name, picture in (("flat", flat), ("noise", noise)):
        (tmp_path / f"{name}.jpg").write_bytes(sinks.jpeg(picture, 100))
    for row in sinks.read_pictures(spark, str(tmp_path)).collect():
        picture = flat if row["path"].endswith("flat.jpg") else noise
        assert np.abs(np.frombuffer(row["data"], np.uint8).reshape(picture.shape).astype(int) - picture).mean() < 2


def test_unreadable_files_are_listed(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(sinks.png(smooth(4, 4)))
    (tmp_path / "b.webp").write_bytes(b"RIFF\x04\0\0\0WEBP")
    (tmp_path / "c.jpg").write_bytes(b"no picture")
    (tmp_path / "notes.txt").write_text("x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in sinks.unreadable(spark, str(tmp_path)).collect()) == ["b.webp", "c.jpg"]
