import bz2
import gzip
import struct
import zlib

import numpy as np
import pytest

from tessera.sources import images as im
from tessera.streaming import series


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(0).integers(0, 256, (7, 9)).astype(np.uint8)


def test_png_round_trips(picture):
    assert np.array_equal(im.decode_png(im.encode_png(picture))[..., 0], picture)
    rgb = np.stack([picture, picture[::-1], picture[:, ::-1]], 2)
    assert np.array_equal(im.decode("a.png", im.encode_png(rgb)), rgb)


def test_png_filters(picture):
    rgb = np.stack([picture, picture[::-1], picture[:, ::-1]], 2)
    ny, stride, flat, raw = 7, 27, rgb.reshape(7, 27).astype(int), b""
    for y in range(ny):
        up = flat[y - 1] if y else np.zeros(stride, int)
        left = np.r_[[0] * 3, flat[y][:-3]]
        corner = np.r_[[0] * 3, up[:-3]]
        p = left + up - corner
        d = np.abs([p - left, p - up, p - corner])
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = [0 * up, left, up, (left + up) // 2, paeth][y % 5]
        raw += bytes([y % 5]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = im.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(im.decode_png(data), rgb)


def test_maps_and_compression(picture):
    data = im.encode_map(picture)
    for name, body in (("a.pgm", data), ("a.pgm.gz", gzip.compress(data)), ("a.pgm.bz2", bz2.compress(data))):
        assert np.array_equal(im.decode(name, body)[..., 0], picture)
    real = picture / 3.0
    assert np.array_equal(im.decode_map(im.encode_map(real))[..., 0], real)
    assert np.array_equal(im.decode_map(b"P2\n# note\n2 2\n9\n1 2\n3 4\n")[..., 0], [[1, 2], [3, 4]])
    volume = np.arange(24, dtype="<f8").reshape(2, 3, 4)
    assert np.array_equal(im.decode_map(b"Q9\n4 3 2\n1\n" + volume.tobytes())[..., 0], volume)
    meta = b"ObjectType = Image\nDimSize = 4 3 2\nElementType = MET_DOUBLE\nElementDataFile = LOCAL\n" + volume.tobytes()
    assert np.array_equal(im.decode("v.mha", meta)[..., 0], volume)
    with pytest.raises(ValueError):
        im.decode("a.xyz", b"")


def test_value_rules():
    v = np.array([[-10.0, 0, 100, 255, 300]])
    assert im.to_range(v, "clip").tolist() == [[0, 0, 100, 255, 255]]
    assert im.to_range(v, "reflect").tolist() == [[10, 0, 100, 255, 210]]
    assert im.to_range(v, "scale")[0, [0, -1]].tolist() == [0, 255]
    assert im.to_range(np.array([[0.5, 2.0]]), "clip_then_scale").tolist() == [[128, 255]]


def test_images_through_spark(spark, picture, tmp_path):
    for k in range(3):
        (tmp_path / f"{k:03}.png").write_bytes(im.encode_png(np.roll(picture, k)))
    px = im.read_images(spark, f"file://{tmp_path}")
    assert px.count() == 3 * picture.size
    one = px.where("path LIKE '%/001.png'").selectExpr("1 AS image_id", "x", "y", "v")
    assert np.array_equal(im.decode_png(bytes(im.encoded_images(one).first()["content"]))[..., 0], np.roll(picture, 1))


def test_windows_on_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02}:00", "ab"[i % 2], float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    want = {(r["start"], r["event_type"]): r["n"] for r in series.windowed(df, "10 minutes").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = series.windowed(stream, "10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("windows").collect()} == want
