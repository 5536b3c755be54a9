"""File formats against bytes written by hand, and through Spark."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import formats as ff
from tessera.sources import images as im


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(0).integers(0, 256, (5, 7)).astype(np.uint8)


def tiff_by_hand(body, compression, order=">", more=()):
    """A gray TIFF of 7 by 5 bytes in one strip, in either byte order."""
    tags = [(256, 3, 1, 7), (257, 3, 1, 5), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, 1, 400), (277, 3, 1, 1), (278, 3, 1, 5), (279, 4, 1, len(body)), *more]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(tags))
    for tag, kind, n, value in tags:
        out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return out.ljust(400, b"\0") + body


def lzw(data):
    """Codes of a plain encoder, as a stream of bits."""
    table, bits, out, w = {bytes([k]): k for k in range(256)}, 9, "1" + "0" * 8, b""
    emit = lambda c: format(c, f"0{bits}b")
    n = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if w + c in table:
            w += c
            continue
        out += emit(table[w])
        table[w + c] = n
        n += 1
        if n in (512, 1024, 2048):
            bits += 1
        w = c
    out += emit(table[w])
    n += 1
    if n in (512, 1024, 2048):
        bits += 1
    out += emit(257)
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


def test_tiff(picture):
    raw = picture.tobytes()
    packed = b"".join(bytes([0, v]) for v in raw)
    for order in "<>":
        for body, compression in ((raw, 1), (zlib.compress(raw), 8), (packed, 32773), (lzw(raw), 5)):
            assert np.array_equal(ff.decode_tiff(tiff_by_hand(body, compression, order))[..., 0], picture)
    runs = tiff_by_hand(bytes([257 - 35 & 255, 9]), 32773)
    assert (ff.decode_tiff(runs) == 9).all()
    long = np.random.default_rng(1).integers(0, 4, 35).astype(np.uint8)
    assert ff._lzw(lzw(bytes(range(256)) * 12 + long.tobytes())) == bytes(range(256)) * 12 + long.tobytes()
    steps = np.diff(picture.astype(int), axis=1, prepend=0).astype(np.uint8)
    assert np.array_equal(ff.decode_tiff(tiff_by_hand(steps.tobytes(), 1, "<", [(317, 3, 1, 2)]))[..., 0], picture)
    rgb = np.stack([picture] * 3, 2)
    for image in (picture, rgb, picture.astype("u2") * 200, picture / 3, (picture / 3).astype("f4")):
        for deflate in (True, False):
            assert np.array_equal(ff.decode_tiff(ff.encode_tiff(image, deflate)), np.atleast_3d(image))
    with pytest.raises(ValueError):
        ff.decode_tiff(b"no image")


def tag_file(version, image):
    """A file of nested tags with a preview and an image, little-endian values."""
    count = ">i" if version == 3 else ">q"
    size = lambda b: b if version == 3 else struct.pack(">q", len(b)) + b

    def data(name, info, body):
        own = b"%%%%" + struct.pack(count, len(info)) + b"".join(struct.pack(count, k) for k in info) + body
        return b"\x15" + struct.pack(">H", len(name)) + name + size(own)

    def group(name, tags):
        own = b"\0\0" + struct.pack(count, len(tags)) + b"".join(tags)
        return b"\x14" + struct.pack(">H", len(name)) + name + size(own)

    def entry(u):
        sizes = group(b"Dimensions", [data(b"", [5], struct.pack("<I", n)) for n in u.shape[::-1]])
        return group(b"", [group(b"ImageData", [data(b"Data", [20, 6, u.size], u.astype("<f4").tobytes()), data(b"DataType", [5], struct.pack("<I", 2)), sizes]), data(b"Name", [18, 3], "abc".encode("utf-16-le"))])

    tags = [data(b"Point", [15, 0, 2, 0, 6, 0, 3], struct.pack("<fi", 1.5, 7)), group(b"ImageList", [entry(image[:2, :2]), entry(image)])]
    body = b"\0\0" + struct.pack(count, len(tags)) + b"".join(tags)
    return struct.pack(">i", version) + struct.pack(count, len(body)) + struct.pack(">i", 1) + body


def test_tag_files(picture):
    u = picture.astype("f4") / 4
    for version in (3, 4):
        found = ff.TagReader(tag_file(version, u)).found
        assert found["Point"] == [1.5, 7] and found["ImageList/1/Name"] == "abc"
        assert np.array_equal(im.decode(f"a.dm{version}", tag_file(version, u))[..., 0], u)


def test_vectors_and_text():
    v = np.array([1.5, -2.0, 1e300])
    assert np.array_equal(ff.decode_vectors(b"M9\n# a note\n3\n" + v.tobytes())[0], v)
    a, b = ff.decode_vectors(ff.encode_vectors([np.arange(3), np.arange(5)], 33), "f8")
    assert a.dtype == float and a.tolist() == [0, 1, 2] and len(b) == 5
    mask = np.random.default_rng(2).random(21) < 0.5
    assert np.array_equal(ff.decode_vectors(ff.encode_vectors([mask]))[0], mask)
    assert np.array_equal(ff.decode_ascii(ff.encode_ascii(np.eye(3) / 3))[..., 0], np.eye(3) / 3)
    assert im.decode_map(b"P7\n# note\n2 2\n9\n1.5 2\n3 -4e1\n")[..., 0].tolist() == [[1.5, 2], [3, -40]]
    assert im.decode_map(b"P11\n2 1\n9\n" + struct.pack("<2h", -3, 500))[..., 0].tolist() == [[-3, 500]]


def test_sinks():
    vtk = ff.encode_vtk(np.arange(6.0).reshape(1, 2, 3)).decode()
    assert "DIMENSIONS 3 2 1" in vtk and vtk.endswith("0\n1\n2\n3\n4\n5\n")
    assert ff.encode_density(np.array([[[0.0, 0.5], [1.0, 2.0]]]), 0, 1) == struct.pack(">3H4B", 2, 2, 1, 0, 128, 255, 255)
    assert ff.encode_ppm(np.zeros((1, 2, 3), "u1")) == b"P6\n2 1\n255\n" + bytes(6)
    assert np.array_equal(im.decode("a.ppm", ff.encode_ppm(np.arange(6).reshape(1, 2, 3))), np.arange(6).reshape(1, 2, 3))
    assert b"1 2 moveto 3 4 lineto" in ff.encode_eps([(1, 2, 3, 4)], 9, 9) and 'plot "a.txt"' in ff.plot_script("a.txt")
    vertices, faces = np.random.default_rng(3).normal(size=(4, 3)).astype("f4"), np.array([[0, 1, 2], [1, 2, 3]])
    v, f, more = ff.decode_ply(ff.encode_ply(vertices, faces))
    assert np.allclose(v, vertices) and np.array_equal(f, faces) and not more


def test_files_through_spark(spark, picture, tmp_path):
    volume = np.random.default_rng(4).normal(size=(3, 5, 7)).astype("f4")
    head, body = im.encode_meta(volume, "v.raw")
    (tmp_path / "in").mkdir()
    for name, data in (("a.tif", ff.encode_tiff(picture)), ("v.mhd", head), ("v.raw", body), ("m.mrc", ff.encode_mrc(volume))):
        (tmp_path / "in" / name).write_bytes(data)
    px = im.read_images(spark, f"file://{tmp_path}/in")
    got = {r["f"]: (r["n"], r["s"]) for r in px.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("f")).agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert got == {"a.tif": (35, picture.sum()), "v.mhd": (105, pytest.approx(volume.sum(dtype=float))), "m.mrc": (105, pytest.approx(volume.sum(dtype=float)))}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.raw").write_bytes(ff.encode_raw(picture, "u1"))
    assert ff.read_raw(spark, f"file://{tmp_path}/raw", 7, 5, kind="u1").agg(F.sum("v")).first()[0] == picture.sum()
    rows = spark.createDataFrame([(k, bytearray(im.encode_png(np.roll(picture, k)))) for k in range(3)], "k int, content binary")
    files, size = ff.write_files(rows, f"file://{tmp_path}/out", F.format_string("img%03d.png", "k"))
    assert files == 3 and size == sum(p.stat().st_size for p in (tmp_path / "out").iterdir())
    out = im.read_images(spark, f"file://{tmp_path}/out")
    stack = ff.stacked_slices(out, "img%03d.png", 1, 2, "y")
    assert {(r["y"], r["s"]) for r in stack.groupBy("y").agg(F.sum("v").alias("s")).collect()} == {(0, picture.sum()), (1, picture.sum())}
    assert ff.rgba(out.select("path", "x", "y", "c", "v")).count() == 4 * 3 * 35
    ff.write_lines(ff.metric_lines(spark.createDataFrame([("O", 0.5, 0.1)], "metric string, mean double, sd double")), f"file://{tmp_path}/metrics")
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/metrics").collect()] == ["O = 0.500000 +- 0.100000"]
