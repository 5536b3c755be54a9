"""Image files as pixel tables and back.

Files are read by Spark's binaryFile source and decoded a batch at a time, so a
folder of images is a table scan like any other. Decoders are chosen by suffix;
a trailing .gz or .bz2 is unpacked first. Volumes come out with a z column."""

from __future__ import annotations

import bz2
import gzip
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import decode_ascii, decode_mrc, decode_tags, decode_tiff

#: Element types by the digit in a portable map's or a raw file's header (fixed values of the format).
KINDS = {"5": "u1", "8": "<f4", "9": "<f8", "10": "<u2", "11": "<i2", "33": "<i4", "34": "<u4"}
META_KINDS = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """Scan lines of a PNG without their filters."""
    out = np.zeros((rows, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for r in range(rows):
        kind, line = raw[r * (stride + 1)], np.frombuffer(raw, np.uint8, stride, r * (stride + 1) + 1).copy()
        if kind == 2:
            line += before
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            left, up = line.tolist(), before.tolist()
            for i in range(stride):
                a = left[i - step] if i >= step else 0
                c = up[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + up[i]) // 2
                else:
                    p = a + up[i] - c
                    pa, pb, pc = abs(p - a), abs(p - up[i]), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else up[i] if pb <= pc else c
                left[i] = (left[i] + guess) & 255
            line = np.array(left, np.uint8)
        out[r] = before = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """[y, x, channel] of 8- or 16-bit gray, color and palette images that aren't interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, palette = 8, [], None
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            nx, ny, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if interlaced:
        raise ValueError("interlaced PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    bits = channels * depth
    lines = unfiltered(zlib.decompress(b"".join(parts)), ny, -(-nx * bits // 8), max(1, bits // 8))
    if depth == 16:
        out = lines.reshape(ny, nx, channels, 2).astype(np.uint16)
        return out[..., 0] << 8 | out[..., 1]
    if depth < 8:
        flat = np.unpackbits(lines, axis=1).reshape(ny, -1, depth)
        lines = flat.dot(1 << np.arange(depth)[::-1]).astype(np.uint8)[:, :nx]
        if color == 0:
            lines = lines * (255 // ((1 << depth) - 1))
    out = lines.reshape(ny, nx, channels)
    return palette[out[..., 0]] if color == 3 else out


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit PNG of [y, x] or [y, x, channel] with 1 to 4 channels."""
    image = np.atleast_3d(np.asarray(image, np.uint8))
    ny, nx, channels = image.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", nx, ny, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    raw = np.concatenate([np.zeros((ny, 1), np.uint8), image.reshape(ny, -1)], 1).tobytes()
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_map(data: bytes) -> np.ndarray:
    """Portable gray maps P2 and P5, color maps P6, and the typed variants P7
    (numbers as text), P8 to P11, P33, P34 (two dimensions) and Q with three: a
    header of sizes and a greatest value, then the elements. P211 is a PNG."""
    if data[:8] == SIGNATURE:
        return decode_png(data)
    m = re.match(rb"(?:\s|#[^\n]*\n)*([PQ])(\d+)(?:\s|#[^\n]*\n)+", data)
    if not m:
        raise ValueError("not a portable map")
    volume, kind, at = m[1] == b"Q", m[2].decode(), m.end()
    numbers = []
    while len(numbers) < 3 + volume:
        n = re.compile(rb"(?:\s|#[^\n]*\n)*([\d.eE+-]+)").match(data, at)
        numbers.append(float(n[1]))
        at = n.end()
    shape = tuple(int(x) for x in numbers[: 2 + volume][::-1])
    if kind in ("2", "7"):
        return np.array(data[at:].split(), float).reshape(*shape, 1)
    at += 1
    if kind == "6":
        return np.frombuffer(data, "u1", int(np.prod(shape)) * 3, at).reshape(*shape, 3)
    return np.frombuffer(data, KINDS[kind], int(np.prod(shape)), at).reshape(*shape, 1)


def encode_map(image: np.ndarray, kind: str | None = None) -> bytes:
    """An image, or with Q a volume, of that kind; by itself P5 for bytes, P9 for anything else."""
    image = np.asarray(image)
    kind = kind or ("5" if image.dtype == np.uint8 else "9")
    if kind == "211":
        return encode_png(image)
    sizes = " ".join(map(str, image.shape[::-1]))
    head = f"{'Q' if image.ndim == 3 else 'P'}{kind}\n{sizes}\n{int(np.ceil(image.max(initial=0)))}\n".encode()
    if kind in ("2", "7"):
        return head + ("\n".join(" ".join(f"{v:.17g}" for v in row) for row in image.reshape(-1, image.shape[-1])) + "\n").encode()
    return head + np.ascontiguousarray(image, KINDS[kind]).tobytes()


def decode_meta(data: bytes, elements: Callable[[str], bytes] | None = None) -> np.ndarray:
    """MetaImage; elements gives the content of the file beside it that it may name."""
    fields, at = {}, 0
    while "ElementDataFile" not in fields:
        end = data.index(b"\n", at)
        name, _, value = data[at:end].decode("latin-1").partition("=")
        fields[name.strip()] = value.strip()
        at = end + 1
    body = data[at:]
    if fields["ElementDataFile"] != "LOCAL":
        if elements is None:
            raise ValueError("the elements are in another file")
        body = elements(fields["ElementDataFile"])
    shape = tuple(int(x) for x in fields["DimSize"].split())[::-1]
    body = zlib.decompress(body) if fields.get("CompressedData", "False") == "True" else body
    order = ">" if fields.get("BinaryDataByteOrderMSB", "False") == "True" else "<"
    channels = int(fields.get("ElementNumberOfChannels", 1))
    return np.frombuffer(body, order + META_KINDS[fields["ElementType"]], int(np.prod(shape)) * channels).reshape(*shape, channels)


def encode_meta(image: np.ndarray, beside: str | None = None, compressed: bool = False) -> tuple[bytes, bytes]:
    """Header and elements of an image or volume; without a name for the elements' file they follow the header."""
    kind = next(k for k, v in META_KINDS.items() if np.dtype(v) == image.dtype)
    body = np.ascontiguousarray(image, image.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(body) if compressed else body
    fields = {"ObjectType": "Image", "NDims": image.ndim, "DimSize": " ".join(map(str, image.shape[::-1])), "BinaryDataByteOrderMSB": "False", "CompressedData": str(compressed), "ElementType": kind, "ElementDataFile": beside or "LOCAL"}
    return "".join(f"{k} = {v}\n" for k, v in fields.items()).encode(), body


DECODERS = {".png": decode_png, ".pgm": decode_map, ".ppm": decode_map, ".q2bz": decode_map, ".dat": decode_map, ".mha": decode_meta, ".mhd": decode_meta, ".tif": decode_tiff, ".tiff": decode_tiff, ".mrc": decode_mrc, ".dm3": decode_tags, ".dm4": decode_tags, ".txt": decode_ascii}


def decode(name: str, data: bytes) -> np.ndarray:
    """[(z,) y, x, channel] of a file by the suffix of its name."""
    suffixes = PurePosixPath(name).suffixes
    if suffixes and suffixes[-1] in (".gz", ".bz2"):
        data = (gzip if suffixes.pop() == ".gz" else bz2).decompress(data)
    kind = suffixes[-1].lower() if suffixes else ""
    if kind not in DECODERS:
        raise ValueError(f"no decoder for {name}")
    return DECODERS[kind](data)


def pixel_rows(name: str, image: np.ndarray) -> pd.DataFrame:
    if image.ndim == 3:
        image = image[None]
    z, y, x, c = np.indices(image.shape)
    shape = {"nx": image.shape[2], "ny": image.shape[1], "nz": image.shape[0]}
    return pd.DataFrame({"path": name, "x": x.ravel(), "y": y.ravel(), "z": z.ravel(), "c": c.ravel(), "v": image.ravel().astype(float)}).assign(**shape)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, z, c, v, nx, ny, nz of all images below path. Elements that a
    header names beside it (.mhd with .raw or .zraw) come from the same folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data, beside in zip(b["path"], b["content"], b["beside"], strict=True):
                if beside is not None:
                    yield pixel_rows(name, decode_meta(bytes(data), lambda _, beside=beside: bytes(beside)))
                else:
                    yield pixel_rows(name, decode(name, bytes(data)))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    elements = F.col("path").rlike(r"\.z?raw$")
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    named = F.regexp_extract(F.col("content").cast("string"), r"ElementDataFile\s*=\s*(\S+)", 1)
    heads = files.where(~elements).withColumn("own", F.when(F.col("path").endswith(".mhd") & (named != "LOCAL"), F.concat(folder, named)))
    files = heads.join(files.where(elements).select(F.col("path").alias("own"), F.col("content").alias("beside")), "own", "left").select("path", "content", "beside")
    return files.mapInPandas(run, "path string, x int, y int, z int, c int, v double, nx int, ny int, nz int")


def to_range(v: np.ndarray, rule: str) -> np.ndarray:
    """Values as bytes: scaled to 0..255, clipped, mirrored at both ends, or clipped to 0..1 and scaled."""
    if rule == "scale":
        span = v.max() - v.min()
        v = (v - v.min()) * (255 / span if span else 0)
    elif rule == "reflect":
        v = 255 - np.abs((v % 510) - 255)
    elif rule == "clip_then_scale":
        v = np.clip(v, 0, 1) * 255
    elif rule != "clip":
        raise ValueError(f"unknown rule {rule}")
    return np.clip(np.rint(v), 0, 255).astype(np.uint8)


def encoded_images(px: DataFrame, rule: str = "clip", form: str = "png") -> DataFrame:
    """image_id and the bytes of a file for each image of px (image_id, x, y, v)."""
    make = encode_png if form == "png" else encode_map

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
        image[pdf["y"], pdf["x"]] = pdf["v"]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "content": [make(to_range(image, rule))]})

    return px.groupBy("image_id").applyInPandas(run, f"image_id {px.schema['image_id'].dataType.simpleString()}, content binary")
