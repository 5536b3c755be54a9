"""Further file formats: TIFF, MRC, raw elements, microscopy tags, vectors, meshes, and sinks for viewers.

Each is a pair of functions over bytes, so that Spark reads files by its
binaryFile source and writes them from rows, wherever they lie."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- raw elements and MRC ----


def encode_raw(image: np.ndarray, kind: str = "<f8") -> bytes:
    return np.ascontiguousarray(image, kind).tobytes()


def decode_raw(data: bytes, shape: tuple[int, ...], kind: str = "<f8", offset: int = 0) -> np.ndarray:
    """Elements from an offset on as an array with a channel axis."""
    return np.frombuffer(data, kind, int(np.prod(shape)), offset).reshape(*shape, 1)


#: Element types of MRC volumes by the mode in their header, 1024 bytes long (fixed values).
MRC_KINDS = {0: "i1", 1: "<i2", 2: "<f4", 6: "<u2"}


def decode_mrc(data: bytes) -> np.ndarray:
    nx, ny, nz, mode = struct.unpack("<4i", data[:16])
    if mode not in MRC_KINDS:
        raise ValueError(f"unknown mode {mode}")
    extended = struct.unpack("<i", data[92:96])[0]
    return decode_raw(data, (nz, ny, nx), MRC_KINDS[mode], 1024 + extended)


def encode_mrc(volume: np.ndarray) -> bytes:
    """Single precision."""
    nz, ny, nx = volume.shape
    return struct.pack("<4i", nx, ny, nz, 2).ljust(1024, b"\0") + encode_raw(volume, "<f4")


# ---- TIFF ----

#: Sizes and codes of tag types; fields that are read (fixed values of the format).
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, bits, held, count, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, count = held << 8 | byte, count + 8
        if count < bits:
            continue
        count -= bits
        code, held = held >> count, held & (1 << count) - 1
        if code == 257:
            break
        if code == 256:
            table, bits, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """[y, x, channel] of the first image: strips of 8, 16 or 32 bits, plain, packed, LZW or deflated."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in TIFF_TYPES or kind == 2:
            continue
        form = f"{order}{n}{TIFF_TYPES[kind]}"
        size, start = struct.calcsize(form), at + 10 + 12 * k
        if size > 4:
            start = struct.unpack(order + "I", data[start : start + 4])[0]
        tags[tag] = struct.unpack(form, data[start : start + size])
    get = lambda tag, value: tags.get(tag, (value,))[0]
    nx, ny, channels, bits = tags[WIDTH][0], tags[HEIGHT][0], get(SAMPLES, 1), get(BITS, 8)
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(get(COMPRESSION, 1))
    if unpack is None or bits not in (8, 16, 32, 64):
        raise ValueError("a TIFF of another kind")
    raw = b"".join(unpack(data[o : o + c]) for o, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    kind = {1: "u", 2: "i", 3: "f"}[get(SAMPLE_FORMAT, 1)]
    out = np.frombuffer(raw, f"{order}{kind}{bits // 8}", nx * ny * channels).reshape(ny, nx, channels)
    if get(PREDICTOR, 1) == 2:
        out = np.cumsum(out, 1, dtype=np.uint64).astype(out.dtype)
    if get(PHOTOMETRIC, 1) == 0 and kind == "u":  # white is 0
        out = np.iinfo(out.dtype).max - out
    return out


def encode_tiff(image: np.ndarray, deflate: bool = True) -> bytes:
    """One strip of [y, x] or [y, x, channel]; bytes, 16-bit or floating point elements."""
    image = np.atleast_3d(image)
    kind = image.dtype.newbyteorder("<")
    ny, nx, channels = image.shape
    body = np.ascontiguousarray(image, kind).tobytes()
    body = zlib.compress(body) if deflate else body
    bits, form = kind.itemsize * 8, {"u": 1, "i": 2, "f": 3}[kind.kind]
    many = channels > 2
    fields = [
        (WIDTH, 4, 1, nx), (HEIGHT, 4, 1, ny), (BITS, 3, channels, bits), (COMPRESSION, 3, 1, 8 if deflate else 1), (PHOTOMETRIC, 3, 1, 2 if many else 1),
        (OFFSETS, 4, 1, 0), (SAMPLES, 3, 1, channels), (ROWS, 4, 1, ny), (COUNTS, 4, 1, len(body)), (SAMPLE_FORMAT, 3, channels, form),
    ]
    head = 8 + 2 + 12 * len(fields) + 4
    extra, out = b"", b""
    for tag, code, n, value in fields:
        if n * (2 if code == 3 else 4) > 4:  # several short values stand after the table
            own, extra = struct.pack("<I", head + len(extra)), extra + struct.pack(f"<{n}H", *[value] * n)
        elif code == 3:
            own = struct.pack(f"<{n}H", *[value] * n).ljust(4, b"\0")
        else:
            own = struct.pack("<I", value)
        out += struct.pack("<HHI", tag, code, n) + (b"%OFF" if tag == OFFSETS else own)
    out = out.replace(b"%OFF", struct.pack("<I", head + len(extra)))
    return b"II*\0" + struct.pack("<IH", 8, len(fields)) + out + b"\0\0\0\0" + extra + body


# ---- microscopy tags ----

#: Sizes of the simple types of a tag file, and element types of its images (fixed values of the format).
TAG_KINDS = {2: "i2", 3: "i4", 4: "u2", 5: "u4", 6: "f4", 7: "f8", 8: "u1", 9: "u1", 10: "i1", 11: "i8", 12: "u8"}
IMAGE_KINDS = {1: "i2", 2: "f4", 6: "u1", 7: "i4", 9: "i1", 10: "u2", 11: "u4", 12: "f8"}


class TagReader:
    """Nested tags of versions 3 and 4 of a microscope's files, by their paths."""

    def __init__(self, data: bytes):
        self.data, self.at, self.found = data, 4, {}
        (self.version,) = struct.unpack(">i", data[:4])
        if self.version not in (3, 4):
            raise ValueError("not a file of tags")
        self.count()
        self.order = "<" if self.take(">i") else ">"
        self.group(())

    def take(self, form: str):
        size = struct.calcsize(form)
        (value,) = struct.unpack(form, self.data[self.at : self.at + size])
        self.at += size
        return value

    def count(self) -> int:
        return self.take(">i" if self.version == 3 else ">q")

    def group(self, path: tuple) -> None:
        self.at += 2
        for k in range(self.count()):
            kind, size = self.take(">B"), self.take(">H")
            name = self.data[self.at : self.at + size].decode("latin-1") or str(k)
            self.at += size
            if self.version == 4:
                self.at += 8
            if kind == 20:
                self.group((*path, name))
            elif kind == 21:
                self.at += 4  # %%%%
                info = [self.count() for _ in range(self.count())]
                self.found["/".join((*path, name))] = self.value(info)

    def value(self, info: list[int]):
        if info[0] == 20:  # an array, of simple types or of structures
            n, item = info[-1], info[1:-1]
            if item[0] in TAG_KINDS:
                kind = np.dtype(self.order + TAG_KINDS[item[0]])
                out = np.frombuffer(self.data, kind, n, self.at)
                self.at += n * kind.itemsize
                return out
            return [self.value(item) for _ in range(n)]
        if info[0] == 15:  # a structure
            return [self.value([kind]) for kind in info[4::2]]
        if info[0] == 18:  # text
            out = self.data[self.at : self.at + 2 * info[1]].decode("utf-16")
            self.at += 2 * info[1]
            return out
        return self.take(self.order + np.dtype(TAG_KINDS[info[0]]).char)


def decode_tags(data: bytes) -> np.ndarray:
    """The last image (before it there may be a preview), with a z axis if it has three dimensions."""
    found = TagReader(data).found
    images = sorted({p.split("/ImageData/")[0] for p in found if "/ImageData/Data" in p}, key=lambda p: int(p.split("/")[-1]))
    if not images:
        raise ValueError("no image among the tags")
    at = images[-1] + "/ImageData/"
    shape = [int(found[k]) for k in sorted((p for p in found if p.startswith(at + "Dimensions/")), key=lambda p: int(p.split("/")[-1]))]
    kind = IMAGE_KINDS[int(found[at + "DataType"])]
    return np.asarray(found[at + "Data"]).view(kind).reshape(*shape[::-1], 1)


# ---- vectors ----

#: Element types of self-describing files by number (fixed values of the format).
ELEMENTS = {5: "u1", 8: "<f4", 9: "<f8", 10: "<u2", 11: "<i2", 32: "i1", 33: "<i4", 34: "<u4", 35: "<i8", 36: "<u8", 38: "u1"}


def encode_vectors(parts: list[np.ndarray], kind: int = 9) -> bytes:
    """M with one vector, N with several; L (packed bits, lowest first) for booleans: letter, type, sizes, elements."""
    if parts[0].dtype == bool:
        return f"L38\n{len(parts[0])}\n".encode() + np.packbits(parts[0], bitorder="little").tobytes()
    body = b"".join(np.ascontiguousarray(p, ELEMENTS[kind]).tobytes() for p in parts)
    if len(parts) == 1:
        return f"M{kind}\n{len(parts[0])}\n".encode() + body
    return f"N{kind}\n{len(parts)}\n{' '.join(str(len(p)) for p in parts)}\n".encode() + body


def decode_vectors(data: bytes, to: str | None = None) -> list[np.ndarray]:
    """All vectors of a file, cast to another element type if asked; lines that start with # are comments."""
    lines, at = [], 0
    while len(lines) < (3 if data[:1] == b"N" else 2):
        end = data.index(b"\n", at)
        if data[at : at + 1] != b"#":
            lines.append(data[at:end].decode("ascii"))
        at = end + 1
    letter, kind = lines[0][0], int(lines[0][1:])
    sizes = [int(x) for x in lines[-1].split()]
    if letter == "L":
        return [np.unpackbits(np.frombuffer(data, "u1", -(-sizes[0] // 8), at), bitorder="little")[: sizes[0]].astype(bool)]
    out = []
    for n in sizes:
        out.append(np.frombuffer(data, ELEMENTS[kind], n, at).astype(to or ELEMENTS[kind]))
        at += n * np.dtype(ELEMENTS[kind]).itemsize
    return out


def encode_ascii(image: np.ndarray) -> bytes:
    """A line for each row, elements with a blank between them."""
    return ("\n".join(" ".join(f"{v:.17g}" for v in row) for row in np.atleast_2d(image)) + "\n").encode()


def decode_ascii(data: bytes) -> np.ndarray:
    return np.array([[float(v) for v in line.split()] for line in data.decode().splitlines() if line.strip()])[..., None]


# ---- meshes ----


def encode_ply(vertices: np.ndarray, faces: np.ndarray, values: np.ndarray | None = None) -> bytes:
    """Triangles as text, with a number for each vertex if there is one."""
    more = ["property float generic_scalar"] if values is not None else []
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in "xyz"), *more, f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    rows = vertices if values is None else np.column_stack([vertices, values])
    body = [" ".join(f"{v:.9g}" for v in r) for r in rows] + [" ".join(map(str, (3, *f))) for f in faces.tolist()]
    return ("\n".join([*head, *body]) + "\n").encode()


def decode_ply(data: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Vertices, faces and what else the vertices have, of a text file."""
    head, _, body = data.decode("ascii").partition("end_header\n")
    names, counts, of = {"vertex": [], "face": []}, {}, ""
    for line in head.splitlines():
        word = line.split()
        if word[:1] == ["element"]:
            of, counts[word[1]] = word[1], int(word[2])
        elif word[:1] == ["property"]:
            names.setdefault(of, []).append(word[-1])
    lines = body.splitlines()
    rows = np.array([[float(v) for v in line.split()] for line in lines[: counts["vertex"]]]).reshape(counts["vertex"], -1)
    at = {n: rows[:, k] for k, n in enumerate(names["vertex"])}
    faces = np.array([[int(v) for v in line.split()[1:]] for line in lines[counts["vertex"] : counts["vertex"] + counts.get("face", 0)]])
    return np.column_stack([at.pop(c) for c in "xyz"]), faces, at


# ---- sinks for viewers ----


def encode_vtk(volume: np.ndarray, name: str = "data") -> bytes:
    """Structured points of a legacy file, as text."""
    volume = volume if volume.ndim == 3 else volume[None]
    nz, ny, nx = volume.shape
    head = f"# vtk DataFile Version 2.0\n{name}\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {volume.size}\nSCALARS {name} double 1\nLOOKUP_TABLE default\n"
    return (head + "\n".join(f"{v:.17g}" for v in volume.ravel()) + "\n").encode()


def encode_density(volume: np.ndarray, low: float, high: float, bits: int = 8) -> bytes:
    """A ray tracer's density file: three sizes and elements, most significant byte first."""
    nz, ny, nx = volume.shape
    top = (1 << bits) - 1
    scaled = np.clip((volume - low) / ((high - low) or 1.0), 0, 1) * top
    return struct.pack(">3H", nx, ny, nz) + np.rint(scaled).astype(f">u{bits // 8}").tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    """P6 of [y, x, 3] bytes."""
    ny, nx, _ = image.shape
    return f"P6\n{nx} {ny}\n255\n".encode() + np.ascontiguousarray(image, "u1").tobytes()


def encode_eps(lines: list[tuple[float, float, float, float]], width: int, height: int) -> bytes:
    """Line segments as a figure."""
    body = "".join(f"{a:g} {b:g} moveto {c:g} {d:g} lineto stroke\n" for a, b, c, d in lines)
    return f"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 {width} {height}\n{body}showpage\n%%EOF\n".encode()


def plot_script(data: str, title: str = "") -> str:
    """A plotter's commands for a file of two columns."""
    return f'set title "{title}"\nplot "{data}" using 1:2 with lines notitle\n'


# ---- over DataFrames ----


def image_ids(px: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """px with image_id, the number that the first group of a pattern finds in the path; files that it doesn't fit are left out."""
    found = F.regexp_extract(F.col(path), pattern, 1)
    return px.withColumn("image_id", F.when(found != "", found.cast("int"))).where("image_id IS NOT NULL")


def pattern_of(mask: str) -> str:
    """A file mask such as img%03d.png as a pattern whose groups are its numbers."""
    parts = re.split(r"%(0?)(\d*)d", mask)
    out = re.escape(parts[0])
    for zero, width, rest in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        out += (rf"(\d{{{width},}})" if zero and width else r"(\d+)") + re.escape(rest)
    return out + "$"


def stacked_slices(px: DataFrame, mask: str, first: int, last: int, axis: str = "z", path: str = "path") -> DataFrame:
    """Images whose names fit a mask, from number first to last, as the slices of one volume across an axis: x, y, z, v."""
    at = image_ids(px, pattern_of(mask), path).where(F.col("image_id").between(first, last))
    place = F.col("image_id") - first
    own = {"z": ("x", "y", place), "y": ("x", place, "y"), "x": (place, "x", "y")}[axis]
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in own)
    return at.select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), "v")


def rgba(px: DataFrame) -> DataFrame:
    """Images as four channels each: one is repeated for red, green and blue, and alpha is 255 where there is none."""
    keys = [c for c in px.columns if c not in ("c", "v")]
    at = lambda k: F.max(F.when(F.col("c") == k, F.col("v")))
    n = F.max("c") + 1
    rows = px.groupBy(*keys).agg(n.alias("__n"), *[at(k).alias(f"__{k}") for k in range(4)])
    color = F.col("__n") >= 3
    alpha = F.when(F.col("__n") == 2, F.col("__1")).when(F.col("__n") == 4, F.col("__3")).otherwise(255.0)
    values = [F.col("__0"), F.when(color, F.col("__1")).otherwise(F.col("__0")), F.when(color, F.col("__2")).otherwise(F.col("__0")), alpha]
    return rows.select(*keys, F.posexplode(F.array(*values)).alias("c", "v"))


def metric_lines(metrics: DataFrame, name: str = "metric", mean: str = "mean", sd: str = "sd") -> DataFrame:
    """A line of text for each metric: its name, mean and standard deviation."""
    return metrics.select(F.format_string("%s = %.6f +- %.6f", F.col(name), F.col(mean), F.col(sd)).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.text(path)  # a few metrics


def write_files(rows: DataFrame, folder: str, name: Column, content: str = "content") -> tuple[int, int]:
    """Writes each row's bytes to a file of its own, in the tasks; how many files and bytes.

    The folder is a file: path that all executors share. Files are written under
    another name and then renamed, so a task that runs again after a lost
    executor leaves whole files."""
    if not folder.startswith("file:"):
        raise ValueError("single files are written to a shared file: folder only")
    named = rows.select(name.alias("name"), F.col(content).alias("content"))
    done = named.mapInPandas(lambda batches: _write_batches(batches, folder), "bytes long").agg(F.count("*"), F.sum("bytes")).first()
    return done[0], done[1] or 0


def _write_batches(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    base = urlparse(folder).path
    os.makedirs(base, exist_ok=True)
    for b in batches:
        for name, content in zip(b["name"], b["content"], strict=True):
            part = os.path.join(base, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(content)
            os.replace(part, os.path.join(base, name))
        yield pd.DataFrame({"bytes": [len(c) for c in b["content"]]})


def read_raw(spark: SparkSession, path: str, nx: int, ny: int, nz: int = 1, kind: str = "<f8") -> DataFrame:
    """path, x, y, z, c, v, nx, ny, nz of files that hold elements and nothing else."""
    from .images import pixel_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                yield pixel_rows(name, decode_raw(bytes(data), (nz, ny, nx), kind))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x int, y int, z int, c int, v double, nx int, ny int, nz int")
