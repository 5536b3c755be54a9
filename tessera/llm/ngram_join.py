"""N-gram Jaccard self-join by rare-first prefix filtering.

A text's set holds 64-bit hashes of its distinct shingles of ``width`` words.
Texts with equal sets are one class and take part once, so groups of copies
cost one set. All sets are sorted by one global order, rare shingles first: two
sets of Jaccard similarity t or more share a shingle among their first
n - ceil(t n) + 1. The order comes from a count sketch over all documents; any
order gives the same result, a better one fewer candidates.

Candidates share a prefix shingle and pass the length filter and the positional
filter: what both can share up to that shingle (no more than either has of
shingles that several sets hold) and what the shorter rest can add must reach
the needed overlap. The suffix filter bounds the overlap by the sizes of the two sets' parts in fixed
ranges of the hash; what passes is verified exactly, once per pair.

Only links that join different components matter, and most groups of near copies
have a text that the others were made from. In a first round, every prefix
shingle takes as its pivot the set in which it comes earliest (an original has
few shingles of its own before it) and pairs the others with that: as many
pairs as postings, not their square. More such rounds follow, with pivots by a
hash, while they find links and the pairs left are many more than the postings.
The last round takes all pairs left that share a prefix shingle and stand in
different components, which makes the components exact; a shingle that many
such sets share is dealt in blocks, of which any two meet in a task of their own.

Defined cases: null text and text without words have an empty set, size 0, and
link with nothing; with fewer than ``width`` words the whole sequence is one
shingle. Repeated rows are one class. A null doc_id is never the smallest of a
component that has another; a component of nulls has a null id. Columns beside
doc_id and text are not looked at; working columns start with ``__ng_``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release_shuffles, remove_path, remove_paths

SKETCH_BITS, CHUNK_BITS = 22, 16
#: So many sets that share a shingle meet in one task of the last round.
BLOCK = 2000
#: Size of the bitmap of shingles that occur in several prefixes: 8 MB.
BITMAP_BITS = 26
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A, MIX_B, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return [_powers[0][:n], _powers[1][:n]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, A-Z lower-cased, and each text's first word."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    gap = _space[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    p, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_lower[raw].astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start]), np.searchsorted(start, at)


def shingle_sets(texts: list[str | None], width: int = 5, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text, in order; blocks bound the memory."""
    own, held = [], 0
    for t in texts:
        own.append((t or "").encode("utf-8", "surrogatepass"))
        held += len(own[-1])
        if held >= block:
            yield from _block_sets(own, width)
            own, held = [], 0
    yield from _block_sets(own, width)


def _block_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not texts:
        return
    words, first = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = mixed(rolled * GOLD + words[k : k + n])
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mixed(h * GOLD + w)
            yield h
        else:
            yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set. (With 1e10 different sets about three pairs may meet.)"""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


# ---- pass 1: sizes, ids, and the sketch of how often shingles occur ----


def profile(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row for each document (chunk null): __ng_key, two hashes of its text,
    __ng_set, __ng_n; and this task's part of the sketch, a row for each chunk."""
    kind = docs.schema[key].dataType.simpleString()

    names = ["k", "h", "g", "s", "n", "chunk", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: a key keeps its type beside a null
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        key_type = None
        for b in batches:
            key_type = b.schema.field("k").type
            ids, sizes = [], []
            held, waiting = [], 0
            for s in shingle_sets(b.column("t").to_pylist(), width):
                ids.append(set_id(s))
                sizes.append(len(s))
                held.append(s)
                waiting += len(s)
                if waiting > 1 << 20:
                    _count(sketch, held)
                    held, waiting = [], 0
            _count(sketch, held)
            own = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), b.column("g"), *own], names=names)
        if key_type is not None:
            parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(-1, 1 << CHUNK_BITS)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, key_type), *[pa.nulls(m, pa.int64())] * 4, pa.array(range(m), pa.int32()), pa.array(parts, pa.binary())], names=names)

    rows = docs.select(F.col(key).alias("k"), *text_hashes(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"k {kind}, h long, g long, s long, n long, chunk int, part binary")


def text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")


def _count(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        np.add.at(sketch, (np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), np.uint32(1))


def merged_sketch(rows: DataFrame) -> np.ndarray:
    """A byte for each cell of the sketch, growing with the log of its count.

    Parts are added as they stream by: a task holds the sums of its chunks. The
    driver gets one byte a cell, 4 MB whatever the input."""
    chunks = 1 << (SKETCH_BITS - CHUNK_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, part in zip(b["chunk"], b["part"], strict=True):
                x = np.frombuffer(zlib.decompress(part), np.uint32).astype(np.uint64)
                total[c] = total[c] + x if c in total else x
        for c, x in total.items():
            level = np.minimum(255, np.round(6 * np.log2(x + 1.0))).astype(np.uint8)
            yield pd.DataFrame({"chunk": [c], "part": [level.tobytes()]})

    parts = rows.where("chunk IS NOT NULL").select("chunk", "part").repartition(chunks, "chunk")
    out = np.zeros((chunks, 1 << CHUNK_BITS), np.uint8)
    for c, part in parts.mapInPandas(run, "chunk int, part binary").collect():
        out[c] = np.frombuffer(part, np.uint8)
    return out.ravel()


# ---- pass 2: prefixes ----


def bitmap_of(tokens: DataFrame) -> np.ndarray:
    """A bit for each cell of a table of fixed size that one of tokens falls into.

    It spares the shuffle most shingles that occur in one text only. A table
    that fills up lets more of them through; the join behind it is exact."""
    chunk = 1 << CHUNK_BITS  # bytes
    chunks = (1 << BITMAP_BITS) // 8 // chunk

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
        for b in batches:
            cell = b["token"].to_numpy() & ((1 << BITMAP_BITS) - 1)
            np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        parts = bits.reshape(chunks, chunk)
        some = np.flatnonzero(parts.any(1))
        yield pd.DataFrame({"chunk": some.astype(np.int32), "part": [zlib.compress(parts[c].tobytes(), 1) for c in some]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, part in zip(b["chunk"], b["part"], strict=True):
                x = np.frombuffer(zlib.decompress(part), np.uint8)
                total[c] = total[c] | x if c in total else x
        for c, x in total.items():
            yield pd.DataFrame({"chunk": [c], "part": [x.tobytes()]})

    kind = "chunk int, part binary"
    out = np.zeros((chunks, chunk), np.uint8)
    for c, part in tokens.mapInPandas(mark, kind).repartition(chunks, "chunk").mapInPandas(merge, kind).collect():
        out[c] = np.frombuffer(part, np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, text: str, sketch, width: int, percent: int, only=None) -> DataFrame:
    """s, token, and n << 32 | place of every prefix shingle (of those marked in
    the bitmap only, if it is given); a set seen twice in a task comes once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, mask = sketch.value, np.uint64((1 << SKETCH_BITS) - 1)
        bits, cells = (only.value if only else None), np.uint64((1 << BITMAP_BITS) - 1)
        seen: set[int] = set()
        for b in batches:
            tokens, ids, places, held = [], [], [], 0
            for s in shingle_sets(b["t"].tolist(), width):
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                p = prefix_length(len(s), percent)
                freq = level[(s & mask).astype(np.int64)]
                if p < len(s):  # s is sorted: a stable sort by frequency leaves ties in order of the hash
                    cut = np.partition(freq, p - 1)[p - 1]
                    near = np.flatnonzero(freq <= cut)
                    order = near[np.argsort(freq[near], kind="stable")][:p]
                else:
                    order = np.argsort(freq, kind="stable")
                own, at = s[order], np.arange(p, dtype=np.int64)
                if bits is not None:
                    cell = (own & cells).astype(np.int64)
                    on = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                    own, at = own[on], at[on]
                tokens.append(own)
                ids.append(np.full(len(own), i, np.int64))
                places.append(at | len(s) << 32)
                held += len(own)
                if held > 200_000:
                    yield _postings(tokens, ids, places)
                    tokens, ids, places, held = [], [], [], 0
            if held:
                yield _postings(tokens, ids, places)

    rows = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")
    return rows.mapInPandas(run, "token long, s long, np long")


def _postings(tokens: list, ids: list, places: list) -> pd.DataFrame:
    return pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "s": np.concatenate(ids), "np": np.concatenate(places)})


# ---- candidates and their verification ----


def needed_overlap(a: Column, b: Column, percent: int) -> Column:
    """The least overlap with which sets of sizes a and b reach the similarity."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def with_shared_rank(postings: DataFrame) -> DataFrame:
    """postings with r, how many of a set's postings come up to this one. Only
    shingles that stand in postings of several sets (or, later, components) are
    among them, so r bounds what two sets can share up to a place."""
    return postings.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.col("np").bitwiseAND(0xFFFFFFFF))))


def may_link(percent: int) -> Column:
    """Length and positional filters on postings x and y of one shingle."""
    n, m = F.shiftright("x.np", 32), F.shiftright("y.np", 32)
    i, j = F.col("x.np").bitwiseAND(0xFFFFFFFF), F.col("y.np").bitwiseAND(0xFFFFFFFF)
    lengths = F.lit(percent) * F.greatest(n, m) <= F.lit(100) * F.least(n, m)
    need = needed_overlap(n, m, percent)
    # a pair that links shares a shingle among the first n - need + 1 and m - need + 1 of its sets
    places = (i <= n - need) & (j <= m - need)
    # what they can share up to this shingle, and all that the shorter rest can add
    bound = F.least("x.r", "y.r") + F.least(n - i - 1, m - j - 1)
    return lengths & places & (bound >= need)


def paired(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of joined postings x and y that may link.

    A pair comes with every shingle that it shares; their number and the last
    place on either side bound the overlap once more."""
    swap = F.col("x.s") > F.col("y.s")
    side = lambda c: (F.when(swap, F.col("y." + c)).otherwise(F.col("x." + c)), F.when(swap, F.col("x." + c)).otherwise(F.col("y." + c)))
    (a, b), (i, j) = side("s"), side("np")
    rows = rows.where(may_link(percent)).select(a.alias("a"), b.alias("b"), i.alias("i"), j.alias("j"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))


def links(a: np.ndarray, b: np.ndarray, percent: int, parts: int = 64) -> bool:
    """Whether two sorted sets reach the similarity: suffix filter, then exactly."""
    n, m = len(a), len(b)
    if n > 4 * parts or m > 4 * parts:
        edges = (np.arange(1, parts, dtype=np.uint64)) << np.uint64(64 - parts.bit_length() + 1)
        x = np.diff(np.concatenate([[0], np.searchsorted(a, edges), [n]]))
        y = np.diff(np.concatenate([[0], np.searchsorted(b, edges), [m]]))
        most = int(np.minimum(x, y).sum())
        if 100 * most < percent * (n + m - most):
            return False
    both = np.sort(np.concatenate([a, b]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (n + m - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    rows = pairs.join(sets.select(F.col("s").alias("a"), F.col("members").alias("x")), "a")
    rows = rows.join(sets.select(F.col("s").alias("b"), F.col("members").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def needed_sets(docs: DataFrame, profiles: DataFrame, ids: DataFrame, text: str, width: int, paths: list[str], small: int = 1_000_000) -> DataFrame:
    """s and its members for the given ids, from one text of each."""
    # ids are distinct: an inner join stays above the aggregate, so a set of many copies is one row by then
    texts = profiles.groupBy("s").agg(F.min(F.struct("h", "g")).alias("t")).join(ids, "s").select("t.h", "t.g")
    texts = materialise(texts, "texts", paths)
    if texts.count() <= small:  # 16 bytes each
        texts = F.broadcast(texts)
    rows = docs.select(*text_hashes(F.col(text)), F.col(text).alias("t")).join(texts, ["h", "g"], "left_semi").select("t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            ids, members, held = [], [], 0
            for s in shingle_sets(b["t"].tolist(), width):
                if (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                ids.append(i)
                members.append(s.tobytes())
                held += len(members[-1])
                if held > 1 << 23:
                    yield pd.DataFrame({"s": ids, "members": members})
                    ids, members, held = [], [], 0
            yield pd.DataFrame({"s": ids, "members": members})

    return rows.mapInPandas(run, "s long, members binary").groupBy("s").agg(F.min("members").alias("members"))


# ---- components ----


def components(edges: DataFrame, paths: list[str], a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, comp) for every node of edges, comp the smallest node of its
    component: alternating large and small stars, each round written out."""
    spark, written = edges.sparkSession, []
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    before = None
    for _ in range(most_rounds):
        near = both(now)
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), F.col("a").alias("y"), "m")
        small = small.select(F.explode(F.array("x", "y")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = materialise(small, "stars", written)
        if len(written) > 1:
            remove_path(spark, written.pop(0))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    paths += written
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def live_pairs(shared: DataFrame, bounds: DataFrame, paths: list[str]) -> DataFrame:
    """All joined postings x and y of a shingle in different components. Tokens of
    more than BLOCK postings are dealt to blocks, each of which meets each."""
    live = shared.drop("r").join(bounds.select("token"), "token", "left_semi")
    live = materialise(with_shared_rank(live), "live", paths)
    apart = "x.s < y.s AND x.comp <> y.comp"
    many = live.groupBy("token").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    many = materialise(many, "many", paths)
    if many.isEmpty():
        return live.alias("x").join(live.alias("y"), "token").where(apart)
    few = live.join(many, "token", "left_anti")
    dealt = live.join(many, "token").withColumn("own", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = dealt.select("token", F.col("own").alias("i"), F.col("other").alias("j"), "s", "np", "r", "comp")
    y = dealt.select("token", F.col("other").alias("i"), F.col("own").alias("j"), "s", "np", "r", "comp")
    met = x.alias("x").join(y.alias("y"), ["token", "i", "j"]).where(apart).drop("i", "j")
    both = [F.struct(*[F.col(f"{side}.{c}") for c in ("s", "np", "r", "comp")]).alias(side) for side in "xy"]
    return few.alias("x").join(few.alias("y"), "token").where(apart).select(*both).unionByName(met.select(*both))


def class_components(docs: DataFrame, profiles: DataFrame, text: str, width: int, percent: int, sketch, paths: list[str], pivots: int = 5) -> DataFrame | None:
    """(s, comp) of the sets that link with another; None if there is none."""
    spark = docs.sparkSession
    step: list[str] = []  # what the next table is made of
    often = prefixes(docs, text, sketch, width, percent).select("token").groupBy("token").count().where("count > 1").select("token")
    often = materialise(often, "often", step)
    only = spark.sparkContext.broadcast(bitmap_of(often))
    shared = prefixes(docs, text, sketch, width, percent, only).join(often, "token", "left_semi").dropDuplicates(["token", "s"])
    postings: list[str] = []
    shared = materialise(with_shared_rank(shared.withColumn("comp", F.col("s"))), "postings", postings)
    remove_paths(spark, step)
    found = sets = tried = labels = None
    turn, last = 0, False
    while True:
        first = F.struct(F.col("np").bitwiseAND(0xFFFFFFFF).alias("at"), "s") if not turn else F.struct(F.xxhash64(F.lit(turn), "s").alias("at"), "s")
        bounds = shared.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.min_by(F.struct("s", "np", "r", "comp"), first).alias("pivot"))
        bounds = bounds.where("lo <> hi").drop("lo", "hi")
        bounds = materialise(bounds, "bounds", step)  # a plain table: joins with it can be split where a token is frequent
        if turn:  # pairs that the last round would make, against postings
            load, rows = bounds.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
            last = last or turn >= pivots or (load or 0) <= 32 * (rows or 0)
        if not last:
            pairs = paired(bounds.select("token", "pivot.*").alias("x").join(shared.alias("y"), "token").where("x.comp <> y.comp"), percent)
        else:
            pairs = paired(live_pairs(shared, bounds, step), percent)
            n, m = F.shiftright("i", 32), F.shiftright("j", 32)
            rest = F.least(n - F.col("i").bitwiseAND(0xFFFFFFFF), m - F.col("j").bitwiseAND(0xFFFFFFFF)) - 1
            pairs = pairs.where(F.col("c") + rest >= needed_overlap(n, m, percent))
        pairs = pairs.select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs", paths)
        remove_paths(spark, step)
        release_shuffles(spark)
        tried = pairs if tried is None else tried.unionByName(pairs)
        fruitless = pairs.isEmpty()
        if not fruitless:
            ends = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
            if sets is not None:  # not an anti-join, which Spark would move below the distinct
                ends = ends.join(sets.select("s", F.lit(True).alias("held")), "s", "left").where("held IS NULL").select("s")
            fresh = materialise(needed_sets(docs, profiles, ends, text, width, step), "sets", paths)
            remove_paths(spark, step)
            sets = fresh if sets is None else sets.unionByName(fresh)
            good = materialise(verified(pairs, sets, percent), "links", paths)
            fruitless = good.isEmpty()
        if not fruitless:
            found = good if found is None else found.unionByName(good)
            release_shuffles(spark)
            labels = components(found, paths)
        if last:
            break
        if not fruitless:
            shared = shared.drop("comp").join(labels.select(F.col("node").alias("s"), "comp"), "s", "left")
            shared = materialise(shared.select("token", "s", "np", "r", F.coalesce("comp", "s").alias("comp")), "postings", postings)
            remove_path(spark, postings.pop(0))
        turn, last = turn + 1, fruitless
    remove_paths(spark, postings)
    return None if labels is None else labels.select(F.col("node").alias("s"), "comp")


def _joined(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles (k, h, g, s, n) and (s, group, comp_id), comp_id the smallest key of the group."""
    spark = docs.sparkSession
    rows = materialise(profile(docs, key, text, width), "profile")
    profiles = rows.where("chunk IS NULL").drop("chunk", "part")
    sketch = spark.sparkContext.broadcast(merged_sketch(rows))
    paths: list[str] = []  # of what only leads to the result
    labels = class_components(docs, profiles, text, width, percent, sketch, paths)
    classes = profiles.where("n > 0").groupBy("s").agg(F.min("k").alias("k"))
    if labels is None:
        named = classes.select("s", F.col("s").alias("group"), F.col("k").alias("comp_id"))
    else:
        classes = classes.join(labels, "s", "left").select("s", F.coalesce("comp", "s").alias("group"), "k")
        named = classes.select("s", "group").join(classes.groupBy("group").agg(F.min("k").alias("comp_id")), "group")
    named = materialise(named, "components")
    remove_paths(spark, paths)
    return profiles, named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id of every row of docs."""
    profiles, named = _joined(docs, key, text, width, percent)
    rows = profiles.join(named.drop("group"), "s", "left")
    own = F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("comp_id"))
    return rows.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: the smallest key, then the smallest hash
    of the text (equal rows: any one). Texts without words all stay."""
    profiles, named = _joined(docs, key, text, width, percent)
    member = profiles.where("n > 0").select("k", "h", "g", "s").join(named.select("s", "group"), "s")
    order = F.struct(F.col("k").isNull().alias("z"), "k", "h", "g")
    kept = member.groupBy("group").agg(F.min(order).alias("m")).select("m.k", "m.h", "m.g")
    first = kept.select(F.col("k").alias("__ng_k"), F.col("h").alias("__ng_h"), F.col("g").alias("__ng_g"))
    h, g = text_hashes(F.col(text))
    rows = docs.withColumn("__ng_h", h).withColumn("__ng_g", g).withColumn("__ng_some", F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    worded = rows.where("__ng_some")
    on = worded[key].eqNullSafe(first["__ng_k"]) & (worded["__ng_h"] == first["__ng_h"]) & (worded["__ng_g"] == first["__ng_g"])
    chosen = worded.join(first, on, "left_semi")
    values = [F.first(F.struct(*docs.columns)).alias("__ng_row")]
    chosen = chosen.groupBy("__ng_h", "__ng_g").agg(*values).select("__ng_row.*")
    return chosen.unionByName(rows.where("NOT __ng_some").select(*docs.columns))
