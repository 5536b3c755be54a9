"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids with an end token; those longer than a sequence are
cut. Lengths are whole numbers up to ``capacity``, so an instance is fully
described by how many pieces there are of each length: that histogram (at most
``capacity`` numbers, however many documents) is all the driver sees.

1. Reduction: for a piece j let k be the most other pieces that fit beside it
   (taking the smallest) and j* the largest that fits. A set of at most two
   partners dominates every other feasible set with j, and is fixed for good, if
   k = 0 ({j}); if k = 1 or j and j* fill the sequence ({j, j*}); if k = 2 and
   j* is no shorter than the best fitting pair ({j, j*}); or if k = 2, b is the
   largest that fits beside j and j*, and no two others longer than b fit beside
   j ({j, j*, b}). Sweeps go on until one fixes nothing: what a later piece
   takes may let an earlier one be fixed.
2. What remains is packed best-fit, longest first, over groups of equal bins.

A plan is a list of (pattern, how many sequences). Each length then has a run
of slots, and the piece of rank r among its length takes slot r: ranks come
from counts by (length, salt), whose running sums are joined back, and a row
number inside each. There are as many salts as it takes for about a million
rows each, so no task ever needs all pieces of a length.

Defined cases: null text is an empty document: its end token alone, one piece of
length 1. Repeated rows are packed as often as they stand there; a null id stays
null beside any other. Texts of any length are read whole, and cut when they
have more tokens than a sequence. An empty table gives no rows. Columns beside
id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, loaded
from .common import materialise

CAPACITY = 2048
Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, times), ...), sequences


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, as its
    encode(text, add_special_tokens=False).

    Merging is done by tiktoken from the file's own vocabulary; a rank there is
    an id, as ids of this file follow the order of its merges (checked)."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if order != sorted(order):
            raise ValueError("ids don't follow the order of merges")
        byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(map(byte.__getitem__, s)): i for s, i in vocab.items() if set(s) <= byte.keys() and i < len(vocab)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {b: i for b, i in ranks.items() if i not in self.special.values()}
        self.encode_plain = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if "<|" not in text or not self.split_special.search(text):
            return little(self.encode_plain(text))
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [little(self.encode_plain(text[at : m.start()])), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, little(self.encode_plain(text[at:]))])


def little(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, the first one shorter if need be."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


# ---- the plan, from a histogram of lengths ----


class Lengths:
    """A multiset of lengths as counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.order = sorted(self.n)
        self.capacity = capacity

    def take(self, w: int, c: int) -> None:
        self.n[w] -= c
        if not self.n[w]:
            del self.n[w]
            self.order.pop(bisect.bisect_left(self.order, w))

    def other(self, w: int, used: int) -> int:
        return self.n[w] - (w == used)

    def largest_fit(self, room: int, used: int) -> int:
        """The longest piece of at most room beside one of length used; 0 if there is none."""
        i = bisect.bisect_right(self.order, room)
        while i:
            i -= 1
            if self.other(self.order[i], used) > 0:
                return self.order[i]
        return 0

    def most_fit(self, room: int, used: int, up_to: int = 3) -> int:
        """How many of the smallest other pieces fit into room (counted up to up_to)."""
        k = 0
        for w in self.order:
            t = min(self.other(w, used), room // w, up_to - k)
            k, room = k + t, room - t * w
            if k >= up_to or room < w:
                break
        return k

    def triple(self, w: int) -> tuple[int, int] | None:
        """(j*, b) if w, j* and b dominate every set with w, given that at most
        two others fit beside w. A set with x and y beside w, x at least y, has x
        no longer than j*; and y no longer than b, unless both are longer than b."""
        room = self.capacity - w
        a = self.largest_fit(room, w)
        free = lambda x: self.n[x] - (x == w) - (x == a)
        i = bisect.bisect_right(self.order, room - a)
        b = next((x for x in reversed(self.order[:i]) if free(x) > 0), 0)
        if not b:
            return None
        longer = [x for x in self.order[bisect.bisect_right(self.order, b) :] for _ in range(min(2, free(x)))][:2]
        return None if len(longer) == 2 and sum(longer) <= room else (a, b)

    def best_pair(self, room: int, used: int) -> int:
        """The largest sum of two other pieces that fits into room."""
        best, lo, hi = 0, 0, len(self.order) - 1
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if not self.other(a, used):
                lo += 1
            elif a + b > room or not self.other(b, used):
                hi -= 1
            else:
                if self.other(a, used) >= 1 + (a == b):
                    best = max(best, a + b)
                lo += 1
        return best


def dominant(left: Lengths, w: int) -> tuple[int, ...] | None:
    """A set with a piece of length w that dominates every other, if there is one."""
    room = left.capacity - w
    k, partner = left.most_fit(room, w), left.largest_fit(room, w)
    if k == 0:
        return (w,)
    if k == 1 or partner == room or (k == 2 and partner >= left.best_pair(room, w)):
        return w, partner
    if k == 2 and (rest := left.triple(w)):
        return w, *rest
    return None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Sets that dominate, fixed; and the counts that remain."""
    left, fixed, before = Lengths(counts, capacity), [], -1
    while len(fixed) != before:
        before = len(fixed)
        for w in sorted(left.n, reverse=True):
            while left.n.get(w, 0) and (own := dominant(left, w)):
                need = {x: own.count(x) for x in own}
                # the conditions hold on while all these lengths last: other pieces only get scarcer
                times = min(left.n[x] // t for x, t in need.items())
                fixed.append((tuple(need.items()), times))
                for x, t in need.items():
                    left.take(x, t * times)
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first; equal bins are kept as one entry with their number."""
    bins: dict[int, dict[tuple, int]] = {}  # room left -> pattern -> how many
    rooms: list[int] = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if room not in bins:
            bins[room] = {}
            bisect.insort(rooms, room)
        bins[room][pattern] = bins[room].get(pattern, 0) + times

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                room, pattern, times = capacity, (), n
            else:
                room = rooms[at]
                pattern, times = bins[room].popitem()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            full = min(room // w, n)
            use = min(times, n // full)
            put(room - full * w, (*pattern, (w, full)), use)
            n -= use * full
            if pattern and times > use:
                put(room, pattern, times - use)
    return [(p, t) for group in bins.values() for p, t in group.items()]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    if any(not 0 < w <= capacity for w in counts):
        raise ValueError("every length must be from 1 to the capacity")
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots_of(plan: Plan) -> dict[int, list[np.ndarray]]:
    """By length: first ranks of the runs, first sequences, first offsets, pieces a sequence."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        at = 0
        for w, t in pattern:
            runs.setdefault(w, []).append((filled.get(w, 0), sequence, at, t))
            filled[w] = filled.get(w, 0) + t * times
            at += t * w
        sequence += times
    return {w: list(np.array(r, np.int64).T) for w, r in runs.items()}


# ---- over DataFrames ----


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32 (and ids)."""
    columns = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # Arrow: a key keeps its type beside a null
        enc, end = loaded(ByteBpe, path), end_id.to_bytes(4, "little")
        for b in batches:
            rows, of = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                whole = enc.ids(t) + end
                for k, (s, n) in enumerate(cut(len(whole) // 4, capacity)):
                    own = whole[4 * s : 4 * (s + n)]
                    of.append(i)
                    rows.append((k, s, n, zlib.crc32(own), *([np.frombuffer(own, "<i4")] * with_ids)))
            values = [pa.array([r[j] for r in rows], t) for j, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(of, pa.int64())), *values], names=["k", *columns])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = f"k {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 1_000_000) -> DataFrame:
    """pieces (with length and anything else) with sequence_id and offset.

    pieces must give the same rows whenever it is read: a written table. The
    driver gets how many there are of each length, at most capacity rows."""
    total = pieces.count()
    salts = max(16, -(-total // rows_per_salt))
    key = [c for c in pieces.columns if not c.startswith("_") and c != "ids"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counts = materialise(salted.groupBy("length", "_salt").count(), "counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = slots_of(plan_sequences(by_length, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy(*[F.col(c) for c in key])
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(base, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(w: pd.Series, rank: pd.Series) -> pd.DataFrame:
        w, rank = w.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for length in np.unique(w):
            at = np.flatnonzero(w == length)
            first, sequence, offset, times = slots[length]
            j = np.searchsorted(first, rank[at], "right") - 1
            r = rank[at] - first[j]
            seq[at] = sequence[j] + r // times[j]
            off[at] = offset[j] + (r % times[j]) * length
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    place = placed(F.col("length"), (F.col("_rank") + F.col("_base")).cast("long"))
    return ranked.withColumn("_at", place).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return assign_sequences(materialise(cut_documents(docs, path, capacity, end_id, key, text, with_ids), "pieces"), capacity)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from pack_documents(with_ids=True)."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"))
