"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without white space at both ends, A-Z lower-cased, as
a 128-bit hash. ``LineRuns`` keeps, for the keys seen so far, how many
documents hold them, in runs sorted by hash. Runs are far smaller than documents
and in as few files as their size asks for: each file costs its writer time and a
process for the file's mode on local disks, while dealing runs anew costs little. A new batch of documents is counted,
merge-anti-joined with the runs of keys already known to be common (their
lines go whatever else comes) and added as a run of level 0. When a level has
``fanout`` runs they are merged into one of the next level, and keys that have
reached ``min_docs`` move to the run of common keys. Documents that come as one
table are dealt to batches by a hash of their text.

The common keys are written out before lines are held against them: where they
are few (counted) each task gets all of them, else the join is by sorted hashes,
and one very frequent line is split by Spark's skew join.

Defined cases: null and empty texts have one empty line; an empty key, or one
of fewer than ``min_chars`` code points, is never dropped. A row is a document,
so repeated rows count each. An empty table has no common keys. A text that
loses all lines becomes empty. A text may be long and lose many of its lines:
its lost keys are looked up in groups by hash. Columns beside the text stay as
they are; working columns start with ``__line_``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, fresh_path, materialise, remove_path

KEY = ("__line_a", "__line_b")
#: So many common keys, of 16 bytes each, are sent to every task.
FEW = 500_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    # lower() agrees with A-Z only on plain ASCII, where it is the faster one
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def hashes_of(text: Column, min_chars: int) -> Column:
    """The distinct hashed keys of a text's lines, those of fewer than min_chars left out."""
    keys = F.filter(F.array_distinct(F.transform(lines_of(text), key_of)), lambda k: F.char_length(k) >= min_chars)
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias(KEY[0]), F.xxhash64(F.lit(7), k).alias(KEY[1])))


class LineRuns:
    """Document counts of line keys in levelled sorted runs."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.levels: list[list[str]] = [[]]
        self.common: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        path = fresh_path(self.spark, "line-run")
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        return path

    def _read(self, run: str, counts: bool = True) -> DataFrame:
        return self.spark.read.schema(f"{KEY[0]} long, {KEY[1]} long" + ", n long" * counts).parquet(run)

    def _drop(self, run: str) -> None:
        remove_path(self.spark, run)

    def _summed(self, runs: Iterable[str]) -> DataFrame:
        rows = [self._read(r) for r in runs]
        if not rows:
            return self.spark.createDataFrame([], f"{KEY[0]} long, {KEY[1]} long, n long")
        both = rows[0]
        for r in rows[1:]:
            both = both.unionByName(r)
        return both.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Counts a batch of documents and adds it as a run."""
        keys = docs.select(F.inline(hashes_of(F.col(text), self.min_chars)))
        fresh = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        for run in self.common:
            # as an outer join: Spark moves an anti-join below the counts, where one frequent line is many rows
            known = self._read(run, False).withColumn("__line_known", F.lit(True)).hint("merge")
            fresh = fresh.join(known, list(KEY), "left").where("__line_known IS NULL").drop("__line_known")
        self.levels[0].append(self._write(fresh))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            rows = self._summed(old)
            self.common.append(self._write(rows.where(F.col("n") >= self.min_docs).select(*KEY)))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(rows.where(F.col("n") < self.min_docs)))
            for run in old:
                self._drop(run)
            level += 1

    def common_keys(self) -> DataFrame:
        """Keys found in at least min_docs of the documents added so far."""
        out = self._summed(r for runs in self.levels for r in runs).where(F.col("n") >= self.min_docs).select(*KEY)
        for run in self.common:
            out = out.unionByName(self._read(run, False))
        return out.distinct()  # a key that became common in one level may have grown anew in another

    def close(self) -> None:
        """Removes the runs."""
        for run in (*(r for runs in self.levels for r in runs), *self.common):
            self._drop(run)
        self.levels, self.common = [[]], []


def drop_lines(docs: DataFrame, common: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """docs without the lines whose key is in common, and with __line_n and
    __line_dropped, the numbers of lines before and of lines dropped.

    What a text loses depends on the text alone, so the lists of common keys are
    made and joined by a 128-bit hash of the text; equal texts share one list."""
    own = (F.xxhash64(F.col(text)).alias("__line_t"), F.xxhash64(F.lit(7), F.col(text)).alias("__line_u"))
    found = docs.select(*own, F.inline(hashes_of(F.col(text), min_chars)))
    found = found.join(common, list(KEY), "left_semi")
    # written: a join of plain tables is one that Spark can split where many texts are equal
    gone = materialise(found.groupBy("__line_t", "__line_u").agg(F.collect_set(KEY[0]).alias("__line_gone")), "line-gone")
    rows = docs.select("*", *own).join(gone, ["__line_t", "__line_u"], "left").drop("__line_t", "__line_u")
    lines = lines_of(F.col(text))
    # n lines against m lost keys: groups of keys, as many as the root of n, so that a line meets one of them only
    groups = F.when(F.size("__line_gone") > 32, F.ceil(F.sqrt(F.size(lines).cast("double")))).otherwise(1).cast("int")
    rows = rows.withColumn("__line_groups", groups)
    dealt = F.transform(F.sequence(F.lit(0), F.col("__line_groups") - 1), lambda k: F.filter("__line_gone", lambda h: F.pmod(h, F.col("__line_groups")) == k))
    rows = rows.withColumn("__line_gone", F.when(F.col("__line_gone").isNotNull(), dealt))

    def lost(line: Column) -> Column:
        h = F.xxhash64(key_of(line))
        return F.array_contains(F.get("__line_gone", F.pmod(h, F.col("__line_groups")).cast("int")), h) & (F.char_length(key_of(line)) >= min_chars)

    kept = F.filter(lines, lambda x: ~lost(x))
    hit = F.col("__line_gone").isNotNull()
    rows = rows.withColumn("__line_kept", F.when(hit, kept))
    n = F.size(lines).cast("long")
    return (
        rows.withColumn("__line_n", n)
        .withColumn("__line_dropped", F.when(hit, n - F.size("__line_kept")).otherwise(F.lit(0)).cast("long"))
        .withColumn(text, F.when(hit, F.array_join("__line_kept", "\n")).otherwise(F.col(text)))
        .drop("__line_gone", "__line_kept", "__line_groups")
    )


def file_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """A table read from files, and nothing else done to it, as that many tables
    of files; by a hash of the text if there are fewer files."""
    files = sorted(docs.inputFiles())
    if len(files) < batches:
        return hash_batches(docs, batches)
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[k::batches]) for k in range(batches)]


def hash_batches(docs: DataFrame, batches: int, text: str = "text") -> list[DataFrame]:
    """Any table as that many, by a hash of the text."""
    return [docs.where(F.pmod(F.xxhash64(text), F.lit(batches)) == k) for k in range(batches)]


def dedup_lines(docs: DataFrame, batches: list[DataFrame] | int = 4, text: str = "text", min_docs: int = 10, min_chars: int = 1, fanout: int = 2) -> DataFrame:
    """docs without the lines found in at least min_docs documents. batches are
    the documents in the order in which they came, or how many to deal them to."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    for batch in hash_batches(docs, batches, text) if isinstance(batches, int) else batches:
        runs.add(batch, text)
    common = materialise(runs.common_keys(), "line-common")
    runs.close()
    if common.count() <= FEW:
        common = F.broadcast(common)
    return drop_lines(docs, common, text, min_chars)
