"""WARC records and a Merkle fixity audit of their replicas.

Each archive file is a sequence of records at known offsets. A record's leaf
hashes its byte range and its SHA-256; a node hashes its range and the hashes
of up to ``FAN`` children in order; the root stands for the file. Two replicas
are compared root by root, and only below nodes that differ: an intact file
costs one comparison, a damaged record one path. Nothing but digests moves.

What is found: ``changed`` (another digest at that place), ``moved`` (the same
record and digest elsewhere), ``missing`` and ``extra``.

Defined cases: null url and null html are written as empty; null ids sort
first; equal rows are copies 0, 1, ... of one record, numbered so that a run
gives the same files each time; an empty table has no files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

FAN = 16
CRLF = "\r\n"


def record_of(key: Column, url: Column, body: Column) -> Column:
    """A response record as text; its bytes are its UTF-8."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    ident = F.coalesce(key.cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), ident,
        F.lit(f">{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head, body, F.lit(CRLF + CRLF))


def layout(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_file: int = 1000) -> DataFrame:
    """file, place, start, stop, record_id, copy, sha256 of every row's record.

    Files get about per_file records each, by a hash of id and copy number, so
    neither a large table nor many equal rows make a large file."""
    record = record_of(F.col(key), F.col(url), F.col(body))
    rows = pages.select(F.col(key).alias("record_id"), F.octet_length(record).cast("long").alias("size"), F.sha2(record.cast("binary"), 256).alias("sha256"))
    rows = rows.groupBy("record_id", "size", "sha256").count()
    rows = materialise(rows, "records")
    files = max(1, -(-(rows.agg(F.sum("count")).first()[0] or 0) // per_file))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy")).drop("count")
    name = F.concat_ws("/", F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    rows = rows.withColumn("file", F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % files)
    order = Window.partitionBy("file").orderBy("record_id", "sha256", "copy")
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("place", F.row_number().over(order).cast("long") - 1).withColumn("stop", stop)
    return rows.select("file", "place", (F.col("stop") - F.col("size")).alias("start"), "stop", "record_id", "copy", "sha256")


def ranged_hash(start: Column, stop: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(" ", start.cast("string"), stop.cast("string"), content).cast("binary"), 256)


def tree(records: DataFrame) -> DataFrame:
    """file, level (0: leaves), place, start, stop, hash of all nodes; each file's root is its only node of the top level."""
    most = records.agg(F.max("place")).first()[0]
    level = records.select("file", "place", "start", "stop", ranged_hash(F.col("start"), F.col("stop"), F.col("sha256")).alias("hash"))
    out, k = level.withColumn("level", F.lit(0)), 0
    while most:
        most, k = most // FAN, k + 1
        level = level.groupBy("file", F.floor(F.col("place") / FAN).alias("place")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("below")
        )
        content = F.array_join(F.transform("below", lambda x: x["hash"]), "")
        level = level.select("file", "place", "start", "stop", ranged_hash(F.col("start"), F.col("stop"), content).alias("hash"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def differing_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """(file, place) of the leaves in which two trees differ, by descent from the roots."""
    tops = [t.agg(F.max("level")).first()[0] or 0 for t in (one, other)]
    top = max(tops)
    bad: DataFrame | None = None
    for level in range(top, -1, -1):
        sides = []
        for t, name in ((one, "a"), (other, "b")):
            rows = t.where(F.col("level") == level).select("file", "place", F.col("hash").alias(name))
            if bad is not None:
                rows = rows.join(bad, (F.col("file") == F.col("f")) & (F.floor(F.col("place") / FAN) == F.col("p")), "left_semi")
            sides.append(rows)
        both = sides[0].join(sides[1], ["file", "place"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        bad = materialise(both.select(F.col("file").alias("f"), F.col("place").alias("p")), "differing")
        if bad.isEmpty():
            break
    # a tree of fewer levels has no node to compare above its root: its leaves are reached all the same
    return bad.select(F.col("f").alias("file"), F.col("p").alias("place"))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of records (a layout) with its status in the replica, and the replica's extra records."""
    one, other = materialise(tree(records), "tree"), materialise(tree(replica), "tree")
    bad = differing_leaves(one, other)
    mine = records.join(bad.withColumn("suspect", F.lit(True)), ["file", "place"], "left")
    theirs = replica.join(bad, ["file", "place"], "left_semi")
    theirs = theirs.select(*[F.col(c).alias("r_" + c) for c in ("file", "copy", "record_id", "sha256", "place", "start", "stop")])
    suspects = mine.where("suspect").drop("suspect")
    same = (F.col("file") == F.col("r_file")) & F.col("record_id").eqNullSafe(F.col("r_record_id")) & (F.col("copy") == F.col("r_copy"))
    found = suspects.join(theirs, same, "full_outer").select(
        F.coalesce("file", "r_file").alias("file"),
        F.coalesce("place", "r_place").alias("place"),
        F.coalesce("start", "r_start").alias("start"),
        F.coalesce("stop", "r_stop").alias("stop"),
        F.coalesce("record_id", "r_record_id").alias("record_id"),
        F.coalesce("copy", "r_copy").alias("copy"),
        F.coalesce("sha256", "r_sha256").alias("sha256"),
        F.when(F.col("place").isNull(), "extra").when(F.col("r_place").isNull(), "missing").when(F.col("sha256") != F.col("r_sha256"), "changed").otherwise("moved").alias("status"),
    )
    intact = mine.where("suspect IS NULL").drop("suspect").withColumn("status", F.lit("intact"))
    return intact.unionByName(found)


def roots(nodes: DataFrame) -> DataFrame:
    """file, root and size of every file."""
    top = nodes.groupBy("file").agg(F.max(F.struct("level", "hash", "stop")).alias("t"))
    return top.select("file", F.col("t.hash").alias("root"), F.col("t.stop").alias("size"))


# ---- files ----


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", per_file: int = 1000) -> None:
    """Archive files below path, a folder file=n for each, whose records lie at the places of layout()."""
    record = record_of(F.col(key), F.col(url), F.col(body))
    rows = pages.select(F.col(key).alias("record_id"), record.alias("value")).withColumn("sha256", F.sha2(F.col("value").cast("binary"), 256))
    places = layout(pages, key, url, body, per_file)
    texts = rows.groupBy("record_id", "sha256").agg(F.min("value").alias("value"))
    on = texts["record_id"].eqNullSafe(places["record_id"]) & (texts["sha256"] == places["sha256"])
    out = places.join(texts, on).select("file", "start", "value").repartition("file").sortWithinPartitions("file", "start")
    # a record ends in two line breaks, the last of which the writer adds
    out.select("file", F.expr("substring(value, 1, char_length(value) - 2)").alias("value")).write.partitionBy("file").option("lineSep", CRLF).text(path)


RECORD, END = b"WARC/", b"\r\n\r\n"


def record_at(content: bytes, at: int) -> tuple[int, dict[str, str], bytes] | None:
    """stop, header fields and body of the record that starts at a place; None
    if there is none, or its length doesn't lead to its end."""
    end = content.find(END, at)
    if content[at : at + len(RECORD)] != RECORD or end < 0:
        return None
    fields = dict(x.split(": ", 1) for x in content[at:end].decode("utf-8", "replace").split(CRLF)[1:] if ": " in x)
    size = fields.get("Content-Length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    stop = end + len(END) + int(size) + len(END)
    return (stop, fields, content[end + len(END) : stop - len(END)]) if content[stop - len(END) : stop] == END else None


def parsed(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, bool]]:
    """start, stop, header fields, body and True for the records of an archive
    file; for a range that can't be read as one its bytes, no fields and False.
    Such a range goes on to the next place, after a record's end mark, that can."""
    at = 0
    while at < len(content):
        if found := record_at(content, at):
            yield at, *found, True
            at = found[0]
            continue
        start = at
        while (at := content.find(END + RECORD, at)) >= 0 and not record_at(content, at := at + len(END)):
            pass
        at = at if at >= 0 else len(content)
        yield start, at, {}, content[start:at], False


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, start, stop, uri, record_id, body of the records of archive files,
    and intact: false for a range of bytes that can't be read as a record, of
    which only place and bytes are given. A file is read whole, by one task, and
    so must be below 2 GB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = [(name, s, e, f.get("WARC-Target-URI", ""), f.get("WARC-Record-ID", ""), bytes(x), ok) for s, e, f, x, ok in parsed(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "start", "stop", "uri", "record_id", "body", "intact"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, start long, stop long, uri string, record_id string, body binary, intact boolean")
