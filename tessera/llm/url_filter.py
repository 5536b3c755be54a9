"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs,
give each character a probability from the longest context they know,
interpolated down to a uniform one. A URL is rejected if its log-likelihood
difference per character exceeds a threshold: the one that best separates the
two classes (balanced accuracy), halfway to the next score, over all labelled
URLs. Hosts are dealt to folds, and each URL is scored for this by models that
have seen no URL of its host's fold; so the threshold holds for unknown hosts.

Labels are a column of the table, where there is one. Without, hosts that hold
one of a list of words (a parameter) count as rejected and all others as
accepted: a weak source, from which the models learn what such URLs look like.

Counts are kept by 64-bit hashes of the grams that occur, over every labelled
URL; the driver gets a key and a count for each distinct gram, class and fold,
so that no two grams share a cell however many there are, and two histograms.

Defined cases: a null URL, or one without "://", has an empty host and an empty
path, fits no rule and is allowed; so is any URL that the models can't tell
apart, and any without a rule where one of the classes is empty. Where a class
is known from hosts of one fold only, the threshold comes from the models of all
folds. Of rules of one length that both fit the last one listed wins. Repeated
rows are judged alike; a URL of any length is read whole; an empty table gives
no rows. Columns of the table named host, path, rule, verdict or url_score are
replaced; others stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

ORDER, CELLS = 5, 1 << 15  # cells of a dense table
WIDE = 1 << 59  # so many cells that grams don't share one; only those that occur are held
#: Scores are calibrated in bins of this width between -LIMIT and LIMIT.
STEP, LIMIT = 0.01, 20.0


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    rule: str  # host and the beginning of a path, like com/en/

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


#: What marks a host as rejected when no labelled URLs are at hand.
SPAM_SEEDS = (
    "ads-", "adserv", "adult", "banner", "bets", "betting", "bonus", "casino", "cialis", "clickbait", "counterfeit", "escort", "gambl", "jackpot", "loans", "lottery",
    "malware", "payday", "pharma", "phish", "pills", "poker", "popup", "porn", "replica", "slots", "spam", "track", "viagra", "warez", "xxx",
)
#: Parts that hosts are dealt to when the threshold is set.
FOLDS = 2


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def seed_label(host: Column, seeds: tuple[str, ...] = SPAM_SEEDS) -> Column:
    """1 for hosts with a seed in them, else 0."""
    hit = F.lit(False)
    for s in seeds:
        hit = hit | host.contains(s)
    return hit.cast("int")


# ---- the models ----


def grams(urls: list[str], k: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the grams of k characters that end at each place of each URL (an
    end mark included), and the URL of each. Marks before the start fill contexts."""
    sizes = np.fromiter(map(len, urls), np.int64, len(urls)) + 1
    code = np.frombuffer("".join("\x02" * (ORDER - 1) + u + "\x03" for u in urls).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    own = np.repeat(np.arange(len(urls)), sizes)
    end = np.arange(len(own)) + (ORDER - 1) * (own + 1)
    h = np.full(len(end), k, np.uint64)
    for j in range(k - 1, -1, -1):
        h = (h ^ code[end - j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(cells)).astype(np.int64), own


def contexts(urls: list[str], k: int, cells: int = CELLS) -> np.ndarray:
    """Cells of the k characters before each place."""
    marked = ["\x02" + u for u in urls]  # the place before the first character, and without the end mark
    code = np.frombuffer("".join("\x02" * (ORDER - 1) + u for u in marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(urls))
    own = np.repeat(np.arange(len(urls)), sizes)
    end = np.arange(len(own)) + (ORDER - 1) * (own + 1)
    h = np.full(len(end), 1000 + k, np.uint64)
    for j in range(k - 1, -1, -1):
        h = (h ^ code[end - j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(cells)).astype(np.int64)


class Counts:
    """How often the grams of each class occur, by sorted keys."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n  # n: [class, key]

    def of(self, k: int, kind: int, cells: np.ndarray) -> np.ndarray:
        """[class, cell] of the grams (kind 0) or contexts (kind 1) of order k."""
        if not len(self.keys):
            return np.zeros((2, len(cells)), np.int64)
        distinct, back = np.unique(key(k, kind, cells), return_inverse=True)
        at = np.minimum(self.keys.searchsorted(distinct), len(self.keys) - 1)
        return np.where(self.keys[at] == distinct, self.n[:, at], 0)[:, back]


def key(k: int, kind: int, cells: np.ndarray) -> np.ndarray:
    return cells + (2 * k + kind) * WIDE


class FoldCounts:
    """Counts of each class and fold of hosts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n  # n: [fold, class, key]

    def all(self) -> Counts:
        return Counts(self.keys, self.n.sum(0, dtype=self.n.dtype))

    def without(self, fold: int) -> Counts:
        return Counts(self.keys, self.n.sum(0, dtype=self.n.dtype) - self.n[fold])


def count_tables(labelled: DataFrame) -> FoldCounts:
    """Of all grams and contexts of all rows of labelled (url, y, fold). The driver
    gets a row for each distinct gram: its key, and a number a class and fold, of
    four bytes where all characters together are few enough."""
    names = [f"n{k}" for k in range(2 * FOLDS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (fold, y), own in b.groupby(["fold", "y"])["url"]:
                urls = own.tolist()
                for k in range(ORDER):
                    for kind, cells in enumerate((grams(urls, k + 1, WIDE)[0], contexts(urls, k, WIDE))):
                        found, n = np.unique(key(k, kind, cells), return_counts=True)
                        yield pd.DataFrame({"key": found, **dict.fromkeys(names, 0), names[2 * fold + y]: n})

    most = labelled.agg(F.sum(F.length("url") + 1)).first()[0] or 0
    kind = "int" if most < 1 << 31 else "long"
    rows = labelled.mapInPandas(run, "key long, " + ", ".join(f"{n} long" for n in names))
    found = rows.groupBy("key").agg(*[F.sum(n).cast(kind).alias(n) for n in names]).toPandas().sort_values("key")
    return FoldCounts(found["key"].to_numpy(np.int64), found[names].to_numpy(np.int32 if kind == "int" else np.int64).T.reshape(FOLDS, 2, -1).copy())


def scores(urls: list[str], tables: np.ndarray | Counts, strength: float = 4.0, alphabet: int = 256) -> np.ndarray:
    """Rejected minus accepted log-likelihood of each URL per character; tables
    are Counts, or dense as [class, order, 0: grams or 1: contexts, cell]."""
    if not urls:
        return np.zeros(0)
    p = np.full((2, sum(map(len, urls)) + len(urls)), 1.0 / alphabet)
    own = None
    for k in range(ORDER):
        wide = isinstance(tables, Counts)
        cells, own = grams(urls, k + 1, WIDE if wide else CELLS)
        before = contexts(urls, k, WIDE if wide else CELLS)
        ns, ofs = (tables.of(k, 0, cells), tables.of(k, 1, before)) if wide else (tables[:, k, 0, cells], tables[:, k, 1, before])
        for y, (n, of) in enumerate(zip(ns, ofs, strict=True)):
            p[y] = (np.minimum(n, of) + strength * p[y]) / (of + strength)
    ratio = np.log(p[1]) - np.log(p[0])
    return np.bincount(own, ratio, len(urls)) / (np.fromiter(map(len, urls), float, len(urls)) + 1)


def scored(rows: DataFrame, tables, url: str, score: str) -> DataFrame:
    """rows with the score of url by the broadcast tables."""

    @F.pandas_udf("double")
    def run(urls: pd.Series) -> pd.Series:
        return pd.Series(scores(urls.tolist(), tables.value))

    return rows.withColumn(score, run(F.coalesce(F.col(url), F.lit(""))))


def cross_scored(labelled: DataFrame, tables) -> DataFrame:
    """labelled with the score of each URL by counts without its own fold."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        counts = [tables.value.without(f) for f in range(FOLDS)]
        for urls, folds in batches:
            out = np.zeros(len(urls))
            for f in range(FOLDS):
                at = np.flatnonzero(folds.to_numpy() == f)
                out[at] = scores(urls.iloc[at].tolist(), counts[f])
            yield pd.Series(out)

    return labelled.withColumn("score", run("url", "fold"))


def calibrated(rows: DataFrame, score: str, label: str) -> float:
    """The threshold between the classes of greatest balanced accuracy, from a
    histogram of all rows. Infinite (nothing is rejected) if a class is empty."""
    place = F.floor(F.least(F.greatest(F.col(score), F.lit(-LIMIT)), F.lit(LIMIT)) / STEP).cast("int")
    hist = rows.groupBy(place.alias("bin"), F.col(label).alias("y")).count().collect()
    bins = sorted({b for b, _, _ in hist})
    n = np.zeros((2, len(bins)))
    for b, y, c in hist:
        n[y, bins.index(b)] += c
    if not n.sum(1).all():
        return float("inf")
    share = n.cumsum(1) / n.sum(1, keepdims=True)
    gain = share[0, :-1] + 1 - share[1, :-1]  # accepted below, rejected above
    if not len(gain):
        return float("inf")
    best = int(np.argmax(gain))
    return STEP * (bins[best] + 1 + bins[best + 1]) / 2


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...], url: str = "url", label: Column | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and url_score (null where a rule decides).

    label: 1 for rejected and 0 for accepted URLs, null for others; by default
    what the seeds say of the host."""
    link, spark = F.col(url), pages.sparkSession
    rows = pages.withColumn("host", host_of(link)).withColumn("path", path_of(link))
    y = seed_label(host_of(link)) if label is None else label
    fold = F.pmod(F.crc32(host_of(link).cast("binary")), F.lit(FOLDS)).cast("int")
    labelled = pages.select(link.alias("url"), y.cast("int").alias("y"), fold.alias("fold")).where("url IS NOT NULL AND y IS NOT NULL").where(F.col("url").contains("://"))
    counts = count_tables(labelled)
    tables = spark.sparkContext.broadcast(counts.all())
    whole = counts.n.any(2).sum(0).min() > 1  # both classes have hosts in two folds at least
    tried = cross_scored(labelled, spark.sparkContext.broadcast(counts)) if whole else scored(labelled, tables, "url", "score")
    threshold = calibrated(tried, "score", "y")
    rows = scored(rows.withColumn("__url_rule", rule_of(F.col("host"), F.col("path"), rules)), tables, url, "url_score")
    reject = (F.col("url_score") > threshold) & (F.col("host") != "")
    verdict = F.coalesce(F.col("__url_rule.verdict"), F.when(reject, "block").otherwise("allow"))
    return rows.withColumn("rule", F.col("__url_rule.rule")).withColumn("verdict", verdict).drop("__url_rule")
