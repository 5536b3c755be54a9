"""Toxicity by noisy-channel deobfuscation and a scorer on restored text.

Restoring. A character language model (n-grams of letters within words, counted
over all documents) says how plausible a spelling is. A token with marks of
obfuscation (digits or signs among letters, letters three times in a row, a run
of single letters with separators) becomes a lattice: each sign may stand for
itself or for letters that it resembles, a repeated letter for one or two of
them, a separator for nothing. The Viterbi algorithm finds the path of the
greatest channel probability times language-model probability. Tokens without
such marks stay as they are. Runs, and tokens with separators, are also read
with separators that may end a word; each word of that reading counts.

Scoring. Features are the restored words and their beginnings. Labelled training
rows give each feature its share of toxic and of clean documents; its evidence
is the log ratio of the two where a likelihood ratio test is sure of it. A logistic regression on a document's strongest and summed evidence,
fitted on evidence that leaves out the document's own fold, gives the score.

Nothing but the text enters a score.

Defined cases: null, empty and unworded texts have no evidence and the score
that goes with that. Equal texts score alike, whatever their row or partition;
repeated rows are scored one each. Texts, tokens and words of any length are
read whole. A null id is never held out, and has no label. Without rows, or
without labels of both kinds, nothing is toxic. Columns of the table that are
named score, predicted or held_out are replaced; others stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove_paths

#: Letters that a sign may stand for (fixed values).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
LM_CELLS = 1 << 16  # of a dense table
WIDE = 1 << 60  # so many cells that grams don't share one; only those that occur are held
ORDER = 4

EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!|+*#") + "«»„“”‘’…–—"
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][\s.\-_*]{1,2}){3,}[^\W_](?![^\W_])")
SET_APART = re.compile(r"([^\W_])([\s.\-_*]*)")
THRICE = re.compile(r"([^\W\d_])\1\1")
SIGN_IN_WORD = re.compile(r"[^\W\d_][0-9@$!|+*#%(€£¡.\-_]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]|[^\W\d_][0-9@$|+€£]+$")


# ---- the character language model ----


def ngram_counts(docs: DataFrame, text: str) -> DataFrame:
    """(cell, n): letter n-grams of all words of all documents, hashed to WIDE cells for each order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        for b in batches:
            for t in b["t"]:
                words.update(t.lower().split())
            if len(words) > 200_000:
                yield _ngrams(words, WIDE)
                words = Counter()
        if words:
            yield _ngrams(words, WIDE)

    rows = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")
    return rows.mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _ngrams(words: Counter[str], cells: int = LM_CELLS) -> pd.DataFrame:
    """Counts of the n-grams of orders 1 to ORDER, vectorised over the words' code points."""
    plain: Counter[str] = Counter()
    for w, n in words.items():
        if (w := bare(w)).isalpha():
            plain[w] += n
    found = []
    if plain:
        text = "\n" + "\n".join(plain) + "\n"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        alphabet, letter = np.unique(code, return_inverse=True)
        weight = np.repeat(np.array(list(plain.values())), [len(w) + 1 for w in plain])
        weight = np.concatenate([[0], weight])[: len(code)]  # the end mark counts with its word
        for k in range(1, ORDER + 1):
            n, size = len(code) - k + 1, len(alphabet) ** k
            gram, ok = np.zeros(n, np.int64), np.ones(n, bool)
            for j in range(k):
                gram = gram * len(alphabet) + letter[j : j + n]
                if 0 < j < k - 1:
                    ok &= code[j : j + n] != 10
            if size <= 1 << 21:  # as many cells as grams there can be
                sums = np.bincount(gram[ok], weight[k - 1 :][ok], size)
                at = np.flatnonzero(sums)
                sums = sums[at]
            else:
                at, of = np.unique(gram[ok], return_inverse=True)
                sums = np.bincount(of, weight[k - 1 :][ok], len(at))
            spelt = np.stack([alphabet[at // len(alphabet) ** (k - 1 - j) % len(alphabet)] for j in range(k)])
            found.append(pd.DataFrame({"cell": gram_cells(spelt.astype(np.uint64), cells) + (k - 1) * cells, "n": sums.astype(np.int64)}))
    out = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"cell": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    return out[out["n"] > 0].groupby("cell", as_index=False).sum()


def gram_cells(letters: np.ndarray, cells: int = LM_CELLS) -> np.ndarray:
    """Cells of grams of k code points, given as k rows."""
    h = np.full(letters.shape[1], len(letters), np.uint64)
    for row in letters:
        h = (h ^ row) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(cells)).astype(np.int64)


class CharModel:
    """log P(letter | up to ORDER - 1 letters before it), interpolated over the orders."""

    def __init__(self, counts: np.ndarray, keys: np.ndarray | None = None, strength: float = 8.0):
        """counts: by cell of a dense table, or of the sorted cells ``keys`` out of WIDE for each order."""
        self.counts, self.keys, self.cells = counts, keys, len(counts) // ORDER if keys is None else WIDE
        first = self.cells if keys is None else np.searchsorted(keys, WIDE)
        self.total = max(1, int(counts[:first].sum()))
        self.strength = strength
        self.kept: dict[str, float] = {}

    def count(self, gram: str) -> int:
        h = len(gram)
        for c in gram:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 32
        at = (len(gram) - 1) * self.cells + h % self.cells
        if self.keys is None:
            return int(self.counts[at])
        i = int(self.keys.searchsorted(at))
        return int(self.counts[i]) if i < len(self.keys) and self.keys[i] == at else 0

    def log_p(self, gram: str) -> float:
        """Of the last letter, given those before it."""
        if (p := self.kept.get(gram)) is None:
            if len(self.kept) > 200_000:
                self.kept.clear()
            x = (self.count(gram[-1]) + 0.1) / (self.total + 50)
            for k in range(2, len(gram) + 1):
                g = gram[-k:]
                n, of = self.count(g), self.count(g[:-1])
                x = (n + self.strength * x) / (max(n, of) + self.strength)
            p = self.kept[gram] = float(np.log(x))
        return p


# ---- the channel ----

SAME, LOOK, DROP, TWICE = 0.0, -1.0, -0.7, -1.2
KEEP_SIGN = -6.0
BREAK = -2.0  # a separator ends a word


def lattice(token: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """For each place, what may have stood there, with the channel's log probability.
    With breaks, a separator may stand for a word's end (a line feed)."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c = token[at]
        run = at
        while (c.isalpha() or c in LOOKS_LIKE) and run < len(token) and token[run] == c:
            run += 1
        if c.isalpha():
            if run - at >= 3:
                out.append([(c, SAME), (c + c, TWICE)])
                at = run
                continue
            out.append([(c, SAME)])
        elif c in LOOKS_LIKE:
            out.append([*((x, LOOK - np.log(len(LOOKS_LIKE[c]))) for x in LOOKS_LIKE[c]), ("", DROP - 2.0)])
            if run - at >= 3:
                at = run
                continue
        else:
            out.append([("", DROP), ("\n", DROP + BREAK)] if breaks else [("", DROP)])
        at += 1
    return out


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of letters set apart. Any separator may end a word; where the
    run has separators of one and of two signs, one of two rather does than not."""
    found = SET_APART.findall(run)
    wide = 2 if {len(s) for _, s in found[:-1]} == {1, 2} else 3
    out: list[list[tuple[str, float]]] = []
    for k, (c, sep) in enumerate(found):
        places = lattice(c)
        if c.isalpha() and k and found[k - 1][0] == c and c in (found[k - 2][0] if k > 1 else "", found[k + 1][0] if k + 1 < len(found) else ""):
            places = [[(c, SAME), ("", TWICE)]]  # one of three or more
        out += places
        if sep:
            joins, ends = (BREAK, 0.0) if len(sep) >= wide else (0.0, BREAK)
            out.append([("", joins), ("\n", ends), *((x, LOOK - np.log(len(LOOKS_LIKE["*"]))) for x in LOOKS_LIKE["*"] if "*" in sep)])
    return out


def best_path(places: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The most probable spelling of a lattice (Viterbi over the last ORDER - 1 letters of a word)."""
    states: dict[str, tuple[float, tuple | None]] = {"\n": (0.0, None)}
    for choices in places:
        after: dict[str, tuple[float, tuple | None]] = {}
        for tail, (score, made) in states.items():
            for letters, channel in choices:
                s, t = score + channel, tail
                for c in letters:
                    if c == t == "\n":  # no word ends where none began
                        continue
                    s += model.log_p(t + c)
                    t = c if c == "\n" else (t + c)[-(ORDER - 1) :]
                if t not in after or s > after[t][0]:
                    after[t] = (s, (made, letters) if letters else made)
        states = after
    end = []
    for t, (s, made) in states.items():
        spelt = []
        while made:
            made, letters = made
            spelt.append(letters)
        end.append((s + model.log_p(t + "\n"), "".join(reversed(spelt))))
    return max(end)[1]


def decode(token: str, model: CharModel) -> str:
    """The most probable spelling of a token as one word."""
    return best_path(lattice(token), model)


def bare(token: str) -> str:
    return token.strip(EDGE).rstrip("!*#$%&|").lstrip("*#%&")


class Restorer:
    def __init__(self, model: CharModel):
        self.model = model
        self.kept: dict[str, tuple[str, ...]] = {}

    def read(self, token: str) -> tuple[str, ...]:
        """A lower-cased token without the signs at its ends, deobfuscated if it
        needs to be; then also the words that its separators part."""
        plain = bare(token)
        if not (plain and not plain.isalpha() and SIGN_IN_WORD.search(plain) or THRICE.search(plain)):
            return (plain,)
        words = (decode(plain, self.model),)
        if any(not c.isalpha() and c not in LOOKS_LIKE for c in plain):
            words += tuple(best_path(lattice(plain, breaks=True), self.model).split("\n"))
        return words

    def readings(self, token: str) -> tuple[str, ...]:
        """read, kept for tokens that come again."""
        if (w := self.kept.get(token)) is None:
            if len(self.kept) > 100_000:
                self.kept.clear()
            w = self.kept[token] = self.read(token)
        return w

    def run_words(self, low: str) -> set[str]:
        """Of letters set apart in a lower-cased text: joined, then the signs among them read; as one word and as several."""
        found: set[str] = set()
        for m in SPACED.finditer(low):
            joined = decode("".join(c for c in m[0] if not c.isspace()), self.model)
            found.update((joined, joined[1:], joined[:-1]))  # a one-letter word may stand beside it
            found.update(best_path(spaced_lattice(m[0]), self.model).split("\n"))
        found.discard("")
        return found

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        found = {w for t in set(low.split()) for w in self.readings(t)} | self.run_words(low)
        found.discard("")
        return found


# ---- the scorer ----


def hashed(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) - (1 << 31)


@lru_cache(maxsize=1 << 16)
def beginnings(start: str) -> tuple[int, ...]:
    return tuple(hashed(f"{k}:{start[:k]}") for k in (4, 5) if len(start) >= k)


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word as a whole and of its beginnings of 4 and 5 letters; none of an empty one."""
    return (hashed("=" + word), *beginnings(word[:5])) if word else ()


@dataclass
class Scorer:
    evidence: dict[int, float]  # by feature
    weights: np.ndarray  # of bias, strongest, sum

    def score(self, marks: set[int]) -> float:
        """From the features of a text that speak for toxicity."""
        x = self.weights @ summed(np.array([self.evidence[c] for c in sorted(marks)]))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Reader:
    """Scores many texts. Most tokens have nothing to say: those met are held in
    two sets, the older of which goes when the younger is full."""

    def __init__(self, restorer: Restorer, scorer: Scorer, most: int = 150_000):
        self.restorer, self.scorer, self.most = restorer, scorer, most
        self.silent: set[str] = set()
        self.older: set[str] = set()
        self.loud: set[str] = set()
        self.marks_of: dict[str, list[int]] = {}
        self.none = scorer.score(set())

    def marks(self, words: Iterable[str]) -> list[int]:
        return [c for w in words for c in features(w) if c in self.scorer.evidence]

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        tokens = set(low.split())
        for t in tokens - self.silent - self.older - self.loud:
            if found := self.marks(self.restorer.read(t)):
                self.loud.add(t)
                self.marks_of[t] = found
            else:
                self.silent.add(t)
        found = {c for t in tokens & self.loud for c in self.marks_of[t]}
        if runs := self.restorer.run_words(low):
            found.update(self.marks(runs))
        if len(self.silent) > self.most:
            self.older, self.silent = self.silent, set()
        if len(self.loud) > self.most:
            self.loud, self.marks_of = set(), {}
        return self.scorer.score(found) if found else self.none


def summed(found: np.ndarray) -> np.ndarray:
    """What the regression sees of the evidence of a text's distinct features."""
    return np.array([1.0, found.max(initial=0.0), np.log1p(found.sum())])


def evidence_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, sure: float) -> np.ndarray:
    """The log ratio of a feature's shares of toxic and clean texts where a
    likelihood ratio test is sure of it (a signed root of 2 log LR), else 0."""
    both = toxic + clean
    share = n_toxic / max(1, n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0))
        ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((ratio > 0) & (g > sure * sure), ratio, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge. A weight that would count evidence
    against toxicity is dropped."""
    use = list(range(x.shape[1]))
    each = 1 / len(y)
    while True:
        z, w = x[:, use], np.zeros(len(use))
        pull = np.r_[1e-6, np.full(len(use) - 1, ridge)]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (each * (p - y)) + pull * w
            hess = (z * (each * p * (1 - p))[:, None]).T @ z + np.diag(pull)
            step = np.clip(np.linalg.solve(hess, grad), -2, 2)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if len(use) == 1 or w[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        use.pop(1 + int(np.argmin(w[1:])))


def language_model(docs: DataFrame, text: str = "text") -> CharModel:
    """From all documents. The driver gets a cell and a count for each distinct n-gram."""
    found = ngram_counts(docs, text).toPandas().sort_values("cell")
    return CharModel(found["n"].to_numpy(np.int64), found["cell"].to_numpy(np.int64))


FOLDS = 4


def train(docs: DataFrame, labels: DataFrame, model: CharModel, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000, sure: float = 4.5) -> Scorer:
    """A scorer from a sample of about most_rows labelled rows: those whose
    text's hash is below a threshold. A text that is labelled both ways counts
    as toxic. Texts that agree in two smallest hashes of their words (copies and
    most near copies) count once, and folds keep those with equal ones together.

    The driver gets the features that the test is sure of, which the sample
    bounds (each needs several toxic texts of it), and three numbers for each
    sampled text."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, most_rows / max(1, marked.count()))
    near = F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).where(near).join(marked, key).select("y", "t")

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, kept = Restorer(model), {}
        for b in batches:
            out = []
            for t in b["t"]:
                own: set[int] = set()
                low = high = 0
                for w in restorer.words(t):
                    if (f := kept.get(w)) is None:
                        if len(kept) > 100_000:
                            kept.clear()
                        f = kept[w] = features(w)
                    own.update(f)
                    low, high = min(low, f[0]), max(high, f[0])
                out.append((low, high, np.fromiter(own, np.int32, len(own))))
            yield pd.DataFrame({"y": b["y"], "low": [x[0] for x in out], "high": [x[1] for x in out], "f": [x[2] for x in out]})

    rows = rows.mapInPandas(words_of, "y int, low int, high int, f array<int>")
    rows = rows.groupBy("low", "high").agg(F.max("y").alias("y"), F.min("f").alias("f")).withColumn("fold", F.pmod("low", F.lit(FOLDS)))
    paths: list[str] = []
    rows = materialise(rows, "labelled", paths)
    sizes = np.zeros((FOLDS, 2))
    for f, y, n in rows.groupBy("fold", "y").count().collect():
        sizes[f, y] = n
    names = [f"n{f}{y}" for f in range(FOLDS) for y in (0, 1)]
    sums = [F.count(F.when((F.col("fold") == f) & (F.col("y") == y), 1)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)]
    counts = rows.select("fold", "y", F.explode("f").alias("f")).groupBy("f").agg(*sums).where("+".join(f"n{f}1" for f in range(FOLDS)) + " > 1")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b[names].to_numpy().reshape(len(b), FOLDS, 2)
            out = {"f": b["f"], "e": evidence_of(n.sum(1)[:, 1], n.sum(1)[:, 0], *sizes.sum(0)[::-1], sure)}
            for k in range(FOLDS):
                rest, size = n.sum(1) - n[:, k], sizes.sum(0) - sizes[k]
                out[f"e{k}"] = evidence_of(rest[:, 1], rest[:, 0], size[1], size[0], sure)
            out = pd.DataFrame(out)
            yield out[out.drop(columns="f").any(axis=1)]

    columns = ["e", *(f"e{k}" for k in range(FOLDS))]
    found = counts.mapInPandas(weigh, "f int, " + ", ".join(f"{c} double" for c in columns))
    found = found.toPandas()
    known = {c: {int(f): float(e) for f, e in zip(found["f"], found[c], strict=True) if e > 0} for c in columns}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = []
            for f, own in zip(b["fold"], b["f"], strict=True):
                e = shared.value[f"e{f}"]
                x.append(summed(np.array([e[c] for c in own.tolist() if c in e])))
            yield pd.DataFrame({"y": b["y"], "x1": [r[1] for r in x], "x2": [r[2] for r in x]})

    sample = rows.mapInPandas(seen, "y int, x1 double, x2 double").toPandas().sort_values(["y", "x1", "x2"])
    remove_paths(docs.sparkSession, paths)
    y = sample["y"].to_numpy()
    x = np.column_stack([np.ones(len(y)), sample[["x1", "x2"]].to_numpy()])
    return Scorer(known["e"], logistic(x, y) if 0 < y.sum() < len(y) else np.array([-5.0, 1.0, 0.0]))


def held_out(key: Column) -> Column:
    """Rows whose labels are never looked at: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_texts(docs: DataFrame, scorer: Scorer, model: CharModel, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.evidence, scorer.weights, model.counts, model.keys))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence, weights, counts, keys = shared.value
        reader = Reader(Restorer(CharModel(counts, keys)), Scorer(evidence, weights))
        for texts in batches:
            yield texts.map(reader.score).astype("float64")

    return docs.withColumn(score, run(F.coalesce(F.col(text), F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score, predicted and held_out; learnt from the labels of rows that aren't held out."""
    model = language_model(docs, text)
    learn = labels.where(~held_out(F.col(key)))
    scorer = train(docs, learn, model, key, text)
    out = score_texts(docs, scorer, model, text)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col(key)))


def filter_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with the same columns."""
    model = language_model(docs, text)
    scorer = train(docs, labels.where(~held_out(F.col(key))), model, key, text)
    name = "__tox_score"
    return score_texts(docs, scorer, model, text, name).where(F.col(name) < threshold).drop(name)
