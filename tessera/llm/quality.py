"""Quality rules as a short-circuit cascade.

Every rule has a predicate that rejects a document. On a sample that is spread
over the table by a hash of the text, tasks measure what each rule costs and
which rows it rejects; the driver gets one number a rule and row, no texts.
Rules are then ordered greedily by rejections per second: the best one first,
then the best on the rows that it lets through, and so on. Each rule sees only
the rows that all earlier ones let through. The order decides how fast a
verdict is reached, never which verdict; the rule named as the reason is the
first in the order in which rules are listed, so it doesn't depend on time.

Defined cases: null or empty text has no words: all counts are 0, and the base
rule rejects. Equal texts get equal verdicts, repeated rows one each; a null id
stays null beside any other. Texts of any length are read whole, one at a time.
An empty table gives no rows. Columns beside id and text are not looked at,
whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE

SYMBOLS = "#*$%&|<>"


def count_all(text: str, chars: str) -> int:
    return sum(map(text.count, chars))


class Facts:
    """Measurements of one text, each made when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._kept: dict[str, object] = {}

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def words(self) -> list[bytes]:
        # bytes.split() cuts at exactly the six ASCII white space characters
        return self._once("words", lambda: self.text.encode("utf-8", "surrogatepass").split())

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._once("word_chars", lambda: len(self.text) - count_all(self.text, ASCII_SPACE))

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: count_all(self.text, SYMBOLS))

    @property
    def lines(self) -> list[str]:
        return self._once("lines", lambda: [x for x in self.text.split("\n") if x.strip(ASCII_SPACE)])

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - self._once("line_set", lambda: len(set(self.lines)))

    @property
    def n_repeat_words(self) -> int:
        return self._once("n_repeat_words", lambda: repeated(self.words))


def repeated(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, n - 2)
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


@dataclass(frozen=True)
class Rule:
    """rejects(Facts) -> True if the document is to go."""

    name: str
    rejects: Callable[[Facts], bool]


def too_short(x: Facts, least: int = 50) -> bool:
    return x.n_words < least


def too_repetitive(x: Facts) -> bool:
    return 100 * x.n_repeat_words > 50 * x.n_words


def too_many_symbols(x: Facts) -> bool:
    return 10 * x.n_symbols > x.n_words


def shouting(x: Facts) -> bool:
    return 10 * x.text.count("!") > 3 * x.n_words


def mostly_capitals(x: Facts) -> bool:
    letters = x._once("letters", lambda: sum(map(str.isalpha, x.text)))
    return 10 * sum(map(str.isupper, x.text)) > 4 * letters


def word_length(x: Facts) -> bool:
    return not 2 * x.n_words <= x.word_chars <= 15 * x.n_words


def repeated_lines(x: Facts) -> bool:
    return 10 * x.n_dup_lines > 4 * len(x.lines)


BASE = (Rule("too_short", too_short), Rule("too_repetitive", too_repetitive))
RULES = (
    Rule("too_many_symbols", too_many_symbols),
    Rule("shouting", shouting),
    Rule("mostly_capitals", mostly_capitals),
    Rule("word_length", word_length),
    Rule("repeated_lines", repeated_lines),
)


@dataclass
class Cascade:
    """Rules in the order in which they are tried."""

    rules: list[Rule]

    def rejects(self, facts: Facts) -> bool:
        return any(r.rejects(facts) for r in self.rules)


def measured(rules: tuple[Rule, ...], text: str | None) -> tuple[int, list[float]]:
    """Bits of the rules that reject a text, and the seconds that each takes by itself."""
    bits, seconds = 0, []
    for k, r in enumerate(rules):
        facts = Facts(text)
        began = time.perf_counter()
        bits |= r.rejects(facts) << k
        seconds.append(time.perf_counter() - began)
    return bits, seconds


def ordered(rules: tuple[Rule, ...], bits: np.ndarray, seconds: np.ndarray) -> Cascade:
    """Greedy by rejections per second among the rows that are left; as listed on ties."""
    left, rest, out = np.ones(len(bits), bool), list(range(len(rules))), []
    while rest:
        if not left.any():
            out += rest
            break
        best = max(rest, key=lambda k: ((bits[left] >> k & 1).mean() / max(seconds[left, k].mean(), 1e-9), -k))
        out.append(best)
        rest.remove(best)
        left &= (bits >> best & 1) == 0
    return Cascade([rules[k] for k in out])


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 1024) -> Cascade:
    """A cascade planned on about sample_rows rows (they set the order only)."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(np.ceil(share * (1 << 30)))).limit(4 * sample_rows)

    @F.pandas_udf("struct<bits:long,seconds:array<double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [measured(rules, t) for t in texts]
        return pd.DataFrame({"bits": [b for b, _ in found], "seconds": [s for _, s in found]})

    rows = some.select(run(F.coalesce(F.col(text), F.lit(""))).alias("m")).select("m.*").collect()  # len(rules) + 1 numbers a row
    return ordered(rules, np.array([r["bits"] for r in rows], np.int64), np.array([r["seconds"] for r in rows]).reshape(len(rows), len(rules)))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text: str = "text", sample_rows: int = 1024) -> DataFrame:
    """The rows of docs that no rule rejects, with the same columns."""
    cascade = plan(docs, rules, text, sample_rows)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: not cascade.rejects(Facts(t))).astype(bool)

    return docs.where(keep(F.coalesce(F.col(text), F.lit(""))))


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample_rows: int = 1024) -> DataFrame:
    """The base counts, base_failed and kept of every row, and the first listed rule that rejects it."""
    cascade = plan(docs, rules, text, sample_rows)
    names = [c.split()[0] for c in VERDICT.split(", ")]

    @F.pandas_udf(VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:  # sees the text alone: a key goes through no batch of another type
        rows = []
        for t in texts:
            f = Facts(t)
            base = too_short(f) or too_repetitive(f)
            gone = base or cascade.rejects(f)
            why = "base" if base else next(r.name for r in rules if r.rejects(f)) if gone else None
            rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base, not gone, why))
        return pd.DataFrame(rows, columns=names)

    return docs.select(F.col(key), judge(F.coalesce(F.col(text), F.lit(""))).alias("__q")).select(key, "__q.*")
