"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word starts as its symbols. The leaves of a segment tree hold, for each
position that still heads a symbol, the rank of the merge with its right
neighbour (infinite if there is none). An inner node keeps the smaller rank of
its children, the left one on ties, so the root names the leftmost merge of the
lowest rank. A merge changes three leaves, each in logarithmic time: a word of
n symbols takes O(n log n) however the merges nest. Trees of many words are
merged in step as rows of arrays.

Texts are cut at single blanks first: no token of the vocabulary's splitting
rule spans white space, so each piece can be encoded alone and its result kept
in a cache of bounded size (a pure speed-up; a cold cache gives the same rows).

Defined cases: null text counts as empty: no tokens, and the digests of the
empty string. Equal texts get equal rows, repeated rows one each; a null id
stays null beside any other. Texts of any length are read whole, a batch of them
at a time. An empty table gives no rows. Columns beside id and text are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = (1 << 60) - 1


class MergeForest:
    """One segment tree for each word of a batch, merged in step.

    Row r of ``tree`` is the tree of word r: node 1 is the root, node p has the
    children 2p and 2p + 1, and leaf ``size + i`` holds the rank of the merge of
    the symbol at position i with its right neighbour. Every round makes, in
    each word that still has a mergeable pair, the merge that its root names."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """merges: (left id, right id, id of the whole) in order of rank."""
        m = np.array(merges, np.int64).reshape(-1, 3)
        pair = m[:, 0] << 32 | m[:, 1]
        self.by_pair = np.argsort(pair, kind="stable")
        self.pairs = pair[self.by_pair]
        self.whole = m[:, 2]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; INF where there is none or an id is -1."""
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (a >= 0) & (b >= 0), self.by_pair[at], INF)

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """The symbols of each word once no pair has a rank."""
        out: list[list[int]] = [list(w) for w in words]
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > 1:
                by_size.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for size, of in by_size.items():
            step = max(1, 4_000_000 // size)  # bounds the memory of a round
            for at in range(0, len(of), step):
                own = of[at : at + step]
                for k, row in zip(own, self._merge([words[k] for k in own], size), strict=True):
                    out[k] = [x for x in row if x >= 0]
        return out

    def _merge(self, words: list[list[int]], size: int) -> list[list[int]]:
        n = len(words)
        sym = np.full((n, size), -1, np.int64)
        long = np.fromiter(map(len, words), np.int64, n)
        sym[np.arange(size) < long[:, None]] = np.fromiter((x for w in words for x in w), np.int64)
        nxt = np.tile(np.arange(1, size + 1), (n, 1))
        nxt[np.arange(n), long - 1] = -1
        prv = np.tile(np.arange(-1, size - 1), (n, 1))
        tree = np.full((n, 2 * size), INF, np.int64)
        tree[:, size : 2 * size - 1] = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, -1)
        p = size
        while p > 1:
            tree[:, p // 2 : p] = np.minimum(tree[:, p : 2 * p : 2], tree[:, p + 1 : 2 * p : 2])
            p //= 2
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            rank, at = tree[live, 1], np.ones(len(live), np.int64)
            while at[0] < size:  # all leaves are equally deep
                at *= 2
                at += tree[live, at] != rank
            i = at - size
            j = nxt[live, i]
            k, h = nxt[live, j], prv[live, i]
            sym[live, i], sym[live, j] = self.whole[rank], -1
            nxt[live, i] = k
            on = k >= 0
            prv[live[on], k[on]] = i[on]
            self._update(tree, live, size + j, np.full(len(live), INF))
            self._update(tree, live, size + i, self.rank(sym[live, i], np.where(on, sym[live, k], -1)))
            on = h >= 0
            self._update(tree, live[on], size + h[on], self.rank(sym[live[on], h[on]], sym[live[on], i[on]]))
            live = live[tree[live, 1] < INF]
        return sym.tolist()

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        if len(rows):
            tree[rows, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])


class PieceCache(dict):
    """Results by piece. When it reaches ``most`` entries they become the older
    half, which is asked second and dropped at the next turn."""

    def __init__(self, make: Callable, most: int = 400_000):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, piece):
        if (value := self.older.get(piece)) is None:
            value = self.make(piece)
        self.put(piece, value)
        return value

    def put(self, piece, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = value

    def lacks(self, piece) -> bool:
        return piece not in self and piece not in self.older


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: How this kind of vocabulary cuts normalised text; what no branch matches is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library that
    drops white space and marks word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": WORDS} or spec["decoder"]:
            raise ValueError("a vocabulary file of another kind")
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: s for s, i in vocab.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s for s, i in self.special.items()}
        self.number = {i: str(i) for i in self.token}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.forest = MergeForest([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        letters = byte_letters()
        self.inner = {b: vocab[c] for b, c in letters.items()}
        self.last = {b: vocab[c + self.suffix] for b, c in letters.items()}
        self.split_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.find = regex.compile(WORDS).findall
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.pieces = PieceCache(lambda piece: self._encode_pieces([piece])[0])
        self.words = PieceCache(lambda word: self._encode_words([word])[0])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        inner, last, symbols = self.inner.__getitem__, self.last, []
        for w in words:
            b = w.encode()
            symbols.append([*map(inner, b[:-1]), last[b[-1]]])
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in self.forest.merge(symbols)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, 32 bits each."""
        # a piece of ASCII letters alone is one word
        cut = [((p.lower(),) if p.isalpha() else self.find(p.lower())) if p.isascii() else self.find(self.normalise(p)) for p in pieces]
        fresh = [w for w in {w for words in cut for w in words} if self.words.lacks(w)]
        known = dict(zip(fresh, self._encode_words(fresh), strict=True))
        words = self.words
        out = [b"".join([known[w] if w in known else words[w] for w in own]) for own in cut]
        for w, r in known.items():
            words.put(w, r)
        return out

    def _segments(self, text: str) -> list[list[str] | int]:
        """The pieces between special tokens, and the special tokens' ids."""
        if "<|" not in text:
            return [text.replace("\n", " ").split(" ")]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [text[at : m.start()].replace("\n", " ").split(" "), self.special[m[0]]]
            at = m.end()
        return [*out, text[at:].replace("\n", " ").split(" ")]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self._segments(t or "") for t in texts]
        fresh = {p for segments in cut for s in segments if not isinstance(s, int) for p in s}
        fresh = [p for p in fresh if self.pieces.lacks(p)]
        for p, r in zip(fresh, self._encode_pieces(fresh), strict=True):
            self.pieces.put(p, r)
        get = self.pieces.__getitem__  # what the cache has dropped meanwhile is encoded again
        rows = [b"".join([s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(get, s)) for s in segments]) for segments in cut]
        return [np.frombuffer(r, "<u4") for r in rows]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder in the file: the tokens joined by a blank."""
        return " ".join(map(self.token.__getitem__, ids))

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids and of the decoded text."""
        sha, number, out = hashlib.sha256, self.number.__getitem__, []
        for ids in map(np.ndarray.tolist, self.encode_batch(texts)):
            out.append((len(ids), sha(" ".join(map(number, ids)).encode()).hexdigest(), sha(self.decode(ids).encode()).hexdigest()))
        return out


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One tokenizer a worker process and file."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids. Other columns stay."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        enc = loaded(WordBpe, path)
        return texts.map(enc.encode)

    return docs.withColumn(ids, run(F.coalesce(F.col(text), F.lit(""))))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of a column of token ids (null: empty)."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        enc = loaded(WordBpe, path)
        return rows.map(lambda x: "" if x is None else enc.decode([int(i) for i in x]))

    return docs.withColumn(text, run(F.col(ids)))


def digest_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:  # sees the text alone: a key goes through no batch of another type
        return pd.DataFrame(loaded(WordBpe, path).digests(texts.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), run(F.coalesce(F.col(text), F.lit(""))).alias("__bpe")).select(key, "__bpe.*")
