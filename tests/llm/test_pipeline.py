"""The pipeline's stages in order, their columns and what they keep."""

import collections
import hashlib
import random
import re
import sys
from pathlib import Path

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm_operators import SPACE, brute_components, brute_lines, brute_quality  # noqa: E402


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "line_dedup", "ngram_jaccard", "best_fit_packing"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    lexicon = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(160):
        w = [rng.choice(lexicon) for _ in range(rng.randint(60, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["moronish", "scumbaggy"]))
        text = " ".join(w) + ("\nShared last line" if i % 3 == 0 else "")
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, 1, toxic))
    base = [r for r in rows if r[0] % 5 and r[0] % 3][:4]
    rows += [(1000 + k, base[k % 4][1], "en", "src", 1) for k in range(8)] + [(2000, None, None, None, None), (2001, "", "en", "src", 0), (2002, "## " * 80, "en", "src", 240)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    toxicity, quality, lines, join, pack = [f for _, f in corpus_pipeline.STAGES]
    one = toxicity(spark, docs, tables).cache()
    assert one.columns == docs.columns
    ids = {r["doc_id"] for r in one.collect()}
    assert not ids & set(range(0, 160, 5)) and {i for i in range(160) if i % 5} <= ids
    two = quality(spark, one, tables)
    ids = {r["doc_id"] for r in two.collect()}
    assert not ids & {2000, 2001, 2002} and {i for i in range(160) if i % 5} <= ids
    three = lines(spark, two, tables)
    assert three.columns == docs.columns and three.count() == two.count()
    assert not any("Shared last line" in r["text"] or len(r["text"]) != r["n_chars"] for r in three.where("doc_id < 1000").collect())
    four = join(spark, three, tables)
    assert four.columns == docs.columns and not {r["doc_id"] for r in four.collect()} & set(range(1000, 1008))
    assert {r["doc_id"] for r in pack(spark, four, tables).collect()} == {i for i in range(160) if i % 5}


def plain_verdict(t):
    """The quality rules once more, one after another."""
    n, chars, symbols, dup, repeat = brute_quality(t)
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    letters = [c for c in t or "" if c.isalpha()]
    return not (
        n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or 10 * (t or "").count("!") > 3 * n or 10 * sum(map(str.isupper, t or "")) > 4 * len(letters)
        or not 2 * n <= chars <= 15 * n or 10 * dup > 4 * len(lines)
    )


def test_stages_against_brute_force(spark):
    """Each stage but the classifier on rows with gaps, repeated ids and rows, and a long text."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    texts = []
    for k in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 8))]
        lines += ["  Shared LINE of many"] * (k % 3 == 0) + ["other shared line\t"] * (k % 4 == 0)
        texts.append("\n".join(lines))
    texts += [texts[k].replace(" ", "  ", 1) for k in range(5)] + [texts[k] + " tail" for k in range(5, 12)] + [texts[0]] * 3
    texts += [None, "", "LOUD WORDS " * 60, "wow!!! " * 80, "a b " * 100, " ".join(word() for _ in range(30_000))]
    rows = [(None if k % 17 == 16 else k // 2 if k % 5 == 0 else k, t, None if k % 9 == 8 else "en", "s", None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    _, quality, lines, join, pack = [f for _, f in corpus_pipeline.STAGES]
    bag = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    two = quality(spark, docs, "").cache()
    assert bag(two) == sorted([(i, t) for i, t, *_ in rows if plain_verdict(t)], key=repr)
    three = lines(spark, two, "").cache()
    want = brute_lines([(r["doc_id"], r["text"]) for r in two.collect()])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted([(r["doc_id"], digest(r["text"])) for r in three.collect()], key=repr) == sorted([(i, h) for i, _, _, h in want], key=repr)
    assert sum(n for _, _, n, _ in want) > 20
    four = join(spark, three, "").cache()
    left = [(k, r["doc_id"], r["text"]) for k, r in enumerate(three.collect())]
    group = brute_components([(k, t) for k, _, t in left])
    groups = collections.defaultdict(list)
    for k, i, t in left:
        groups[group[k][1] if group[k][0] else ("none", k)].append((i is None, i or 0, t))
    got = collections.Counter(bag(four))
    assert four.count() == len(groups) < len(left)
    assert collections.Counter(i for i, _ in got.elements()) == collections.Counter(None if (m := min(g))[0] else m[1] for g in groups.values())
    assert set(got) <= {(i, t) for _, i, t in left}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = collections.Counter()
    held = collections.defaultdict(int)
    for r in pack(spark, four, "").collect():
        sizes[r["doc_id"]] += r["length"]
        held[r["sequence_id"]] += r["length"]
    want = collections.Counter()
    for r in four.collect():
        want[r["doc_id"]] += len(lib.encode(r["text"], add_special_tokens=False).ids) + 1
    assert sizes == want and max(held.values()) <= 2048 and len(held) <= -(-sum(want.values()) // 2048) + 1


def test_whole_run_and_empty_table(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables)
    assert {r["doc_id"] for r in out.collect()} == {i for i in range(160) if i % 5}
    spark.read.parquet(f"{tables}/documents.parquet").where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").where("false").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
