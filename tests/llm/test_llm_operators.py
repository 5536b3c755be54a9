"""The operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows, no rows, and columns whose names clash."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, bpe, html_extract, line_dedup, ngram_join, packing, quality, toxicity, url_filter, warc

DOCS = "doc_id long, text string, h string, s string, v string, token string"
SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts):
    rows = texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS).repartition(3)


def words(rng, n, of=300):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


# ---- op1 ----

RULES = tuple(url_filter.UrlRule(*r) for r in [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")])


def expected_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.rule)).rule if fits else None


def test_url_rules_and_model(spark):
    good = [f"https://site{i}.example.org/en/{i}?a=b" for i in range(40)]
    bad = [f"http://www.casino-win{i}.example.org/en/{i}" for i in range(20)]
    odd = [None, "", "nothing", "://", "HTTP://A.Example.COM/en/71#x", "x://notexample.com/en/7", "x://com/en/", "x://com", "x://b.net/de/8", "x://example.net/de/88", "x://a.org/es/\n2", "https://casino.example.org/" + "q" * 20_000]
    urls = good + bad + odd + good[:1]
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)], "page_id long, url string, y string, score double")
    out = url_filter.filter_urls(df, RULES)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(urls) and {"y", "score"} <= set(out.columns)
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == expected_rule(u), u
    assert all(got[i]["verdict"] == "allow" for i in range(40)) and all(got[40 + i]["verdict"] == "block" for i in range(20))
    assert got[60]["verdict"] == got[61]["verdict"] == "allow"
    none = url_filter.filter_urls(df.where("false"), RULES)
    assert none.count() == 0


def test_url_scores_against_plain_counting():
    urls, rejected = ["http://ab.c/", "http://ab.d/x", ""], ["http://zz.z/"]
    tables = np.zeros((2, url_filter.ORDER, 2, url_filter.CELLS), np.int64)
    plain = collections.Counter()
    for y, own in enumerate((urls, rejected)):
        for k in range(url_filter.ORDER):
            tables[y, k, 0] += np.bincount(url_filter.grams(own, k + 1)[0], minlength=url_filter.CELLS)
            tables[y, k, 1] += np.bincount(url_filter.contexts(own, k), minlength=url_filter.CELLS)
            for u in own:
                marked = "\x02" * (url_filter.ORDER - 1) + u + "\x03"
                for e in range(url_filter.ORDER - 1, len(marked)):
                    plain[y, marked[e - k : e + 1]] += 1
                    plain[y, "ctx", marked[e - k : e]] += 1

    def score(u):
        total, marked = 0.0, "\x02" * (url_filter.ORDER - 1) + u + "\x03"
        for e in range(url_filter.ORDER - 1, len(marked)):
            p = [1 / 256, 1 / 256]
            for k in range(url_filter.ORDER):
                for y in (0, 1):
                    p[y] = (plain[y, marked[e - k : e + 1]] + 4 * p[y]) / (plain[y, "ctx", marked[e - k : e]] + 4)
            total += math.log(p[1]) - math.log(p[0])
        return total / (len(u) + 1)

    probe = ["http://ab.c/", "zz", "", "é"]
    assert np.allclose(url_filter.scores(probe, tables), [score(u) for u in probe], atol=1e-3)


def test_url_counts_hold_every_gram_apart(spark):
    rng = random.Random(2)
    urls = ["http://" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) for _ in range(3000)]
    plain = [collections.Counter(), collections.Counter()]
    for i, u in enumerate(urls):
        marked = "\x02" * (url_filter.ORDER - 1) + u + "\x03"
        plain[i % 2].update(marked[e - url_filter.ORDER + 1 : e + 1] for e in range(url_filter.ORDER - 1, len(marked)))
    assert len(plain[0]) > url_filter.CELLS
    tables = url_filter.count_tables(spark.createDataFrame([(u, i % 2, i // 2 % 2) for i, u in enumerate(urls)], "url string, y int, fold int").repartition(3))
    assert tables.all().n.sum() == tables.without(0).n.sum() + tables.without(1).n.sum() and tables.n.any(2).all()
    tables = tables.all()
    for u in urls[:20]:
        marked = "\x02" * (url_filter.ORDER - 1) + u + "\x03"
        got = tables.of(url_filter.ORDER - 1, 0, url_filter.grams([u], url_filter.ORDER, url_filter.WIDE)[0])
        assert got.tolist() == [[plain[y][marked[e - url_filter.ORDER + 1 : e + 1]] for e in range(url_filter.ORDER - 1, len(marked))] for y in (0, 1)]


def test_url_models_reject_an_unknown_host(spark):
    rng = random.Random(6)
    good = [f"https://{rng.choice(['news', 'www', 'blog'])}.{rng.choice(['river', 'stone', 'maple', 'cloud'])}{k % 40}.example.org/articles/{rng.choice(['politics', 'science', 'culture'])}/{rng.randrange(9999)}" for k in range(400)]
    bad = [f"http://{rng.choice(['casino', 'poker', 'pills', 'porn'])}{k % 20}.example.org/win-free-cash-now/bonus-deal-{rng.randrange(99)}.php?aff={rng.randrange(99)}" for k in range(60)]
    new = ["http://luckyday.example.org/win-free-cash-now/bonus-deal-7.php?aff=3", "https://www.valley3.example.org/articles/science/123"]
    df = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, ()).collect()}
    assert not any(s in new[0].split("/")[2] for s in url_filter.SPAM_SEEDS)
    assert (got[460], got[461]) == ("block", "allow")
    assert all(got[400 + k] == "block" for k in range(60)) and sum(got[k] == "block" for k in range(400)) <= 4
    told = url_filter.filter_urls(df, (), label=F.when(F.col("page_id") % 2 == 0, (F.col("page_id") >= 400).cast("int")))
    assert {r["verdict"] for r in told.where("page_id BETWEEN 400 AND 460").collect()} == {"block"}
    none = url_filter.filter_urls(df, (url_filter.UrlRule("block", "org/articles/"),), label=F.lit(0))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {("org/articles/", "block"), (None, "allow")}


def test_url_rules_of_one_length_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "https://b.com/ab/c", 7, "mine")], "page_id long, url string, rule int, host string")
    one, two = url_filter.UrlRule("block", "com/ab/"), url_filter.UrlRule("allow", "b.com/a")
    for rules in ((one, two), (two, one)):
        out = url_filter.filter_urls(df, rules)
        (r,) = out.collect()
        assert (r["rule"], r["verdict"], r["host"]) == (rules[1].rule, rules[1].verdict, "b.com")
        assert sorted(out.columns) == ["host", "page_id", "path", "rule", "url", "url_score", "verdict"]


# ---- op2 ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>A  title &amp; more</h1><p>First <b>para</b>graph<br>with a break, of some length, as text goes.<p>Second paragraph &lt;here&gt;, also of some length.
<div class="ad">Buy now</div><ul><li>One item of the text.</li></ul></article>
<aside class="sidebar"><p>Popular posts</p></aside><section id="comments"><h3>Comments</h3><article class="comment"><p>I think so too, and this is long enough to look like text.</p></article></section>
<form><label>Name</label><input></form><footer>&copy; site</footer><script>var a = "</p>";</script></body></html>"""


def test_main_text_of_a_page(spark):
    want = "A title & more\n\nFirst paragraph with a break, of some length, as text goes.\n\nSecond paragraph <here>, also of some length.\n\nOne item of the text."
    rows = [(0, PAGE), (1, None), (2, ""), (3, "<p>unclosed <div <<< &amp;"), (4, PAGE), (5, "<div>" * 3000 + "deep" + "</div>" * 10)]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, model string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert got[0] == got[4] == want and got[1] == got[2] == "" and len(got) == 6
    assert html_extract.extract_pages(df.where("false")).count() == 0


HAND = [  # a page, and its main text as a reader sees it
    ('<body><script>var s="<!--";</script><article><p>Some text of an article, long enough to be one.</p></article><footer>Imprint</footer></body>', "Some text of an article, long enough to be one."),
    ("<body><style>a > b { c: '</p>' }</style><article><p>Text after a style sheet, in a paragraph of its own.</p></article></body>", "Text after a style sheet, in a paragraph of its own."),
    ("<article><p>The firm AT&amp<i>;</i>T has a paragraph here, with a few words.</p></article>", "The firm AT&;T has a paragraph here, with a few words."),
    ("<article><p>Drawn <svg><g><svg><text>inner</text></svg><text>outer</text></g></svg> beside the words of this paragraph.</p></article>", "Drawn beside the words of this paragraph."),
    ('<body><a href="/">Home</a> <a href="/in">Login</a> <a href="/x">More</a><article><h1>A title</h1><p>And the text of it, which goes on for a while.</p></article></body>', "A title\n\nAnd the text of it, which goes on for a while."),
    ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in the words of this text.</p></article>", "Energy is E=m in the words of this text."),
    ("<article><p>Press <button>OK</button> to go on reading the rest of this long sentence.</p></article>", "Press to go on reading the rest of this long sentence."),
    ("<article><p>An unclosed <button>paragraph goes on.<p>And a second one follows, with enough words in it.</article>", None),
    ("<article><h2>Head</h2><p>One <my-tag>custom</my-tag> element inside of a running line of text.</p></article>", "Head\n\nOne custom element inside of a running line of text."),
    ("<article><p>First line of words here,<br>second line of words here.</p><!-- <p>not this</p> --></article>", "First line of words here, second line of words here."),
    ("<article><ul><li>One item of the list, in words<li>Another item of the list, in words</ul></article>", "One item of the list, in words\n\nAnother item of the list, in words"),
    ("<article><p>Less &lt; more &gt; less &#65; &#x42; &eacute; all are references here.</p></article>", "Less < more > less A B \u00e9 all are references here."),
    ("<title>Not this</title><article><p>Only this text stands in the article of the page.</p></article><textarea>Not that</textarea>", "Only this text stands in the article of the page."),
    ("<article><blockquote><p>Someone said these words, and they are quoted here.</p></blockquote></article>", "Someone said these words, and they are quoted here."),
    ("<article><table><tr><td>Cell one of it</td><td>Cell two of it</td></tr></table><p>A paragraph after the table, with words.</p></article>", "Cell one of it\n\nCell two of it\n\nA paragraph after the table, with words."),
    ("<nav><p>Menu text that is long enough to look like a paragraph of an article.</p></nav><main><p>The text of the page, as it should come out.</p></main>", "The text of the page, as it should come out."),
    ("<header><h1>The site</h1></header><article><p>What the page is about stands in this paragraph.</p></article><aside><p>Popular posts</p></aside>", "What the page is about stands in this paragraph."),
    ('<div class="content"><p>A page without an article element, but with its text in a division.</p></div><div class="sidebar"><p>Other things</p></div>', "A page without an article element, but with its text in a division."),
    ('<article><p>Text before an advert in the article, and so on.</p><div class="ad">Buy this</div><p>Text after the advert in the article.</p></article>', "Text before an advert in the article, and so on.\n\nText after the advert in the article."),
    ('<article><p>An article that readers have written to.</p></article><section class="comments"><div class="comment"><p>I think this is a good one, thanks.</p></div></section>', "An article that readers have written to."),
    ("<article><p>Spaces \t\n  are   folded\r\n into one of them.</p></article>", "Spaces are folded into one of them."),
    ("<article>Text that stands in the article itself, with no paragraph around it at all.</article>", "Text that stands in the article itself, with no paragraph around it at all."),
    ("<article><p>Bold <b>words</b>, <em>more</em> and <code>code</code> in a line of text.</p></article>", "Bold words, more and code in a line of text."),
    ("<article><p>A form follows the text of this article.</p><form><label>Name</label><input><button>Send</button></form></article>", "A form follows the text of this article."),
    ("<ARTICLE><P>Upper-case tags hold the text of this page too.</P></ARTICLE><FOOTER>End</FOOTER>", "Upper-case tags hold the text of this page too."),
    ('<article><p>A link <a href="/a?b=1&amp;c=2">in the text</a> stays in the text as words.</p></article>', "A link in the text stays in the text as words."),
    ("<article><p title='a > b'>An attribute with a bracket in it, before the text.</p></article>", "An attribute with a bracket in it, before the text."),
    ("<article><h1>Only a heading here, of an article that says no more</h1></article>", "Only a heading here, of an article that says no more"),
    ("<body><script>if (a < b) { document.write('<p>x</p>') }</script><div class='article-body'><p>The body of the article, in words.</p></div></body>", "The body of the article, in words."),
    ("<article><p>Emoji \U0001f600 and \u65e5\u672c\u8a9e are text as well, in this paragraph.</p></article>", "Emoji \U0001f600 and \u65e5\u672c\u8a9e are text as well, in this paragraph."),
    ("<nav><ul><li><a href='/'>Home</a></li></ul></nav><footer>All rights reserved</footer>", ""),
]


def test_main_text_of_pages_written_by_hand():
    got = html_extract.main_texts([p for p, _ in HAND], html_extract.trained())
    wrong = [(p, g, w) for (p, w), g in zip(HAND, got, strict=True) if w is not None and g != w]
    assert not wrong


def test_text_of_insets_is_apart_and_lines_go_on():
    page = html_extract.Page("<p>one <button>two <svg><text>three</text></svg> four</button> five<p>six <video>seven<p>eight</p></p>nine")
    assert [t for _, t in page.blocks] == ["one five", "two four", "three", "six", "seven", "eight", "nine"]
    assert [page.nodes[k].tag for k, _ in page.blocks] == ["p", "button", "svg", "p", "#text", "p", "#text"]


def test_extract_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([(1, "<article><p>Some words of an article stand here.</p></article>", "mine", 5)], "page_id long, html string, text string, n_chars int")
    out = html_extract.extract_pages(df)
    assert sorted(out.columns) == sorted(df.columns) and [tuple(r[c] for c in ("page_id", "text", "n_chars")) for r in out.collect()] == [(1, "Some words of an article stand here.", 5)]


def test_main_text_held_out():
    model = html_extract.trained()
    pages = html_extract.training_pages(150, seed=1234)
    right = sum(t == "\n\n".join(b for _, b in html_extract.Page(s).blocks if "x" in b) for s, t in zip(pages, html_extract.main_texts(pages, model), strict=True))
    assert right >= 0.93 * len(pages)


def test_choice_is_consistent_and_best():
    page = html_extract.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><div><p>d</p></div>")
    rng = np.random.default_rng(0)
    n = len(page.nodes)
    for _ in range(30):
        odds = rng.normal(size=n - 1)
        keep = html_extract.chosen(page, odds)
        ok = lambda k: all(not k[i] or k[page.nodes[i].parent] for i in range(1, n))
        assert ok(keep)
        best = max(sum(odds[i - 1] for i in range(1, n) if k[i]) for c in itertools.product([False, True], repeat=n - 1) if ok(k := [True, *c]))
        assert np.isclose(sum(odds[i - 1] for i in range(1, n) if keep[i]), best)


# ---- op3 ----


def brute_quality(t):
    t = t or ""
    w = re.findall(SPACE, t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(0)
    clean = " ".join(words(rng, 200, 5000))
    texts = [None, "", " \n\t", "a\u00a0b\x1cc d", clean, clean.upper(), " ".join(x + "!!" for x in clean.split()), " | ".join(clean.split()), "x y z " * 40, clean + "\nsame line\nsame line", "é " * 60, " ".join(words(rng, 30_000, 10**6)), clean]
    got = {r["doc_id"]: r for r in quality.judge_documents(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert [i for i in got if got[i]["kept"]] and all(got[i]["kept"] for i in (4, 9, 11, 12)) and not any(got[i]["kept"] for i in (0, 1, 5, 6, 7, 8))
    kept = quality.filter_documents(docs_of(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]} and kept.columns == docs_of(spark, texts).columns
    assert quality.judge_documents(docs_of(spark, texts).where("false")).count() == 0


def test_the_order_of_rules_never_changes_a_verdict():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B!", "#", "WORD", "longer"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    verdicts = set()
    for order in itertools.permutations(quality.RULES):
        verdicts.add(tuple(quality.Cascade(list(order)).rejects(quality.Facts(t)) for t in texts))
    assert len(verdicts) == 1


def test_rules_go_by_rejections_per_second_among_what_is_left():
    rules = tuple(quality.Rule(n, None) for n in "abcd")
    bits = np.array([0b0001, 0b0011, 0b0011, 0b0110, 0b1000, 0, 0, 0])
    seconds = np.array([[1.0, 1.0, 1.0, 0.5]] * 8)
    # a and b reject three rows each; once a has gone first, b is left with one row, as has d at half the cost
    assert [r.name for r in quality.ordered(rules, bits, seconds).rules] == ["a", "d", "b", "c"]
    assert [r.name for r in quality.ordered(rules, bits[:0], seconds[:0]).rules] == list("abcd")


def test_the_reason_does_not_depend_on_the_order(spark):
    texts = [" | ".join("WORD!!" for _ in range(60)), " ".join(words(random.Random(3), 80, 5000)), None]
    rows = {tuple(sorted((r["doc_id"], r["rejected_by"]) for r in quality.judge_documents(docs_of(spark, texts)).collect())) for _ in range(2)}
    assert rows == {((0, "base"), (1, None), (2, "base"))}
    loud = " ".join(f"WORD{k}!!" for k in range(80)) + " |" * 20
    assert {r["rejected_by"] for r in quality.judge_documents(docs_of(spark, [loud])).collect()} == {"too_many_symbols"}


# ---- ids that a batch of numbers with gaps would change ----

BIG = 2**53 + 1


@pytest.mark.parametrize("run", [
    quality.judge_documents, ngram_join.near_duplicates,
    lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: bpe.digest_documents(d, public_tokenizers.path("word_bpe_49k.json")),
])
def test_ids_stay_as_they_are_beside_a_null(spark, run):
    rows = [(BIG, "one text"), (None, "two texts of a few words"), (BIG + 2, None), (-BIG, "three")]
    got = [r["doc_id"] for r in run(docs_of(spark, rows).coalesce(1)).collect()]
    assert sorted(got, key=repr) == sorted([i for i, _ in rows], key=repr)


# ---- op4 ----


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(SPACE, (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "one two", "One TWO", "one two three four five", "İ i", "a b c d", "a b c d e f", "a\u00a0b c"]
    shared = words(rng, 60, 10**6)
    for family in range(8):
        base = words(rng, rng.choice([12, 40, 150]), 10**6)
        for _ in range(rng.choice([1, 4, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            texts.append(" ".join(w))
        chain = list(base)
        for k in range(5):  # each like the one before it, the ends unlike each other
            chain[(7 * k) % len(chain)] = f"step{family}-{k}"
            texts.append(" ".join(chain).upper() if k % 2 else "\n".join(chain))
    for k in range(12):
        texts.append(" ".join(shared + words(rng, 5 + 3 * k, 10**6)))
    texts += [" ".join(words(rng, 3000, 10**6))] * 2 + [texts[12]] * 5
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts, strict=True))


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_against_all_pairs(spark, seed):
    texts = near_texts(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs_of(spark, texts)).collect()}
    want = brute_components(texts)
    assert got == want
    kept = ngram_join.one_of_each(docs_of(spark, texts))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({c for _, c in want.values()}) and kept.columns == docs_of(spark, texts).columns


@pytest.mark.parametrize("block", [2, 2000])
def test_near_duplicates_of_texts_that_share_most_shingles(spark, monkeypatch, block):
    """Many sets that share every shingle with most others, a few of them linked."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(14)
    parts = [" ".join(words(rng, 30, 10**6)) for _ in range(14)]
    texts = [" ".join(parts[i] for i in range(14) if i not in gap) for gap in itertools.combinations(range(14), 3) if sum(gap) % 7 in (0, 3)]
    texts += [" ".join(rng.sample(parts, 9)) for _ in range(40)] + texts[:3]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows)


def test_scratch_tables_are_removed(spark, monkeypatch):
    from tessera.llm import common

    made, gone = [], []
    fresh, remove = common.fresh_path, common.remove_path
    monkeypatch.setattr(common, "fresh_path", lambda s, n: made.append(fresh(s, n)) or made[-1])
    for module in (common, ngram_join):
        monkeypatch.setattr(module, "remove_path", lambda s, p: (gone.append(p), remove(s, p)))
    ngram_join.near_duplicates(docs_of(spark, near_texts(0))).count()
    assert len(made) - len(gone) == 2 and set(gone) <= set(made)


def test_near_duplicates_of_odd_tables(spark):
    same = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = sorted(map(tuple, ngram_join.near_duplicates(docs_of(spark, same)).collect()), key=repr)
    assert got == sorted([(None, 2, 3)] * 2 + [(3, 2, 3)] * 2 + [(None, 0, None)], key=repr)
    assert sorted((r["doc_id"] or -1) for r in ngram_join.one_of_each(docs_of(spark, same)).collect()) == [-1, 3]
    empty = docs_of(spark, same).where("false")
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


# ---- op5 ----


def lower_bound(lengths, capacity):
    """The bound of Martello and Toth: for each k, pieces too long to stand
    beside others of k or more, and what the rest then lacks in room."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = sum(w > capacity - k for w in lengths)
        middle = [w for w in lengths if capacity / 2 < w <= capacity - k]
        small = sum(w for w in lengths if k <= w <= capacity / 2)
        best = max(best, big + len(middle) + max(0, -(-(small - (capacity * len(middle) - sum(middle))) // capacity)))
    return best


def test_packing(spark):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    lib = Tokenizer.from_file(path)
    texts = [None, "", "a", "a  b <|endoftext|> c", "x" * 3000, " ".join(words(rng, 9000)), "same"] + ["same"] * 40 + [" ".join(words(rng, rng.randrange(900))) for _ in range(60)]
    rows = packing.pack_documents(docs_of(spark, texts), path).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["piece"]):
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(own))
            assert r["length"] == 2048 or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        ends = list(itertools.accumulate(r["length"] for r in own))
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by_seq) <= lower_bound([r["length"] for r in rows], 2048) + 1
    whole = packing.packed_sequences(packing.pack_documents(docs_of(spark, texts[:6]), path, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in rows if r["doc_id"] < 6)
    assert packing.pack_documents(docs_of(spark, texts).where("false"), path).count() == 0


def fewest(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    lengths.sort(reverse=True)
    go(0, [])
    return best


def test_plans_against_the_fewest_sequences():
    rng = random.Random(3)
    over = triples = 0
    for _ in range(300):
        cap = rng.choice([10, 20, 31])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        plan = packing.plan_sequences(dict(collections.Counter(lengths)), cap)
        held = collections.Counter()
        for pattern, times in plan:
            assert times > 0 and sum(w * t for w, t in pattern) <= cap
            for w, t in pattern:
                held[w] += t * times
        assert held == collections.Counter(lengths)
        fixed, rest = packing.reduce_dominated(dict(collections.Counter(lengths)), cap)
        triples += sum(sum(t for _, t in p) == 3 for p, _ in fixed)
        least = fewest(list(lengths), cap)
        assert sum(t for _, t in fixed) + fewest([w for w, c in rest.items() for _ in range(c)], cap) == least  # the reduction loses nothing
        over += sum(t for _, t in plan) - least
    assert over <= 5 and triples > 20


def test_two_partners_that_dominate_are_fixed():
    # beside 10 fit at most two others of 20: 5 with 4, as no two longer than 4 fit but with 5
    assert packing.reduce_dominated({10: 1, 5: 1, 4: 1, 3: 2, 8: 0}, 19)[0][0] == (((10, 1), (5, 1), (4, 1)), 1)
    # the shorter sets {10, 6} and {10, 4, 4} leave each other what the other lacks
    assert packing.dominant(packing.Lengths({10: 1, 6: 1, 4: 2, 2: 1}, 18), 10) is None


# ---- op6 ----


def brute_lines(texts, min_docs=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    n = collections.Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    rng = random.Random(4)
    common = ["License text", "  license TEXT\t", "Éa", "éa", "a\u00a0", "x"]
    texts = [(k % 50 if k % 7 else None, "\n".join(rng.choice([*common, f"line {rng.randrange(40)}", "", " \r", f"own {k}"]) for _ in range(rng.randrange(12)))) for k in range(120)]
    texts += [(1000, None), (1001, ""), (1002, "\n" * 3000 + "License text\n" * 3000)] + [(1003, "copy of a text\nx")] * 15
    df = docs_of(spark, texts)
    parts = [df.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == k) for k in range(batches)]
    before = {t.name for t in spark.catalog.listTables()}
    out = line_dedup.dedup_lines(df, parts)
    assert {t.name for t in spark.catalog.listTables()} == before  # no run is left
    got = [(r["doc_id"], r["__line_n"], r["__line_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=repr) == brute_lines(texts)
    assert set(df.columns) <= set(out.columns)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_line_runs_go_through_levels(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [(k, "\n".join(f"line {rng.randrange(60)}" for _ in range(6))) for k in range(200)]
    docs_of(spark, texts).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    df = spark.read.parquet(f"file://{tmp_path}/one")
    assert len(df.inputFiles()) == 1
    merged, levels = [], []
    compact = line_dedup.LineRuns._compact
    monkeypatch.setattr(line_dedup.LineRuns, "_compact", lambda self: (compact(self), levels.append(len(self.levels)), merged.append(len(self.common))))
    out = line_dedup.dedup_lines(df, line_dedup.file_batches(df, 4))
    got = [(r["doc_id"], r["__line_n"], r["__line_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=repr) == brute_lines(texts)
    assert max(levels) == 3 and merged[-1] == 3


def test_line_dedup_where_the_common_keys_are_many(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 0)
    texts = [(k, "\n".join([f"line {j}" for j in range(300)] + [f"own {k}", ""])) for k in range(12)] + [(50, None)] * 3
    got = [(r["doc_id"], r["__line_n"], r["__line_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()]
    assert sorted(got, key=repr) == brute_lines(texts)


def test_runs_of_lines_are_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        runs = line_dedup.LineRuns(spark, min_docs=3)
        for k in range(4):
            runs.add(spark.createDataFrame([(f"common\nline {k} {i}\nother {i}",) for i in range(200)], "text string"))
        written = [*(r for level in runs.levels for r in level), *runs.common]
        assert all(len(spark.read.parquet(r).inputFiles()) <= 16 for r in written)
        assert runs.common_keys().count() == 201
        runs.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- op7 ----


def texts_for_bpe():
    rng = random.Random(5)
    out = ["", "a", " ", "a  b", "<|endoftext|> hi<|endoftext|>", "<|startoftext|>", "ÉA'S don't I'LL 123 ab12", "İstanbul ΣΑΣ ẞ", "a\x1cb\x85c\u2003d", "日本語 한국어", "e\u0301 \u0301x", "x" * 5000, "ab" * 2000 + " tail"]
    return out + ["".join(rng.choice("ab'sTé \n\t<|>endoftext1$!\u0301") for _ in range(rng.randrange(60))) for _ in range(400)]


def test_bpe_against_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, texts = Tokenizer.from_file(path), bpe.WordBpe(path), texts_for_bpe()
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and own.decode(want) == lib.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.digest_documents(docs_of(spark, [None, *texts[:20]]), path).collect()}
    for i, t in enumerate([None, *texts[:20]]):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode_documents(bpe.encode_documents(docs_of(spark, texts[:9]), path), path)
    assert both.count() == 9 and bpe.digest_documents(docs_of(spark, texts).where("false"), path).count() == 0


def test_segment_trees_against_scanning():
    rng = random.Random(6)
    merges, known = [], list(range(6))
    for new in range(6, 60):
        merges.append((rng.choice(known), rng.choice(known), new))
        known.append(new)
    merges = list({m[:2]: m for m in reversed(merges)}.values())[::-1]
    ranks = {m[:2]: (k, m[2]) for k, m in enumerate(merges)}
    own = [[rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in range(200)]
    for w, got in zip(own, bpe.MergeForest(merges).merge(own), strict=True):
        s = list(w)
        while found := [(ranks[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in ranks]:
            _, i = min(found)
            s[i : i + 2] = [ranks[s[i], s[i + 1]][1]]
        assert got == s


# ---- op8 ----


def test_fixity_audit_and_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(400)] + [(7, "http://h/7", "<p>7</p>" * 2)] * 3 + [(None, None, None), (401, None, "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = warc.layout(df, per_file=50)
    assert one.count() == len(rows)
    same = warc.audit(one, warc.layout(df.repartition(5), per_file=50))
    assert {r["status"] for r in same.collect()} == {"intact"} and same.count() == len(rows)
    hurt = df.withColumn("html", F.when(F.col("page_id").isin(11, 222), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    found = warc.audit(one, warc.layout(hurt, per_file=50)).where("status <> 'intact'").collect()
    assert sorted((r["record_id"], r["status"]) for r in found) == [(11, "changed"), (222, "changed")]
    gone = materialised_without(warc.layout(df, per_file=50), 33)
    found = {(r["record_id"], r["status"]) for r in warc.audit(one, gone).collect()}
    assert {x for x in found if x[1] in ("missing", "extra", "changed")} == {(33, "missing")}
    back = {(r["record_id"], r["status"]) for r in warc.audit(gone, one).collect()}
    assert (33, "extra") in back and not {x for x in back if x[1] == "missing"}
    warc.write_warc(df, f"file://{tmp_path}/w", per_file=50)
    read = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert len(read) == len(rows)
    want = collections.Counter((r["start"], r["stop"]) for r in one.collect())
    assert collections.Counter((r["start"], r["stop"]) for r in read) == want
    assert warc.audit(one.where("false"), one.where("false")).count() == 0


def test_damaged_files_give_what_can_be_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>\r\n\r\nWARC/1.0 in a body" * (i + 1), "x", 1) for i in range(6)], "page_id long, url string, html string, stop string, copy int")
    warc.write_warc(df, f"file://{tmp_path}/w", per_file=1000)
    (path,) = tmp_path.glob("w/*/part-*")
    whole = path.read_bytes()
    records = list(warc.parsed(whole))
    assert len(records) == 6 and all(ok for *_, ok in records) and [r[0] for r in records] == [0, *(r[1] for r in records[:-1])]
    at = records[2][0]
    length = whole.index(b"Content-Length: ", at) + 16
    for hurt in (whole[:length] + b"x" + whole[length + 1 :], whole[:length] + b"9999999" + whole[length + 2 :], whole[:at] + b"XXXX" + whole[at + 4 :]):
        got = list(warc.parsed(hurt))
        assert [r[3] for r in got if r[4]] == [r[3] for k, r in enumerate(records) if k != 2]
        assert [not r[4] for r in got] == [False, False, True, False, False, False] and b"".join(hurt[r[0] : r[1]] for r in got) == hurt
    cut = list(warc.parsed(whole[:-30]))
    assert [r[4] for r in cut] == [True] * 5 + [False] and list(warc.parsed(b"")) == [] and [r[4] for r in warc.parsed(b"no archive")] == [False]
    path.write_bytes(whole[:at] + whole[at + 3 :])
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    rows = warc.read_warc(spark, f"file://{tmp_path}/w").orderBy("start").collect()
    assert [r["intact"] for r in rows] == [True, True, False, True, True, True] and rows[2]["record_id"] == ""


def materialised_without(layout, record_id):
    """A replica whose file lacks a record: what follows moves up."""
    from pyspark.sql import Window

    rows = layout.where(~F.col("record_id").eqNullSafe(F.lit(record_id))).withColumn("size", F.col("stop") - F.col("start"))
    w = Window.partitionBy("file").orderBy("place")
    stop = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("p", F.row_number().over(w).cast("long") - 1).withColumn("e", stop)
    return rows.select("file", F.col("p").alias("place"), (F.col("e") - F.col("size")).alias("start"), F.col("e").alias("stop"), "record_id", "copy", "sha256")


# ---- op9 ----


def brute_nearest(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, q in ok.items():
        if i % 20 == 0:
            out[i] = sorted(((-float(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in ok.items() if j != i))[:k]
    return out


def test_nearest_against_all(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(12, 8)) * 3
    rows = [(i, (middle[i % 12] + rng.normal(size=8) * 0.4).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(5000 + i, middle[0].astype(np.float32).tolist()) for i in range(300)]
    rows += [(3000, None), (3020, [0.0] * 8), (3040, [float("nan")] + [1.0] * 7), (3060, [None] + [1.0] * 7), (3080, [float("inf")] * 8), (3100, [1.0] * 3), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), ann.Params(list_size=64, sample=1000)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    want = brute_nearest(rows, 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        assert [r["rank"] for r in got[q]] == list(range(1, 21))
        keys = [(-r["score"], r["vec_id"]) for r in got[q]]
        assert keys == sorted(keys)
        hits += len({j for _, j in near} & {r["vec_id"] for r in got[q]})
        total += len(near)
    assert hits >= 0.9 * total
    few = df.where("vec_id in (0, 1, 2)")
    assert [(r["query_id"], r["rank"]) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.nearest(df.where("false"), df).count() == 0


def test_nearest_reads_all_lists_within_the_ratio(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    p = ann.Params(list_size=4, ratio=1e9)
    assert len(rows) // p.list_size > 2 * p.beam
    got = collections.defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), p).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert got == {q: {j for _, j in near} for q, near in brute_nearest(rows, 20).items()}


def test_nearest_writes_no_row_for_each_query_and_list(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    written = []

    def counted(df, name, paths=None, write=ann.materialise):
        out = write(df, name, paths)
        written.append(out.count())
        return out

    monkeypatch.setattr(ann, "materialise", counted)
    p = ann.Params(list_size=4, ratio=1e9, round=40)  # every query reads all of some 500 lists; three rounds
    got = collections.defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), p).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert got == {q: {j for _, j in near} for q, near in brute_nearest(rows, 20).items()}
    assert max(written) <= 2 * len(rows)  # 100 queries by 20, and rows with replicas


def test_nearest_with_production_parameters(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(6000, 64)).astype(np.float32)
    rows = [(i, x.tolist(), "a", 0.5) for i, x in enumerate(v)] + [(9000 + i, [1.0] * 65, "b", 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, score double")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    v, hits = v.astype(float), 0
    for q in range(0, 6000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert set(got) == set(range(0, 6000, 20)) and hits >= 0.95 * 20 * len(got)  # the three longer vectors take no part


# ---- op10 ----


def toxic_table(rng, n):
    bad, texts, labels = ["moronish", "scumbaggy", "trashfolk"], [], []
    lexicon = [("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))) for _ in range(700)]
    for i in range(n):
        w = [rng.choice(lexicon) for _ in range(rng.randint(20, 80))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, y))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = toxic_table(random.Random(8), 500)
    texts += [(900, None), (901, ""), (902, "quiet words aeon"), (903, "you m0r0nish thing"), (904, "such a s.c.u.m.b.a.g.g.y person"), (905, "trrrashfolk !! tr@shfolk and moronish"), (906, "w " * 40_000), (907, texts[0][1]), (908, texts[0][1])]
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(spark, texts), lab).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, _, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert not any(got[i]["predicted"] for i in (900, 901, 902, 906)) and got[907]["score"] == got[908]["score"]
    assert all(got[i]["predicted"] for i in (903, 904, 905))
    kept = toxicity.filter_documents(docs_of(spark, texts), lab)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]} and kept.columns == docs_of(spark, texts).columns


def test_toxicity_never_learns_from_held_out_rows(spark):
    texts, labels = toxic_table(random.Random(9), 200)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    schema, docs = "doc_id long, quality int, toxic int", docs_of(spark, texts)
    one = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, spark.createDataFrame(labels, schema)).collect()}
    two = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, spark.createDataFrame(flipped, schema)).collect()}
    assert one == two


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r["predicted"] for r in toxicity.score_documents(docs_of(spark, ["a b", None]), none).collect())
    assert toxicity.score_documents(docs_of(spark, ["a"]).where("false"), none).count() == 0


def test_viterbi_against_all_paths():
    counts = np.zeros(toxicity.ORDER * toxicity.LM_CELLS, np.int64)
    frame = toxicity._ngrams(collections.Counter({"idiot": 50, "lost": 30, "title": 20, "iii": 1}))
    counts[frame["cell"]] = frame["n"]
    model = toxicity.CharModel(counts)
    for token in ("1d10t", "l0st", "t!tle", "iiidiot"):
        best = (-math.inf, "")
        for path in itertools.product(*toxicity.lattice(token)):
            text, score = "".join(p[0] for p in path), sum(p[1] for p in path)
            full = "\n" + text + "\n"
            score += sum(model.log_p(full[max(0, k - toxicity.ORDER + 1) : k + 1]) for k in range(1, len(full)))
            best = max(best, (score, text))
        assert toxicity.decode(token, model) == best[1]


def test_words_of_long_runs_and_tokens():
    plain = {"you": 50, "are": 40, "stupid": 30, "idiot": 30, "and": 50, "nothing": 20, "else": 20}
    counts = np.zeros(toxicity.ORDER * toxicity.LM_CELLS, np.int64)
    frame = toxicity._ngrams(collections.Counter(plain))
    counts[frame["cell"]] = frame["n"]
    restorer = toxicity.Restorer(toxicity.CharModel(counts))
    said = "you are nothing and nothing and nothing and nothing else and you are stupid idiot".split()
    assert len("".join(said)) > 60 and len(said) == 15
    assert set(said) <= restorer.words("  ".join(" ".join(w) for w in said))
    assert {"stupid", "idiot"} <= restorer.words("s t u p i d i d i o t") and "stupid" in restorer.words("s  t  u  p  1  d")
    assert set(said) <= restorer.words("-".join(said).replace("stupid", "stup1d").replace("idiot", "1diot"))


def test_long_runs_repeats_and_words_are_read_to_their_end(spark):
    texts, labels = toxic_table(random.Random(12), 400)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    alphabet = " ".join("abcdefghijklmnopqrstuvwxyz")
    long = "m" + "o" * 300 + "r" * 300 + "onish"
    texts += [(900, f"{alphabet}  {alphabet}  {alphabet}  s c u m b a g g y"), (901, f"such {long} folk"), (902, "x" * 41 + " " + "quiet " * 30), (903, f"{alphabet}  {alphabet}  {alphabet}")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs_of(spark, texts), lab).where("doc_id >= 900").collect()}
    assert got == {900: 1, 901: 1, 902: 0, 903: 0}


def test_toxicity_columns_that_clash(spark):
    texts, labels = toxic_table(random.Random(13), 120)
    df = docs_of(spark, texts).withColumn("score", F.lit("mine")).withColumn("held_out", F.lit(3)).withColumn("toxic", F.lit(9))
    out = toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["held_out"] == "boolean" and {r["toxic"] for r in out.collect()} == {9}


def test_letter_counts_hold_every_gram_apart(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 60))) for _ in range(6000)]
    plain = collections.Counter()
    for w in lexicon:
        full = "\n" + w + "\n"
        plain.update(full[i : i + 4] for i in range(len(full) - 3))
    assert len(plain) > toxicity.LM_CELLS
    texts = [" ".join(lexicon[i : i + 50]) + "," for i in range(0, 6000, 50)]
    model = toxicity.language_model(docs_of(spark, texts))
    probe = sorted(plain)[::200]
    assert [model.count(g) for g in probe] == [plain[g] for g in probe] and model.count("\n\n\n\n") == 0
