"""op11 to op13: main text of pages, source divergence, spelling variants, each against brute force."""

from __future__ import annotations

import html as markup
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swathlab.llm import divergence, pages, queries, spelling

from .conftest import awkward_rows

# -- op11 ----------------------------------------------------------------------------------
LONG = "This is a long paragraph of the article with enough words to stand out from what is around it on the page."
PAGES = {
    "a list of links and a menu behind": (f"<body><ul><li><a href=/>Home</a><li><a href=/>About</a></ul><h1>Title</h1><p>{LONG}<p>Short.<p>{LONG}<div><a href=/>More</a> <a href=/>x</a></div></body>", f"Title\n{LONG}\nShort.\n{LONG}"),
    "elements without names": (f"<div id=top><a>Home</a> <a>News</a></div><div id=c1><h2>Title</h2><p>{LONG}</p><p>Be.</p><p>{LONG}</p></div><div>Copyright 2024 us</div>", f"Title\n{LONG}\nBe.\n{LONG}"),
    "sidebar, advert, footer, comments": (
        f'<main><article><header><h1>T</h1></header><p>{LONG}</p><aside>side {LONG}</aside><div class="ad-box">{LONG}</div><p>x &lt; y&nbsp;&#38; z &eacute;&copy</p><footer>f</footer></article><section id="comments"><article class="comment"><p>{LONG * 9}</p></article></section></main>',
        f"T\n{LONG}\nx < y & z é©",
    ),
    "notice and form": (f'<div class="cookie-notice"><p>{LONG * 5}</p></div><article><p>A b</p></article><form><p>{LONG}</p></form>', "A b"),
    "empty": ("", ""), "null": (None, ""), "menu only": ("<nav><a>x</a></nav>", ""), "text only": ("just \n text", "just text"),
    "lists, cells and lines": ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x\n y</pre><p>l<br>m</article>", "one\ntwo\na\nb\nx y\nl m"),
    "script, style, remark": ('<article><p>a<script>if(a<b)document.write("<p>no</p>")</script>b</p><style>p{}</style><p>c<!-- <p>no</p> -->d</p></article>', "a\nb\ncd"),
    "wrapper that names a sidebar": (f'<body class="has-sidebar"><div class="page with-sidebar"><div id="sidebar"><p>{LONG}</p></div><div class="post"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></div></body>', f"T\n{LONG}\n{LONG}"),
    "advert in a line": ('<article><p>Hello <span class="ad">buy</span> world</p></article>', "Hello\nworld"),
    "hidden": ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</p></article>', "yes"),
    "two articles": (f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main>", f"{LONG}\n{LONG}"),
    "unclosed": ("<article><p>a <b>b<br><p>c</article><footer>x", "a b\nc"), "tiny article": (f'<div class="ad">{LONG}</div><article><h1>Be.</h1></article><footer>{LONG}</footer>', "Be."),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    given_, expected = PAGES[name]
    assert pages.main_text(given_) == expected


@pytest.mark.parametrize("text", ["<" * 50_000, "<!--" * 50_000, "<a " * 50_000, "<div>" * 30_000 + "x", "</p>x" * 30_000, '<b class="ad">' * 20_000 + "x", "<![foo[" * 20_000, "<script>" * 20_000, '<a href="' * 20_000, "<div><li>x" * 10_000, "&" * 50_000, "<p>word " * 50_000])
def test_broken_pages_end(text):
    """Broken and deep markup is read in one pass."""
    assert isinstance(pages.main_text(text), str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<!--", "-->", "<a href='/'>", "</a>", "<script>", "</script>", "word ", "&amp;", "<td>", "<", ">", "<h1>", "<footer>", "</footer>", '<i class="ad">', "</i>"]), max_size=40))
def test_any_markup_is_read(parts):
    text = pages.main_text("".join(parts))
    assert text == "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def test_smoothing_and_threshold():
    ratios = np.array([5.0, 4, 90, 3, 120, 100, 6, 5, 4])
    smooth = pages.smoothed(ratios, 1.0)
    for i in range(len(ratios)):
        weights = [np.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 3 else 0 for j in range(len(ratios))]
        assert np.isclose(smooth[i], np.dot(weights, ratios) / sum(weights))
    values = [1.0, 2, 2, 3, 50, 60, 61]
    best = max(range(1, 7), key=lambda k: k * (7 - k) * (np.mean(values[k:]) - np.mean(values[:k])) ** 2)
    assert pages.threshold(np.array(values)) == values[best] == 50
    assert pages.threshold(np.array([2.0, 2.0])) == 2.0 and pages.threshold(np.array([])) == 0.0


def plain_article(text):
    """The pages of the given tables: paragraphs and headings of the one article."""
    parts = re.split(r"</?(?:p|h1)>", re.search("<article>(.*?)</article>", text, re.S)[1])
    return "\n".join(x for x in (" ".join(markup.unescape(re.sub("</?b>", "", p.replace("<br>", " "))).split()) for p in parts) if x)


def test_op11(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op11_main_text(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found) == Counter((r["page_id"], r["url"], plain_article(r["html"]), len(plain_article(r["html"]))) for r in rows)


def test_main_text_of_a_table(spark):
    rows = [(i, h, "kept", "gone", 7) for i, (h, _) in enumerate(PAGES.values())] + [(0, next(iter(PAGES.values()))[0], "kept", "gone", 7), (None, None, "kept", None, None), (99, f"<article>{'<p>Word. ' * 30_000}", "kept", "", 1)]
    table = spark.createDataFrame(rows, "page_id long, html string, _html string, text string, n_chars int")
    found = pages.extract_main_text(table)
    assert found.columns == ["page_id", "html", "_html", "text", "n_chars"]
    expected = [*[(i, t) for i, (_, t) in enumerate(PAGES.values())], (0, next(iter(PAGES.values()))[1]), (None, ""), (99, "\n".join(["Word."] * 30_000))]
    assert Counter((r["page_id"], r["text"], r["n_chars"], r["_html"]) for r in found.collect()) == Counter((i, t, len(t), "kept") for i, t in expected)
    assert pages.extract_main_text(table.limit(0)).count() == 0


# -- op12 ----------------------------------------------------------------------------------
def reference_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(divergence.TERM, (text or "").encode().lower().decode())) for text, lang, source in rows]
    groups = sorted({d[:2] for d in docs})
    out = []
    for lang in {g[0] for g in groups}:
        df = Counter(t for x, _, words in docs if x == lang for t in set(words))
        kept = {t for t, n in df.items() if n >= least}
        n = {s: Counter() for x, s in groups if x == lang}
        for x, s, words in docs:
            if x == lang:
                n[s].update(w for w in words if w in kept)
        whole = sum(n.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in n.items()}, share(whole)
        for s in n:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in n if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top]
    return Counter(out)


def divergence_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("al", "Be", "çé", "du", "ER") for b in "abcdefgh"]
    rows = [(" ".join(rng.choices(words[: 10 + s * 3], k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{s}") for s in range(9) for _ in range(12)]
    rows += [(text, "en", "s0") for text, _, _ in rows[:40]]  # a hot source
    return rows + [(None, None, None), ("", "fr", "s1"), ("one two", "fr", None), ("one", "fr", "s1"), ("x1y", "", ""), ("al" * 50_000, "en", "s3")] + [rows[0]] * 3


@pytest.mark.parametrize(("block", "tile"), [(4096, 32), (3, 2)])
def test_divergence_against_brute_force(spark, block, tile):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, "kept", 1, "x") for r in rows], "text string, lang string, source string, term string, n int, item string").repartition(5)
    found = divergence.source_divergence(docs, least_documents=6, top=4, block=block, tile=tile)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == reference_divergence(rows, 6, 4)


def test_divergence_without_terms_or_rows(spark, nothing, awkward):
    assert divergence.source_divergence(nothing).count() == 0
    rows = [(r["text"], r["lang"], r["source"]) for r in awkward.collect()]
    assert Counter(map(tuple, divergence.source_divergence(awkward).collect())) == reference_divergence(rows, 30, 50)
    assert Counter(map(tuple, divergence.source_divergence(awkward, least_documents=10**6).collect())) == reference_divergence(rows, 10**6, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    n, size, terms = 10**13 + 7, 10**17 + 3, 12_345
    from pyspark.sql import functions as F

    found = spark.range(1).select(divergence._share(F.lit(n), F.lit(size), F.lit(terms)).alias("p")).first()["p"]
    assert found == 1 + 10**9 * (n + 5) // (size + 5 * terms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60), st.integers(0, 1000))
def test_runs_give_what_columns_give(cells, first):
    a, b = (np.array(x) for x in zip(*cells, strict=True))
    columns = [divergence.runs(first, len(x), np.flatnonzero(x) + first, x[np.flatnonzero(x)]) for x in (a, b)]
    for x, (starts, values) in zip((a, b), columns, strict=True):
        assert (np.repeat(values, np.diff(np.append(starts, len(x)))) == x).all() and (values[1:] != values[:-1]).all()
    assert divergence.run_difference(*columns, len(a)) == np.abs(a - b).sum()


def test_equal_counts_stand_together(spark):
    """Terms with equal counts in all sources are one run in every column."""
    rows = [("en", s, f"t{i}", 1 + i % 3, 40) for i in range(60) for s in ("a", "b", "c")[: 1 + i % 3]]
    kept = divergence.kept_terms(spark.createDataFrame(rows, "lang string, source string, term string, n long, docs long"), 30)
    order = divergence.term_order(kept)
    cells = kept.join(order, ["lang", "term"]).collect()
    assert order.count() == 60 and len({r["slot"] for r in order.collect()}) == 60
    slots = sorted(r["slot"] for r in order.collect())
    for source in "abc":
        n = {r["slot"]: r["n"] for r in cells if r["source"] == source}
        column = [n.get(s, 0) for s in slots]
        assert sum(x != y for x, y in zip(column, column[1:], strict=False)) <= 2 + 3  # counts by partition of the order


# -- op13 ----------------------------------------------------------------------------------
def reference_counts(rows):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def reference_forms(counts):
    words = {w: n for w, n in counts.items() if n >= 2}
    near = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            for cut in {w[:i] + w[i + 1 :]}:
                near[cut].append(w)
    met = defaultdict(set)
    for cut, ws in near.items():  # words one edit apart share one with a letter less, or one is the other with a letter less
        for a in ws:
            met[a].update(b for b in ws if one_edit(a, b))
            if cut in words:
                met[a].add(cut)
                met[cut].add(a)
    form = {}
    for w, n in words.items():
        best = min(met[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(met[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def spelled_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(60)] + ["Constantly", "internal", "ÀÉÎõûÿabc", "x" * 5000, "x" * 4999 + "y"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 50 else None, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 200_000), (1003, "a" * 200_000), (1002, "a" * 200_000), rows[3], rows[3]]


def test_spelling_against_brute_force(spark):
    rows = spelled_rows() + [(r[0], r[1]) for r in awkward_rows()]
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    counts = reference_counts(rows)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == dict(counts)
    short = Counter({w: n for w, n in counts.items() if len(w) < 1000})  # the reference is quadratic in a word's length
    table = spark.createDataFrame(list(short.items()), "word string, n long")
    for paired in (64, 2):
        assert Counter(map(tuple, spelling.spelling_forms(table, paired=paired).select("word", "form", "root", "n", "n_near", "form_n").collect())) == reference_forms(short)
    long = {r["word"]: r for r in spelling.spelling_variants(docs).where("length(word) >= 1000").collect()}
    assert all(r["n_near"] >= 1 for w, r in long.items() if w == "x" * 5000) and set(long) == {w for w, n in counts.items() if len(w) >= 1000 and n >= 2}


@pytest.mark.parametrize("paired", [2, 64])
def test_a_hot_half_is_cut_further(spark, paired):
    """Thousands of words share a half; pairs are whole, each once, whatever the bucket's bound."""
    rng = random.Random(4)
    words = sorted({"commonpart" + "".join(rng.choice("ab") for _ in range(rng.randint(6, 11))) for _ in range(1500)} | {"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) + "commonpart" for _ in range(400)} | {"commonpar", "commonpart", "commonpartt", "ab", "a", "b", "", "abc"})
    found = [(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), paired).collect()]
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1 :]].add(w)
    expected = {frozenset((a, b)) for ws in cut.values() for a in ws for b in ws if a < b and one_edit(a, b)} | {frozenset((w, x)) for w in words for x in cut.get(w, ())}
    assert len(found) == len({frozenset(p) for p in found}) and {frozenset(p) for p in found} == expected


def test_roots_follow_forms(spark):
    chain = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20_000), ("zzzzzzz", 2), ("zzzzzzy", 19), ("ccccccc", 5), ("ccccccd", 50), ("ccccccb", 50), (None, 9), ("once", 1)]
    found = {r["word"]: r for r in spelling.spelling_forms(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert {w: r["root"] for w, r in found.items()} == {w: ("aaabbbb" if w[0] == "a" else "ccccccb" if w == "ccccccc" else w) for w, n in chain if w and n > 1}
    assert found["ccccccc"]["form"] == "ccccccb" and found["zzzzzzz"]["form"] is None and found["aaaaaaa"]["form_n"] == 20


def test_spelling_of_nothing(spark, nothing):
    assert spelling.spelling_variants(nothing).count() == 0
    one = spark.createDataFrame([(1, "Someword someword")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.spelling_variants(one).collect()] == [("someword", None, "someword", 2, 0, None)]


def test_op13(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op13_spelling(spark, sf).collect()) == reference_forms(reference_counts(rows))
