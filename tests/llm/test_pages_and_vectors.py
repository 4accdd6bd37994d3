"""URL filters, HTML extraction, top-k search and the pipeline."""

import math
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_text, language_id, near_dedup, topk_search, toxicity, url_filter
from tidemark.llm.common import copied
from tidemark.llm.packing import TokenEncoder
from tidemark.llm.queries import ORACLES, QUERIES, URL_RULES, tokenizer_file, tokenizer_pattern

URLS = [
    "https://A.Example.ORG/es/x?q#f", "http://example.org/en/17", "http://example.org/en/2", "http://example.org", "http://org/", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/a",
    "http://x.com:80/de/", "ftp://u@a.b.com/fr/", "no scheme/org/", "", None, "http://", "http://example.org?x=/es/", "http://example.org//es/", "a://b://example.org/es/", "http://example.org/es/", "http://example.org/es/",
    "http://..example.org/es/", "http://exämple.org/es/", "http://com/fr", "x\n://example.org/es/\ny",
]


def _verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end : min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), v, h + p) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else "allow"


@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_urls_match_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    pages = spark.createDataFrame([(k if k != 3 else None, u, "clash", "x") for k, u in enumerate(URLS)] + [(1, URLS[1], "clash", "x")], "page_id long, url string, short string, verdict string")
    rules = url_filter.rules_frame(spark, [*URL_RULES, URL_RULES[0], (None, "/", "block")])
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()]
    expected = [(k if k != 3 else None, *_verdict(u)) for k, u in enumerate(URLS)] + [(1, *_verdict(URLS[1]))]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    none = url_filter.judge_urls(pages, url_filter.rules_frame(spark, [])).collect()
    assert len(none) == len(URLS) + 1 and {r.verdict for r in none} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []


def test_urls_with_another_url_in_the_query(spark):
    urls = ["https://example.org?u=http://x/es/1", "https://a.com#://b/fr/x", "https://example.org/en/1?u=http://x.com/de/1", "https://example.org", "no scheme", "a" * 20_000 + "://example.org?://x/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, URL_RULES)).collect()}
    assert got == {k: _verdict(u) for k, u in enumerate(urls)} and got[0] == ("example.org", "", None, "allow")


def test_many_copies_of_a_row(spark, monkeypatch):
    frame = spark.createDataFrame([(0, 1), (1, 3), (2, None), (3, 10_000), (4, 4096), (5, 4097)], "id int, copies long")
    assert {r.id: r["count"] for r in copied(frame, "copies").groupBy("id").count().collect()} == {0: 1, 1: 3, 2: 1, 3: 10_000, 4: 4096, 5: 4097}


def test_rules_of_many_path_lengths_all_count(spark):
    rules = spark.range(1, 5001).selectExpr("'a.org' AS host", "concat('/', repeat('x', int(id) - 1)) AS path", "'block' AS verdict")
    urls = [(n, "http://a.org/" + "x" * (n - 1)) for n in (1, 700, *range(4950, 5001, 5), 5100)]
    got = {r.page_id: len(r.rule) - len("a.org") for r in url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {n: min(n, 5000) for n, _ in urls}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="menu">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a>B</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now, it is really very cheap today.</div>
<div id="cookie-notice">We use cookies on this page for many good reasons.</div>
<article class=post><h1>Head &amp; line</h1><p><b>First&nbsp;&lt;one&gt;<br>still  the
 same.<p>Second <a href='x>y'>link</a> text.</p><blockquote>Be.</blockquote><aside>Side remark nobody asked for at all.</aside><form><label>Your mail</label><input name="a"><button>Send</button></form>
<div class="comments"><p>I am a reader and I comment at length on this article.</p></div><p>Last.</article><div class="related">More of it</div><footer>&copy; all</footer></body>"""


def test_main_text_of_pages(spark):
    assert html_text.main_text(PAGE) == "Head & line\nFirst <one> still the same.\nSecond link text.\nBe.\nLast."
    for awkward in (None, "", "   ", "<", "<p", "<!--", "</", "<a href='", "&#", "<script>", "<p>&#x110000;&bogus;</p>", "a<b", "<article>" * 50):
        assert isinstance(html_text.main_text(awkward), str)
    assert html_text.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    long = "word " * 200_000
    assert html_text.main_text(f"<article><p>{long}</p></article>") == long.strip()
    plain = "<p>" + "A paragraph of a page that marks nothing but has many words in each of its blocks. " * 3 + "</p>"
    assert html_text.main_text(f"<ul><li><a>x</a><li><a>y</a></ul>{plain}{plain}").count("\n") == 1
    frame = spark.createDataFrame([(1, "u", PAGE, "t"), (None, None, None, "t"), (1, "u", PAGE, "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract_pages(frame).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows) and html_text.extract_pages(frame.limit(0)).collect() == []


@pytest.mark.parametrize("tag", ["button", "object", "canvas", "svg", "noscript", "select", "template"])
def test_unclosed_elements_do_not_swallow_the_page(tag):
    article = "<article><p>The article stands here in full, whatever comes before it.</p></article>"
    assert html_text.main_text(f"<{tag}>{article}") == html_text.main_text(article) != ""
    assert html_text.main_text(f"<div><{tag}>gone</{tag}></div>{article}") == html_text.main_text(article)
    assert html_text.main_text(f"<script>{article}") == ""


def test_tree_fits_its_table():
    table = html_text.labelled_table()
    assert (html_text.default_tree().predict(table[:, :-1]) == table[:, -1].astype(bool)).all()


def _article(html):
    """The blocks of the only article of a page of the test tables, by regular expressions."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " ")
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", body)]
    return [part for part in parts if part]


def test_counts_alone_find_the_articles_of_pages_without_names(spark):
    """Held-out pages with all names of elements and classes taken away: only counts and densities are left."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    right = found = wanted = 0
    for html in pages:
        assert html_text.main_text(html) == "\n".join(_article(html))
        plain = html_text.main_text(re.sub(r'<(/?)(?:nav|article|footer|div)(?: class="ad")?>', r"<\1div>", html)).split("\n")
        true = _article(html)
        right += sum((Counter(plain) & Counter(true)).values())
        found, wanted = found + len(plain), wanted + len(true)
    assert right >= 0.99 * found and right >= 0.99 * wanted


def test_features_match_a_count_block_by_block():
    found = html_text.blocks(PAGE)
    rows = html_text.features(found)
    for i, (_, words, linked, container, _) in enumerate(found):
        near = [(found[k][1], found[k][2] / found[k][1]) if 0 <= k < len(found) else (0, 0) for k in (i - 1, i + 1)]
        own = [b for b in found if b[3] == container]
        total = sum(b[1] for b in own)
        largest = max(sum(b[1] for b in found if b[3] == c) for c in {b[3] for b in found})
        expected = [words, linked / words, *near[0], *near[1], total, sum(b[2] for b in own) / total, len(own), total / largest]
        assert np.allclose(rows[i], expected)


@pytest.mark.parametrize(("gone", "kept"), [
    ('<p class="ad">Buy it now</p>', ""), ('<ul><li class="comment">I say so<li>a point</ul>', "a point"), ('<p>one <span class="promo">buy</span> two</p>', "one two"),
    ('<h2 class="post-header">A headline</h2>', "A headline"), ('<header class="entry-header"><h2>A headline</h2></header>', "A headline"), ('<p id=ad>gone<p>stays', "stays"), ('<span class="share"><p>stays</p>', "stays"),
])
def test_names_on_any_element_take_away_and_nothing_more(gone, kept):
    text = "A paragraph of an article that has a good many words in each of its blocks, so that it stays."
    page = f"<article><h1>Title</h1><p>{text}</p>{gone}<p>{text}</p></article>"
    assert html_text.main_text(page) == "\n".join(x for x in ("Title", text, kept, text) if x)


def _vectors():
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(int(i), rows[5][1]) for i in range(1000, 1400)]  # one common vector, four times a query's
    rows += [(2000, None), (2100, [1.0] * 7 + [None]), (2200, [math.nan] + [0.0] * 7), (2300, [math.inf] + [0.0] * 7), (None, [9.0] * 8), (2400, [2.0] * 5), (2401, [1.0] * 5), (2500, []), (100, rows[100][1]), (200, [3.0] * 8)]
    return rows


def _top(rows, k=10):
    clean = sorted((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(1024 * x) for x in v))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in clean]
    out = []
    for q, (i, v) in enumerate(whole):
        if i % 100 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(1 << 63)), (1 << 63) - 1), j) for c, (j, w) in enumerate(whole) if c != q and len(w) == len(v))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(4096, 1024), (100, 3)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", block)
    frame = spark.createDataFrame([(i, v, 1) for i, v in _vectors()], "vec_id long, embedding array<float>, score int")
    assert sorted(map(tuple, topk_search.top_k(frame).collect())) == _top(_vectors())


def test_top_k_of_little(spark):
    frame = spark.createDataFrame([(100, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(frame).orderBy("rank").collect()] == [(100, 1, 1, 1572864), (100, 2, 2, 1572864)]
    assert topk_search.top_k(frame.limit(0)).collect() == [] and topk_search.top_k(frame.filter("vec_id < 100")).collect() == []


def test_top_k_counts_repeated_rows_and_large_components(spark):
    v, big = [1.0, 2.0], [1e12, -3.0]
    rows = [(100, v), (100, v), (1, v), (1, v), (2, [1e306, 0.0]), (3, big), (4, [1e8, 7.0]), (200, [1e8, -1.0]), (300, big)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(frame).collect())) == _top(rows)
    four = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in topk_search.top_k(four).collect()) == sorted([(100, 1, 1), (100, 2, 1), (100, 3, 100)] * 2)


def test_clustered_vectors_meet_few_leaves():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 4000
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 40)
    ids = np.arange(4000)
    tree = topk_search.BallTree(ids, ids, np.ones(4000, np.int64), points)
    got = tree.search(ids[:200], ids[:200], points[:200], [topk_search.LEAST] * 200, 10)
    exact = points[:200] @ points.T
    exact[np.arange(200), np.arange(200)] = -np.inf
    for found, row in zip(got, exact, strict=True):
        assert found == [(int(row[i]), int(i)) for i in np.lexsort((ids, -row))[:10]]
    assert tree.leaves_met < 0.2 * 200 * sum(c < 0 for c in tree.left)


def test_queries_and_oracles_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} and set(ORACLES) <= set(QUERIES)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert docs.count() <= before
        before = docs.count()
    assert before > 150 and docs.filter("n_chars <> length(text)").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before


def test_near_duplicates_keep_one_row_of_each_group(spark, sf_dir):
    text = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 40))
    groups = [
        [(5, text(1)), (9, text(1))],
        [(5, text(2)), (5, text(2)), (7, text(2))],  # the same id in another group
        [(6, text(3)), (8, text(3))],
        [(8, text(4))],  # its id is a copy elsewhere
        [(None, text(5)), (None, text(5))],
        [(None, text(6)), (4, text(6))],
        *[[(77, text(100 + i))] for i in range(50)],  # a hot id with unrelated texts
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for g in groups for i, t in g], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    assert kept.columns == corpus_pipeline.COLUMNS and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)


def test_pipeline_matches_brute_force(spark, sf_dir):
    """Each stage done plainly on the driver, with the models that the stages fit, gives the tokens that the pipeline packs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.fit(docs, labels, lambda i: ~toxicity.held_out(i))
    rows = [r for r, score in zip(rows, model.scores([t for _, t in rows]), strict=True) if score < toxicity.THRESHOLD]
    left = docs.filter(F.col("doc_id").isin(*[i for i, _ in rows]))
    model = language_id.fit(left, lambda i: ~language_id.held_out(i))
    rows = [r for r, (_, _, rejected) in zip(rows, model.predict([t for _, t in rows]), strict=True) if not rejected]
    prints = [near_dedup.fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
                    moved = True
    first = {}
    for (i, _), g in zip(rows, group, strict=True):
        first[g] = min(first.get(g, i), i)
    rows = sorted((i, (t or "").encode()) for (i, t), g in zip(rows, group, strict=True) if first[g] == i)
    seen = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    expected = {}
    encoder = TokenEncoder(tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_pattern())
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        text, at = "", 0
        for c in b.decode():
            n = len(c.encode())
            text += "" if any(gone[at : at + n]) else c
            at += n
        expected[i] = np.append(encoder.ids(text), np.uint32(1)).astype("<u4")
    found = {}
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        assert p.doc_tokens == len(expected[p.doc_id]) and zlib.crc32(expected[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        found[p.doc_id] = found.get(p.doc_id, 0) + p.length
    assert found == {i: len(ids) for i, ids in expected.items()} and 0 < len(found) < docs.count()


def test_pipeline_on_awkward_rows(spark, tmp_path, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here and there", "en", "a", 1), (4, "same words here and there", "en", "a", 1), (4, "same words here and there", None, "a", 1), (None, "no id at all but words", "en", None, 5)]
    for folder, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/{folder}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()}
    assert kept == {3, None} and corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
