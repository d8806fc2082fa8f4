"""HTML extraction, the token store and exact search."""

import io
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import html_extraction as H
from lodeframe.llm import textnum as X
from lodeframe.llm import token_store as S
from lodeframe.llm import topk_search as K

from .helpers import docs

SF = "/root/testdata/sf0.001"
ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph  with\n<b>bold</b> text and a <a href='/x'>link</a>.<br>After a break.<p>Second one, &lt;b&gt; is no tag; 3 < 4.</p><ul><li>one<li>two</ul><blockquote>quoted words</blockquote>"
WANT = "Title & more\nFirst paragraph with bold text and a link. After a break.\nSecond one, <b> is no tag; 3 < 4.\none\ntwo\nquoted words"
FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a = "<p>no</p>";</script></head><body class="page">
<header><h2>Site name</h2><p>Slogan of the site that is long enough to look like text.</p></header><nav><ul><li><a href="/">Home</a><li><a href="/a">About</a></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this great thing today, it is the best thing that you can buy, really, buy it now.</div><div id="cookie-notice"><p>We use cookies to make this site better for you and for all of us.</p></div>
{0}<aside><p>Related reading that is not of this article at all, though it is long.</p></aside><section class="comments"><p>I think that this is a very good article, and I have a lot to say about it, much more than it says itself, as readers do.</p></section>
<form><label>Mail</label><input name=m><button>Send</button></form><footer>&copy; 2020 All rights reserved by the people who made this page.</footer></body></html>"""


def framed(body):
    return FRAME.replace("{0}", body)


@pytest.mark.parametrize("wrap", ["<article>{0}</article>", "<main>{0}</main>", "<div class='content'>{0}</div>", "<div><div id='post-body'>{0}</div></div>", "<article><header>{0}</article>"])
def test_main_text_of_a_page(wrap):
    assert H.main_text(framed(wrap.format(ARTICLE))) == WANT


@pytest.mark.parametrize("name", ["class='content has-sidebar'", "class='layout-right-rail'", "id='form-article'", "class='overlay'"])
def test_wrappers_whose_names_hold_words_of_page_parts(name):
    long = "<p>" + "some more words of it " * 30 + "</p>"
    assert H.main_text(framed(f"<div {name}><div class='text'>{ARTICLE}{long}</div></div>")) == WANT + "\n" + ("some more words of it " * 30).strip()
    assert H.main_text(f"<body><section {name}><p>all of the page</p></section></body>") == "all of the page"


def test_parts_of_an_article_with_such_names():
    page = framed(f"<article><div class='post-header'><h1>Head</h1></div><p class='notice'>A notice.</p>{ARTICLE}<div class='ad'>Buy it.</div><div class='share-links'>Share it.</div></article>")
    assert H.main_text(page) == "Head\n" + WANT  # notices are no part of a text


def test_sections_and_headings_beside_the_centre():
    page = framed("<div><h1>Head</h1><section><p>" + "one two " * 30 + "</p></section><section><p>" + "three four " * 20 + "</p></section></div>")
    assert H.main_text(page) == "Head\n" + ("one two " * 30).strip() + "\n" + ("three four " * 20).strip()


LINE = "One long sentence of sixteen words that says a little more than others do here."


def lines(n, mark=""):
    return "".join(f"<p>{mark}{k} {LINE}</p>" for k in range(n))


def read(n, mark=""):
    return [f"{mark}{k} {LINE}" for k in range(n)]


@pytest.mark.parametrize("name", ["id='reader-comments'", "class='post-comments'", "class='user-comments box'", "class='commentThread'", "id='comments-of-readers'", "class='ad-slot-1'", "class='adSlot'", "class='notice'", "class='alert'", "id='cookie-bar'", "class='sponsored-posts'"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_talk_adverts_and_notices_go_even_where_they_outweigh_the_article(name, tag):
    foreign = f"<div {name}>{lines(10, 'x')}</div>"
    assert H.main_text(f"<body><{tag}>{lines(3)}</{tag}>{foreign}</body>").split("\n") == read(3)
    assert H.main_text(f"<body><{tag}>{lines(2)}<div {name}>{lines(1, 'x')}</div><p>End.</p></{tag}></body>").split("\n") == [*read(2), "End."]
    assert H.main_text(f"<body><div {name}><article>{lines(3)}</article></div></body>").split("\n") == read(3)  # a name around the article
    assert H.main_text(f"<body>{foreign}</body>").split("\n") == read(10, "x")  # there is nothing else


@pytest.mark.parametrize("name", ["share-buttons", "related-articles", "related-posts", "social-icons", "newsletter-box"])
def test_parts_inside_an_article_go(name):
    assert H.main_text(f"<article>{lines(3)}<div class='{name}'><p>Something else.</p></div><p>End.</p></article>").split("\n") == [*read(3), "End."]


@pytest.mark.parametrize("name", ["has-comments", "no-comments", "with-comments", "layout"])
def test_names_that_tell_what_an_element_has(name):
    assert H.main_text(f"<body class='{name}'><div class='{name}'>{lines(3)}</div><div class='comments'>{lines(9, 'x')}</div></body>").split("\n") == read(3)


def test_sections_beside_the_centre_stay():
    sections = [*read(6), *read(3, "b"), "Three", "A short one."]
    page = f"<div><section>{lines(6)}</section><section>{lines(3, 'b')}</section><section><h2>Three</h2><p>A short one.</p></section></div>"
    assert H.main_text(f"<body>{page}</body>").split("\n") == sections
    page = f"<body><div>{lines(6)}</div><div><h2>Second</h2><p>Short.</p><ul><li>one<li>two</ul></div><div>The end.</div><div>© 2020 Someone</div><div><a href=x>All that was written before</a></div></body>"
    assert H.main_text(page).split("\n") == [*read(6), "Second", "Short.", "one", "two", "The end."]
    page = f"<body><article><div>{lines(6)}</div></article><div>A line of the site.</div></body>"
    assert H.main_text(page).split("\n") == read(6)


def test_references_do_not_run_over_markup():
    assert H.main_text("<p>&am<b>p;</b> &amp;lt; &#x26;&l<i>t;</i></p>") == "&amp; &lt; &&lt;"


def test_many_nested_tables_take_linear_time():
    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        assert H.main_text("<table><tr><td>" * n + "x") == "x"
        took.append(time.perf_counter() - began)
    assert took[1] < 2.5 and took[1] < 8 * took[0] + 0.3


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<script>x", "<!-- open", "<p", "<", "</p></div>", "<style>a{}</style>"])
def test_pages_without_text(page):
    assert H.main_text(page) in ("", "<", "<p")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>a <a href="/hidden-beach">link</a> b</p>', "a link b"),
        ('<p title="hidden gems">x</p><p data-hidden="false">y</p>', "x\ny"),
        ('<p class="x>Hello', "Hello"),
        ("<p><a href=it's>the link</a> and", "the link and"),
        ("<html><head><title>t</title><body><p>Hello there</p>", "Hello there"),
        ("<html><head><meta x><p>Open head", "Open head"),
        ('<article><h2 id="discussion">Disc</h2><p id="related-work">Text of it.<div class="article-header">Head</div></article>', "Disc\nText of it.\nHead"),
        ("<div hidden>no</div><p hidden=''>no<p>yes", "yes"),
        ('<img src=x alt="a>b">t', "t"),
        ("<div class = 'ad'>no</div><p id=ad>no</p><p>a long text here for all", "a long text here for all"),
        ("<p>one&nbsp;&#233;&eacute;&lt;b&gt;</p>", "one éé<b>"),
    ],
)
def test_markup_as_browsers_read_it(page, want):
    assert H.main_text(page) == want


def test_densities_choose_without_an_article_element():
    text = "<p>" + "words of the text and more of them, " * 12 + "</p>"
    links = "<div>" + "".join(f"<p><a href='/{i}'>a headline of another page {i}</a></p>" for i in range(30)) + "</div>"
    for tag in ("div", "article", "main"):
        page = f"<body><{tag}><h1>Head</h1><div>{text * 3}</div><ul><li>short</ul></{tag}>{links}</body>"
        out = H.main_text(page)
        assert "Head" in out and out.count("words of the text") == 36 and "headline" not in out
    page = f"<body><main><div>{text * 3}</div>{links}</main></body>"  # an element of the name alone decides nothing
    assert "headline" not in H.main_text(page) and H.main_text(page).count("words of the text") == 36
    page = f"<body><article><div>{text * 3}</div><ul><li>one<li>two</ul><p>End.</p></article>{links}</body>"
    assert H.main_text(page).endswith("one\ntwo\nEnd.")


def test_pages_equal_an_independent_reading(spark):
    """The given pages hold their text in one element: its blocks by the standard library's parser."""
    from html.parser import HTMLParser

    parts = set("article p h1 h2 h3 ul ol li table tr td th div blockquote pre section br".split())

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.skip, self.blocks = 0, 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.skip += self.inside > 0 and tag in ("script", "style", "aside", "nav", "form")
            self.blocks += [[]] if tag in parts - {"br"} else []
            self.blocks[-1].append(" ") if tag == "br" else None

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.skip -= self.inside > 0 and tag in ("script", "style", "aside", "nav", "form")
            self.blocks += [[]] if tag in parts else []

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks[-1].append(data)

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        a = Article()
        a.feed(r.html)
        a.close()
        assert H.main_text(r.html) == "\n".join(b for b in (" ".join("".join(x).split()) for x in a.blocks) if b), r.page_id


@pytest.mark.parametrize("page", ["<div>" * 8000 + "</span>" * 8000 + "deep", "<span><article>" + "<div>" * 8000 + "</span>" * 8000 + "deep", "<b>" * 8000 + "<p>x</p>" * 8000, "<div class=notice>" * 8000 + "deep", "<li><p>" * 8000 + "x", "<table><tr><td>" * 3000 + "x", "<p " * 20000, "<p a='" * 20000, "<a b=" * 20000 + "<"])
def test_no_page_takes_quadratic_time(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 2


def test_broken_deep_and_long_pages():
    assert H.main_text("<div><p>a<div>b</p></span>c").endswith("b\nc")
    assert H.main_text("<div>" * 3000 + "deep text" + "</div>" * 10) == "deep text"
    assert len(H.main_text("<p>" + "word " * 400_000)) == 1_999_999


def test_table_of_pages(spark):
    rows = [(1, "u", framed(f"<article>{ARTICLE}</article>"), "x"), (1, "u", None, "x"), (None, None, "<p>é", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in H.extracted(df).collect()), key=str) == sorted([(1, WANT, len(WANT)), (1, "", 0), (None, "é", 1)], key=str)
    assert H.extracted(df.limit(0)).count() == 0 and H.run(spark, SF).where("n_chars = 0").count() == 0


def test_shards_round_trip():
    rng = random.Random(1)
    rows = [(None, 0, [0]), (-5, 0, [1, 2]), (-5, 1, [3])] + [(i * 3, 0, [rng.randrange(60_000) for _ in range(rng.randint(0, 3000))]) for i in range(300)] + [(2**62, 0, [70_000, 1])]
    out = io.BytesIO()
    w = S.ShardWriter(out)
    for i, copy, ids in rows:
        w.add(S.key_of(i, copy), np.array(ids, np.uint32))
    assert w.close() == (len(rows), sum(len(x) for _, _, x in rows))
    r = S.ShardReader(pa.PythonFile(io.BytesIO(out.getvalue()), mode="r"))
    assert [(S.id_of(k), v.tolist()) for k, v in r] == [(i, x) for i, _, x in rows] and len(r.index) > 5
    assert [v.tolist() for v in r.get(-5)] == [[1, 2], [3]] and [v.tolist() for v in r.get(None)] == [[0]] and r.get(1) == [] and r.get(2**62)[0].tolist() == [70_000, 1]
    assert all(r.get(i * 3)[0].tolist() == rows[i + 3][2] for i in range(0, 300, 17)) and sum(bool(r.get(i)) for i in range(1, 900, 3)) == 0


def test_encoder_equals_the_library():
    e, rng = S.Encoder(S.default_tokenizer()), random.Random(5)
    bits = ["a", "B", "é", "1", "22", " ", "  ", "\n", "\n\n", "\r\n", "\t", "'", "'s", "'ll", ".", ",", "—", "\xa0", "　", " ", "中文", "🙂", "<|endoftext|>", "_", "\x00", "\x1c", "\x85", "don't", "…"]
    for _ in range(400):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        ids, at = e(*X.column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    e.remembered = 3  # memory is cleared, not wrong
    ids, at = e(*X.column_bytes(pa.array(["one two three four five six"])))
    assert ids.tolist() == e.tokenizer.encode("one two three four five six", add_special_tokens=False).ids


def test_literals_of_added_tokens_equal_the_untouched_library():
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(S.default_tokenizer()), S.Encoder(S.default_tokenizer()), random.Random(9)
    assert e(*X.column_bytes(pa.array(["<|endoftext|>"])))[0].tolist() == [50256]
    bits = ["<|endoftext|>", "<|endof", "text|>", "a", " ", "  ", "\n", "é", ".", "<", "|>", "one two"]
    for _ in range(400):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(5)]
        ids, at = e(*X.column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_store_of_a_table(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(S.default_tokenizer())
    rows = [(5, "five é"), (3, None), (1, "one"), (5, "five a"), (None, "null id"), (9, ""), (2, "long " * 50_000)]
    manifest = S.write_store(docs(spark, rows), f"file://{tmp_path}/store", shard_rows=2)
    out = S.read_store(manifest).orderBy("start").collect()
    hashes = {r.text: r.h for r in docs(spark, rows).selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    at = 0
    for r, (i, text) in zip(out, order, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shards = manifest.collect()
    assert len(shards) > 1 and S.lookup(shards, 1)[0].tolist() == [*t.encode("one").ids, 0] and S.lookup(shards, 77) == [] and len(S.lookup(shards, 5)) == 2
    assert S.read_store(S.write_store(docs(spark, []), f"file://{tmp_path}/none")).count() == 0


def test_store_of_a_whole_table(spark):
    """Every document of the smallest tables by the untouched library, read back in ascending order."""
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(S.default_tokenizer()), 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in S.run(spark, SF).collect()) == want


def test_shards_are_bounded_and_repeated_ids_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_PARTS", 3)
    rows = [(None, f"row {i % 7} " * 5) for i in range(300)] + [(i, "one two " * 40) for i in range(60)]
    manifest = S.write_store(docs(spark, rows), f"file://{tmp_path}/store", shard_rows=40, shard_ids=400)
    shards = manifest.orderBy("part", "number").collect()
    assert len({r.part for r in shards if r.first_id is None}) > 3 and max(r.number for r in shards) > 1 and all(r.ids < 600 for r in shards)
    out = S.read_store(manifest).orderBy("start").collect()
    assert [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out)])[:-1].tolist() and len(out) == len(rows)
    assert [r.doc_id for r in out] == [None] * 300 + list(range(60)) and len(S.lookup(shards, None)) == 300 and len(S.lookup(shards, 7)) == 1


def test_long_texts_go_in_pieces(monkeypatch):
    from tokenizers import Tokenizer

    t, e, rng = Tokenizer.from_file(S.default_tokenizer()), S.Encoder(S.default_tokenizer()), random.Random(12)
    monkeypatch.setattr(X, "BLOCK", 100)
    for _ in range(20):
        texts = ["".join(rng.choice(["a", " ", "é", "word ", ". ", "\n", "12", "  ", "中"]) for _ in range(n)) for n in (900, 3, 0, 400)]
        ids, at = e(*X.column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_stretches_of_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(S.default_tokenizer()), S.Encoder(S.default_tokenizer())
    monkeypatch.setattr(X, "word_hashes", lambda data, starts, ends, lower=None: ((ends - starts) % 3).astype(X.U64))
    texts = ["one two three", "six ten four eleven", "one"]
    for _ in range(2):
        ids, at = e(*X.column_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute_top(rows, k=5, every=50):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {i: v for i, v in sorted(ok, reverse=True) if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(16)]) for i in range(400)]
    rows += [(400, None), (450, [1.0, float("nan")] * 8), (500, [None] * 16), (550, [float("inf")] + [0.0] * 15), (600, []), (None, [1.0] * 16), (650, [0.5, -0.25]), (651, [1.0, 2.0]), (652, [0.5, 0.5])]
    rows += [(701 + i, [0.125] * 16) for i in range(12)] + [(750, [0.125] * 16), (333, [0.125] * 16)]
    df = spark.createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    for rule in (K.SearchRule(), K.SearchRule(block=3, sample=20, cells=21, levels=((0.0, 2), (0.3, 3), (1.0, 1))), K.SearchRule(sparse=0.0, numbers=64), K.SearchRule(sparse=1.0, turned=8)):
        assert sorted(tuple(r) for r in K.top_k(df, rule).collect()) == brute_top(rows)
    assert K.top_k(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = np.floor(rng.normal(0, 100, (50, 64))), np.floor(rng.normal(0, 100, (80, 64)))
    for level in ((0.0, 1), (0.0, 4), (0.0, 7), (0.0, 40), (0.3, 5), (0.5, 64), (1.0, 1)):
        bounds = K.cuts(64, level)
        upper = K.statistics(x, bounds) @ K.statistics(y, bounds).T
        assert bounds[0] == 0 and bounds[-1] == 64 and (upper >= x @ y.T - 1e-6).all()
    assert np.allclose(upper, x @ y.T)  # single axes are exact


def test_bounds_prune_pairs(spark):
    sf = "/root/testdata/sf0.1"
    pairs = K.surviving(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert pairs == sorted(pairs, reverse=True) and 0 < pairs[-1] < pairs[0] / 4
    rng = np.random.default_rng(5)  # strong axes, as learned vectors have: the coarse level prunes as well
    strong = rng.normal(0, 1, (3000, 32)) * 0.7 ** np.arange(32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(strong)], "vec_id long, embedding array<double>")
    pairs = K.surviving(df)
    assert pairs[1] < pairs[0] / 2 and pairs[-1] < pairs[0] / 20


def test_a_block_costs_no_more_than_a_few_products():
    """Many queries at once: bounds and survivors by matrix products, not query by query."""
    rng = np.random.default_rng(7)
    x, y, pool = (np.floor(256 * rng.normal(0, 0.125, (n, 64))) for n in (8192, 512, 4096))
    floor = np.concatenate([np.sort(x[a : a + 512] @ pool.T, axis=1)[:, -5] for a in range(0, len(x), 512)])
    began = time.perf_counter()
    for _ in range(4):
        np.partition(x @ y.T, len(y) - 5, axis=1)
    plain = (time.perf_counter() - began) / 4
    block = K.Block(np.arange(len(x)), x, floor, np.linalg.eigh(pool.T @ pool)[1][:, ::-1].copy(), K.SearchRule())
    began = time.perf_counter()
    for at in range(0, len(y), block.rows):
        block.meet(y[at : at + block.rows], np.arange(at, at + len(y[at : at + block.rows])) + 10**6)
    assert time.perf_counter() - began < 6 * plain + 0.2 and block.pairs[-1] < 0.05 * block.pairs[0] and block.pairs[1] < 0.8 * block.pairs[0]
    best = block.best().to_pydict()
    scores = x @ y.T
    for q in range(0, len(x), 997):
        mine = [(s, v - 10**6) for i, v, s in zip(best["query_id"], best["vec_id"], best["score"], strict=True) if i == q]
        assert mine == [(s, v) for s, v in sorted(((int(s), v) for v, s in enumerate(scores[q])), key=lambda t: (-t[0], t[1]))[:5] if s >= floor[q]]


def test_wide_vectors_keep_their_axes_and_go_in_small_blocks(spark):
    rng = np.random.default_rng(8)
    wide = np.floor(rng.normal(0, 8, (120, 5000))) / 256
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "vec_id long, embedding array<double>")
    rule = K.SearchRule(every=10, numbers=1 << 14)
    _, _, n, sampled = K._blocks(df, rule)
    assert n == 4 and K.principal_axes(sampled, rule) == {}
    scores = np.floor(256 * wide) @ np.floor(256 * wide).T
    want = sorted((q, k, v, int(scores[q, v])) for q in range(0, 120, 10) for k, v in enumerate(sorted((v for v in range(120) if v != q), key=lambda v: (-scores[q, v], v))[:5], 1))
    assert sorted(tuple(r) for r in K.top_k(df, rule).collect()) == want


def test_whole_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in K.run(spark, SF).collect()) == brute_top(rows)
