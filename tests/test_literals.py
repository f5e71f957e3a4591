"""Small literal cases with known answers."""

import codecs
import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import combine, dom, jsonx, rx
from pagemill.functions.dom import Step
from pagemill.functions.text import js_trim, normalize_newlines, prefix_sums
from pagemill.functions.urls import encode_component, resolve_url
from pagemill.operators import content, extract, purify, search, segment, shelf, store, toc
from pagemill.operators.purify import Rule
from pagemill.operators.requests import expand_template, plan_requests
from pagemill.sources import bytes as by
from pagemill.sources.catalog import import_counts, import_merge, parse_catalog
from pagemill.sources.shred import shred_pages


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def page(spark, html):
    return shred_pages(spark.createDataFrame([(0, "https://h.example/a/b?x=1", html)], "page_id int, url string, html string"), keep_html=True)


def on_page(spark, html, column):
    return page(spark, html).select(column.alias("v")).first()["v"]


def N():
    return F.col("nodes")


def texts(sel):
    return F.transform(sel, lambda p: dom.text(N(), p))


# --- text, urls, regex, combining ------------------------------------------------------------


def test_trim_and_newlines(spark):
    assert one(spark, js_trim(F.lit(" ﻿　x y \n"))) == "x y"
    assert one(spark, normalize_newlines(F.lit("﻿a\r\nb\rc\n"))) == "a\nb\nc\n"


def test_prefix_sums(spark):
    df = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "a array<int>")
    for row in df.select("a", prefix_sums(F.col("a")).alias("s")).collect():
        assert row.s == [sum(row.a[:i]) for i in range(len(row.a))]


@pytest.mark.parametrize(
    "href, base, expect",
    [
        ("../x", "http://a.com/b/c/d?q=1#z", "http://a.com/b/x"),
        ("..", "http://a.com/b/c/d", "http://a.com/b/"),
        ("./", "http://a.com/b/c/d", "http://a.com/b/c/"),
        ("?a=b c", "http://a.com/b/c/d?q=1", "http://a.com/b/c/d?a=b%20c"),
        ("#f", "http://a.com/b?q=1#z", "http://a.com/b?q=1#f"),
        ("//H.org/p q", "https://a.com/", "https://h.org/p%20q"),
        ("/für?x=é", "https://A.com:443/z", "https://a.com/f%C3%BCr?x=%C3%A9"),
        ("a/./b/../../../c", "http://a.com/x/y", "http://a.com/c"),
        ("c.jpg", "http://a.com", "http://a.com/c.jpg"),
        ("c.jpg", "http://a.com/d/e", "http://a.com/d/c.jpg"),
        ("%20é", "http://a.com/", "http://a.com/%20%C3%A9"),
        (" HTTP://Z/q ", "http://a.com/", "HTTP://Z/q"),
        ("javascript:void(0)", "http://a.com/", "javascript:void(0)"),
        ("", "http://a.com/", ""),
        ("x", "not a url", "x"),
    ],
)
def test_resolve_url(spark, href, base, expect):
    assert one(spark, resolve_url(F.lit(href), F.lit(base))) == expect


def test_encode_component(spark):
    assert one(spark, encode_component(F.lit("测试 a!'()~*&"))) == "%E6%B5%8B%E8%AF%95%20a!'()~*%26"


def test_rewrites(spark):
    assert one(spark, rx.rewrite_first(F.lit("rain, rain, go"), "rain", "sun")) == "sun, rain, go"
    assert one(spark, rx.rewrite_first(F.lit("calm"), "wind", "sun")) == "calm"
    assert one(spark, rx.rewrite_all(F.lit("left [x] right [x]"), r"\[x\]", "")) == "left  right "
    assert one(spark, rx.rewrite_all(F.lit("ab"), "(a)(b)", "$2$1$&")) == "baab"
    assert one(spark, rx.rewrite_all(F.lit("a\n"), "a$", "b")) == "a\n"


def test_browser_dialect(spark):
    assert one(spark, rx.rewrite_first(F.lit("ya xa xa"), "(?<=x)a", "_")) == "ya x_ xa"
    assert one(spark, rx.rewrite_first(F.lit("abcc dd"), r"([a-z])\1", "<$1>")) == "ab<c> dd"
    assert one(spark, rx.rewrite_first(F.lit("k=v"), "(k)=(v)", "$2$1$&$3$$")) == "vkk=v$3$"
    assert one(spark, rx.rewrite_all(F.lit("ab"), "b", "$5")) == "a$5"
    assert one(spark, rx.rewrite_all(F.lit("ab"), "(", "x")) == "ab"
    assert one(spark, rx.rewrite_first(F.lit("ab"), "(", "x")) == "ab"
    assert one(spark, rx.rewrite_all(F.lit("a&b"), "[a&&b]", "-")) == "---"
    assert one(spark, F.size(rx.regex_items(F.lit("a"), "(", 1))) == 0
    assert one(spark, rx.regex_values(F.lit("a　b"), r"\s")) == ["　"]
    assert one(spark, rx.regex_values(F.lit("k1=v1,k2=v2"), "(k[0-9])=")) == ["k1", "k2"]
    starts = rx.java_pattern("^", multiline=True)
    assert one(spark, F.regexp_count(F.lit("a\n"), F.lit(starts))) == 2


def test_regex_items_reversed(spark):
    raw = F.lit('<a href="/1">First</a><a href="/2">Second</a>')
    items = rx.regex_items(raw, '<a href="([^"]*)">(.*?)</a>', 2, reverse=True)
    titles = F.transform(items, lambda x: rx.capture(x, 2))
    links = F.transform(items, lambda x: resolve_url(rx.capture(x, 1), F.lit("https://h.example/toc")))
    assert one(spark, titles) == ["Second", "First"]
    assert one(spark, links) == ["https://h.example/2", "https://h.example/1"]


def test_combining(spark):
    a, b = F.split(F.lit("a1,a2,a3"), ","), F.split(F.lit("b1"), ",")
    assert one(spark, combine.interleave(a, b)) == ["a1", "b1", "a2", "a3"]
    assert one(spark, combine.first_value(F.lit(" "), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, combine.join_segments(a, b)) == "a1a2a3\nb1"
    assert one(spark, combine.first_list(F.array().cast("array<string>"), b)) == ["b1"]


# --- pages -----------------------------------------------------------------------------------

POSITIONS = (
    '<section class="facts"><p>by <a>Ada</a></p><p>in <a>Oslo</a></p><p>for <a>Kim</a></p></section>'
    '<nav class="steps"><a>boil</a><a>stir</a><a>serve</a></nav>'
    '<b class="hot">tea</b><b class="hot">soup</b><b class="cold">milk</b><b class="cold">ice</b>'
)


def test_positions(spark):
    paragraphs = dom.select(N(), Step(cls="facts"), Step(tag="p"))
    second = dom.select(N(), Step(tag="a"), roots=dom.at(paragraphs, 1))
    assert on_page(spark, POSITIONS, texts(second)) == ["Oslo"]
    child = dom.select(N(), Step(tag="a", child=True), roots=dom.at(paragraphs, 1))
    assert on_page(spark, POSITIONS, texts(child)) == ["Oslo"]
    items = dom.select(N(), Step(cls="steps"), Step(tag="a"))
    assert on_page(spark, POSITIONS, texts(dom.at(items, 1))) == ["stir"]
    assert on_page(spark, POSITIONS, texts(dom.without(items, 0, -1))) == ["stir"]
    assert on_page(spark, POSITIONS, texts(dom.span(items, -1, 0))) == ["serve", "stir", "boil"]
    assert on_page(spark, POSITIONS, texts(dom.picks(items, -1, (0, 2, 1)))) == ["serve", "boil", "stir"]
    both = combine.interleave(texts(dom.select(N(), Step(cls="hot"))), texts(dom.select(N(), Step(cls="cold"))))
    assert on_page(spark, POSITIONS, both) == ["tea", "milk", "soup", "ice"]


FACTS = [(7, "River Notes", "J. Moss"), (9, "Night Ferry", "L. Tarn")]


def test_item_scoped_fields(spark):
    html = "".join(f"<article><h2>No. {n} <a>{t}</a></h2><footer><em>{w}</em></footer></article>" for n, t, w in FACTS)
    rows = extract.item_rows(
        page(spark, html),
        ["page_id"],
        dom.select(N(), Step(tag="article")),
        {
            "name": lambda n, p: dom.text(n, dom.first(dom.select(n, Step(tag="h2"), Step(tag="a"), roots=F.array(p)))),
            "author": lambda n, p: dom.text(n, dom.first(dom.select(n, Step(tag="em"), roots=F.array(p)))),
        },
    )
    assert [(r.name, r.author) for r in rows.orderBy("ord").collect()] == [(t, w) for _, t, w in FACTS]


def shredded_texts(html):
    from pagemill.sources import shred

    columns = shred._Columns()
    shred._shred(html, columns)
    return [(n[shred.TAG], n[6]) for n in columns.nodes]


def test_shredding_keeps_text():
    assert shredded_texts("<p title=it's>Hello</p><p>don't</p>") == [("p", None), ("#text", "Hello"), ("p", None), ("#text", "don't")]
    assert shredded_texts("<a>x<a>y</a>z") == [("a", None), ("#text", "x"), ("a", None), ("#text", "y"), ("#text", "z")]
    assert shredded_texts("<title>1 <b> &amp; 2</title>") == [("title", None), ("#text", "1 <b> & 2")]
    cells = shredded_texts("<table><tr><td><i>a</div></table>b")
    assert cells[-2:] == [("#text", "a"), ("#text", "b")] and [t for t, _ in cells][:4] == ["table", "tr", "td", "i"]
    assert shredded_texts("1 < 2 <b") == [("#text", "1 < 2 <b")]


@pytest.mark.parametrize("bad", ['<a b="x ', "<a b='x>", '<a x=">"', "<a ", "<!x", "</a b"])
def test_shredding_is_linear(bad):
    import time

    start = time.thread_time()
    shredded_texts(bad * 8000)
    assert time.thread_time() - start < 1


def test_html_to_text(spark):
    html = "<p>第一段&nbsp;文字</p><p>第二段文字</p><script>x()</script><p>a<br>b<p>c<ul><li>d<li>e</ul>"
    assert on_page(spark, html, dom.html_to_text(N(), F.lit(-1))) == "第一段 文字\n第二段文字\na\nb\nc\nd\ne"


def test_attributes(spark):
    html = '<a title=" T " href="/x?a=1&copy=2&amp;b" data-u="//c.example/q">t</a>'
    first = dom.first(dom.select(N(), Step(tag="a")))
    assert on_page(spark, html, dom.attr(N(), first, "title", F.col("url"))) == "T"
    assert on_page(spark, html, dom.attr(N(), first, "href")) == "/x?a=1&copy=2&b"
    assert on_page(spark, html, dom.attr(N(), first, "data-u", F.col("url"))) == "https://c.example/q"
    assert on_page(spark, html, dom.attr(N(), first, "missing", F.col("url"))) == ""
    assert on_page(spark, html, dom.outer_html(F.col("html"), N(), first)) == html
    assert on_page(spark, html, dom.inner_html(F.col("html"), N(), first)) == "t"


def test_broken_pages(spark):
    assert on_page(spark, None, F.size(N())) == 0
    assert on_page(spark, "a < b <", dom.text(N(), F.lit(-1))) == "a < b <"
    assert on_page(spark, "<div><script>if (a</script><b>x", dom.html_to_text(N(), F.lit(-1))) == "x"
    assert on_page(spark, "<table><tr><td>1<td>2<tr><td>3</table>", texts(dom.select(N(), Step(tag="td")))) == ["1", "2", "3"]


def test_json_paths(spark):
    v = F.try_parse_json(F.lit('{"a":[{"k":1},{"k":"x"},{"n":null}],"o":{"b":2,"a":1}}'))
    K, I, E = jsonx.Key, jsonx.Index, jsonx.Each
    assert one(spark, jsonx.value(v, K("a"), I(-2), K("k"))) == "x"
    assert one(spark, jsonx.value(v, K("a"), E(), K("k"))) == '[1,"x"]'
    assert one(spark, jsonx.value(v, K("o"), E())) == "[1,2]"
    assert one(spark, jsonx.value(v, K("a"), I(2), K("n"))) == ""
    assert one(spark, F.size(jsonx.items(v, K("a")))) == 3
    assert one(spark, F.size(jsonx.items(v, K("zz")))) == 0
    assert one(spark, jsonx.deep_find(F.lit('{"k":[1,{"k":2}],"b":{"k":3}}'), "k")) == ['[1,{"k":2}]', "2", "3"]
    assert one(spark, extract.response_kind(F.lit(" [1] "))) == "json"
    assert one(spark, extract.response_kind(F.lit('cb({"a":1})'))) == "html"


# --- catalog and requests --------------------------------------------------------------------


def test_parse_catalog(spark):
    good = '{"bookSourceName":"A","bookSourceUrl":"https://a","header":"{\'X\':\'1\'}","x":"y","ruleToc":{"chapterList":"l"}}'
    rows = [(0, good), (1, f"[{good}]"), (2, f"oops\n\n{good}\n" + '{"bookSourceName":""}'), (3, "nothing")]
    out = parse_catalog(spark.createDataFrame(rows, "f int, text string")).orderBy("f").collect()
    assert [(r.f, r.source_name, r.header, r.extra, r.ruleToc) for r in out] == [
        (f, "A", {"X": "1"}, {"x": "y"}, {"chapterList": "l"}) for f in (0, 1, 2)
    ]


def test_import(spark):
    schema = "source_url string, source_name string, source_type int, enabled boolean, ord int"
    old = spark.createDataFrame([("u1", "one", 0, True, 0)], schema)
    new = spark.createDataFrame([("u1", "x", 0, True, 0), ("u2", "b", 1, True, 2), ("u2", "a", 0, True, 1), ("u3", "c", 2, None, 3)], schema)
    rows = {r.source_url: (r.source_name, r.enabled) for r in import_merge(old, new).collect()}
    assert rows == {"u1": ("one", True), "u2": ("a", True), "u3": ("c（暂不支持）", False)}
    assert import_counts(old, new).first().asDict() == {"added": 2, "skipped": 2, "unsupported": 1}


def test_template(spark):
    forms = {"page*15+1": lambda p: p * 15 + 1, "page==1?'first':page": lambda p: F.when(p == 1, "first").otherwise(p.cast("string"))}
    t = F.lit("find={{key}}&from={{page*15+1}}&tab={{page==1?'first':page}}&x={{other}}")
    assert one(spark, expand_template(t, F.lit("海 b"), F.lit(4), forms)) == "find=%E6%B5%B7%20b&from=61&tab=4&x="
    assert one(spark, expand_template(t, F.lit("z"), F.lit(1), forms)) == "find=z&from=16&tab=first&x="


def test_requests(spark):
    src = spark.createDataFrame(
        [
            ("https://a.example", "/s?x=1,{body:'k={{key}}'}", {"A": "1"}),
            ("https://b.example", "https://o.example/s,{method:'post',body:'k={{key}}',headers:{'A':'2','content-type':'t'}}", {"A": "1"}),
        ],
        "source_url string, search_url string, header map<string,string>",
    )
    a, b = plan_requests(src, ["k"]).orderBy("source_url").collect()
    assert (a.url, a.method, a.body, a.headers) == ("https://a.example/s?x=1&k=k", "GET", None, {"A": "1"})
    assert (b.url, b.method, b.body, b.headers) == ("https://o.example/s", "POST", "k=k", {"A": "2", "content-type": "t"})


def test_decoding(spark):
    cases = [
        ("plain é", "plain é".encode(), "utf-8", None),
        ("gb", "第一章".encode("gb18030"), "gb18030", None),
        ("bom", b"\xef\xbb\xbfx\r\ny", "utf-8", None),
        ("le", b"\xff\xfe" + "第".encode("utf-16le"), "utf-16le", None),
        ("bad", b"\x81", "gb18030", "undecodable"),
        ("none", b"", "utf-8", "empty"),
    ]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _, _ in cases], "n string, content binary")
    got = {r.n: (r.encoding, r.reason, r.text) for r in by.decode_texts(df).collect()}
    assert {n: got[n][:2] for n in got} == {n: (e, r) for n, _, e, r in cases}
    assert got["gb"][2] == "第一章" and got["bom"][2] == "x\ny" and got["le"][2] == "第"
    big5 = spark.createDataFrame([(bytearray("第".encode("big5")),)], "content binary")
    assert by.decode_texts(big5, requested="big5").first().text == "第"


# --- search ----------------------------------------------------------------------------------

RESULT = "name string, author string, source_url string, book_url string, ord int"


def grouped(spark, rows):
    df = spark.createDataFrame(rows, RESULT)
    return search.variants(df.withColumn("group_key", search.norm_key(F.col("name"), F.col("author"))), ["ord"])


def test_grouping(spark):
    v = grouped(spark, [("Example", "Me", "s1", "b1", 2), ("Exam ple (Complete)", " me ", "s2", "b2", 1), ("Example", "Me", "s1", "b1", 0)])
    row = search.group_variants(v).first()
    assert (row.n_alternatives, row.source_url, row.ord) == (2, "s1", 0)
    flat = search.with_alternatives(v).orderBy("ord").collect()
    assert [(r.source_url, r.is_first) for r in flat] == [("s1", True), ("s2", False)]
    picks = spark.createDataFrame([("example|me", "s2", "b2")], "group_key string, source_url string, book_url string")
    assert search.selected_variant(v, picks).first().source_url == "s2"
    wrong = spark.createDataFrame([("example|me", "s9", "b2")], "group_key string, source_url string, book_url string")
    assert search.selected_variant(v, wrong).first().source_url == "s1"


@pytest.mark.parametrize(
    "pages, expect",
    [
        ([["a"], ["b"], ["a"], ["c"]], (3, False, 2)),
        ([["a"], ["b"]], (2, True, 2)),
        ([["a"], [], ["b"]], (2, False, 1)),
        ([[str(i)] for i in range(25)], (25, True, 25)),
    ],
)
def test_page_merge(spark, pages, expect):
    rows = [("q", "s", u, i + 1) for i, p in enumerate(pages) for u in p]
    read, limits = search.merge_pages(spark.createDataFrame(rows, "q string, source_url string, book_url string, page int"), ["q"])
    row = limits.first()
    assert (row.last_page, row.can_fetch_more, read.count()) == expect


# --- toc, content, store ---------------------------------------------------------------------


def test_info_and_freshness(spark):
    shelf_rows = spark.createDataFrame([("b", "s2", "u")], "id string, source_url string, book_url string")
    stored = spark.createDataFrame([("b", "s1", "u"), ("b", "s2", "u"), ("b", None, None)], "book_id string, source_url string, book_url string")
    assert sorted(str((r.source_url, r.is_fresh)) for r in toc.toc_freshness(stored, shelf_rows).collect()) == [
        "('s1', False)", "('s2', True)", "(None, True)",
    ]


def test_content(spark):
    assert one(spark, content.drop_title_line(F.lit("T \nbody\nx"), F.lit(" T"))) == "body\nx"
    assert one(spark, content.drop_title_line(F.lit("T"), F.lit("T"))) == ""
    assert one(spark, content.drop_title_line(F.lit("U\nb"), F.lit("T"))) == "U\nb"
    pages = spark.createDataFrame(
        [("c1", "c2", " one "), ("c2", "c1", "two"), ("d1", "d2", "x"), ("d2", None, " "), ("e1", "e2", "x")],
        "url string, next_url string, content string",
    )
    starts = spark.createDataFrame([("c", "c1"), ("d", "d1"), ("e", "e1")], "k string, url string")
    good, bad = content.stitch(starts, pages, ["k"])
    assert [(r.k, r.content) for r in good.collect()] == [("c", "one\ntwo")]
    assert sorted(r.k for r in bad.collect()) == ["d", "e"]


def test_store(spark):
    rows = [("b", "s", "u", f"c{i}", 1, "text") for i in range(3)] + [("b", "s", "other", "c3", 1, "t"), ("b", "s", "u", "c4", 2, "t"), ("b", "s", "u", "c5", 1, " ")]
    db = spark.createDataFrame(rows, "book_id string, source_url string, book_url string, chapter_url string, version int, content string")
    want = spark.createDataFrame([("b", "s", "u", f"c{i}") for i in range(9)], "book_id string, source_url string, book_url string, chapter_url string")
    hits, purge = store.checked_read(want, db)
    assert sorted(r.chapter_url for r in hits.collect()) == ["c0", "c1", "c2"]
    assert sorted(r.chapter_url for r in purge.collect()) == ["c3", "c4", "c5"]


@pytest.mark.parametrize("start, n, expect", [(34, 10, [34, 35, 36, 37, 38, 39]), (1, 2, [1, 2]), (99, 3, [39]), (0, 0, [])])
def test_backfill_range(spark, start, n, expect):
    chapters = spark.createDataFrame([("b", i, f"c{i}") for i in range(40)], "book_id string, idx int, url string")
    ask = spark.createDataFrame([("b", start, n)], "book_id string, start int, n int")
    wanted = store.backfill_range(chapters, ask)
    assert sorted(r.idx for r in wanted.collect()) == expect
    stored = spark.createDataFrame([("b", "c35")], "book_id string, chapter_url string")
    assert store.backfill_pending(wanted, stored).count() == len([i for i in expect if i != 35])


def test_title_match(spark):
    chapters = spark.createDataFrame([("b", 0, "Part 4: Low Tide"), ("b", 1, "Map"), ("b", 2, "Map")], "book_id string, idx int, title string")
    wanted = spark.createDataFrame([("b", "ＰＡＲＴ４·low_tide"), ("b", "map"), ("b", " —")], "book_id string, title string")
    got = {r.title: r.match_idx for r in shelf.match_titles(wanted, chapters).collect()}
    assert got == {"ＰＡＲＴ４·low_tide": 0, "map": -1, " —": -1}


# --- purification ----------------------------------------------------------------------------


def purified(spark, text, *rules):
    return purify.apply_rules(spark.createDataFrame([(text,)], "text string"), list(rules)).first()


def test_purify(spark):
    row = purified(spark, "<!> fog <!> sea", Rule("a.1", "<!>", "$1"), Rule("b", "$1 "))
    assert (row.clean, row["hits_a.1"], row.hits_b) == ("fog sea", 2, 2)
    row = purified(spark, "// note\nkeep // this\n// end", Rule("a", "^// .*(?:\\n|$)", mode="regex", multiline=True))
    assert (row.clean, row.hits_a) == ("keep // this\n", 2)
    row = purified(spark, "a\n", Rule("a", "^", "-", mode="regex", multiline=True), Rule("bad", "(?P<n>a)", mode="regex"))
    assert (row.clean, row.hits_a, row.hits_bad) == ("-a\n-", 2, 0)
    row = purified(spark, "axb", Rule("z", "x*", "-", mode="regex"))
    assert (row.clean, row.hits_z) == ("-a--b-", 4)
    row = purified(spark, "a\r\nB.b", Rule("i", "b.", "", ignore_case=True))
    assert (row.clean, row.hits_i) == ("a\nb", 1)


def test_purify_guard(spark):
    row = purified(spark, "e" * 2000, Rule("g", "e", "x" * 501), Rule("h", "x"))
    assert (row.status, row.clean, row.hits_g) == ("too_large", "", 2000)
    assert purified(spark, "e" * 2000, Rule("g", "e", "x" * 500)).status == "ok"


def test_rule_checks(spark):
    schema = "ord int, id string, name string, enabled boolean, mode string, find string, replacement string, ignore_case boolean, multiline boolean, dot_all boolean"
    rows = [(0, "a", "", True, "regex", "(", "", False, False, False), (1, "b", "", True, "text", "", "", False, False, False), (2, "a", "", True, "text", "x", "", False, False, False)]
    df = spark.createDataFrame(rows, schema)
    assert [r.error for r in purify.validate(df).orderBy("ord").collect()] == ["bad_regex", "find_empty", None]
    assert [(r.id, r.mode) for r in purify.load_rules(df).collect()] == [("a", "regex")]


# --- segmentation ----------------------------------------------------------------------------


def sections(spark, text, mode="auto"):
    df = segment.segment(spark.createDataFrame([(text,)], "text string"), mode=mode)
    rows = segment.section_rows(df, []).orderBy("idx").collect()
    return (rows[0].split_method if rows else None), [(r.title, r.section_text) for r in rows]


def test_headed_text(spark):
    text = "A note first\r\nChapter 1 Harbour\r\nShips.\r\n第2章：灯塔\r\n光。\r\n第三节 雾\r\nFog."
    method, parts = sections(spark, text)
    assert (method, [t for t, _ in parts]) == ("headings", ["前言", "Chapter 1 Harbour", "第2章：灯塔", "第三节 雾"])
    assert "".join(p for _, p in parts) == text.replace("\r\n", "\n")


@pytest.mark.parametrize("text", ["第七节里提到的海。" * 1100, "序章之前先看一眼，再往下走。\n" * 400, "🌊" * 9500 + "w" * 8700])
def test_prose_is_split_by_length(spark, text):
    method, parts = sections(spark, text)
    assert method == "length"
    assert "".join(p for _, p in parts) == text


def test_leading_contents(spark):
    titles = ["第一章 正文", "第二章 再见", "第三章 远行", "第四章 归来", "第五章 尾"]
    text = "\n".join(titles) + "\n" + "".join(f"{t}\n{'文' * 900}\n" for t in titles)
    method, parts = sections(spark, text)
    assert method == "headings" and "第一章 正文" in [t for t, _ in parts]
    assert "".join(p for _, p in parts) == text


def test_volumes_only_without_chapters(spark):
    assert [t for t, _ in sections(spark, "第一卷 起\na\n第二卷 落\nb")[1]] == ["第一卷 起", "第二卷 落"]
    assert [t for t, _ in sections(spark, "第一卷 起\n第1章 一\na\n第二卷 落\n第2章 二\nb")[1]] == ["前言", "第1章 一", "第2章 二"]


def test_json_paths_to_any_depth(spark):
    from pagemill.functions.jsonx import Deep, Each, Index, Key

    doc = '{"b":[{"z":1,"a":{"b":[5,6]}},{"a":null}],"a":{"x":{"b":[7]},"b":"s"},"n":[[{"b":[8,9]}]]}'
    cases = {
        (Deep("b"),): ['[{"z":1,"a":{"b":[5,6]}},{"a":null}]', "[5,6]", "[7]", '"s"', "[8,9]"],
        (Key("a"), Deep("b"), Index(0)): ["7"],
        (Deep("b"), Index(-1)): ['{"a":null}', "6", "7", "9"],
        (Deep("a"), Each()): ["[5,6]", '{"b":[7]}', '"s"'],
        (Key("n"), Each(), Deep("b"), Each()): ["8", "9"],
        (Deep("a"), Deep("b")): ["[5,6]", "[7]", '"s"'],
        (Deep("a"), Key("q")): [],
    }
    for steps, want in cases.items():
        assert one(spark, jsonx.find(F.lit(doc), *steps)) == want
    assert one(spark, jsonx.find(F.lit("{no json"), Deep("b"))) == [] and one(spark, jsonx.find(F.lit(None).cast("string"), Deep("b"))) == []
    assert one(spark, jsonx.find_value(jsonx.find(F.lit(doc), Key("a"), Deep("b")))) == '[[7],"s"]'
    assert one(spark, jsonx.find_value(jsonx.find(F.lit(doc), Key("b"), Deep("z")))) == "1"
    assert one(spark, F.size(jsonx.find_items(jsonx.find(F.lit(doc), Key("n"), Deep("b"))))) == 2
    deep = '{"a":' * 300 + "1" + "}" * 300
    assert len(one(spark, jsonx.find(F.lit(deep), Deep("a")))) == 300


def test_many_literal_rules(spark):
    """Ten thousand rules in order, the same as one projection each; a rule may bring hits of later ones and of no earlier."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    few = [purify.Rule(f"r{i}", word(), word() if i % 3 else "") for i in range(40)] + [purify.Rule("off", "a", enabled=False), purify.Rule("twice", "ab"), purify.Rule("again", "ab", "x")]
    texts = [(i, "".join(rng.choice("abc \r\n") for _ in range(60))) for i in range(30)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(texts, "i long, text string")
    want = {r.i: r.clean for r in purify.apply_rules(df, few).select("i", "clean").collect()}
    out = purify.apply_literals(df, few)
    assert {r.i: r.clean for r in out.collect()} == want
    counted = purify.apply_rules(df, few)
    hits = {r["i"]: {x.id: r[x.hits] for x in few if x.enabled and r[x.hits]} for r in counted.collect()}
    assert {r.i: {h.rule_id: h.hits for h in r.hits} for r in out.collect()} == hits
    many = [purify.Rule(f"m{i}", f"phrase number {i};", f"<{i}>") for i in range(10_000)]
    df = spark.createDataFrame([(i, f"x phrase number {i}; phrase number {i + 1}; y") for i in range(0, 9_000, 30)], "i long, text string")
    got = purify.apply_literals(df, many).collect()
    assert all(r.clean == f"x <{r.i}> <{r.i + 1}> y" and len(r.hits) == 2 for r in got)
    growing = [purify.Rule("g", "e", "-" * 600)]
    assert purify.apply_literals(spark.createDataFrame([("e" * 2000,)], "text string"), growing).first().status == "too_large"
    assert purify.apply_literals(df, []).first().clean.startswith("x phrase")


def test_page_arithmetic():
    from pagemill.operators.requests import page_value

    cases = {"(page-1)*20": "40", "page/2": "1.5", " page*10 + 5 ": "35", "-page": "-3", "10%page": "1", "page/(page-3)": "Infinity", "0/(page-3)": "NaN"}
    assert {e: page_value(e, 3) for e in cases} == cases
    for bad in ("page**2", "page//2", "page-", "pagepage", "page(1)", "page.a", "", "page page", "page--1+a"):
        assert page_value(bad, 3) is None


def test_charset_labels(spark):
    """Labels keep their own name, whatever family they belong to; labels of decoders that do not exist are unknown."""
    kept = [
        "utf-16", "windows-1253", "x-cp1251", "iso-8859-7", "iso_8859-2:1987", "iso88595", "latin1", "us-ascii", "koi8-u",
        "koi8-ru", "x-sjis", "windows-31j", "ks_c_5601-1987", "tis-620", "x-gbk", "x-mac-cyrillic", "ibm866", "big5-hkscs",
        "iso-8859-8-i", "l9", "iso-8859-16", "windows-874",
    ]
    changed = {"GB2312": "gb18030", " 'GBK' ": "gb18030", "UTF8": "utf-8", '"Shift_JIS"': "shift_jis"}
    unknown = ["", "nonsense", "iso-8859-12", "hz-gb-2312", "iso-2022-kr", "windows-1259", "xutf-8", "utf-8x", "iso_8859-16", None]
    want = {k: k for k in kept} | changed | dict.fromkeys(unknown)
    df = spark.createDataFrame([(k,) for k in want], "label string")
    assert {r.label: r.name for r in df.select("label", by.normalize_charset(F.col("label")).alias("name")).collect()} == want
    assert all(re.fullmatch(known, label) for label, known in (("koi8-u", by.LABELS["koi8_u"]), ("cyrillic", by.LABELS["iso8859_5"])))


def test_texts_in_labelled_charsets(spark):
    """Every family decodes what its codec wrote, under labels that Python has no name for as well."""
    cases = [
        ("x-cp1251", "Глава", "cp1251"), ("windows-874", "บทที่", "cp874"), ("x-sjis", "第一章", "cp932"),
        ("x-mac-cyrillic", "Глава", "mac_cyrillic"), ("koi8-ru", "Глава", "koi8_u"), ("x-gbk", "第一章", "gbk"),
        ("x-x-big5", "第一章", "big5"), ("csiso88596i", "فصل", "iso8859_6"), ("iso-8859-8-i", "פרק", "iso8859_8"),
    ]
    for label, text, codec in cases:
        files = spark.createDataFrame([(text.encode(codec),)], "content binary")
        (row,) = by.decode_texts(files, requested=label).collect()
        assert (row.text, row.reason) == (text, None), label
    for codec in by.LABELS:
        assert codecs.lookup(codec)


def test_json_text_is_parsed_once_for_all_paths(spark):
    from pagemill.functions.jsonx import Deep, Each, Key, find, find_each
    from pagemill.session import spread_rows

    docs = ['{"b":[{"b":null},{"c":"ü"},1.5,true],"c":{"b":12}}', "{no json", None, "[[1],{}]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, doc string")
    paths = {"deep": (Deep("b"),), "a.`b": (Key("b"), Each()), "none": (Deep("x"), Key("y"))}
    once = df.select("id", find_each(F.col("doc"), paths).alias("found")).select("id", "found.*")
    apart = df.select("id", *(find("doc", *p).alias(n) for n, p in paths.items()))
    assert once.columns == ["id", *paths] and sorted(once.collect()) == sorted(apart.collect())
    assert once.where("id = 0").first()[1] == ['[{"b":null},{"c":"ü"},1.5,true]', "null", "12"]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pythonUDF0") and "pythonUDF1" not in plan
    # A task gets no more than so many rows, however few parts a file has.
    assert spread_rows(spark.range(1000).coalesce(1), 100).rdd.getNumPartitions() == 10
    assert spread_rows(spark.range(1000).coalesce(1), 1000).rdd.getNumPartitions() == 1


def test_plain_rules_cut_a_text_once(spark):
    rules = [
        Rule("a", "e", "-" * 7), Rule("b", "a.", "$1\\"), Rule("c", "\\E", ""), Rule("d", "😀", "xy"), Rule("e", "-x", "-x"),
    ]
    docs = ["eaea.a.e", "a\\Eb\\E", "😀e😀", "", None, "none", "e" * 200_000, ".", "aXa.-x\r\n-x"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, text string")
    out = purify.apply_rules(df, rules)
    for row in out.collect():
        x, counts, big = row["text"], [], False
        limit = max(1_000_000, 4 * len(x or ""))
        x = x and x.replace("\r\n", "\n")
        for r in rules:
            counts.append(None if x is None else x.count(r.find))
            x = x and x.replace(r.find, r.replacement)
            big = big or (r.can_grow and len(x or "") > limit)
        assert row["clean"] == x and [row[r.hits] for r in rules] == counts
        assert row["status"] == ("too_large" if big else "ok")
    assert out.where("status = 'too_large'").count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(clean" not in plan and plan.count("split(") == len(rules)


def test_titles_are_normalised_a_few_at_a_time():
    import tracemalloc
    import unicodedata

    import pyarrow as pa

    titles = ["ｆｕｌｌ　ｗｉｄｔｈ", None, "", "plain", "ﬁ①" + "章" * 1000] * 2000
    column = pa.array(titles, pa.string())
    tracemalloc.start()
    found = shelf.normalized(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000  # all titles at once take over 8 MB
    assert found.to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in titles]
    assert shelf.normalized(column.slice(0, 0)).to_pylist() == []
