"""Extraction from the page table, JSON columns and raw text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import combine, dom, jsonx, rx
from ..functions.dom import Step
from ..functions.text import js_trim
from ..functions.urls import resolve_url
from ..operators import extract as ex
from ..operators import structural
from ..session import new_table_path, spread_rows
from ..sources.shred import shred_pages
from . import sqltext as q
from .views import tables

def nodes():
    return F.col("nodes")


NAV_LINKS = (Step(tag="nav"), Step(tag="li"), Step(tag="a"))


def pages_of(spark, sf) -> DataFrame:
    return tables(spark, sf, "pages")["pages"]


def shredded(spark, sf, keep_html: bool = False) -> DataFrame:
    return shred_pages(pages_of(spark, sf), keep_html=keep_html)


def _long(pages: DataFrame, selections: dict, value) -> DataFrame:
    """Several selections of each page as rows (kind, ord, value); each page is visited once."""
    def rows(kind: str, sel):
        return F.transform(sel, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("ord"), value(nodes(), p).alias("value")))

    return pages.select("page_id", F.inline(F.concat(*[rows(k, sel) for k, sel in selections.items()])))


def resp_route(spark, sf):
    k = F.col("page_id") % 5
    js = F.to_json(F.struct("html"))
    body = (
        F.when(k == 1, F.concat(F.lit("　\n"), js))
        .when(k == 2, F.concat(F.lit("[1,"), js, F.lit("]")))
        .when(k == 3, F.concat(F.lit("{"), F.col("html")))
        .when(k == 4, F.concat(F.lit("cb("), js, F.lit(")")))
        .otherwise(F.col("html"))
    )
    return pages_of(spark, sf).select("page_id", ex.response_kind(body).alias("kind"))


def dom_nodes(spark, sf):
    rows = ex.node_rows(shredded(spark, sf), ["page_id"]).where(F.col("text").isNull())
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def dom_select(spark, sf):
    sel = {
        "chain": dom.select(nodes(), *NAV_LINKS),
        "group": dom.any_of(dom.select(nodes(), Step(tag="h1")), dom.select(nodes(), *NAV_LINKS), dom.select(nodes(), Step(tag="a"))),
        "class": dom.select(nodes(), Step(cls="ad")),
        "child": dom.select(nodes(), *(Step(tag="article") / Step(tag="p"))),
        "attr": dom.select(nodes(), Step(attr="href")),
        "none": dom.select(nodes(), Step(id="missing")),
        "contains": dom.select(nodes(), Step(tag="li", contains="e")),
    }
    return _long(shredded(spark, sf), sel, dom.text)


LI_LINK = Step(tag="li"), Step(tag="a", child=True)
# Selections by their form, and the same ones for arrays and for the node table.
FORMS = {
    "next": (Step(tag="nav"), Step(tag="li"), Step(tag="li", sibling="+"), Step(tag="a")),
    "later": (Step(tag="li"), Step(tag="li", sibling="~"), Step(tag="a")),
    "odd": (Step(tag="li", nth=(2, 1)), Step(tag="a")),
    "third": (Step(tag="li", nth=3), Step(tag="a", child=True)),
    "upto": (Step(tag="li", nth=(-1, 2)), Step(tag="a")),
    "starts": (Step(tag="nav"), Step(tag="a", attr="href", attr_op="^=", attr_value="/")),
    "ends": (Step(attr="href", attr_op="$=", attr_value="e"),),
    "anywhere": (*LI_LINK[:1], Step(tag="a", attr="href", attr_op="*=", attr_value="n")),
    "word": (Step(tag="div", attr="class", attr_op="~=", attr_value="ad"),),
    "classes": (Step(cls=("ad", "missing")),),
    "after_head": (Step(tag="article"), Step(tag="h1"), Step(tag="p", sibling="~")),
    "after_nav": (Step(tag="nav"), Step(sibling="~"), Step(tag="h1", child=True)),
    "nested": (Step(tag="*"), Step(tag="*"), Step(tag="a")),
    "children": (Step(tag="*"), Step(child=True, tag="*"), Step(tag="h1")),
}


def dom_select_forms(spark, sf):
    sel = {name: dom.select(nodes(), *steps) for name, steps in FORMS.items()}
    return _long(shredded(spark, sf), sel, dom.own_text)


def dom_select_rows(spark, sf):
    """The same selections on the node table, which is written once and read by each."""
    rows = ex.node_rows(shredded(spark, sf), ["page_id"])
    path = new_table_path(spark, "nodes")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    parts = []
    for name, steps in FORMS.items():
        found = structural.own_texts(rows, structural.select_rows(rows, ["page_id"], *steps), ["page_id"])
        parts.append(found.select("page_id", F.lit(name).alias("kind"), F.col("ord").cast("bigint").alias("ord"), js_trim("own").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def dom_position(spark, sf):
    links = dom.select(nodes(), *NAV_LINKS)
    sel = {
        "last": dom.at(links, -1),
        "second": dom.at(links, 1),
        "beyond": dom.at(links, 99),
        "stride": dom.span(links, 0, None, 2),
        "middle": dom.span(links, 1, -1, 1),
        "down": dom.span(links, 3, 0, -1),
        "without": dom.without(links, 0, -1),
        "reversed": dom.span(links, -1, 0),
        "lt": dom.first_n(links, 2),
        "gt": dom.after_n(links, -3),
        "list": dom.picks(links, 2, 0, 2),
    }
    return _long(shredded(spark, sf), sel, dom.text)


def dom_values(spark, sf):
    links = ex.item_rows(
        shredded(spark, sf, keep_html=True),
        ["page_id", "url", "html"],
        dom.select(nodes(), *NAV_LINKS),
        {
            "text": dom.text,
            "own": dom.own_text,
            "link": lambda n, p: dom.attr(n, p, "href", F.col("url")),
            "outer": lambda n, p: dom.outer_html(F.col("html"), n, p),
            "inner": lambda n, p: dom.inner_html(F.col("html"), n, p),
            "none": lambda n, p: dom.attr(n, p, "title"),
        },
    )
    paragraphs = ex.item_rows(
        shredded(spark, sf, keep_html=True),
        ["page_id", "url", "html"],
        dom.select(nodes(), Step(tag="p")),
        {
            "text": dom.text,
            "own": dom.own_text,
            "link": lambda n, p: F.lit(""),
            "outer": lambda n, p: F.lit("p"),
            "inner": lambda n, p: F.lit("p"),
            "none": lambda n, p: F.lit(""),
        },
    )
    return links.unionByName(paragraphs).select(
        "page_id", F.col("ord").cast("bigint").alias("ord"), "text", "own", "link", "outer", "inner", "none"
    )


def html_to_text(spark, sf):
    article = dom.first(dom.select(nodes(), Step(tag="article")))
    return shredded(spark, sf).select(
        "page_id",
        dom.html_to_text(nodes(), article).alias("article_text"),
        dom.html_to_text(nodes(), F.lit(dom.DOCUMENT)).alias("page_text"),
    )


EVENT_JSON = """concat('{{"data":{{"list":[{{"id":', event_id, ',"name":"', event_type, '"}},{{"id":', event_id + 1, '}},{{"id":null}}],"props":', props, ',"user name":"', user_id, '"}},"k":{{"k":[', user_id, ',{{"k":"deep"}}]}}}}')"""


def event_docs(spark, sf) -> DataFrame:
    sql = "select event_id, " + EVENT_JSON + " as doc from {events}"
    return spark.sql(sql, events=spread_rows(tables(spark, sf, "events")["events"]))


def json_items(spark, sf):
    K, I, E = jsonx.Key, jsonx.Index, jsonx.Each
    v = F.col("v")
    # What belongs to the whole response is worked out once, before its items are unfolded.
    whole = {
        "from_end": jsonx.value(v, K("data"), K("list"), I(-2), K("id")),
        "all_ids": jsonx.value(v, K("data"), K("list"), E(), K("id")),
        "prop": jsonx.value(v, K("data"), K("props"), E()),
        "quoted": jsonx.value(v, K("data"), K("user name")),
        "link": F.concat(
            F.lit("/api?k="), jsonx.value(v, K("data"), K("props"), K("k")), F.lit("&x="), jsonx.value(v, K("nope"))
        ),
    }
    df = event_docs(spark, sf).withColumn("v", F.try_parse_json("doc")).withColumns(whole)
    fields = {"id": lambda v, x: jsonx.value(x, K("id")), "name": lambda v, x: jsonx.value(x, K("name"))}
    rows = ex.json_rows(df, ["event_id", *whole], jsonx.items(v, K("data"), K("list")), fields)
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


def extract_rows_json(spark, sf):
    """Six fields per item of a JSON response; two of them belong to the whole response."""
    K = jsonx.Key
    v = F.col("v")
    df = event_docs(spark, sf).withColumn("v", F.try_parse_json("doc"))
    df = df.withColumns(
        {"author": jsonx.value(v, K("data"), K("user name")), "kind": jsonx.value(v, K("data"), K("props"), K("k"))}
    )
    base = F.lit("https://api.example/search?q=x")
    fields = {
        "name": lambda v, x: jsonx.value(x, K("name")),
        "intro": lambda v, x: jsonx.value(x, K("nope")),
        "cover_url": lambda v, x: resolve_url(F.concat(jsonx.value(x, K("name")), F.lit(".jpg")), base),
        "book_url": lambda v, x: resolve_url(F.concat(F.lit("/b/"), jsonx.value(x, K("id"))), base),
    }
    rows = ex.json_rows(df, ["event_id", "author", "kind"], jsonx.items(v, K("data"), K("list")), fields)
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


def json_paths(spark, sf):
    """Steps to any depth inside longer paths, in scalar and in list form."""
    K, D, I, E = jsonx.Key, jsonx.Deep, jsonx.Index, jsonx.Each
    paths = {
        "ids": (K("data"), D("id")),
        "second": (D("list"), I(1), K("id")),
        "last": (D("list"), I(-1)),
        "first_k": (K("k"), D("k"), I(0)),
        "all_k": (D("k"),),
        "names": (D("list"), E(), D("name")),
        "nothing": (D("nope"), K("id")),
    }
    df = event_docs(spark, sf)
    # Each text is parsed once for all paths.
    df = df.select("event_id", jsonx.find_each(F.col("doc"), {"list": (D("list"),), **paths}).alias("found")).select("event_id", "found.*")
    values = {n: jsonx.find_value(F.col(n)) for n in paths}
    return df.select("event_id", *(v.alias(n) for n, v in values.items()), F.size(jsonx.find_items(F.col("list"))).cast("bigint").alias("n_items"))


def json_deep_find(spark, sf):
    df = event_docs(spark, sf).select("event_id", F.posexplode(jsonx.deep_find(F.col("doc"), "k")).alias("ord", "value"))
    return df.select("event_id", F.col("ord").cast("bigint").alias("ord"), "value")


LINK_PATTERN = '<a href="([^"]*)">([^<]*)</a>'


def regex_items(spark, sf):
    items = rx.regex_items(F.col("html"), LINK_PATTERN, 2, reverse=True)
    df = pages_of(spark, sf).select("page_id", F.posexplode(items).alias("ord", "item"))
    return df.select(
        "page_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.col("item.text").alias("text"),
        rx.capture(F.col("item"), 1).alias("href"),
        rx.capture(F.col("item"), 2).alias("label"),
        rx.capture(F.col("item"), 3).alias("missing"),
    )


def regex_rewrite(spark, sf):
    t = F.col("text")
    return tables(spark, sf, "documents")["documents"].select(
        "doc_id",
        rx.rewrite_all(t, "th([a-z])", "<$1>").alias("all_hits"),
        rx.rewrite_first(t, "(e)([a-z]+)", "[$2$1]").alias("first_hit"),
        rx.rewrite_all(t, "[aeiou]$", "#").alias("at_end"),
    )


def _texts(sel):
    return F.transform(sel, lambda p: dom.text(nodes(), p))


def field_fallback(spark, sf):
    bold = dom.first(dom.select(nodes(), Step(tag="article"), Step(tag="b")))
    none = dom.select(nodes(), Step(cls="missing"))
    titles = combine.first_value(
        dom.text(nodes(), dom.first(none)), dom.text(nodes(), bold), dom.text(nodes(), dom.first(dom.select(nodes(), Step(tag="h1"))))
    )
    lists = combine.first_list(_texts(none), _texts(dom.select(nodes(), *NAV_LINKS)))
    return shredded(spark, sf).select("page_id", titles.alias("title"), F.size(lists).cast("bigint").alias("n_items"))


def field_concat(spark, sf):
    parts = combine.join_segments(_texts(dom.select(nodes(), Step(tag="h1"))), _texts(dom.select(nodes(), *NAV_LINKS)))
    return shredded(spark, sf).select("page_id", parts.alias("joined"))


def field_interleave(spark, sf):
    merged = combine.interleave(_texts(dom.select(nodes(), *NAV_LINKS)), _texts(dom.select(nodes(), Step(tag="p"))))
    rows = shredded(spark, sf).select("page_id", F.posexplode(merged).alias("ord", "value"))
    return rows.withColumn("ord", F.col("ord").cast("bigint"))


def extract_rows(spark, sf):
    head = F.transform(dom.select(nodes(), Step(tag="h1")), lambda p: dom.text(nodes(), p))
    pages = shredded(spark, sf).withColumn("intro", F.get(head, F.lit(0)))
    rows = ex.item_rows(
        pages,
        ["page_id", "url", "intro"],
        dom.select(nodes(), Step(tag="nav"), Step(tag="li")),
        {
            "name": lambda n, p: dom.text(n, p),
            "author": lambda n, p: dom.text(n, dom.first(dom.select(n, Step(tag="a"), roots=F.array(p)))),
            "cover_url": lambda n, p: F.coalesce(dom.attr(n, dom.first(dom.select(n, Step(tag="img"), roots=F.array(p))), "src", F.col("url")), F.lit("")),
            "book_url": lambda n, p: dom.attr(n, dom.first(dom.select(n, Step(tag="a"), roots=F.array(p))), "href", F.col("url")),
            "kind": lambda n, p: F.get(n, p)["tag"],
        },
    )
    return rows.select("page_id", F.col("ord").cast("bigint").alias("ord"), "name", "author", "cover_url", "intro", "book_url", "kind")


def udf_field_hook(spark, sf):
    """The reader's own step between the selected value and the rewrite."""
    links = _texts(dom.select(nodes(), *NAV_LINKS))
    rows = shredded(spark, sf).select("page_id", F.posexplode(links).alias("ord", "v"))
    hook = ex.with_hook(F.col("v"), lambda c: F.concat(F.lit("["), js_trim(c), F.lit("]")), lambda c: rx.rewrite_all(c, "e(.)", "$1-"))
    return rows.select("page_id", F.col("ord").cast("bigint").alias("ord"), hook.alias("value"))


QUERIES = {
    "resp_route": resp_route,
    "dom_nodes": dom_nodes,
    "dom_select": dom_select,
    "dom_select_forms": dom_select_forms,
    "dom_select_rows": dom_select_rows,
    "dom_position": dom_position,
    "dom_values": dom_values,
    "html_to_text": html_to_text,
    "json_items": json_items,
    "json_paths": json_paths,
    "json_deep_find": json_deep_find,
    "extract_rows_json": extract_rows_json,
    "regex_items": regex_items,
    "regex_rewrite": regex_rewrite,
    "field_fallback": field_fallback,
    "field_concat": field_concat,
    "field_interleave": field_interleave,
    "extract_rows": extract_rows,
    "udf_field_hook": udf_field_hook,
}

# Each list as (page_id, ord from 1, raw fragment), and with the number of items.
_A = """(select page_id, url, i, x, count(*) over (partition by page_id) as n from (
 select page_id, url, unnest(l) as x, generate_subscripts(l, 1) as i from (
  select page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as l from pages)))"""
_P = """(select page_id, i - 1 as i, x from (
 select page_id, unnest(l) as x, generate_subscripts(l, 1) as i from (
  select page_id, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') as l from pages)) where i > 1)"""
_HREF = "regexp_extract(x, 'href=\"([^\"]*)\"', 1)"
_X = q.plain("x")


def _pick(kind: str, ord_sql: str, cond: str) -> str:
    return f"select page_id, '{kind}' as kind, {ord_sql} as ord, {_X} as value from {_A} where {cond}"


_AD = "regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"
_SOME = "select page_id, '{}' as kind, row_number() over (partition by page_id order by i) - 1 as ord, {} as value from {} where {}"
_OWN_P = q.plain("regexp_replace(x, '(?s)<b>.*', '')")
_FORMS = "\nunion all ".join(
    [
        *(_SOME.format(name, _X, _A, "i > 1") for name in ("next", "later")),
        _SOME.format("odd", _X, _A, "i % 2 = 1"),
        _SOME.format("third", _X, _A, "i = 3"),
        _SOME.format("upto", _X, _A, "i <= 2"),
        _SOME.format("starts", _X, _A, f"starts_with({_HREF}, '/')"),
        _SOME.format("ends", _X, _A, f"ends_with({_HREF}, 'e')"),
        _SOME.format("anywhere", _X, _A, f"contains({_HREF}, 'n')"),
        *(_SOME.format(name, _X, _A, "true") for name in ("nested",)),
        _SOME.format("after_head", _OWN_P, _P, "true"),
        f"select page_id, 'word', 0, {q.plain(_AD)} from pages where contains(html, '<div class=')",
        f"select page_id, 'after_nav', 0, {q.plain(q.H1)} from pages",
        f"select page_id, 'children', 0, {q.plain(q.H1)} from pages",
    ]
)

ORACLES = {
    "dom_select_forms": _FORMS,
    "dom_select_rows": _FORMS,
    "resp_route": "select page_id, case when page_id % 5 in (1, 2) then 'json' else 'html' end as kind from pages",
    "dom_nodes": """select page_id, tag, count(*) as n from (
 select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) as tag from pages) group by page_id, tag""",
    "dom_select": f"""{_pick('chain', 'i - 1', 'true')}
union all {_pick('group', 'i', 'true')}
union all select page_id, 'group', 0, {q.plain(q.H1)} from pages
union all select page_id, 'class', 0, {q.plain("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} from pages
union all select page_id, 'child', i - 1, {_X} from {_P}
union all {_pick('attr', 'i - 1', 'true')}
union all select page_id, 'contains', row_number() over (partition by page_id order by i) - 1, {_X} from {_A} where contains({q.unescape(q.no_tags('x'))}, 'e')""",
    "dom_position": "\nunion all ".join(
        [
            _pick("last", "0", "i = n"),
            _pick("second", "0", "i = 2"),
            _pick("stride", "(i - 1) // 2", "(i - 1) % 2 = 0"),
            _pick("middle", "i - 2", "i > 1 and i < n"),
            _pick("down", "4 - i", "i in (2, 3, 4) and n >= 4"),
            _pick("down", "n - i", "i > 1 and n < 4 and false"),
            _pick("without", "i - 2", "i > 1 and i < n"),
            _pick("reversed", "n - i", "true"),
            _pick("lt", "i - 1", "i <= 2"),
            _pick("gt", "i - 1 - greatest(n - 2, 0)", "i > n - 2"),
            _pick("list", "case when i = 3 then 0 when n < 3 then 0 else 1 end", "i in (1, 3)"),
        ]
    ),
    "dom_values": f"""select page_id, i - 1 as ord, {_X} as text, {_X} as own, {q.root_link(_HREF, 'url')} as link, x as outer,
 {q.trim("regexp_extract(x, '>([^<]*)<', 1)")} as inner, '' as none from {_A}
union all select page_id, i - 1, {_X}, case when x like '<b>%' then '' else {_X} end, '', 'p', 'p', '' from {_P}""",
    "html_to_text": f"""select page_id, {q.html_to_text(q.ARTICLE)} as article_text, {q.html_to_text('html')} as page_text from pages""",
    "json_items": f"""with d as (select event_id, cast({EVENT_JSON.format()} as json) as j from events)
select event_id, o as ord, coalesce(j->'data'->'list'->o->>'id', '') as id, coalesce(j->'data'->'list'->o->>'name', '') as name,
 cast(event_id + 1 as varchar) as from_end, concat('[', event_id, ',', event_id + 1, ',null]') as all_ids,
 j->'data'->'props'->>'k' as prop, j->'data'->>'user name' as quoted, concat('/api?k=', j->'data'->'props'->>'k', '&x=') as link
from d, (values (cast(0 as bigint)), (1), (2)) t(o)""",
    "extract_rows_json": f"""with d as (select event_id, event_type, cast({EVENT_JSON.format()} as json) as j from events)
select event_id, o as ord, j->'data'->>'user name' as author, j->'data'->'props'->>'k' as kind, case when o = 0 then event_type else '' end as name, '' as intro,
 concat('https://api.example/', case when o = 0 then event_type else '' end, '.jpg') as cover_url,
 concat('https://api.example/b/', case o when 0 then cast(event_id as varchar) when 1 then cast(event_id + 1 as varchar) else '' end) as book_url
from d, (values (cast(0 as bigint)), (1), (2)) t(o)""",
    "json_paths": """with d as (select event_id, event_id + 1 as n, event_type as t, user_id as u, cast(props as json)->>'k' as p,
 concat('[', user_id, ',{"k":"deep"}]') as inner_k from events)
select event_id, concat('[', event_id, ',', n, ',null]') as ids, cast(n as varchar) as second, '{"id":null}' as last, cast(u as varchar) as first_k,
 concat('[', p, ',{"k":', inner_k, '},', inner_k, ',"deep"]') as all_k, t as names, '' as nothing, cast(3 as bigint) as n_items from d""",
    "json_deep_find": f"""with d as (select event_id, json_extract(cast({EVENT_JSON.format()} as json), '$..k') as l from events)
select event_id, case i when 3 then 0 when 4 then 3 else i end as ord, value from (
 select event_id, generate_subscripts(l, 1) as i, cast(unnest(l) as varchar) as value from d)""",
    "regex_items": f"""select page_id, n - i as ord, x as text, {_HREF} as href, regexp_extract(x, '>([^<]*)<', 1) as label, '' as missing from {_A}""",
    "regex_rewrite": """select doc_id, regexp_replace(text, 'th([a-z])', '<\\1>', 'g') as all_hits,
 regexp_replace(text, '(e)([a-z]+)', '[\\2\\1]') as first_hit, regexp_replace(text, '[aeiou]\\z', '#') as at_end from documents""",
    "field_fallback": f"""with f as (select page_id, {_X} as t from {_P} where x like '<b>%' qualify row_number() over (partition by page_id order by i) = 1)
select p.page_id, case when coalesce(f.t, '') <> '' then f.t else {q.plain(q.H1)} end as title,
 cast(len(regexp_extract_all(html, '<a href=')) as bigint) as n_items from pages p left join f on p.page_id = f.page_id""",
    "field_concat": f"""select page_id, concat({q.plain(q.H1)}, chr(10), array_to_string(list_transform(
 regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), lambda x: {_X}), '')) as joined from pages""",
    "field_interleave": f"""select page_id, row_number() over (partition by page_id order by i, side) - 1 as ord, value from (
 select page_id, i, 0 as side, {_X} as value from {_A} union all select page_id, i, 1, {_X} from {_P})""",
    "extract_rows": f"""select a.page_id, i - 1 as ord, {_X} as name, {_X} as author, '' as cover_url, {q.plain(q.H1)} as intro,
 {q.root_link(_HREF, 'a.url')} as book_url, 'li' as kind from {_A} a join pages p on a.page_id = p.page_id""",
    "udf_field_hook": f"""select page_id, i - 1 as ord, regexp_replace(concat('[', {_X}, ']'), 'e(.)', '\\1-', 'g') as value from {_A}""",
}
