"""Catalog, byte scans, sinks and request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import resolve_url
from ..operators import segment as seg
from ..operators.extract import link_degrees, link_edges
from ..operators.requests import plan_requests
from ..operators.shelf import import_books
from ..session import new_table_path
from ..sources import bytes as by
from ..sources import catalog as cat
from ..sources.shred import shred_pages
from ..sources.sinks import export_shelf, read_sections, read_shelf, write_sections
from . import sqltext as q
from .views import sql_view, tables, view

# Catalog files of eight sources each: a JSON array, or JSON lines with blank and broken ones.
CATALOG_TEXTS = """
select f as file_no, case when f % 2 = 0 then concat('[', body_array, ']') else concat('{{broken', chr(10), chr(10), body_lines) end as text
from (select f, {join_array} as body_array, {join_lines} as body_lines from (
 select cast(floor(s_suppkey / 8) as int) as f, s_suppkey as k,
  concat('{{"bookSourceName":"', s_name, '","bookSourceUrl":"', case when s_suppkey % 9 = 4 then '' else concat('https://s', s_suppkey, '.example') end,
  '","bookSourceType":', s_suppkey % 2, ',"enabled":', case when s_suppkey % 3 = 0 then 'false' else 'true' end, ',"searchUrl":"/s?q={{{{key}}}}"}}') as row_json
 from {supplier}) group by f)"""


def catalog_texts(spark: SparkSession, sf: str) -> DataFrame:
    def join(sep: str) -> str:
        return f"array_join(transform(sort_array(collect_list(struct(k, row_json))), x -> x.row_json), {sep})"

    sql = CATALOG_TEXTS.replace("{join_array}", join("','")).replace("{join_lines}", join("chr(10)"))
    return spark.sql(sql, **tables(spark, sf, "supplier"))


def src_parse_catalog(spark, sf):
    out = cat.parse_catalog(catalog_texts(spark, sf))
    return out.select("file_no", "source_name", "source_url", "source_type", "enabled", "search_url")


def _import_tables(spark, sf):
    sources = view(spark, sf, "sources")
    known = sources.where("ord % 3 = 1")
    # Every source comes in twice, the second time under another name.
    again = sources.withColumn("source_name", F.concat("source_name", F.lit("-b"))).withColumn("ord", F.col("ord") + 1_000_000_000)
    return known, sources.unionByName(again)


def src_import_merge(spark, sf):
    known, incoming = _import_tables(spark, sf)
    return cat.import_merge(known, incoming).select("source_url", "source_name", "source_type", "enabled")


def src_import_counts(spark, sf):
    return cat.import_counts(*_import_tables(spark, sf))


def src_enabled(spark, sf):
    return cat.enabled_sources(view(spark, sf, "sources"), for_search=True).select("source_url", "source_name")


def src_lookup(spark, sf):
    return cat.lookup_source(view(spark, sf, "shelf"), view(spark, sf, "sources")).select(
        "id", "source_url", "found_name", "source_missing"
    )


def _texts_as_files(spark, sf) -> DataFrame:
    """Documents as landed files: some with a byte order mark, some in UTF-16, some too large or empty."""
    doc = tables(spark, sf, "documents")["documents"]
    k = F.col("doc_id") % 10
    body = (
        F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(k == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(k == 4, F.unhex(F.lit("")))
        .when(k == 5, F.concat(F.unhex(F.lit("81")), F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode("text", "UTF-8"))
    )
    return doc.select("doc_id", body.alias("content")).withColumn("length", F.length("content"))


def scan_binary_text(spark, sf):
    """Documents landed as text files: bytes accepted and refused by size."""
    docs = tables(spark, sf, "documents")["documents"]
    path = new_table_path(spark, "landed")
    docs.select(F.col("text").alias("value")).write.text(path)
    good, bad = by.accept_size(by.read_texts(spark, path))
    sizes = [
        df.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")).select(F.lit(kind).alias("kind"), "n_bytes")
        for kind, df in (("accepted", good), ("refused", bad))
    ]
    return sizes[0].unionByName(sizes[1])


def scan_decode_bytes(spark, sf):
    out = by.decode_texts(_texts_as_files(spark, sf))
    return out.select("doc_id", "encoding", F.sha2("text", 256).alias("text_hash"), "reason")


def scan_sniff_charset(spark, sf):
    pages = tables(spark, sf, "pages")["pages"]
    k = F.col("page_id") % 6
    header = F.when(k == 0, "text/html; charset=GBK").when(k == 1, "text/html; charset=nonsense").when(k == 2, "text/html")
    html = F.when(k == 3, F.replace(F.col("html"), F.lit('charset="utf-8"'), F.lit("charset='gb2312'"))).when(
        k == 4, F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.lit('<?xml encoding="Big5"?>'))
    ).when(k == 5, F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.lit(""))).otherwise(F.col("html"))
    return pages.select("page_id", by.sniff_charset(header, F.encode(html, "UTF-8")).alias("charset"))


def scan_text_sanity(spark, sf):
    docs = tables(spark, sf, "documents")["documents"]
    k = F.col("doc_id") % 5
    text = (
        F.when(k == 1, F.concat(F.lit("　\t \n"), F.lit(" ")))
        .when(k == 2, F.concat(F.repeat(F.lit("\x01"), 40), F.col("text")))
        .when(k == 3, F.concat(F.lit("\x0b\x02"), F.col("text")))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", by.sanity_reason(text).alias("reason"))


def sink_sections(spark, sf):
    from .segments import headed

    path = new_table_path(spark, "sections")
    write_sections(seg.section_rows(seg.segment(headed(spark, sf)), ["doc_id"]), path, "doc_id")
    return read_sections(spark, path).select("book_id", "chapter_id", "title", "content_hash")


def _incoming_books(spark, sf):
    return spark.sql(
        """select case when l_linenumber = 7 then '' else concat('im', l_orderkey, '-', l_linenumber) end as id,
 concat('https://s', l_suppkey, '.example') as source_url,
 concat('https://s', l_suppkey, '.example/book/', l_partkey) as book_url,
 l_orderkey * 10 + l_linenumber as ord from {lineitem}""",
        **tables(spark, sf, "lineitem"),
    )


def shelf_export_import(spark, sf):
    """Export the shelf, read it back, and import other books into it."""
    path = new_table_path(spark, "shelf")
    shelf = view(spark, sf, "shelf").select("id", "source_url", "book_url")
    export_shelf(shelf, path)
    return import_books(read_shelf(spark, path, shelf.schema), _incoming_books(spark, sf), "ord")


def plan_requests_query(spark, sf):
    sources = cat.enabled_sources(view(spark, sf, "sources"), for_search=True)
    template = F.concat(
        F.col("search_url"),
        F.when(F.col("ord") % 4 == 1, F.lit(",{'method':'post', body:'q={{key}}&start={{(page-1)*20}}', headers:{'X-A':'1'}}"))
        .when(F.col("ord") % 4 == 2, F.lit(',{"body":"n={{java.encodeURI(key)}}","charset":"gbk"}'))
        .when(F.col("ord") % 4 == 3, F.lit(",{broken{{other}}"))
        .otherwise(F.lit("")),
    )
    header = F.create_map(F.lit("User"), F.lit("a"), F.lit("X-A"), F.lit("0"))
    df = sources.select("source_url", template.alias("search_url"), header.alias("header"))
    out = plan_requests(df, ["测试 a", "x&y"], pages=3, page_forms={"(page-1)*20": lambda p: (p - 1) * 20})
    headers = F.array_join(
        F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
    )
    return out.drop("reason").withColumn("headers", headers)


def plan_page_expressions(spark, sf):
    """Page arithmetic of several kinds, without forms made by hand, and expressions that nothing fills."""
    forms = ["{{(page-1)*20}}", "{{page*5}}&h={{ page / 2 }}", "{{page>1?page:0}}", "{{page-1}}&x={{secret}}", "{{10%page}}{{page-}}"]
    template = F.concat(F.lit("/s?k={{key}}&p={{page}}&o="), F.element_at(F.array(*map(F.lit, forms)), (F.col("ord") % 5 + 1).cast("int")))
    df = view(spark, sf, "sources").select("source_url", template.alias("search_url"), F.lit(None).cast("map<string,string>").alias("header"))
    return plan_requests(df, ["k"], pages=3).select("source_url", "page", "url", "reason")


def link_edges_query(spark, sf):
    pages = shred_pages(tables(spark, sf, "pages")["pages"])
    return link_edges(pages).select("page_id", F.col("ord").cast("bigint").alias("ord"), "href", "target")


def link_degrees_query(spark, sf):
    return link_degrees(link_edges(shred_pages(tables(spark, sf, "pages")["pages"])))


RELATIVE = ["../up", "?q=1", "#top", "//cdn.example/x y", "/a/./b/../c", "mailto:x@y", "HTTP://Q/z", ""]


def link_resolve(spark, sf):
    pages = tables(spark, sf, "pages")["pages"].select("page_id", "url")
    rows = pages.withColumn("href", F.explode(F.array(*[F.lit(r) for r in RELATIVE])))
    return rows.select("page_id", "href", resolve_url(F.col("href"), F.col("url")).alias("target"))


QUERIES = {
    "src_parse_catalog": src_parse_catalog,
    "src_import_merge": src_import_merge,
    "src_import_counts": src_import_counts,
    "src_enabled": src_enabled,
    "src_lookup": src_lookup,
    "scan_binary_text": scan_binary_text,
    "scan_decode_bytes": scan_decode_bytes,
    "scan_sniff_charset": scan_sniff_charset,
    "scan_text_sanity": scan_text_sanity,
    "sink_sections": sink_sections,
    "shelf_export_import": shelf_export_import,
    "plan_requests": plan_requests_query,
    "plan_page_expressions": plan_page_expressions,
    "link_edges": link_edges_query,
    "link_degrees": link_degrees_query,
    "link_resolve": link_resolve,
}

_TEXTS_SQL = (
    CATALOG_TEXTS.replace("{join_array}", "string_agg(row_json, ',' order by k)")
    .replace("{join_lines}", "string_agg(row_json, chr(10) order by k)")
    .format(supplier="supplier")
)
_SOURCES = sql_view("sources")
_SHELF = sql_view("shelf")
_IMPORT = f"""with s as {_SOURCES}, known as (select * from s where ord % 3 = 1),
firsts as (select * from s where source_url not in (select source_url from known))"""
_EDGES = f"""(select page_id, i - 1 as ord, h as href, {q.root_link('h', 'url')} as target from (
 select page_id, url, unnest(l) as h, generate_subscripts(l, 1) as i from (
  select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) as l from pages)))"""
_ORIGIN = "regexp_extract(url, '^https?://[^/?#]+')"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_ENC = q.encode_component

ORACLES = {
    "src_parse_catalog": f"""with t as ({_TEXTS_SQL}), j as (
 select file_no, unnest(cast(json_extract(cast(text as json), '$[*]') as json[])) as x from t where file_no % 2 = 0
 union all
 select file_no, cast(l as json) from (select file_no, unnest(string_split(text, chr(10))) as l from t where file_no % 2 = 1)
 where json_valid(l))
select file_no, x->>'bookSourceName' as source_name, x->>'bookSourceUrl' as source_url,
 cast(x->>'bookSourceType' as int) as source_type, cast(x->>'enabled' as boolean) as enabled, x->>'searchUrl' as search_url
from j where x->>'bookSourceUrl' <> ''""",
    "src_import_merge": f"""{_IMPORT}
select source_url, source_name, source_type, enabled from known
union all select source_url, case when source_type <> 0 then concat(source_name, '{cat.UNSUPPORTED_SUFFIX}') else source_name end,
 source_type, case when source_type <> 0 then false else enabled end from firsts""",
    "src_import_counts": f"""{_IMPORT}
select count(*) as added, cast((select count(*) * 2 from s) - count(*) as bigint) as skipped,
 count(*) filter (where source_type <> 0) as unsupported from firsts""",
    "src_enabled": f"""select source_url, source_name from {_SOURCES}
where coalesce(enabled, true) and source_type = 0 and search_url <> ''""",
    "src_lookup": f"""select b.id, b.source_url, s.source_name as found_name, s.source_url is null as source_missing
from {_SHELF} b left join {_SOURCES} s on b.source_url = s.source_url""",
    "scan_binary_text": "select 'accepted' as kind, cast(sum(strlen(text) + 1) as bigint) as n_bytes from documents union all select 'refused', 0",
    "scan_decode_bytes": """select doc_id, case doc_id % 10 when 2 then 'utf-16le' when 3 then 'utf-16be' when 5 then 'gb18030' else 'utf-8' end as encoding,
 case when doc_id % 10 not in (4, 5) then sha256(text) end as text_hash,
 case doc_id % 10 when 4 then 'empty' when 5 then 'undecodable' end as reason from documents""",
    "scan_sniff_charset": """select page_id, case when page_id % 6 in (0, 3) then 'gb18030' when page_id % 6 = 4 then 'big5' else 'utf-8' end as charset
from pages""",
    "scan_text_sanity": f"""select doc_id, case when trim(t, '{q.WS_CHARS}') = '' then 'blank'
 when length(regexp_replace(t, '[^\\x{{01}}\\x{{02}}\\x{{0B}}\\x{{0C}}]', '', 'g')) > greatest(8.0, length(t) * 0.01) then 'control_chars' end as reason
from (select doc_id, case when doc_id % 5 = 1 then concat(chr(12288), chr(9), ' ', chr(10), chr(160))
 when doc_id % 5 = 2 then concat(repeat(chr(1), 40), text) when doc_id % 5 = 3 then concat(chr(11), chr(2), text) else text end as t
 from documents)""",
    "shelf_export_import": f"""with s as (select id, source_url, book_url from {_SHELF}),
inc as (select case when l_linenumber = 7 then '' else concat('im', l_orderkey, '-', l_linenumber) end as id,
 concat('https://s', l_suppkey, '.example') as source_url, concat('https://s', l_suppkey, '.example/book/', l_partkey) as book_url,
 l_orderkey * 10 + l_linenumber as ord from lineitem),
f as (select *, row_number() over (partition by source_url, book_url order by ord) as rn from inc where id <> '')
select * from s union all select id, source_url, book_url from f
where rn = 1 and not exists (select 1 from s where s.source_url = f.source_url and s.book_url = f.book_url)""",
    "plan_requests": f"""with s as (select source_url, ord % 4 as k from {_SOURCES}
 where coalesce(enabled, true) and source_type = 0 and search_url <> ''),
r as (select source_url, k, key, {_ENC('key')} as e, page from s, (values ('测试 a'), ('x&y')) t(key), (values (1), (2), (3)) p(page))
select source_url, key, page,
 concat(source_url, '/search?q=', e, '&p=', page, case when k = 2 then concat('&n=', e) else '' end) as url,
 case when k = 1 then 'POST' else 'GET' end as method,
 case when k = 1 then 'Content-Type=application/x-www-form-urlencoded;User=a;X-A=1' else 'User=a;X-A=0' end as headers,
 case when k = 1 then concat('q=', e, '&start=', (page - 1) * 20) end as body,
 case when k = 2 then 'gbk' end as charset from r""",
    "link_edges": f"select page_id, ord, href, target from {_EDGES}",
    "link_degrees": f"select page_id, count(*) as out_links, count(distinct target) as out_targets from {_EDGES} group by page_id",
    "link_resolve": f"""select page_id, href, case href
 when '../up' then concat({_ORIGIN}, case when len(string_split({_PATH}, '/')) > 3
  then concat('/', array_to_string(list_slice(string_split({_PATH}, '/'), 2, len(string_split({_PATH}, '/')) - 2), '/'), '/up') else '/up' end)
 when '?q=1' then concat({_ORIGIN}, case when {_PATH} = '' then '/' else {_PATH} end, '?q=1')
 when '#top' then concat(regexp_extract(url, '^[^#]*'), '#top')
 when '//cdn.example/x y' then concat(regexp_extract(url, '^https?:'), '//cdn.example/x%20y')
 when '/a/./b/../c' then concat({_ORIGIN}, '/a/c') else href end as target
from pages, (values {', '.join("('" + r + "')" for r in RELATIVE)}) v(href)""",
}
ORACLES["plan_page_expressions"] = f"""with s as (select source_url, ord % 5 as k, p from {sql_view('sources')}, range(1, 4) t(p))
select source_url, cast(p as int) as page, concat(source_url, '/s?k=k&p=', p, '&o=', case k when 0 then cast((p - 1) * 20 as varchar)
 when 1 then concat(p * 5, '&h=', case when p % 2 = 0 then cast(p // 2 as varchar) else concat(p // 2, '.5') end)
 when 2 then '' when 3 then concat(p - 1, '&x=') else cast(10 % p as varchar) end) as url,
 case k when 2 then 'unknown expression: page>1?page:0' when 3 then 'unknown expression: secret' when 4 then 'unknown expression: page-' end as reason from s"""
