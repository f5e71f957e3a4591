"""Segmentation of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, normalize_newlines
from ..operators import segment as sg
from . import sqltext as q
from .views import tables


def _headed_sql(spark_sql: bool) -> str:
    """Documents with chapter headings put between their lines, in eight manners by ``doc_id``."""

    def with_heads(heading: str) -> str:
        line = f"case when {{i}} % (doc_id % 7 + 2) = 0 then concat({heading}, nl, l) else l end"
        if spark_sql:
            return f"array_join(transform(split(text, nl), (l, i) -> {line.format(i='i')}), nl)".replace("{n}", "(i + 1)")
        return (
            f"array_to_string(list_transform(string_split(text, nl), lambda l, i: {line.format(i='(i - 1)')}), nl)"
        ).replace("{n}", "i")

    heading = lambda a, b: f"concat('{a}', {{{{n}}}}, '{b}')"
    chapters = with_heads(heading("第", "章 head"))
    contents = "concat('第1章 a', nl, '第2章 b', nl, '第3章 c', nl, '第4章 d', nl, '第5章 e', nl)"
    sql = f"""select doc_id, case doc_id % 8
 when 0 then concat(text, nl, text, nl, text, nl, text, nl, text, nl, text)
 when 1 then {with_heads(heading('  Chapter ', ': Name of it '))}
 when 2 then {with_heads(heading('第', '卷　Part'))}
 when 3 then concat({contents}, {chapters})
 when 4 then concat(text, nl, '第1章 late', nl, lang)
 when 5 then concat(text, nl, '序章', nl, text, nl, '番外 end', nl, text, nl, '第三章里说过这样的话。', nl, text)
 when 6 then concat('正文 第一章 long', nl, text, nl, text, nl, text, nl, text, nl, text, nl, '第二回：more', nl, text)
 else concat(bom, replace({chapters}, nl, crlf)) end as text from docs"""
    for name, code in (("nl", [10]), ("crlf", [13, 10]), ("bom", [65279])):
        chars = [f"decode(unhex('EFBBBF'), 'UTF-8')" if spark_sql and c == 65279 else f"chr({c})" for c in code]
        sql = _word(sql, name, chars[0] if len(chars) == 1 else f"concat({', '.join(chars)})")
    return sql


def _word(sql: str, name: str, by: str) -> str:
    import re

    return re.sub(rf"\b{name}\b", lambda _: by, sql)


def headed(spark, sf) -> DataFrame:
    sql = _headed_sql(True).replace("from docs", "from {documents}")
    return spark.sql(sql, **tables(spark, sf, "documents"))


def _normalized(spark, sf):
    return headed(spark, sf).select("doc_id", normalize_newlines(F.col("text")).alias("text"))


def seg_normalize(spark, sf):
    return _normalized(spark, sf)


def seg_lines(spark, sf):
    rows = sg.line_table(_normalized(spark, sf), ["doc_id"])
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", *_offsets())


def _offsets(prefix: str = ""):
    return [F.col(f"{prefix}start").cast("bigint").alias("start"), F.col(f"{prefix}end").cast("bigint").alias("end")]


def seg_heading_match(spark, sf):
    df = _normalized(spark, sf).select("doc_id", F.explode(sg.points(F.col("text"))).alias("p"))
    return df.select("doc_id", F.col("p.start").cast("bigint").alias("start"), F.col("p.title").alias("title"))


def seg_toc_suppress(spark, sf):
    df = _normalized(spark, sf).select("doc_id", sg.outline(F.col("text")).alias("o"))
    return df.select(
        "doc_id", F.size("o.points").cast("bigint").alias("n_points"), F.size("o.kept").cast("bigint").alias("n_kept")
    )


def seg_single_guard(spark, sf):
    df = _normalized(spark, sf).withColumn("o", sg.outline(F.col("text")))
    return df.select("doc_id", sg.unreliable(F.col("o.kept"), F.length("text")).alias("by_length"))


def _rows(spark, sf):
    rows = sg.section_rows(sg.segment(headed(spark, sf)), ["doc_id"])
    return rows.select(
        "doc_id",
        "split_method",
        F.col("idx").cast("bigint").alias("idx"),
        "title",
        *_offsets(),
        F.sha2("section_text", 256).alias("text_hash"),
    )


def seg_sections(spark, sf):
    return _rows(spark, sf)


def seg_split_long(spark, sf):
    """The numbered chunks of sections that were too long."""
    return _rows(spark, sf).where(F.col("title").endswith("）")).drop("text_hash")


def seg_length_split(spark, sf):
    rows = sg.section_rows(sg.segment(headed(spark, sf), mode="length"), ["doc_id"], with_text=False)
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "title", *_offsets())


def seg_cut(spark, sf):
    """Where a text without line ends is cut."""
    flat = tables(spark, sf, "documents")["documents"].select(
        "doc_id",
        F.translate(F.concat("text", "text"), "\n", " ").alias("text"),
    )
    flat = flat.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.translate("text", ".", "")).otherwise(F.col("text")))
    ends = flat.select("doc_id", F.explode(sg.cuts(F.col("text"))).alias("end"))
    return ends.withColumn("end", F.col("end").cast("bigint"))


def seg_manifest(spark, sf):
    return sg.manifest(sg.segment(headed(spark, sf)), ["doc_id"]).select(
        "doc_id",
        "content_hash",
        "split_method",
        F.col("n_sections").cast("bigint").alias("n_sections"),
        "latest_chapter",
        "last_chapter_id",
        F.col("unread_count").cast("bigint").alias("unread_count"),
    )


def seg_dedupe_hash(spark, sf):
    docs = tables(spark, sf, "documents")["documents"]
    shelf = docs.where(F.col("source") == "src1").select(F.sha2("text", 256).alias("content_hash")).distinct()
    return sg.dedupe_by_hash(docs, "doc_id", imported=shelf)


def seg_import_manifest(spark, sf):
    """What an import keeps of each text beside its sections."""
    kept = sg.manifest(sg.segment(headed(spark, sf)), ["doc_id"], encoding=F.when(F.col("doc_id") % 2 == 0, "utf-8").otherwise("gb18030"))
    ids = F.array_join(F.transform("chapters", lambda c: F.concat(c["id"], F.lit(" "), c["title"])), "|")
    return kept.select("doc_id", "encoding", F.array_join("warnings", "|").alias("warnings"), ids.alias("chapters"))


def seg_import_plan(spark, sf):
    """Texts of one source are books already; every third of these has lost its chapters, every fifth its first one."""
    docs = tables(spark, sf, "documents")["documents"]
    own = docs.where(F.col("source") == "src1")
    books = own.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    chapters = own.where("doc_id % 3 <> 0").select(
        F.col("doc_id").alias("book_id"), F.lit(0).alias("idx"), F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("content")
    )
    return sg.import_plan(docs, "doc_id", books, chapters)


QUERIES = {
    "seg_import_manifest": seg_import_manifest,
    "seg_import_plan": seg_import_plan,
    "seg_normalize": seg_normalize,
    "seg_lines": seg_lines,
    "seg_heading_match": seg_heading_match,
    "seg_toc_suppress": seg_toc_suppress,
    "seg_single_guard": seg_single_guard,
    "seg_sections": seg_sections,
    "seg_split_long": seg_split_long,
    "seg_length_split": seg_length_split,
    "seg_cut": seg_cut,
    "seg_manifest": seg_manifest,
    "seg_dedupe_hash": seg_dedupe_hash,
}


def _re2(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{WS}]")


_MAIN = f"{_re2(sg.CHAPTER)}|{_re2(sg.ENGLISH)}"
_HEADED = _headed_sql(False).replace("from docs", "from documents")
_BASE = f"""t as materialized (select doc_id, regexp_replace(regexp_replace(text, '\\A\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g') as text from ({_HEADED})),
raw as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
 len(string_split(text, chr(10))) as n_lines from t),
lines as materialized (select *, cast(sum(n) over (partition by doc_id order by line_no) as bigint) as e from (
 select doc_id, line, line_no, length(line) + case when line_no < n_lines - 1 then 1 else 0 end as n, {q.trim('line')} as v from raw))"""
_POINTS = f"""{_BASE},
flags as (select doc_id, bool_or(regexp_full_match(v, '{_MAIN}')) as has_main from lines group by doc_id),
pts as (select l.doc_id, e - n as s, e, v as title from lines l join flags f on l.doc_id = f.doc_id
 where length(v) between 1 and {sg.TITLE_LIMIT} and (regexp_full_match(v, '{_MAIN}|{_re2(sg.SPECIAL)}') or (not has_main and regexp_full_match(v, '{_re2(sg.VOLUME)}')))),
pn as (select pts.*, text, length(text) as len, row_number() over w - 1 as i, lead(s) over w as nxt, count(*) over (partition by pts.doc_id) as k
 from pts join t on t.doc_id = pts.doc_id window w as (partition by pts.doc_id order by s)),
run as (select doc_id, any_value(k) as k, coalesce(min(i) filter (where nxt is null or s > least(5000, len * 0.2)
 or length({q.trim('substr(text, e + 1, nxt - e)')}) > 40), 0) as r from pn group by doc_id),
kept as materialized (select pn.*, case when r >= 4 then r else 0 end as dropped from pn join run on pn.doc_id = run.doc_id
 where r < 4 or i >= r)"""
_KEPT_N = "(select doc_id, count(*) as n, min(s) as s0 from kept group by doc_id)"
_MODE = f"""{_POINTS},
mode as materialized (select t.doc_id, text, length(text) as len, coalesce(n, 0) = 0 or (n = 1 and s0 > least(2000, length(text) * 0.25)) as by_length, n, s0
 from t left join {_KEPT_N} k on t.doc_id = k.doc_id where {q.trim('text')} <> '')"""
_SENT = "length(regexp_extract({x}, '^[^。！？.!?]*[。！？.!?]'))"


def _next(w: str) -> str:
    ahead = f"instr(substr({w}, 6000), chr(10))"
    back = f"instr(reverse(substr({w}, 4000, 2000)), chr(10))"
    s1 = _SENT.format(x=f"substr({w}, 6000, 2001)")
    s2 = _SENT.format(x=f"reverse(substr({w}, 4000, 2001))")
    return f"""case when {ahead} > 0 and ({back} = 0 or {ahead} - 1 <= {back}) then 5999 + {ahead} when {back} > 0 then 6000 - {back}
 when {s1} > 0 then 5999 + {s1} when {s2} > 0 then 6001 - {s2} else 6000 end"""


def _cutting(source: str) -> str:
    """Recursive cuts of ``source`` (doc_id, sec, body)."""
    return f"""cut as (select doc_id, sec, body, 0 as k, cast(0 as bigint) as a, cast(0 as bigint) as z from {source} union all
 select doc_id, sec, body, k + 1, z, case when length(body) - z <= 8000 then length(body) else z + {_next('substr(body, z + 1, 8000)')} end
 from cut where z < length(body)), chunks as (select doc_id, sec, k, a, z from cut where k > 0)"""


_SECTIONS = f"""with recursive {_MODE},
sec as materialized (select m.doc_id, k.s, coalesce(lead(k.s) over (partition by m.doc_id order by k.s), m.len) as z, title, m.text
 from mode m join kept k on m.doc_id = k.doc_id where not by_length
 union all select doc_id, 0, s0, '前言', text from (select m.doc_id, s0, m.text from mode m where not by_length and s0 > 0
 and {q.trim('substr(m.text, 1, s0)')} <> '')),
todo as (select doc_id, s as sec, substr(text, s + 1, z - s) as body from sec where z - s > 20000
 union all select doc_id, -1, text from mode where by_length),
{_cutting('todo')},
rows as (select doc_id, 'headings' as split_method, title, s as st, z as en from sec where z - s <= 20000
 union all select c.doc_id, 'headings', concat(title, '（', k, '）'), s + a, s + c.z from chunks c join sec on c.doc_id = sec.doc_id and c.sec = sec.s where c.sec >= 0
 union all select c.doc_id, 'length', case when len <= 20000 then '正文' else concat('第 ', k, ' 节') end, a, z
 from chunks c join mode m on c.doc_id = m.doc_id where c.sec = -1),
done as (select r.*, row_number() over (partition by r.doc_id order by st) - 1 as idx, sha256(substr(text, st + 1, en - st)) as text_hash
 from rows r join t on r.doc_id = t.doc_id)"""

ORACLES = {
    "seg_normalize": f"with {_BASE} select doc_id, text from t",
    "seg_lines": f'with {_BASE} select doc_id, line_no, line, cast(e - n as bigint) as start, cast(e as bigint) as "end" from lines',
    "seg_heading_match": f"with {_POINTS} select doc_id, cast(s as bigint) as start, title from pts",
    "seg_toc_suppress": f"""with {_POINTS} select t.doc_id, coalesce(any_value(run.k), 0) as n_points, count(kept.s) as n_kept
from t left join run on t.doc_id = run.doc_id left join kept on kept.doc_id = t.doc_id group by t.doc_id""",
    "seg_single_guard": f"with {_MODE} select doc_id, by_length from mode",
    "seg_sections": f'{_SECTIONS} select doc_id, split_method, idx, title, cast(st as bigint) as start, cast(en as bigint) as "end", text_hash from done',
    "seg_split_long": f"""{_SECTIONS} select doc_id, split_method, idx, title, cast(st as bigint) as start, cast(en as bigint) as "end"
from done where title like '%）'""",
    "seg_length_split": f"""with recursive {_BASE}, whole as (select doc_id, 0 as sec, text as body from t where {q.trim('text')} <> ''), {_cutting('whole')}
select c.doc_id, cast(k - 1 as bigint) as idx, case when length(text) <= 20000 then '正文' else concat('第 ', k, ' 节') end as title,
 a as start, z as "end" from chunks c join t on c.doc_id = t.doc_id""",
    "seg_cut": f"""with recursive flat as (select doc_id, 0 as sec, case when doc_id % 3 = 0 then replace(x, '.', '') else x end as body
 from (select doc_id, replace(concat(text, text), chr(10), ' ') as x from documents)), {_cutting('flat')} select doc_id, z as "end" from chunks""",
    "seg_manifest": f"""{_SECTIONS} select d.doc_id, sha256(any_value(t.text)) as content_hash, any_value(split_method) as split_method, count(*) as n_sections,
 arg_max(title, idx) as latest_chapter, lpad(cast(count(*) as varchar), 6, '0') as last_chapter_id, count(*) - 1 as unread_count
from done d join t on d.doc_id = t.doc_id group by d.doc_id""",
    "seg_dedupe_hash": """select sha256(text) as content_hash, min(doc_id) as doc_id, count(*) as n_copies from documents
where sha256(text) not in (select sha256(text) from documents where source = 'src1') group by 1""",
}
ORACLES["seg_import_manifest"] = f"""{_SECTIONS} select d.doc_id, case when d.doc_id % 2 = 0 then 'utf-8' else 'gb18030' end as encoding,
 case when any_value(split_method) = 'length' then '未识别到可靠章节标题，已按长度自动分段' else '' end as warnings,
 string_agg(concat(lpad(cast(idx + 1 as varchar), 6, '0'), ' ', title), '|' order by idx) as chapters from done d group by d.doc_id"""
ORACLES["seg_import_plan"] = """with h as (select doc_id, sha256(text) as content_hash, source from documents),
b as (select content_hash, min(doc_id) as book_id from h where source = 'src1' group by 1)
select h.content_hash, min(h.doc_id) as doc_id, count(*) as n_copies, any_value(book_id) as book_id,
 case when any_value(book_id) is null then 'import' when any_value(book_id) % 3 <> 0 and any_value(book_id) % 5 <> 0 then 'open' else 'replace' end as action
from h left join b on b.content_hash = h.content_hash group by 1"""
ORACLES["sink_sections"] = f"""{_SECTIONS} select sha256(cast(doc_id as varchar)) as book_id, lpad(cast(idx + 1 as varchar), 6, '0') as chapter_id,
 title, text_hash as content_hash from done"""
