"""Chapter store, backfill, shelf, progress and source switching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shelf as sh
from ..operators import store as st
from ..operators.toc import unread
from ..session import new_table_path
from .views import sql_view, tables, view


def store_keys(spark, sf):
    df = spark.sql(
        "select cast(conv_id as string) as book_id, 'https://c.example/é' as source_url, concat('/b/', conv_id) as book_url, text as chapter_url from {conversations}",
        **tables(spark, sf, "conversations"),
    )
    keys = st.key_columns()
    return df.select("book_id", *[c.alias(n) for n, c in keys.items()])


def _records(spark, sf, where: str):
    sql = f"""select user_id as book_id, 's' as source_url, concat('b', user_id) as book_url,
 concat('c', cast(floor(value) as int) % 30) as chapter_url, case when event_type = 'error' then ' ' else concat(' ', event_type, props) end as content,
 ts as saved_at, event_id as seq from {{events}} where {where}"""
    return spark.sql(sql, **tables(spark, sf, "events"))


def store_upsert(spark, sf):
    old = _records(spark, sf, "event_type = 'purchase'").withColumn("content", F.concat(F.lit("old"), "content"))
    out = st.upsert(old, _records(spark, sf, "event_type <> 'purchase'"), ["saved_at", "seq"])
    return out.select("book_id", "chapter_url", "content", "seq")


def store_merge_parts(spark, sf):
    """The same on a stored table, in two batches."""
    path = new_table_path(spark, "chapters")
    old = _records(spark, sf, "event_type = 'purchase'").withColumn("content", F.concat(F.lit("old"), "content"))
    st.write_parts(st.upsert(old, old.where("false"), ["saved_at", "seq"]), path)
    new = _records(spark, sf, "event_type <> 'purchase'")
    for rest in (0, 1):
        st.merge_parts(spark, path, new.where(F.col("book_id") % 2 == rest), ["saved_at", "seq"])
    return st.read_parts(spark, path).select("book_id", "chapter_url", "content", "seq")


def store_clear_parts(spark, sf):
    path = new_table_path(spark, "chapters")
    st.write_parts(view(spark, sf, "store"), path)
    gone = tables(spark, sf, "customer")["customer"].where("c_acctbal < 0").select(F.col("c_custkey").alias("book_id"))
    st.clear_parts(spark, path, gone)
    return st.read_parts(spark, path).select("book_id", "chapter_url")


def _wanted(spark, sf):
    return view(spark, sf, "toc").select(
        "book_id",
        F.col("url").alias("chapter_url"),
        F.lit("https://c.example").alias("source_url"),
        F.concat(F.lit("https://c.example/"), "book_id").alias("book_url"),
    )


def store_valid_read(spark, sf):
    hits, purge = st.checked_read(_wanted(spark, sf), view(spark, sf, "store"))
    return hits.select("chapter_url", "content", F.lit("hit").alias("state")).unionByName(
        purge.select("chapter_url", "content", F.lit("purge").alias("state"))
    )


def store_coverage(spark, sf):
    return st.coverage(view(spark, sf, "toc"), view(spark, sf, "store"))


def store_clear_book(spark, sf):
    gone = tables(spark, sf, "customer")["customer"].where("c_acctbal < 0").select(F.col("c_custkey").alias("book_id"))
    return st.clear_books(view(spark, sf, "store"), gone).select("book_id", "chapter_url")


def _asked(spark, sf):
    sql = "select conv_id as book_id, cast(max(conv_id % 9) as int) as start, cast(max(conv_id % 5) as int) as n from {conversations} group by conv_id"
    return spark.sql(sql, **tables(spark, sf, "conversations"))


def backfill_range(spark, sf):
    return st.backfill_range(view(spark, sf, "toc"), _asked(spark, sf)).select("book_id", "idx", "url")


def backfill_pending(spark, sf):
    wanted = st.backfill_range(view(spark, sf, "toc"), _asked(spark, sf))
    return st.backfill_pending(wanted, view(spark, sf, "store")).select("book_id", "idx", "url")


def backfill_outcome(spark, sf):
    return st.backfill_outcome(view(spark, sf, "attempts"))


def shelf_recent(spark, sf):
    shelf = tables(spark, sf, "orders")["orders"].select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("last_read_time"), F.col("o_orderkey").alias("added_ord")
    )
    return sh.recent(shelf).select("id", "added_ord")


def shelf_unread(spark, sf):
    totals = tables(spark, sf, "part")["part"].select(
        F.col("p_partkey").alias("book_id"), F.col("p_size").alias("total"), (F.col("p_partkey") % 40).cast("int").alias("chapter_index")
    )
    return totals.select("book_id", unread(F.col("total"), F.col("chapter_index")).alias("unread_count"))


def shelf_remove(spark, sf):
    gone = view(spark, sf, "toc").where("idx = 6").select("book_id")
    left = sh.remove_books(
        {"toc": (view(spark, sf, "toc"), "book_id"), "store": (view(spark, sf, "store"), "book_id"), "progress": (view(spark, sf, "progress"), "book_id")},
        gone,
    )
    parts = [df.groupBy("book_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(n)) for n, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def progress_latest(spark, sf):
    return sh.latest_progress(view(spark, sf, "progress")).select(
        "book_id", "seq", "chapter_index", "chapter_url", "chapter_title", "scroll_ratio"
    )


def progress_resume(spark, sf):
    return sh.resume(sh.latest_progress(view(spark, sf, "progress")), view(spark, sf, "toc"))


def title_unique_match(spark, sf):
    wanted = view(spark, sf, "toc").select("book_id", F.col("idx").alias("old_idx"), F.when(F.col("idx") % 6 == 5, F.lit("—")).otherwise(F.col("title")).alias("title"))
    return sh.match_titles(wanted, view(spark, sf, "new_toc")).select("book_id", "old_idx", "match_idx")


def _readers(spark, sf):
    toc = view(spark, sf, "toc").where(F.col("idx") == F.col("book_id") % 9).select("book_id", "title")
    base = _asked(spark, sf).select("book_id", F.col("start").alias("chapter_index"), (F.col("book_id") % 2 == 0).alias("was_read"))
    return base.join(toc, "book_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def switch_plan(spark, sf):
    return sh.switch_plan(_readers(spark, sf), view(spark, sf, "new_toc"))


def switch_apply(spark, sf):
    id_ = F.col("book_id").cast("bigint")
    shelf = _asked(spark, sf).select(
        id_.alias("id"),
        F.when(id_ % 6 == 4, F.lit("moved")).otherwise(F.lit("s-old")).alias("source_url"),
        F.lit("old").alias("source_name"),
        F.concat(F.lit("old/"), id_).alias("book_url"),
        F.lit("t-old").alias("toc_url"),
        F.lit("cover-old").alias("cover_url"),
        F.lit("intro-old").alias("intro"),
        F.lit(0).cast("bigint").alias("total_chapters"),
        F.lit("").alias("latest_chapter"),
        F.col("start").alias("chapter_index"),
        F.lit("").alias("chapter_url"),
        F.lit("").alias("chapter_title"),
        F.lit(0).cast("bigint").alias("unread_count"),
        F.lit(7).alias("added_time"),
        F.lit(0.7).alias("scroll_ratio"),
    )
    plan = sh.switch_plan(_readers(spark, sf), view(spark, sf, "new_toc")).where("auto_commit").select(
        id_.alias("id"),
        F.lit("s-old").alias("old_source_url"),
        F.concat(F.lit("old/"), id_).alias("old_book_url"),
        F.lit("s-new").alias("source_url"),
        F.lit("new").alias("source_name"),
        F.concat(F.lit("new/"), id_).alias("book_url"),
        F.lit("t-new").alias("toc_url"),
        F.when(id_ % 3 == 0, F.lit("")).otherwise(F.lit("cover-new")).alias("cover_url"),
        F.lit("").alias("intro"),
        F.when(id_ % 17 == 3, F.col("target_idx") + 1000).otherwise(F.col("target_idx")).alias("target_idx"),
    )
    out, conflicts = sh.switch_apply(shelf, plan, view(spark, sf, "new_toc"))
    return out.select(
        "id", "source_url", "source_name", "book_url", "cover_url", "intro", "total_chapters", "latest_chapter",
        "chapter_index", "chapter_url", "unread_count", "added_time", "scroll_ratio", F.lit("shelf").alias("part"),
    ).unionByName(conflicts.select("id", F.col("reason").alias("part")), allowMissingColumns=True)


QUERIES = {
    "store_keys": store_keys,
    "store_upsert": store_upsert,
    "store_merge_parts": store_merge_parts,
    "store_clear_parts": store_clear_parts,
    "store_valid_read": store_valid_read,
    "store_coverage": store_coverage,
    "store_clear_book": store_clear_book,
    "backfill_range": backfill_range,
    "backfill_pending": backfill_pending,
    "backfill_outcome": backfill_outcome,
    "shelf_recent": shelf_recent,
    "shelf_unread": shelf_unread,
    "shelf_remove": shelf_remove,
    "progress_latest": progress_latest,
    "progress_resume": progress_resume,
    "title_unique_match": title_unique_match,
    "switch_plan": switch_plan,
    "switch_apply": switch_apply,
}

_TOC, _NEW, _STORE, _PROGRESS, _ATTEMPTS = (sql_view(v) for v in ("toc", "new_toc", "store", "progress", "attempts"))
_ASK = "a as (select distinct conv_id as book_id, conv_id % 9 as start, conv_id % 5 as n from conversations)"
_RANGE = f"""t as {_TOC}, m as (select book_id, max(idx) as last from t group by book_id), {_ASK},
w as (select t.book_id, idx, url from t join m on t.book_id = m.book_id join a on a.book_id = t.book_id
 where n > 0 and idx between least(start, last) and least(least(start, last) + n - 1, last))"""
_LATEST = f"""l as (select * from {_PROGRESS} qualify row_number() over (partition by book_id order by ts desc, seq desc) = 1)"""
_NOISE = "[\\t-\\r \\x{{00A0}}\\x{{3000}}·:：、，。!！?？_—-]".replace("{{", "{").replace("}}", "}")


def _key(title: str) -> str:
    return f"lower(regexp_replace(nfc_normalize({title}), '{_NOISE}', '', 'g'))"


_SINGLE = f"""n as {_NEW}, k as (select book_id, {_key('title')} as key, min(idx) as idx from n group by all having count(*) = 1)"""
_PLAN = f"""{_SINGLE}, {_ASK}, t as {_TOC},
r as (select a.book_id, a.start as ci, a.book_id % 2 = 0 as was_read, coalesce(t.title, '') as title,
 (select count(*) from n where n.book_id = a.book_id) as total from a left join t on t.book_id = a.book_id and t.idx = a.start),
p as (select r.book_id, cast(case when total = 0 then null when k.idx is not null then k.idx else least(ci, total - 1) end as int) as target_idx,
 case when total = 0 then 'rejected' when k.idx is not null then 'matched' else 'manual' end as how,
 total > 0 and (k.idx is not null or (not was_read and ci = 0)) as auto_commit, total
 from r left join k on k.book_id = r.book_id and k.key = {_key('r.title')} and k.key <> '')"""

ORACLES = {
    "store_keys": """select cast(conv_id as varchar) as book_id, sha256(concat('["', conv_id, '"]')) as book_key,
 sha256(concat('["https://c.example/é","/b/', conv_id, '"]')) as source_key,
 sha256(concat('[', cast(to_json(text) as varchar), ']')) as chapter_key from conversations""",
    "store_upsert": """with r as (select user_id as book_id, concat('c', cast(floor(value) as int) % 30) as chapter_url,
 case when event_type = 'purchase' then concat('old ', event_type, props) else concat(event_type, props) end as content, ts, event_id as seq
 from events where event_type <> 'error')
select book_id, chapter_url, content, seq from r qualify row_number() over (partition by book_id, chapter_url order by ts desc, seq desc) = 1""",
    "store_valid_read": f"""select s.chapter_url, s.content, case when version = 1 and s.book_url = concat('https://c.example/', s.book_id) and trim(content) <> ''
 then 'hit' else 'purge' end as state from {_STORE} s""",
    "store_coverage": f"""with t as {_TOC}, s as {_STORE} select book_id, count(*) as n_chapters,
 count(*) filter (where url in (select chapter_url from s)) as n_stored, n_stored * 100.0 / count(*) as pct from t group by book_id""",
    "store_clear_book": f"""select book_id, chapter_url from {_STORE} where book_id not in (select c_custkey from customer where c_acctbal < 0)""",
    "backfill_range": f"with {_RANGE} select book_id, idx, url from w",
    "backfill_pending": f"with {_RANGE}, s as {_STORE} select book_id, idx, url from w where url not in (select chapter_url from s)",
    "backfill_outcome": f"""with a as {_ATTEMPTS}, f as (select *, outcome = 'failed' and lag(outcome) over w = 'failed' and lag(outcome, 2) over w = 'failed' as three
 from a window w as (partition by run_id order by ord)),
s as (select run_id, min(ord) as stop_at, arg_min(case when http_status in (403, 429) then 'refused' else 'failing' end, ord) as reason
 from f where three or (outcome = 'failed' and http_status in (403, 429)) group by run_id)
select a.run_id, count(*) as total, count(*) filter (where ord <= coalesce(stop_at, ord)) as processed,
 count(*) filter (where ord <= coalesce(stop_at, ord) and outcome = 'saved') as saved,
 count(*) filter (where ord <= coalesce(stop_at, ord) and outcome = 'skipped') as skipped,
 count(*) filter (where ord <= coalesce(stop_at, ord) and outcome = 'failed') as failed,
 any_value(reason) as reason, case when any_value(reason) is null then 'completed' else 'error' end as status
from a left join s on a.run_id = s.run_id group by a.run_id""",
    "shelf_recent": "select o_orderkey as id, o_orderkey as added_ord from orders order by o_orderdate desc, o_orderkey",
    "shelf_unread": "select p_partkey as book_id, cast(greatest(0, p_size - p_partkey % 40 - 1) as int) as unread_count from part",
    "shelf_remove": f"""with t as {_TOC}, g as (select book_id from t where idx = 6)
select book_id, count(*) as n, 'toc' as table_name from t where book_id not in (select book_id from g) group by book_id
union all select book_id, count(*), 'store' from {_STORE} where book_id not in (select book_id from g) group by book_id
union all select book_id, count(*), 'progress' from {_PROGRESS} where book_id not in (select book_id from g) group by book_id""",
    "progress_latest": f"with {_LATEST} select book_id, seq, chapter_index, chapter_url, chapter_title, least(1.0, greatest(0.0, scroll_ratio)) as scroll_ratio from l",
    "progress_resume": f"""with {_LATEST}, t as {_TOC}, z as (select book_id, count(*) as n from t group by book_id)
select l.book_id, cast(coalesce(t.idx, least(chapter_index, n - 1), chapter_index) as bigint) as open_at,
 case when t.idx is not null then least(1.0, greatest(0.0, scroll_ratio)) else 0.0 end as ratio, t.idx is not null as found
from l left join z on z.book_id = l.book_id left join t on t.book_id = l.book_id and t.url = l.chapter_url""",
    "title_unique_match": f"""with {_SINGLE}, t as {_TOC} select t.book_id, t.idx as old_idx, coalesce(k.idx, -1) as match_idx
from t left join k on k.book_id = t.book_id and t.idx % 6 <> 5 and k.key = {_key('t.title')}""",
    "switch_plan": f"with {_PLAN} select book_id, cast(target_idx as bigint) as target_idx, how, auto_commit from p",
    "switch_apply": f"""with {_PLAN}, j as (select a.book_id as id, start, p.*, auto_commit and a.book_id % 6 <> 4 and a.book_id % 17 <> 3 as go,
 (select arg_max(title, idx) from n where n.book_id = a.book_id) as latest,
 (select url from n where n.book_id = a.book_id and n.idx = target_idx) as url from a join p on a.book_id = p.book_id)
select id, case when go then 's-new' when id % 6 = 4 then 'moved' else 's-old' end as source_url, case when go then 'new' else 'old' end as source_name,
 concat(case when go then 'new/' else 'old/' end, id) as book_url, case when go and id % 3 <> 0 then 'cover-new' else 'cover-old' end as cover_url,
 'intro-old' as intro, case when go then total else 0 end as total_chapters, case when go then latest else '' end as latest_chapter,
 cast(case when go then target_idx else start end as int) as chapter_index, case when go then url else '' end as chapter_url,
 case when go then greatest(0, total - target_idx - 1) else 0 end as unread_count, 7 as added_time, cast(case when go then 0 else 0.7 end as double) as scroll_ratio, 'shelf' as part from j
union all select id, null, null, null, null, null, null, null, null, null, null, null, null, case when id % 6 = 4 then 'changed' else 'no_chapter' end
from j where auto_commit and (id % 6 = 4 or id % 17 = 3)""",
}
ORACLES |= {"store_merge_parts": ORACLES["store_upsert"], "store_clear_parts": ORACLES["store_clear_book"]}
