"""Streams over the test tables as they landed, run to their end, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search as se
from ..session import new_table_path
from ..streaming import jobs
from . import purifying, searching, shelving
from .views import VIEWS, sql_view, tables, view


def landed(spark, sf: str, name: str) -> DataFrame:
    """A whole test table, one file or a folder of them, as a stream of what has landed."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def stream_progress_latest(spark, sf):
    path = new_table_path(spark, "progress")
    jobs.keep_latest_progress(spark.sql(VIEWS["progress"], events=landed(spark, sf, "events")), path)
    return jobs.current_progress(spark, path).select(
        "book_id", "seq", "chapter_index", "chapter_url", "chapter_title", "scroll_ratio"
    )


def stream_debounce(spark, sf):
    diff = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
    ms = f"1700000000000 + {diff} div 78000000"
    sql = f"select user_id as name, event_id as seq, timestamp_millis({ms}) as ts from {{events}}"
    path = new_table_path(spark, "debounce")
    jobs.keep_bursts(spark.sql(sql, events=landed(spark, sf, "events")), path)
    return jobs.current_bursts(spark, path).select("name", "seq", F.unix_millis("ts").alias("ts_ms"), "n_writes")


def stream_stale_drop(spark, sf):
    sql = "select user_id as key, event_id as ord, event_id + cast(floor(value) as bigint) % 200 as seq from {events}"
    path = new_table_path(spark, "stale")
    jobs.drop_stale(spark.sql(sql, events=landed(spark, sf, "events")), path)
    return jobs.read_appended(spark, path).select("key", "ord", "seq")


def stream_incremental_group(spark, sf):
    path = new_table_path(spark, "groups")
    rows = spark.sql(VIEWS["results"], lineitem=landed(spark, sf, "lineitem"), **tables(spark, sf, "part"))
    jobs.group_results(searching.keyed(rows), path, searching.ORDER)
    groups = se.group_variants(jobs.current_variants(spark, path, searching.ORDER))
    return groups.select("group_key", "name", "author", "source_url", "book_url", "kind", "n_alternatives")


def stream_backfill_skip(spark, sf):
    toc = spark.sql(VIEWS["toc"], conversations=landed(spark, sf, "conversations"))
    # Every chapter is asked for twice.
    again = F.explode(F.array(F.lit(1700000000000), F.lit(1700000500000)))
    twice = toc.withColumn("_at", again).withColumn("ts", F.timestamp_millis(F.col("_at") + F.col("idx") * 1000)).drop("_at")
    path = new_table_path(spark, "pending")
    jobs.run_to_files(jobs.skip_stored(twice, view(spark, sf, "store")), path)
    return jobs.read_appended(spark, path).select("book_id", "url")


def stream_purify(spark, sf):
    path = new_table_path(spark, "purified")
    docs = landed(spark, sf, "documents").select("doc_id", "text")
    jobs.run_to_files(jobs.purify_stream(docs, purifying.RULES), path)
    return jobs.read_appended(spark, path).select("doc_id", "clean", "status")


QUERIES = {
    "stream_progress_latest": stream_progress_latest,
    "stream_debounce": stream_debounce,
    "stream_stale_drop": stream_stale_drop,
    "stream_incremental_group": stream_incremental_group,
    "stream_backfill_skip": stream_backfill_skip,
    "stream_purify": stream_purify,
}

ORACLES = {
    "stream_progress_latest": shelving.ORACLES["progress_latest"],
    "stream_debounce": """with e as (select user_id as name, event_id as seq,
 1700000000000 + date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) // 78000000 as ms from events),
n as (select *, case when ms - lag(ms) over (partition by name order by ms, seq) <= 500 then 0 else 1 end as fresh from e),
b as (select *, sum(fresh) over (partition by name order by ms, seq rows unbounded preceding) as burst from n),
r as (select name, arg_max(seq, (ms - 1700000000000) * 100000000 + seq) as seq, max(ms) as ts_ms, count(*) as n_writes from b group by name, burst)
select name, seq, ts_ms, n_writes from r""",
    "stream_stale_drop": """with e as (select user_id as key, event_id as ord, event_id + cast(floor(value) as bigint) % 200 as seq from events)
select key, ord, seq from e qualify seq = max(seq) over (partition by key order by ord rows unbounded preceding)""",
    "stream_incremental_group": searching.ORACLES["search_group"],
    "stream_backfill_skip": f"select book_id, url from {sql_view('toc')} where url not in (select chapter_url from {sql_view('store')})",
    "stream_purify": purifying.ORACLES["pur_apply"],
}
