"""Input views derived from the test tables; one SQL text serves Spark and the check engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS = {
    "sources": """
select concat('https://s', s_suppkey, '.example') as source_url, s_name as source_name,
 case when s_suppkey % 7 = 3 then 1 else 0 end as source_type,
 case when s_suppkey % 5 = 0 then false when s_suppkey % 5 = 1 then cast(null as boolean) else true end as enabled,
 case when s_suppkey % 6 = 5 then '' else '/search?q={{{{key}}}}&p={{{{page}}}}' end as search_url,
 s_suppkey as ord from {supplier}""",
    "results": """
select concat('https://s', l_suppkey, '.example') as source_url,
 case when l_linenumber % 2 = 0 then concat(p_name, ' (Complete)') else p_name end as name,
 case when p_size % 9 = 4 then cast(null as varchar(10)) else p_brand end as author, concat('/book/', l_partkey) as book_href, p_type as kind,
 l_suppkey as source_ord, l_orderkey as page, l_linenumber as item_ord, l_shipdate as ts
 from {lineitem} join {part} on l_partkey = p_partkey""",
    "shelf": """
select concat('bk', p_partkey) as id, p_name as name, p_brand as author,
 concat('https://s', p_partkey % 150, '.example') as source_url,
 concat('https://s', p_partkey % 150, '.example/book/', p_partkey) as book_url from {part}""",
    "progress": """
select user_id as book_id, event_id as seq, ts, cast(floor(value) as int) % 30 as chapter_index,
 case when event_id % 4 <> 1 then concat('https://c.example/', user_id, '/', cast(floor(value) as int) % 9) end as chapter_url,
 concat('title ', event_id % 50) as chapter_title,
 value / 100 as scroll_ratio from {events}""",
    "attempts": """
select user_id as run_id, event_id as ord,
 case when event_type = 'error' then 'failed' when event_type = 'purchase' then 'skipped' else 'saved' end as outcome,
 case when event_type = 'error' and event_id % 11 = 0 then 429 when event_type = 'error' then 500 end as http_status
 from {events}""",
    "toc": """
select conv_id as book_id, cast(turn as int) as idx, concat('第', turn + 1, '章 ', text) as title,
 concat('https://c.example/', conv_id, '/', turn) as url from {conversations}""",
    "new_toc": """
select conv_id as book_id, cast(turn as int) as idx,
 case when turn % 4 = 3 then '序章' else concat('第 ', turn + 1, '章： ', text, '!') end as title,
 concat('https://n.example/', conv_id, '/', turn) as url from {conversations} where conv_id % 13 <> 5""",
    "links": """
select book_id, concat('https://c.example/', book_id, '/', n) as url,
 case when n + 1 < pages then concat('https://c.example/', book_id, '/', n + 1) end as next_url,
 case when turn = 3 and conv_id % 37 = 2 then '  ' else text end as content
 from (select cast(floor(conv_id / 9) as bigint) as book_id, conv_id, turn, text,
  row_number() over (partition by floor(conv_id / 9) order by conv_id, turn) - 1 as n,
  count(*) over (partition by floor(conv_id / 9)) as pages from {conversations}) s""",
    "store": """
select conv_id as book_id, 'https://c.example' as source_url,
 concat('https://c.example/', case when turn % 8 = 7 then 'old' else cast(conv_id as varchar(20)) end) as book_url,
 concat('https://c.example/', conv_id, '/', turn) as chapter_url, text as content,
 case when turn % 6 = 5 then 2 else 1 end as version from {conversations} where role = 'assistant'""",
}


# Tables whose rows get heavy work; a small copy read as one partition is spread over the cores first.
HEAVY = {"documents", "pages", "lineitem", "events", "conversations"}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    read = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return {n: spread(df) if n in HEAVY else df for n, df in read.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))
    return spark.sql(sql, **tables(spark, sf_dir, *used))


def sql_view(name: str) -> str:
    """The view as a subquery for the check engine."""
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"
