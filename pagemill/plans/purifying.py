"""Purification rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import purify as pu
from ..operators.purify import Rule
from .views import tables

RULES = [
    Rule("r1", "the "),
    Rule("r2", "ER", "$1", ignore_case=True),
    Rule("r3", "$1"),
    Rule("r4", r"^[A-Z][a-z]+\.$", "#", mode="regex", multiline=True),
    Rule("r5", "[0-9]{3,}", "N", mode="regex"),
    Rule("r6", "the ", enabled=False),
]
# A rule whose result outgrows the limit on longer texts.
GROWING = [Rule("g1", "e", "-" * 600), Rule("g2", "a", "b")]


def docs(spark, sf):
    return tables(spark, sf, "documents")["documents"]


def _phrases(spark, sf):
    """Rules made from the benchmark passages, some of them broken or doubled."""
    sql = """select item_id as ord, case when item_id % 10 = 9 then 'b0' else concat('b', item_id) end as id, concat('rule ', item_id) as name,
 case when item_id % 7 = 3 then cast(null as boolean) else true end as enabled,
 case when item_id % 6 = 5 then 'regex' else 'text' end as mode,
 case when item_id % 8 = 6 then '' when item_id % 6 = 5 then case when item_id % 4 = 1 then '(' else '[0-9]+' end else text end as find,
 case when item_id % 8 = 7 then repeat('x', 10001) else '' end as replacement,
 false as ignore_case, false as multiline, false as dot_all from {benchmark}"""
    return spark.sql(sql, **tables(spark, sf, "benchmark"))


def pur_validate(spark, sf):
    return pu.validate(_phrases(spark, sf)).select("ord", "error")


def pur_load_rules(spark, sf):
    return pu.load_rules(_phrases(spark, sf)).select("ord", "id", "mode")


def pur_recovered(spark, sf):
    return pu.recovered(_phrases(spark, sf))


def pur_literal(spark, sf):
    """Every usable benchmark passage removed from every document."""
    rules = [r for r in pu.collect_rules(_phrases(spark, sf)) if r.mode == "text"]
    out = pu.apply_literals(docs(spark, sf), rules)
    hits = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["hits"])
    return out.select("doc_id", F.sha2("clean", 256).alias("clean_hash"), hits.alias("hits"))


def pur_regex(spark, sf):
    rules = [
        Rule("a", "^[^\\n]{0,20}$", "<$1>", mode="regex", multiline=True),
        Rule("b", "th.", "[$&]", mode="regex", dot_all=True),
        Rule("c", "[AEIOU]n", "", mode="regex", ignore_case=True),
    ]
    out = pu.apply_rules(docs(spark, sf), rules)
    return out.select("doc_id", F.sha2("clean", 256).alias("clean_hash"))


def pur_counts(spark, sf):
    out = pu.apply_rules(docs(spark, sf), RULES)
    return out.select("doc_id", *[F.col(f"hits_r{i}").cast("bigint").alias(f"hits_r{i}") for i in range(1, 6)])


def pur_apply(spark, sf):
    out = pu.apply_rules(docs(spark, sf), RULES)
    return out.select("doc_id", "clean", "status")


def pur_output_guard(spark, sf):
    out = pu.apply_rules(docs(spark, sf), GROWING)
    return out.select("doc_id", "status", F.length("clean").cast("bigint").alias("clean_length"), (F.col("clean") == F.col("text")).alias("kept_original"))


def pur_report(spark, sf):
    return pu.report(pu.apply_rules(docs(spark, sf), RULES), RULES, "source")


QUERIES = {
    "pur_validate": pur_validate,
    "pur_load_rules": pur_load_rules,
    "pur_recovered": pur_recovered,
    "pur_literal": pur_literal,
    "pur_regex": pur_regex,
    "pur_counts": pur_counts,
    "pur_apply": pur_apply,
    "pur_output_guard": pur_output_guard,
    "pur_report": pur_report,
}

_PHRASES = """p as (select item_id as ord, case when item_id % 10 = 9 then 'b0' else concat('b', item_id) end as id,
 item_id % 7 <> 3 as given, case when item_id % 8 = 7 then repeat('x', 10001) else '' end as replacement, case when item_id % 6 = 5 then 'regex' else 'text' end as mode,
 case when item_id % 8 = 6 then '' when item_id % 6 = 5 then case when item_id % 4 = 1 then '(' else '[0-9]+' end else text end as find from benchmark),
ok as (select * from p where given and length(find) > 0 qualify row_number() over (partition by id order by ord) = 1)"""


def _chain(rules) -> str:
    """CTEs t0, t1, ...: each rule applied in turn with its hits."""
    steps = ["t0 as (select doc_id, source, text, replace(text, chr(13) || chr(10), chr(10)) as x from documents)"]
    seen = []
    for i, (name, count, result) in enumerate(rules):
        cols = "".join(f", {c}" for c in seen)
        steps.append(f"t{i + 1} as (select doc_id, source, text, {result} as x, {count} as {name}{cols} from t{i})")
        seen.append(name)
    return ",\n".join(steps)


def _literal(find: str, by: str):
    return f"(length(x) - length(replace(x, '{find}', ''))) // {len(find)}", f"replace(x, '{find}', '{by}')"


def _regex(pattern: str, by: str):
    return f"len(regexp_extract_all(x, '{pattern}'))", f"regexp_replace(x, '{pattern}', '{by}', 'g')"


_RULES = _chain(
    [
        ("hits_r1", *_literal("the ", "")),
        ("hits_r2", *_regex("(?i)er", "$1")),
        ("hits_r3", *_literal("$1", "")),
        ("hits_r4", *_regex(r"(?m)^[A-Z][a-z]+\.$", "#")),
        ("hits_r5", *_regex("[0-9]{3,}", "N")),
    ]
)
_REGEX = _chain(
    [
        ("h_a", *_regex("(?m)^[^\\n]{0,20}$", "<$1>")),
        ("h_b", *_regex("(?s)th.", "[$&]")),
        ("h_c", *_regex("(?i)[AEIOU]n", "")),
    ]
)
_SIZES = """s as (select doc_id, text, length(text) + 599 * len(regexp_extract_all(text, 'e')) as grown, greatest(1000000, 4 * length(text)) as lim from documents)"""

ORACLES = {
    "pur_validate": """select item_id as ord, case when item_id % 8 = 6 then 'find_empty' when item_id % 8 = 7 then 'replacement_too_long'
 when item_id % 6 = 5 and item_id % 4 = 1 then 'bad_regex' end as error from benchmark""",
    "pur_load_rules": f"with {_PHRASES} select ord, id, mode from ok",
    "pur_recovered": f"with {_PHRASES} select (select count(*) from p) as given, count(*) as used, count(*) <> (select count(*) from p) as recovered from ok",
    "pur_literal": f"""with recursive {_PHRASES}, f as (select row_number() over (order by ord) as k, find, replacement from ok where mode = 'text'),
go as (select doc_id, text as x, cast(0 as bigint) as k, cast(0 as bigint) as hits from documents union all
 select doc_id, replace(x, find, replacement), go.k + 1, hits + (length(x) - length(replace(x, find, ''))) // length(find) from go join f on f.k = go.k + 1)
select doc_id, sha256(x) as clean_hash, hits from go where k = (select count(*) from f)""",
    "pur_regex": f"with {_REGEX} select doc_id, sha256(x) as clean_hash from t3",
    "pur_counts": f"with {_RULES} select doc_id, " + ", ".join(f"cast(hits_r{i} as bigint) as hits_r{i}" for i in range(1, 6)) + " from t5",
    "pur_apply": f"with {_RULES} select doc_id, x as clean, 'ok' as status from t5",
    "pur_output_guard": f"""with {_SIZES} select doc_id, case when grown > lim then 'too_large' else 'ok' end as status,
 grown as clean_length, not regexp_matches(text, '[ea]') as kept_original from s""",
    "pur_report": f"""with {_RULES}, u as (select source, unnest([{', '.join(f"{{'r': 'r{i}', 'h': hits_r{i}}}" for i in range(1, 6))}]) as z from t5)
select z.r as rule_id, source, cast(sum(z.h) as bigint) as hits, count(*) filter (where z.h > 0) as docs_hit
from u group by grouping sets ((z.r, source), (z.r))""",
}
