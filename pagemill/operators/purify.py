"""Ordered text rules with hit counts, as one chain of projections."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rx import compiles, java_pattern
from ..functions.text import quote_regex, quote_replacement

# Executors get the code with the task, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values. Rules beyond these sizes are reported, and applied all the same.
MAX_FIND = 2000
MAX_REPLACEMENT = 10_000
OUTPUT_FLOOR, OUTPUT_FACTOR = 1_000_000, 4


@dataclass(frozen=True)
class Rule:
    id: str
    find: str
    replacement: str = ""
    mode: str = "text"
    name: str = ""
    enabled: bool = True
    ignore_case: bool = False
    multiline: bool = False
    dot_all: bool = False

    @property
    def pattern(self) -> str:
        """The rule as a Java regex."""
        if self.mode == "text":
            return ("(?iu)" if self.ignore_case else "") + quote_regex(self.find)
        flags = ("iu" if self.ignore_case else "") + ("s" if self.dot_all else "")
        return (f"(?{flags})" if flags else "") + java_pattern(self.find, self.multiline, self.dot_all)

    @property
    def plain(self) -> bool:
        return self.mode == "text" and not self.ignore_case

    @property
    def can_grow(self) -> bool:
        if self.mode == "text":
            return len(self.replacement) > len(self.find)
        return self.replacement != ""

    @property
    def hits(self) -> str:
        return f"hits_{self.id}"


def column(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _bad_patterns(rules: DataFrame) -> list[str]:
    """Regex rules that the JVM, which will run them, does not accept."""

    patterns = rules.where("mode = 'regex' and find is not null").select("find", "multiline").distinct().collect()
    return [r["find"] for r in patterns if not compiles(rules.sparkSession, java_pattern(r["find"], bool(r["multiline"])))]


def validate(rules: DataFrame) -> DataFrame:
    """Add ``error``: why a rule is refused, NULL when it is fine."""
    return rules.withColumn(
        "error",
        F.when(F.length("find") == 0, "find_empty")
        .when(F.length("find") > MAX_FIND, "find_too_long")
        .when(F.length("replacement") > MAX_REPLACEMENT, "replacement_too_long")
        .when((F.col("mode") == "regex") & F.col("find").isin(_bad_patterns(rules)), "bad_regex"),
    )


def load_rules(rules: DataFrame) -> DataFrame:
    """Complete rules, the first per id, in order."""
    needed = ["id", "name", "enabled", "mode", "find", "replacement", "ignore_case", "multiline", "dot_all"]
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    ok = ok & F.col("mode").isin("text", "regex") & (F.length("find") > 0)
    rest = [c for c in rules.columns if c not in ("id", "ord")]
    firsts = (
        rules.where(ok)
        .groupBy("id")
        .agg(F.min("ord").alias("ord"), F.min_by(F.struct(*rest), "ord").alias("r"))
        .select("ord", "id", *[F.col(f"r.{c}").alias(c) for c in rest])
    )
    return firsts.orderBy("ord")


def recovered(rules: DataFrame) -> DataFrame:
    """One row: how many rules were given, how many are used, and whether some were dropped."""
    given = rules.agg(F.count("*").alias("given"), F.lit(0).alias("used"))
    used = load_rules(rules).agg(F.lit(0).alias("given"), F.count("*").alias("used"))
    both = given.unionByName(used).agg(F.sum("given").alias("given"), F.sum("used").alias("used"))
    return both.withColumn("recovered", F.col("given") != F.col("used"))


def collect_rules(rules: DataFrame) -> list[Rule]:
    """Bring the loaded rules to the driver: they are configuration, and each becomes part of the plan."""
    fields = ["id", "find", "replacement", "mode", "name", "enabled", "ignore_case", "multiline", "dot_all"]
    return [Rule(**{f: row[f] for f in fields}) for row in load_rules(rules).collect()]


def pieces(text: Column, rule: Rule) -> Column:
    """What stands between the hits of a plain rule."""
    if not rule.find:
        raise ValueError(f"rule {rule.id} has nothing to find")
    return F.split(text, rule.find if re.fullmatch("[A-Za-z0-9]", rule.find) else quote_regex(rule.find), -1)


def apply_rules(df: DataFrame, rules: list[Rule], text: str = "text", out: str = "clean") -> DataFrame:
    """Add the purified text, ``hits_<id>`` per enabled rule and ``status``.

    Hits are counted on the text as earlier rules left it. Where a text outgrows max(1 000 000, 4 x its
    size) on the way, status says 'too_large'; it is purified all the same. A pattern that the JVM does
    not accept changes nothing and has no hits. Each rule is one projection over the row; nothing is
    shuffled.
    """
    limit = F.greatest(F.lit(OUTPUT_FLOOR), F.length(text) * OUTPUT_FACTOR)
    df = df.withColumns({out: F.regexp_replace(F.col(text), "\r\n?", "\n"), "_big": F.lit(False)})
    df = df.withColumn("_n", F.length(out))
    for rule in (r for r in rules if r.enabled):
        now = F.col(out)
        if rule.mode == "regex" and not compiles(df.sparkSession, rule.pattern):
            df = df.withColumn(rule.hits, F.lit(0))
            continue
        if rule.plain:
            # Cut once: the pieces tell the hits and the new length, and are joined by the replacement as it is.
            df = df.withColumn("_pieces", pieces(now, rule))
            df = df.withColumn(rule.hits, F.array_size("_pieces") - 1)
            new = F.array_join("_pieces", rule.replacement)
            length = F.col("_n") + column(rule.hits).cast("bigint") * (len(rule.replacement) - len(rule.find))
        else:
            df = df.withColumn(rule.hits, F.regexp_count(now, F.lit(rule.pattern)))
            new = F.regexp_replace(now, rule.pattern, quote_replacement(rule.replacement))
            length = F.length(out).cast("bigint")
        df = df.withColumn(out, F.when(column(rule.hits) > 0, new).otherwise(now)).drop("_pieces")
        df = df.withColumn("_n", length)
        if rule.can_grow:
            df = df.withColumn("_big", F.col("_big") | F.coalesce(F.col("_n") > limit, F.lit(False)))
    return df.withColumn("status", F.when(F.col("_big"), "too_large").otherwise("ok")).drop("_big", "_n")


def apply_literals(df: DataFrame, rules: list[Rule], text: str = "text", out: str = "clean") -> DataFrame:
    """Add the purified text, ``hits`` (the rules that hit, in order, with how often) and ``status``; for many rules.

    The same as :func:`apply_rules` for plain text rules, without a column per rule. One automaton over all texts to find
    tells in one pass over a text which rules can hit it at all; the first of them is applied, and as its replacement may
    bring or take hits of later rules, the changed text is looked through again from there. So a text costs one pass and
    one more per rule that hits. Rules travel with the task; rows with a null text have no result and no hits.
    """
    active = [r for r in rules if r.enabled and r.find]
    if not all(r.plain for r in active):
        raise ValueError("only text rules that mind the case")
    table = [(r.id, r.find, r.replacement, r.can_grow) for r in active]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = ahocorasick.Automaton()
        for i, (_, find, _, _) in enumerate(table):
            scan.add_word(find, [*scan.get(find, []), i])
        if table:
            scan.make_automaton()

        def one(value: str | None) -> tuple[str | None, list, str]:
            if value is None:
                return None, [], "ok"
            value = re.sub("\r\n?", "\n", value)
            limit = max(OUTPUT_FLOOR, len(value) * OUTPUT_FACTOR)
            found, nth, large = [], -1, False
            while table:
                later = (i for _, own in scan.iter(value) for i in own if i > nth)
                nth = min(later, default=None)
                if nth is None:
                    break
                rule_id, find, new, grows = table[nth]
                found.append({"rule_id": rule_id, "hits": value.count(find)})
                value = value.replace(find, new)
                large = large or (grows and len(value) > limit)
            return value, found, "too_large" if large else "ok"

        hit = pa.list_(pa.struct([("rule_id", pa.string()), ("hits", pa.int32())]))
        for batch in batches:
            done = [one(v) for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            clean, found, status = zip(*done) if done else ((), (), ())
            arrays = [*batch.columns, pa.array(clean, pa.string()), pa.array(found, hit), pa.array(status, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, out, "hits", "status"])

    added = T.StructType.fromDDL(f"`{out}` string, hits array<struct<rule_id: string, hits: int>>, status string")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def report(applied: DataFrame, rules: list[Rule], by: str) -> DataFrame:
    """Hits and texts hit per rule and ``by``, with totals per rule where ``by`` is NULL.

    The counters are summed side by side, so each text sends one row of sums per task at most.
    """
    active = [r for r in rules if r.enabled]
    sums = []
    for i, r in enumerate(active):
        sums += [F.sum(column(r.hits)).alias(f"h_{i}"), F.count_if(column(r.hits) > 0).alias(f"d_{i}")]
    totals = applied.groupBy(by).agg(*sums)
    per_rule = F.array(
        *[
            F.struct(F.lit(r.id).alias("rule_id"), F.col(f"h_{i}").alias("hits"), F.col(f"d_{i}").alias("docs_hit"))
            for i, r in enumerate(active)
        ]
    )
    long = totals.select(by, F.explode(per_rule).alias("x")).select(by, "x.*")
    return long.rollup("rule_id", by).agg(F.sum("hits").alias("hits"), F.sum("docs_hit").alias("docs_hit")).where(
        F.col("rule_id").isNotNull()
    )
