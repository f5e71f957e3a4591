"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, running, text_hash
from pagemill.session import cut_lineage

MOST = 3
"""No source's target, and no document, goes beyond so many times its size."""


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Add ``target`` to one row per source (``no_source``, ``source``, ``source_size``).

    Sources in order of their names, the null source last, weigh ``weights`` in turn and share the sum of all sizes.
    A source stops at ``most`` times its size and the excess is shared again by weight, until none is above. Each
    round is one aggregate whose result is three numbers.
    """
    ranked = running(sizes.withColumn("_one", F.lit(1)), [], ["no_source", "source"], "_one", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    held = cut_lineage(ranked.withColumn("_weight", weight).withColumn("_cap", most * F.col("source_size")))
    total, share = held.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, capped = (total or 0) / (share or 1), 0
    while True:
        above = F.col("_cap") < level * F.col("_weight")
        n, taken, rest = held.agg(
            F.count_if(above), F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("_weight")))
        ).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - taken) / rest
    target = F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_weight"))
    return held.withColumn("target", target).drop("_one", "_rank", "_weight", "_cap")


def copies(docs: DataFrame, seed: str = "mix", extra: list[str] | None = None, most: int = MOST) -> DataFrame:
    """One row per document with ``size`` in words, ``source_size``, ``target`` and ``copies``.

    A document's expected copies are its source's target over its size. Along each source, in order of size, the
    expected copies are added up from one random offset, and a document is emitted once for every integer passed. As
    the order follows size, a source's words miss their target by less than its longest document. The offset depends
    on seed and source, so reruns agree. Null text has size 0; a source of size 0 emits nothing.
    """
    no_source = F.col("source").isNull()
    keys = ["doc_id", "no_source", "source", "size", *(extra or [])]
    rows = cut_lineage(
        docs.select(
            "doc_id",
            *(extra or []),
            no_source.alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    by_source = ["no_source", "source"]
    sizes = cut_lineage(rows.groupBy(*by_source).agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size")))
    shares = cut_lineage(targets(sizes, most=most))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("source"))), 1, 4), 16, 10).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = ["size", "_mark", *[k for k in keys if k not in (*by_source, "size")]]
    ranked = (
        running(rows, by_source, order, "_copies")
        .withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .join(shares, by_source)
        .withColumn("_rate", rate)
        .withColumn("_offset", (draw + 0.5) / 65536)
        .withColumn("_rank", F.col("before") + F.col("_nth"))
    )
    passed = F.floor(F.col("_rate") * F.col("_rank") + F.col("_offset")) - F.floor(
        F.col("_rate") * (F.col("_rank") - 1) + F.col("_offset")
    )
    return ranked.select(*keys, "source_size", "target", F.least(passed, F.lit(most)).alias("copies"), "_nth")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is emitted, with the columns of ``docs``.

    Rows that agree in doc_id, source and text are one key of the plan. They are numbered, and the plan's copies of the
    key are dealt out among them evenly, so all of them together are emitted as often as the plan says. Only rows of keys
    that come more than once are stored for that.
    """
    names = docs.columns
    own = docs.select("doc_id", "source", "text", text_hash(F.col("text")).alias("_hash"))
    chosen = copies(own, seed, ["_hash"])
    chosen = cut_lineage(
        chosen.groupBy("doc_id", "no_source", "source", "_hash")
        .agg(F.sum("copies").cast("long").alias("_emit"), F.count(F.lit(1)).alias("_rows"))
        .where("_emit > 0")
    )
    keyed = docs.select(
        *[F.col(c).alias(f"_doc_{i}") for i, c in enumerate(names)],
        F.col("doc_id").alias("_k_id"),
        F.col("source").isNull().alias("_k_none"),
        F.coalesce("source", F.lit("")).alias("_k_source"),
        text_hash(F.col("text")).alias("_k_hash"),
    )
    same = (
        F.col("_k_id").eqNullSafe(F.col("doc_id"))
        & (F.col("_k_none") == F.col("no_source"))
        & (F.col("_k_source") == F.col("source"))
        & (F.col("_k_hash") == F.col("_hash"))
    )
    columns = [f"_doc_{i}" for i in range(len(names))]
    out = keyed.join(chosen.where("_rows = 1"), same).select(*columns, "_emit")
    again = chosen.where("_rows > 1")
    if not again.isEmpty():
        key = ["_k_no_id", "_k_text_id", "_k_none", "_k_source", "_k_hash"]
        rows = (
            keyed.join(again, same)
            .withColumn("_k_no_id", F.col("_k_id").isNull())
            .withColumn("_k_text_id", F.coalesce(F.col("_k_id").cast("string"), F.lit("")))
            .select(*columns, *key, "_emit", "_rows", F.rand(7).alias("_draw"), F.lit(1).cast("long").alias("_one"))
        )
        passed = F.expr("_emit * (_nth + 1) div _rows - _emit * _nth div _rows")
        numbered = running(rows, key, ["_draw"], "_one", "_nth").withColumn("_emit", passed)
        out = out.unionByName(numbered.select(*columns, "_emit").where("_emit > 0"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_emit")))).select(
        *[F.col(f"_doc_{i}").alias(c) for i, c in enumerate(names)]
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


SQL = r"""
with d as (
  select doc_id, source is null as no_source, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select no_source, source, sum(size)::bigint as source_size from d group by all),
w as (select *, 1 + (row_number() over (order by no_source, source) - 1) % 3 as weight, 3 * source_size as cap from s),
o as (
  select *, sum(cap) over before_it as capped, sum(weight) over from_it as open, sum(source_size) over () as total
  from w
  window before_it as (order by cap / weight, no_source, source rows between unbounded preceding and 1 preceding),
    from_it as (order by cap / weight, no_source, source rows between current row and unbounded following)),
l as (select max((total - coalesce(capped, 0))::double / open) filter (where (total - coalesce(capped, 0))::double / open * weight <= cap) as level from o),
t as (select w.*, least(cap::double, level * weight) as target from w, l),
r as (
  select d.*, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    (('0x' || substr(md5('mix:' || d.source), 1, 4))::int::double + 0.5) / 65536 as u,
    row_number() over (partition by d.no_source, d.source order by size, md5(coalesce(doc_id::varchar, '')), doc_id) as n
  from d join t on d.no_source = t.no_source and d.source = t.source)
select doc_id, size, source_size, target,
  (size * least(floor(rate * n + u) - floor(rate * (n - 1) + u), 3))::bigint as taken
from r
"""
