"""The source catalog: parsing, importing, and picking the active part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.text import js_trim, let
from ..session import stored_table

# Fixed value: mark on the name of a source whose type cannot be read.
UNSUPPORTED_SUFFIX = "（暂不支持）"

RULE_GROUPS = ["ruleSearch", "ruleBookInfo", "ruleToc", "ruleContent"]
KNOWN = ["bookSourceName", "bookSourceUrl", "bookSourceType", "bookSourceGroup", "enabled", "header", "searchUrl"]


def config_items(text: Column) -> Column:
    """A text's configs: one JSON array or object, else one JSON value per line, bad lines skipped."""

    def pick(t: Column) -> Column:
        whole = F.try_parse_json(t)
        by_line = F.filter(
            F.transform(F.split(t, "\n", -1), lambda x: F.try_parse_json(js_trim(x))), lambda v: v.isNotNull()
        )
        return F.when(whole.isNull(), by_line).otherwise(F.coalesce(jsonx.as_list(whole), F.array(whole)))

    return let(js_trim(text), pick)


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "string")


def parse_catalog(texts: DataFrame, text: str = "text") -> DataFrame:
    """Catalog texts -> one row per config that has a name and an address."""
    keep = [F.col(c) for c in texts.columns if c != text]
    v = F.col("item")
    header = F.coalesce(
        F.try_variant_get(v, "$.header", "map<string,string>"),
        F.from_json(
            _text(v, "header"), "map<string,string>", {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
        ),
    )
    extra = F.map_filter(
        F.try_variant_get(v, "$", "map<string,string>"), lambda k, _: ~k.isin(KNOWN + RULE_GROUPS)
    )
    return (
        texts.select(*keep, F.posexplode(config_items(F.col(text))).alias("ord", "item"))
        .where(jsonx.truthy(jsonx.field(v, "bookSourceName")) & jsonx.truthy(jsonx.field(v, "bookSourceUrl")))
        .select(
            *keep,
            "ord",
            _text(v, "bookSourceName").alias("source_name"),
            _text(v, "bookSourceUrl").alias("source_url"),
            F.coalesce(F.try_variant_get(v, "$.bookSourceType", "int"), F.lit(0)).alias("source_type"),
            _text(v, "bookSourceGroup").alias("source_group"),
            F.try_variant_get(v, "$.enabled", "boolean").alias("enabled"),
            _text(v, "searchUrl").alias("search_url"),
            header.alias("header"),
            *[F.try_variant_get(v, f"$.{g}", "map<string,string>").alias(g) for g in RULE_GROUPS],
            extra.alias("extra"),
        )
    )


def import_merge(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add sources whose address is new; of several with one address the first (by ``ord``) counts.

    The duplicates are combined before the shuffle, so many copies of one address stay cheap.
    """
    rest = [c for c in incoming.columns if c != "source_url"]
    firsts = (
        incoming.groupBy("source_url")
        .agg(F.min_by(F.struct(*rest), F.col("ord")).alias("r"))
        .select("source_url", *[F.col(f"r.{c}").alias(c) for c in rest])
    )
    fresh = firsts.join(catalog.select("source_url"), "source_url", "left_anti")
    odd = F.coalesce(F.col("source_type"), F.lit(0)) != 0
    fresh = fresh.withColumns(
        {
            "enabled": F.when(odd, F.lit(False)).otherwise(F.col("enabled")),
            "source_name": F.when(odd, F.concat("source_name", F.lit(UNSUPPORTED_SUFFIX))).otherwise(F.col("source_name")),
        }
    )
    return catalog.unionByName(fresh, allowMissingColumns=True)


def import_counts(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many were added, skipped as known, and added but disabled."""
    firsts = incoming.groupBy("source_url").agg(
        F.count("*").alias("n"), F.min_by(F.coalesce("source_type", F.lit(0)), F.col("ord")).alias("source_type")
    )
    known = catalog.select("source_url").distinct().withColumn("known", F.lit(True))
    new = F.col("known").isNull()
    return (
        firsts.join(known, "source_url", "left")
        .agg(
            F.count_if(new).alias("added"),
            F.coalesce(F.sum("n") - F.count_if(new), F.lit(0)).alias("skipped"),
            F.count_if(new & (F.col("source_type") != 0)).alias("unsupported"),
        )
    )


def enabled_sources(sources: DataFrame, for_search: bool = False, only: str | None = None) -> DataFrame:
    """Readable sources that are not switched off (a missing switch means on)."""
    out = sources.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("source_type", F.lit(0)) == 0))
    if for_search:
        out = out.where(F.coalesce("search_url", F.lit("")) != "")
    return out if only is None else out.where(F.col("source_url") == only)


def lookup_source(shelf: DataFrame, sources: DataFrame) -> DataFrame:
    """Each book with its source; ``source_missing`` marks books whose source is gone.

    The names are stored first: should they be too many to broadcast, both sides of the join are plain shuffles, of
    which Spark splits a source with very many books.
    """
    known = sources.groupBy("source_url").agg(F.min_by("source_name", "ord").alias("found_name"))
    known = stored_table(known, "source-names")
    return shelf.join(known, "source_url", "left").withColumn("source_missing", F.col("found_name").isNull())
