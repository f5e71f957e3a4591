"""Request tables: active sources x search terms x result pages."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, quote_regex
from ..functions.urls import ABSOLUTE, encode_component, resolve_url

FORM = "application/x-www-form-urlencoded"
OPTIONS = "struct<method:string,body:string,charset:string,headers:map<string,string>>"
LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
# Fixed value: how a template may name the search key.
KEY_FORMS = r"\{\{\s*(?:key|(?i:(?:java\.)?encodeURI(?:Component)?)\(\s*key(?:\s*,\s*['\"][^'\"]+['\"])?\s*\))\s*\}\}"


# Fixed value: what an expression over the page may be written with.
PAGE_ARITHMETIC = r"\A[0-9\s()+\-*/%.page]+\z"


def _divide(a: float, b: float) -> float:
    return a / b if b else math.copysign(math.inf, a) if a else math.nan


_OPERATIONS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: _divide,
    ast.Mod: lambda a, b: math.fmod(a, b) if b else math.nan,
    ast.USub: operator.neg,
    ast.UAdd: operator.pos,
}


def page_value(expression: str, page: int) -> str | None:
    """Arithmetic over ``page`` as a browser would write its result; None for anything else."""

    def of(node) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, ast.Name) and node.id == "page":
            return float(page)
        if isinstance(node, ast.BinOp):
            return _OPERATIONS[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.UnaryOp):
            return _OPERATIONS[type(node.op)](of(node.operand))
        raise KeyError(node)

    try:
        value = of(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, KeyError, ValueError, OverflowError, RecursionError):
        return None
    if math.isnan(value) or math.isinf(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


def page_values(sources: DataFrame, pages: int) -> dict[str, list[str]]:
    """The page arithmetic found in the sources' templates: each distinct expression with its value on every page.

    Only expressions that pass the whitelist come to the driver; they are part of the catalog's configuration.
    """
    named = sources.select(F.explode(F.regexp_extract_all("search_url", F.lit(r"\{\{(.*?)\}\}"), F.lit(1))).alias("e")).distinct()
    fits = F.col("e").rlike(PAGE_ARITHMETIC) & F.contains("e", F.lit("page")) & (js_trim(F.col("e")) != "page")
    found = {r["e"]: [page_value(r["e"], p) for p in range(1, pages + 1)] for r in named.where(fits).collect()}
    return {e: v for e, v in found.items() if None not in v}


def fill_page_values(template: Column, page: Column, values: Mapping[str, list[str]]) -> Column:
    """Put the values of known page expressions in their places; the plan has one lookup, however many there are."""
    if not values:
        return template
    table = F.create_map(*[x for e, v in values.items() for x in (F.lit(e), F.array(*map(F.lit, v)))])
    names = F.regexp_extract_all(template, F.lit(r"\{\{(.*?)\}\}"), F.lit(1))

    def piece(text: Column, i: Column) -> Column:
        name = F.get(names, i)
        value = F.get(F.try_element_at(table, name), page - 1)
        return F.concat(text, F.coalesce(value, F.concat(F.lit("{{"), name, F.lit("}}")), F.lit("")))

    return F.array_join(F.transform(F.split(template, r"\{\{.*?\}\}", -1), piece), "")


def unknown_expressions(template: Column, page_forms: Mapping | None = None) -> Column:
    """What is left in a template that nothing fills, as an array."""
    names = F.regexp_extract_all(template, F.lit(r"(\{\{.*?\}\})"), F.lit(1))
    known = rf"\A(?:{KEY_FORMS}|\{{\{{\s*page\s*\}}\}})\z"
    own = [F.lit(t) for t in page_forms or {}]
    bare = lambda x: js_trim(F.regexp_replace(x, r"\A\{\{|\}\}\z", ""))
    return F.array_distinct(
        F.transform(F.filter(names, lambda x: ~x.rlike(known) & ~(bare(x).isin(own) if own else F.lit(False))), bare)
    )


def expand_template(
    template: Column, key: Column, page: Column, page_forms: Mapping[str, Callable[[Column], Column]] | None = None
) -> Column:
    """Fill ``{{key}}``, ``{{page}}`` and the given page expressions; any other placeholder becomes ''.

    ``page_forms`` maps the text of an expression, such as ``(page-1)*20``, to a function of the page.
    """
    out = F.regexp_replace(template, F.lit(KEY_FORMS), encode_component(F.coalesce(key, F.lit(""))))
    out = F.regexp_replace(out, F.lit(r"\{\{\s*page\s*\}\}"), F.coalesce(page, F.lit(1)).cast("string"))
    for text, form in (page_forms or {}).items():
        value = F.coalesce(form(page).cast("string"), F.lit(""))
        out = F.regexp_replace(out, F.lit(r"\{\{\s*" + quote_regex(text) + r"\s*\}\}"), value)
    return F.regexp_replace(out, r"\{\{.*?\}\}", "")


def merge_headers(own: Column, asked: Column) -> Column:
    """The source's headers, overridden by the request's."""
    none = F.create_map().cast("map<string,string>")
    own, asked = F.coalesce(own, none), F.coalesce(asked, none)
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(asked, k)), asked)


def plan_requests(
    sources: DataFrame,
    terms: list[str],
    pages: int = 1,
    page_forms: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One request per (source, term, page). Needs source_url, search_url and header columns.

    Arithmetic over the page is worked out by itself; ``page_forms`` is for other expressions. ``reason`` names those
    that nothing fills and that were left empty, or is null.
    """
    values = page_values(sources, pages)
    df = sources.withColumn("key", F.explode(F.array(*[F.lit(t) for t in terms])))
    df = df.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    df = df.withColumn("_s", fill_page_values(F.col("search_url"), F.col("page"), values))
    filled = expand_template(F.col("_s"), F.col("key"), F.col("page"), page_forms)
    df = df.withColumn("_t", js_trim(filled)).withColumn("_unknown", unknown_expressions(F.col("_s"), page_forms))
    cut = F.locate(",{", F.col("_t"))
    url = F.when(cut > 0, F.substring(F.col("_t"), F.lit(1), cut - 1)).otherwise(F.col("_t"))
    df = df.withColumns(
        {
            "_url": js_trim(url),
            "_o": F.from_json(
                F.when(cut > 0, F.substring(F.col("_t"), cut + 1, F.length("_t"))), OPTIONS, LENIENT
            ),
        }
    )
    absolute = F.when(F.col("_url").rlike(ABSOLUTE), F.col("_url")).otherwise(
        resolve_url(F.col("_url"), F.col("source_url"))
    )
    df = df.withColumns(
        {
            "_url": absolute,
            "method": F.upper(F.coalesce(F.when(F.col("_o.method") != "", F.col("_o.method")), F.lit("GET"))),
            "_body": F.when(F.col("_o.body") != "", F.col("_o.body")),
            "charset": F.col("_o.charset"),
        }
    )
    in_url = (F.col("method") == "GET") & F.col("_body").isNotNull()
    joiner = F.when(F.contains("_url", F.lit("?")), "&").otherwise("?")
    asked = F.coalesce(F.col("_o.headers"), F.create_map().cast("map<string,string>"))
    typed = F.map_contains_key(asked, "Content-Type") | F.map_contains_key(asked, "content-type")
    asked = F.when(
        F.col("_body").isNotNull() & ~in_url & ~typed,
        F.map_concat(asked, F.create_map(F.lit("Content-Type"), F.lit(FORM))),
    ).otherwise(asked)
    return df.select(
        "source_url",
        "key",
        "page",
        F.when(in_url, F.concat("_url", joiner, "_body")).otherwise(F.col("_url")).alias("url"),
        "method",
        merge_headers(F.col("header"), asked).alias("headers"),
        F.when(~in_url, F.col("_body")).alias("body"),
        "charset",
        F.when(F.size("_unknown") > 0, F.concat(F.lit("unknown expression: "), F.array_join("_unknown", ", "))).alias("reason"),
    )
