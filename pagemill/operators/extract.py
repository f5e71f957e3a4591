"""Rows and fields out of shredded pages, JSON responses and raw text."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.text import js_trim

Field = Callable[[Column, Column], Column]


def response_kind(text: Column) -> Column:
    """'json' for a text that starts like JSON and is valid, else 'html'."""
    t = js_trim(text)
    return F.when(t.rlike(r"\A[{\[]") & F.try_parse_json(t).isNotNull(), "json").otherwise("html")


def node_rows(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The table form of ``nodes``: one row per node, for joins by (page, pre BETWEEN ...)."""
    n = F.col("n")
    fields = ["pre", "fin", "parent", "rank", "tag", "cls", "attrs", "text"]
    return pages.select(*keys, F.explode("nodes").alias("n")).select(*keys, *[n[f].alias(f) for f in fields])


def item_rows(
    pages: DataFrame,
    keep: list[str],
    items: Column,
    fields: Mapping[str, Field],
    where: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per selected item, each field computed from (nodes, item); no shuffle.

    The rows are built inside the page's row and then unfolded, so the nodes are not copied once per
    item. ``where`` filters them there too: a filter on the result would compute the fields twice.
    """
    nodes = F.col("nodes")

    def row(pre: Column, i: Column) -> Column:
        return F.struct(i.alias("ord"), *[f(nodes, pre).alias(name) for name, f in fields.items()])

    rows = F.transform(items, row)
    return pages.select(*keep, F.inline(rows if where is None else F.filter(rows, where)))


def json_rows(
    responses: DataFrame,
    keep: list[str],
    items: Column,
    fields: Mapping[str, Callable[[Column, Column], Column]],
    where: Callable[[Column], Column] | None = None,
    doc: str = "v",
) -> DataFrame:
    """The same for JSON responses: one row per item of a list of VARIANT, each field from (document, item).

    Columns that depend on the document alone belong into ``keep``, so they are worked out once per response.
    """

    def row(item: Column, i: Column) -> Column:
        return F.struct(i.alias("ord"), *[f(F.col(doc), item).alias(name) for name, f in fields.items()])

    rows = F.transform(items, row)
    return responses.select(*keep, F.inline(rows if where is None else F.filter(rows, where)))


def link_edges(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page, href, absolute url) for every anchor with an href."""
    anchors = dom.select(F.col("nodes"), dom.Step(tag="a", attr="href"))
    fields = {
        "href": lambda n, p: dom.attr(n, p, "href"),
        "target": lambda n, p: dom.attr(n, p, "href", F.col(url)),
    }
    return item_rows(pages, [page_id], anchors, fields)


def link_degrees(edges: DataFrame, page_id: str = "page_id") -> DataFrame:
    """How many links leave each page and to how many different targets."""
    per_target = edges.groupBy(page_id, "target").agg(F.count("*").alias("n"))
    return per_target.groupBy(page_id).agg(F.sum("n").alias("out_links"), F.count("*").alias("out_targets"))


def with_hook(values: Column, hook: Callable[[Column], Column], replace: Callable[[Column], Column] | None = None) -> Column:
    """A user's own stage between selecting a value and rewriting it."""
    out = hook(values)
    return out if replace is None else replace(out)
