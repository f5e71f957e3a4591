"""Selections over the node table (one row per node), for pages too large for nested arrays.

A step is a join of two sets of nodes of a page by their place in it. Roots and candidates are swept together in document
order, so a step costs a sort, never a product of the page with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dom import Step, matches

NODE = ["pre", "fin", "parent", "rank"]


def select_rows(nodes: DataFrame, keys: list[str], *steps: Step) -> DataFrame:
    """(keys, ord, pre, fin): what the steps select on each page, in the order of ``dom.select``.

    ``nodes`` is ``extract.node_rows``. Results come root by root, in document order below each root, each once: a node
    that several roots reach is the first one's. A root that contains another always comes before it, whatever the
    steps, so of the roots around a node the outermost is the first. Texts (``Step.contains``) need the array form.
    """
    found = None
    for step in steps:
        if step.contains:
            raise ValueError("a step that looks at the text contained needs dom.select")
        row = {n: F.col(n) for n in [*NODE, "tag", "cls", "attrs", "text"]}
        candidates = nodes.where(matches(row, step)).select(*keys, *NODE)
        if found is None:
            found = _from_document(candidates, step)
        elif step.sibling == "~":
            found = _later_siblings(found, candidates, keys)
        elif step.sibling or step.child:
            found = _next_to(found, candidates, keys, step)
        else:
            found = _below(found, candidates, keys, step.include_self)
        if step.include_self and (step.sibling or step.child):
            raise ValueError("only a step to all nodes below may include the roots")
    order = Window.partitionBy(*keys).orderBy("_root", "pre")
    return found.select(*keys, (F.row_number().over(order) - 1).alias("ord"), "pre", "fin")


def _from_document(candidates: DataFrame, step: Step) -> DataFrame:
    if step.sibling:
        candidates = candidates.where(F.lit(False))
    elif step.child:
        candidates = candidates.where(F.col("parent") < 0)
    return candidates.withColumn("_root", F.lit(0).cast("long"))


def _numbered(found: DataFrame, keys: list[str]) -> DataFrame:
    """Roots with their place in the selection."""
    order = Window.partitionBy(*keys).orderBy("_root", "pre")
    return found.withColumn("_root", F.row_number().over(order).cast("long"))


def _next_to(found: DataFrame, candidates: DataFrame, keys: list[str], step: Step) -> DataFrame:
    """Children and next siblings: every node has one parent and one element before it, so this is a join by value."""
    roots = _numbered(found, keys)
    if step.sibling:
        roots = roots.select(*keys, "parent", (F.col("rank") + 1).alias("rank"), "_root")
        return candidates.join(roots, [*keys, "parent", "rank"])
    return candidates.join(roots.select(*keys, F.col("pre").alias("parent"), "_root"), [*keys, "parent"])


def _later_siblings(found: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Elements behind a root under the same parent; the first of the roots before them counts."""
    before = Window.partitionBy(*keys, "parent").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    roots = _numbered(found, keys).select(*keys, *NODE, "_root", F.lit(False).alias("_wanted"))
    both = candidates.withColumn("_root", F.lit(None).cast("long")).withColumn("_wanted", F.lit(True)).unionByName(roots)
    swept = both.withColumn("_root", F.min("_root").over(before))
    return swept.where(F.col("_wanted") & F.col("_root").isNotNull()).drop("_wanted")


def _below(found: DataFrame, candidates: DataFrame, keys: list[str], include_self: bool) -> DataFrame:
    """Nodes below a root. Roots inside others add nothing, and the rest do not overlap: the last one that began before a
    node is the one around it, if it has not ended yet."""
    page = Window.partitionBy(*keys).orderBy("pre")
    reached = F.max("fin").over(page.rowsBetween(Window.unboundedPreceding, -1))
    roots = _numbered(found, keys).withColumn("_reached", F.coalesce(reached, F.lit(-1))).where("_reached < pre")
    span = F.struct("fin", "_root")
    roots = roots.select(*keys, *NODE, span.alias("_span"), F.lit(False).alias("_wanted"))
    none = F.lit(None).cast("struct<fin:int,_root:bigint>")
    both = candidates.withColumn("_span", none).withColumn("_wanted", F.lit(True)).unionByName(roots)
    # A root is no node below itself: at one place candidates are met before roots, or after if they may be the same.
    place = Window.partitionBy(*keys).orderBy("pre", F.desc("_wanted") if not include_self else "_wanted")
    around = F.last("_span", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = both.withColumn("_span", around).where(F.col("_wanted") & (F.col("_span.fin") >= F.col("pre")))
    return swept.select(*keys, *NODE, F.col("_span._root").alias("_root"))


def own_texts(nodes: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """The selected rows with ``own``: the texts right under each node, joined in document order."""
    texts = nodes.where(F.col("text").isNotNull()).select(*keys, F.col("parent").alias("pre"), F.struct("pre", "text").alias("_t"))
    joined = texts.groupBy(*keys, "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_t")), lambda t: t["text"]), "").alias("own"))
    return selected.join(joined, [*keys, "pre"], "left").withColumn("own", F.coalesce("own", F.lit("")))
