"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut_lineage, in_few_tasks


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether every node is tied to one smaller node, which itself is tied to none."""
    smaller = edges.select(F.col("v").alias("u")).distinct()
    twice, between = edges.groupBy("u").count().where("count > 1"), edges.join(smaller, "u", "left_semi")
    return in_few_tasks(twice, n).isEmpty() and in_few_tasks(between, n).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b) that is linked to another one; a component is named by its
    smallest node.

    Large-star and small-star steps in turn: first every larger neighbour, then every smaller one, is tied to the
    smallest neighbour, until only stars are left. The number of rounds grows with the logarithm of the longest path,
    and links never become more, so the number of tasks of every step follows the number of links. Smallest neighbours
    are stored before they are joined, so Spark can split the links of a node that has very many.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    )
    n = edges.count()
    edges = in_few_tasks(edges, n)
    while not _stars(edges, n):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        low = cut_lineage(in_few_tasks(low, n))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(in_few_tasks(in_few_tasks(large, n).distinct(), n))
        low = cut_lineage(in_few_tasks(large.groupBy("u").agg(F.min("v").alias("m")), n))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = in_few_tasks(small.unionByName(low.select("u", F.col("m").alias("v"))), n)
        edges = cut_lineage(in_few_tasks(small.distinct(), n))
    roots = in_few_tasks(edges.select(F.col("v").alias("node")).distinct(), n).withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
