"""Following 'next page' links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# From how many pages on a chain counts as unusually long. Longer ones are followed all the same.
TOC_PAGES = 20
CONTENT_PAGES = 10



def follow(starts: DataFrame, links: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Pages reached from each start: (keys, page_no from 1, url), none twice, at most ``limit`` if one is given.

    ``starts`` has the keys and ``url``; ``links`` has ``url`` and ``next_url``. Both what is known of the chains and the
    links double in length with every stored round: the pages of a chain up to n, each moved on by n, are its pages up to
    2n, and a link over n pages followed by another is one over 2n. A chain that runs back into itself meets pages it
    has already; they keep their first place, and the loop ends when a round adds nothing. So a chain of n pages takes
    about log2(n) rounds, and no list of a chain's pages is carried along.
    """
    step = links.where(F.coalesce("next_url", F.lit("")) != "").groupBy("url").agg(F.min("next_url").alias("_to"))
    jump = cut_lineage(step.withColumnRenamed("url", "_from"))
    known = starts.select(*keys, "url", F.lit(1).alias("page_no")).distinct()
    reach, size = 1, None
    while limit is None or reach < limit:
        onward = known.join(jump, F.col("url") == F.col("_from")).select(
            *keys, F.col("_to").alias("url"), (F.col("page_no") + reach).alias("page_no")
        )
        if limit is not None:
            onward = onward.where(F.col("page_no") <= limit)
        known = cut_lineage(known.unionByName(onward).groupBy(*keys, "url").agg(F.min("page_no").alias("page_no")))
        reach *= 2
        before, size = size, known.count()
        if size == before:
            break
        after = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_end"))
        jump = cut_lineage(jump.join(after, "_to").select("_from", F.col("_end").alias("_to")))
        if jump.isEmpty():
            break
    return known.select(*keys, "page_no", "url")
