"""Putting alternative, joined and interleaved field values together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, nonblank


def first_value(*alternatives: Column) -> Column:
    """First alternative that is not blank; '' when there is none."""
    return F.coalesce(*[nonblank(a) for a in alternatives], F.lit(""))


def first_list(*alternatives: Column) -> Column:
    """First alternative list that has an item (NULL counts as empty)."""
    out = F.when(F.size(alternatives[-1]) > 0, alternatives[-1])
    for a in reversed(alternatives[:-1]):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def join_segments(*segments: Column) -> Column:
    """Each segment's matches run together, the segments joined by a line feed."""
    return F.concat_ws("\n", *[F.array_join(s, "") for s in segments])


def interleave(*lists: Column) -> Column:
    """a1, b1, a2, b2, ... with the longer list's rest kept at the end."""
    longest = F.greatest(*[F.size(x) for x in lists]) if len(lists) > 1 else F.size(lists[0])

    def merge(n: Column) -> Column:
        rounds = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.filter(
                F.array(*[F.struct((i < F.size(x)).alias("there"), F.get(x, i).alias("v")) for x in lists]),
                lambda p: p["there"],
            ),
        )
        return F.transform(F.flatten(rounds), lambda p: p["v"])

    return let(longest, merge)
