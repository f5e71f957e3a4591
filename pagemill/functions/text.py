"""Whitespace, emptiness and line helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters web pages and browsers treat as white space.
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set for use inside a regex character class.
WS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same set without the line feed, for patterns that must stay on one line.
WS_INLINE = WS.replace(r"\t-\r", r"\t\x0B-\r")


def js_trim(c: Column) -> Column:
    """Strip the full web white space set (Spark's trim only knows the blank)."""
    return F.btrim(c, F.lit(WS_CHARS))


def strip_ws(c: Column) -> Column:
    """Remove every white space character."""
    return F.translate(c, WS_CHARS, "")


def nonblank(c: Column) -> Column:
    """The value itself, or NULL when it is blank after trimming."""
    return let(c, lambda x: F.when(js_trim(x) != "", x))


def let(value: Column, body) -> Column:
    """Name an intermediate value inside one expression, so it is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_newlines(c: Column) -> Column:
    """Drop one leading byte order mark, then turn CRLF and CR into LF."""
    no_bom = F.regexp_replace(c, r"\A\x{FEFF}", "")
    return F.regexp_replace(no_bom, "\r\n?", "\n")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def clean_lines(c: Column) -> Column:
    """Trim each line, drop the blank ones, join the rest again."""
    return F.array_join(F.filter(F.transform(lines(c), js_trim), lambda x: x != ""), "\n")


def quote_regex(text: str) -> str:
    """A Java pattern that matches exactly ``text``."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quote_replacement(text: str) -> str:
    """A Java replacement string that inserts exactly ``text``."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def prefix_sums(sizes: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an INT array.

    Appending inside one long fold copies the array at every step, so the array is cut into
    blocks: folds stay short and the whole costs O(n * block) instead of O(n * n).
    """

    def running(arr: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            arr,
            zero,
            lambda s, x: F.struct(
                (s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"]).alias("out")
            ),
        )

    n = F.size(sizes)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / block).cast("int"), F.lit(0))),
        lambda b: running(F.slice(sizes, b * block + 1, block)),
    )

    def stitch(done: Column) -> Column:
        starts = running(F.transform(done, lambda b: b["sum"]))["out"]
        return F.flatten(
            F.transform(done, lambda b, i: F.transform(b["out"], lambda x: x + F.get(starts, i)))
        )

    return F.when(n > 0, let(blocks, stitch)).otherwise(F.array().cast("array<int>"))
