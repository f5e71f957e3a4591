"""Regex rows and rewrites."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import WS

DOT_ALL = "(?s)"
ITEM = "array<struct<text:string,captures:array<string>>>"
# What ends a line in browsers.
LINE_ENDS = r"\n\r\x{2028}\x{2029}"


def group_count(pattern: str, spark: SparkSession | None = None) -> int | None:
    """Number of groups of a Java pattern, None if the JVM does not accept it.

    Asked on the driver when a plan is made, before any row is touched.
    """
    session = spark or SparkSession.active()
    try:
        return session._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, PySparkException):
        return None


def compiles(spark: SparkSession, pattern: str) -> bool:
    return group_count(pattern, spark) is not None


def regex_items(raw: Column, pattern: str, groups: int, reverse: bool = False) -> Column:
    """All matches as ARRAY<STRUCT<text, captures>>; captures[0] is the whole match. A bad pattern matches nothing."""
    java = DOT_ALL + java_pattern(pattern, dot_all=True)
    there = group_count(java)
    if there is None:
        return F.array().cast(ITEM)
    per_group = [F.regexp_extract_all(raw, F.lit(java), F.lit(g)) for g in range(min(groups, there) + 1)]
    zipped = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(per_group)])
    items = F.transform(
        zipped,
        lambda z: F.struct(
            z["g0"].alias("text"), F.array(*[F.coalesce(z[f"g{i}"], F.lit("")) for i in range(len(per_group))]).alias("captures")
        ),
    )
    return F.reverse(items) if reverse else items


def capture(item: Column, n: int) -> Column:
    """Capture ``n`` of one match, '' when the pattern has no such group."""
    return F.coalesce(F.get(item["captures"], F.lit(n)), F.lit(""))


def regex_values(text: Column, pattern: str) -> Column:
    """First group of each match, or the whole match when the pattern has no group. A bad pattern matches nothing."""
    java = DOT_ALL + java_pattern(pattern, dot_all=True)
    there = group_count(java)
    if there is None:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(java), F.lit(min(there, 1)))


def java_pattern(pattern: str, multiline: bool = False, dot_all: bool = False, shift: int = 0) -> str:
    """The browser dialect in Java's.

    A bare ``$`` means the very end (Java would also accept a final line feed), or the end of a line where
    ``multiline`` is set; ``.`` stops at the browsers' line ends; ``\\s`` is the full web white space,
    ``\\u{...}`` a code point, and ``&&`` in a class two plain signs. References to groups go up by ``shift``.
    """
    line_start, line_end = f"(?<![^{LINE_ENDS}])", f"(?![^{LINE_ENDS}])"
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch, two = pattern[i], pattern[i : i + 2]
        if ch == "\\" and len(two) == 2:
            if two == r"\s":
                out.append(WS if in_class else f"[{WS}]")
            elif two == r"\S" and not in_class:
                out.append(f"[^{WS}]")
            elif pattern.startswith(r"\u{", i):
                out.append(r"\x")
            elif shift and not in_class and two[1] in "123456789":
                end = i + 2
                while end < len(pattern) and pattern[end].isdigit():
                    end += 1
                out.append(f"\\{int(pattern[i + 1 : end]) + shift}")
                i = end
                continue
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            out.append(f"\\{ch}" if ch in "[&" else ch)
        elif ch == "$":
            out.append(line_end if multiline else r"\z")
        elif ch == "^" and multiline:
            out.append(line_start)
        elif ch == "." and not dot_all:
            out.append(f"[^{LINE_ENDS}]")
        else:
            out.append(ch)
        in_class = (ch == "[") or (in_class and ch != "]")
        i += 1
    return "".join(out)


def java_replacement(text: str, groups: int, shift: int = 0) -> str:
    """``$1`` groups stay live if the pattern has them, ``$&`` is the match and ``$$`` a plain sign.

    ``shift`` is how many groups stand before the pattern's own; one of them then holds what lies before
    the match, so the match itself is the last of them.
    """
    out, i = [], 0
    while i < len(text):
        ch, after = text[i], text[i + 1 : i + 2]
        if ch != "$":
            out.append("\\\\" if ch == "\\" else ch)
            i += 1
        elif after == "$":
            out.append("\\$")
            i += 2
        elif after == "&":
            out.append(f"${shift}")
            i += 2
        else:
            digits = next((d for d in (text[i + 1 : i + 3], after) if d.isdigit() and d.isascii() and 1 <= int(d) <= groups), "")
            out.append(f"${int(digits) + shift}" if digits else "\\$")
            i += 1 + len(digits)
            if digits and text[i : i + 1].isdigit():
                out.append(f"\\{text[i]}")  # a digit that is not part of the number
                i += 1
    return "".join(out)


def rewrite_all(text: Column, pattern: str, by: str) -> Column:
    """Replace every match; a bad pattern changes nothing."""
    java = java_pattern(pattern)
    groups = group_count(java)
    return text if groups is None else F.regexp_replace(text, java, java_replacement(by, groups))


def rewrite_first(text: Column, pattern: str, by: str) -> Column:
    """Replace only the first match; a bad pattern, or a text without a match, changes nothing.

    The whole text is matched once, so the pattern may look at what stands around the match.
    """
    groups = group_count(java_pattern(pattern))
    if groups is None:
        return text
    whole = rf"\A([\s\S]*?)({java_pattern(pattern, shift=2)})"
    return F.regexp_replace(text, whole, "$1" + java_replacement(by, groups, 2))
