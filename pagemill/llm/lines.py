"""Quality rules that clean line by line first, then judge documents by what they lost."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from pagemill.llm.common import Spans, Texts, Words, mix64, row_blocks

SYMBOLS = "#*$%&|<>"
NOTICE = re.compile("licen[sc]ed under|released under|all rights reserved", re.ASCII | re.IGNORECASE)
"""Licence notices go, but say nothing about the text around them and do not count as lost."""
BOILERPLATE = re.compile(
    "terms of (?:use|service)|privacy policy|(?:accept|use) cookies|cookie policy|subscribe to our|sign up for|click here"
    "|skip to (?:main )?content|back to top|follow us on",
    re.ASCII | re.IGNORECASE,
)
MAX_SYMBOLS = 0.25
"""A line fails the punctuation rule beyond so many symbols per word."""
MIN_BARS = 3
"""A line is navigation if it has so many separate bars and they are a fifth of its words or more."""
MAX_ECHO = 0.2
"""A line fails the repetition rule if more of its words than this equal the word before."""
MAX_LOST = 0.5
"""A document is rejected if more of its words than this stand in failed lines."""
PROSE = 40
"""In a line of more words than this a phrase is part of what the line says, not what the line is."""
_BASE = 0x8CB92BA72F3D8DD7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def repeat_words(words: Words, hashes: np.ndarray, width: int = 8) -> np.ndarray:
    """Which words stand in a window of ``width`` words that its row has twice or more."""
    n = len(hashes)
    out = np.zeros(n, bool)
    if n >= width:
        at = np.flatnonzero(words.row_end() - np.arange(n) >= width)
        row = words.row()[at].astype(np.uint64)
        key = mix64(Spans(hashes, _BASE).of(at, at + width) ^ mix64(row + np.uint64(1)))
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            begin = at[twice[spot] == key]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + width, -1)
            out = np.cumsum(cover)[:-1] > 0
    return out


def _per(index: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weight, n).astype(np.int64)


def judge(column: pa.Array, prose: int | None = None) -> dict[str, list | np.ndarray]:
    """Counts and verdicts of some texts, and the texts without their failed lines.

    With ``prose``, phrases and notices say nothing about lines of more words than that, and a text of which no word
    would stay is not kept.
    """
    texts = Texts(column)
    words = texts.words()
    data, rows = texts.data, len(words.count)
    h = words.hashes()
    row = words.row()
    shift = np.append(0, np.cumsum(data == 10))  # line feeds before each byte
    first_line = shift[texts.offsets] + np.arange(rows + 1)
    n_lines = int(first_line[-1])
    line = shift[words.start] + row
    in_line = _per(line, n_lines)
    symbols = _SYMBOL[data]
    spot = np.flatnonzero(symbols)
    spot_row = np.searchsorted(texts.offsets, spot, side="right") - 1
    symbols_in_line = _per(shift[spot] + spot_row, n_lines)
    bar = (words.end - words.start == 1) & (data[words.start] == ord("|"))
    bars = _per(line[bar], n_lines)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    echoes = _per(line[echo], n_lines)
    failed = (
        (symbols_in_line > MAX_SYMBOLS * in_line)
        | ((bars >= MIN_BARS) & (5 * bars >= in_line))
        | (echoes > MAX_ECHO * in_line)
    ) & (in_line > 0)
    phrased = (in_line > 0) & (in_line <= prose) if prose is not None else in_line > 0
    doubled = np.zeros(rows, np.int64)
    notice = np.zeros(n_lines, bool)
    clean = []
    for i, text in enumerate(column.to_pylist()):
        if text is None:
            clean.append(None)
            continue
        lines = text.split("\n")
        a, b = first_line[i], first_line[i + 1]
        solid = in_line[a:b] > 0
        if len(lines) > 1:
            seen = set()
            for j, part in enumerate(lines):
                if solid[j]:
                    if part in seen:
                        doubled[i] += 1
                        failed[a + j] = True
                    seen.add(part)
        for pattern, mark in ((BOILERPLATE, failed), (NOTICE, notice)):
            if pattern.search(text):
                for j, part in enumerate(lines):
                    if phrased[a + j] and pattern.search(part):
                        mark[a + j] = True
        bad = failed[a:b] | notice[a:b]
        clean.append("\n".join([part for part, out in zip(lines, bad) if not out]) if bad.any() else text)
    inside = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = np.append(0, np.cumsum(inside[words.end] - inside[words.start]))[words.first]
    repeats = np.append(0, np.cumsum(repeat_words(words, h)))[words.first]
    lost = np.append(0, np.cumsum(np.where(failed & ~notice, in_line, 0)))[first_line]
    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": np.diff(chars),
        "n_symbols": np.diff(np.append(0, np.cumsum(symbols))[texts.offsets]),
        "n_dup_lines": doubled,
        "n_repeat_words": np.diff(repeats),
        "n_lost_words": np.diff(lost),
    }
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["n_lost_words"] <= MAX_LOST * out["n_words"])
    if prose is not None:
        out["kept"] &= np.diff(np.append(0, np.cumsum(np.where(failed | notice, 0, in_line)))[first_line]) > 0
    out["clean_text"] = clean
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]


def apply_rules(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each row, with ``clean_text`` if asked for. One pass, no shuffle.

    A line fails if it has too many symbols for its words, is a navigation bar, echoes words, is a known phrase of
    menus, or repeats an earlier line of its document. Failed lines go, and so do licence notices. A document goes if the
    base rules fail, or if more than half of its words stood in failed lines. Null and empty texts have no words, so the base
    rules reject them.
    """
    keys = docs.select("doc_id", "text")
    fields = [keys.schema["doc_id"], *(StructField(n, LongType()) for n in COUNTS)]
    fields += [StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
    fields += [StructField("clean_text", StringType())] if with_text else []
    names = [f.name for f in fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = judge(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(found[n]) for n in names)], [fields[0].name, *names]
                )

    return keys.mapInArrow(run, StructType(fields))


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected documents, the others without their failed lines; ``n_chars`` follows the text.

    The rules are those of :func:`apply_rules`, except that a phrase or notice inside a line of more than ``PROSE`` words
    is left where it stands, and a document that would lose all its words goes.
    """
    columns = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index("text")
            for lo, hi in row_blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                found = judge(part.column(at), PROSE)
                own = [pa.array(found["clean_text"], pa.string()) if n == "text" else part.column(n) for n in columns]
                yield pa.RecordBatch.from_arrays(own, columns).filter(pa.array(found["kept"]))

    kept = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, list_slice(w, i, i + 7) as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
cov as (select doc_id, count(distinct i + j)::bigint as n from rep, range(0, 8) r(j) group by doc_id),
cut as (select doc_id, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as n from d),
l as (
  select *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as lw, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as symbols,
    row_number() over (partition by doc_id, x order by n) > 1 as again
  from cut),
f as (
  select doc_id, len(lw) as words, len(lw) > 0 and again as doubled,
    len(lw) > 0 and (
      symbols > 0.25 * len(lw)
      or (len(list_filter(lw, lambda y: y = '|')) >= 3 and 5 * len(list_filter(lw, lambda y: y = '|')) >= len(lw))
      or len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) > 0.2 * len(lw)
      or again
      or regexp_matches(x, '(?i)terms of (?:use|service)|privacy policy|(?:accept|use) cookies|cookie policy|subscribe to our|sign up for|click here|skip to (?:main )?content|back to top|follow us on')
    ) as failed,
    regexp_matches(x, '(?i)licen[sc]ed under|released under|all rights reserved') as notice
  from l),
s as (
  select doc_id, count(*) filter (where doubled) as n_dup_lines,
    coalesce(sum(words) filter (where failed and not notice), 0)::bigint as n_lost_words
  from f group by doc_id),
b as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, n_dup_lines, coalesce(cov.n, 0) as n_repeat_words,
    n_lost_words
  from d join s on s.doc_id = d.doc_id left join cov on cov.doc_id = d.doc_id),
g as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select *, not base_failed and n_lost_words <= 0.5 * n_words as kept from g
"""
