"""Substring dedup over a compacted de Bruijn graph of word windows.

The graph's edges are windows of ``window`` consecutive words. Windows that follow each other and share their smallest
k-mer lie on one path without a branch inside, so they are compacted into one piece: its coordinates and one hash of
its words. Equal pieces of different documents meet in a join on that hash; where paths part, at the ends of a shared
passage, pieces differ although they share a k-mer, and only those are opened into single windows. Consecutive
repeated pieces make up a repeated span. Before words are cut, the words at a span's coordinates are hashed again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagemill.llm.common import Spans, Texts, Words, row_blocks
from pagemill.session import cut_lineage

WINDOW = 50
KMER = 12
_ONE, _TWO = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_PLACE = np.uint64((1 << 28) - 1)


def pieces(words: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """The compacted pieces of some texts: (row, first word, windows, smallest k-mer, hash, second hash)."""
    h = words.hashes()
    n = len(h)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    one, two = Spans(h, _ONE), Spans(h, _TWO)
    at = np.arange(n - k + 1)
    kmers = two.of(at, at + k)
    # Smallest k-mer of each window; equal ones by place, so that it depends on the window's words alone.
    low = (kmers & ~_PLACE) | (at.astype(np.uint64) & _PLACE)
    width, span = window - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    begin = np.flatnonzero(words.row_end()[: len(low)] - np.arange(len(low)) >= window)
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    spot = low[begin] & _PLACE
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1] + 1) | (spot[1:] != spot[:-1])
    first = np.flatnonzero(new)
    lo, hi = begin[first], begin[np.append(first[1:], len(begin)) - 1]
    row = np.searchsorted(words.first, lo, side="right") - 1
    mark = kmers[lo + ((spot[first].astype(np.int64) - lo) & int(_PLACE))]
    stop = hi + window
    return (
        row,
        lo - words.first[row],
        hi - lo + 1,
        mark.view(np.int64),
        one.of(lo, stop).view(np.int64),
        two.of(lo, stop).view(np.int64),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of both, which tells repeated ids apart and is never null."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "text", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2")
    )


def _piece_table(keyed: DataFrame, window: int, k: int, brief: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column("text")):
                rows = batch.slice(lo, hi - lo)
                row, start, count, mark, one, two = pieces(Texts(rows.column("text")).words(), window, k)
                own = [rows.column(c).take(pa.array(row)) for c in ("doc_id", *([] if brief else ["k1", "k2"]))]
                values = (mark,) if brief else (mark, start, count, one, two)
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, values)], names)

    names = ["doc_id", "mark"] if brief else ["doc_id", "k1", "k2", "mark", "start", "windows", "h1", "h2"]
    fields = [keyed.schema["doc_id"], *(StructField(n, LongType()) for n in names[1:])]
    columns = ["doc_id", "text"] if brief else ["doc_id", "k1", "k2", "text"]
    return keyed.where("doc_id is not null").select(*columns).mapInArrow(run, StructType(fields))


def _open(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The single windows of the pieces listed with each text."""
    names = ["doc_id", "k1", "k2", "mark", "start", "windows", "h1"]
    for batch in batches:
        for a, b in row_blocks(batch.column("text")):
            rows = batch.slice(a, b - a)
            words = Texts(rows.column("text")).words()
            one = Spans(words.hashes(), _ONE)
            row, at, mark = [], [], []
            for i, parts in enumerate(rows.column("parts").to_pylist()):
                for part in parts:
                    row.append(np.full(part["windows"], i))
                    at.append(np.arange(part["windows"]) + part["start"])
                    mark.append(np.full(part["windows"], part["mark"]))
            row, at, mark = map(np.concatenate, (row, at, mark))
            begin = at + words.first[row]
            hashes = one.of(begin, begin + window).view(np.int64)
            own = [rows.column(c).take(pa.array(row)) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (mark, at, np.ones_like(at), hashes))], names)


def repeated(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and for each key the list of its pieces that start in a document with a smaller id.

    Texts are read twice and shuffled once. First only k-mers and ids move, to find the k-mers that occur in more than
    one document; then the pieces with such a k-mer. Every repeated window has its smallest k-mer in common with its
    copy, so none is missed.
    """
    keyed = _keyed(docs)
    marks = cut_lineage(
        _piece_table(keyed, window, k, brief=True)
        .groupBy("mark")
        .agg(F.min("doc_id").alias("_min"), F.max("doc_id").alias("_max"))
        .where("_min < _max")
        .select("mark")
    )
    found = cut_lineage(_piece_table(keyed, window, k, brief=False).join(marks, "mark"))
    same = ["mark", "h1", "h2"]
    kinds = cut_lineage(found.groupBy(*same).agg(F.min("doc_id").alias("first_doc")))
    forks = cut_lineage(kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"))
    known = found.join(kinds, same)
    whole = known.where("first_doc < doc_id").select("k1", "k2", "start", "windows", "h1")
    parts = (
        known.where("first_doc = doc_id")
        .join(forks, "mark")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "windows", "mark")).alias("parts"))  # once for all repeated rows
    )
    fields = [docs.schema["doc_id"], *(StructField(n, LongType()) for n in ("k1", "k2", "mark", "start", "windows", "h1"))]
    single = (
        keyed.join(parts, ["k1", "k2"])
        .select("doc_id", "k1", "k2", "text", "parts")
        .mapInArrow(lambda batches: _open(batches, window), StructType(fields))
    )
    earliest = single.groupBy("mark", "h1").agg(F.min("doc_id").alias("first_doc"))
    again = (
        single.join(earliest, ["mark", "h1"])
        .where("first_doc < doc_id")
        .select("k1", "k2", "start", "windows", "h1")
    )
    spans = whole.unionByName(again).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("start", "windows", "h1")).alias("spans")
    )
    return keyed, spans


def kept_words(words: Words, spans: list, window: int) -> np.ndarray:
    """Which words stay when the words under the listed pieces go. Pieces must hash to what was found."""
    keep = np.ones(len(words.start), bool)
    if any(spans):
        row = np.concatenate([np.full(len(s or ()), i) for i, s in enumerate(spans)]).astype(np.int64)
        flat = [p for s in spans for p in s or ()]
        lo = words.first[row] + np.array([p["start"] for p in flat])
        hi = lo + np.array([p["windows"] for p in flat]) + (window - 1)
        hashes = np.array([p["h1"] for p in flat], np.int64)
        fits = hi <= words.first[row + 1]
        lo, hi, hashes = lo[fits], hi[fits], hashes[fits]
        true = Spans(words.hashes(), _ONE).of(lo, hi).view(np.int64) == hashes
        cover = np.zeros(len(keep) + 1, np.int64)
        np.add.at(cover, lo[true], 1)
        np.add.at(cover, hi[true], -1)
        keep = np.cumsum(cover)[:-1] == 0
    return keep


def joined_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one blank: all bytes, and where each row's begin."""
    data = words.data
    mark = np.zeros(len(data) + 1, np.int8)
    mark[words.start[keep]] += 1
    mark[words.end[keep]] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    own = words.row()[keep]
    parted = np.flatnonzero(own[1:] == own[:-1])  # a word of the same row follows, so white space does
    blank = words.end[keep][parted]
    out = data.copy()
    out[blank] = 32
    inside[blank] = True
    sizes = np.concatenate([[0], np.cumsum(inside)])
    return out[inside], sizes


def _apply(keyed: DataFrame, spans: DataFrame, make: Callable, fields: list[StructField], window: int) -> DataFrame:
    """``make`` on blocks of (carried, text) with the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_blocks(batch.column(1)):
                rows = batch.slice(a, b - a)
                texts = Texts(rows.column(1))
                words = texts.words()
                yield make(rows, texts, words, kept_words(words, rows.column(2).to_pylist(), window))

    joined = keyed.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    return joined.mapInArrow(run, StructType(fields))


def digests(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row.

    Rows without a doc_id neither lose words nor make others lose any. Rows that share a doc_id do not count as
    repeats of each other. Null and empty texts have no words; their hash is that of nothing.
    """
    keyed, spans = repeated(docs, window, k)

    def make(rows: pa.RecordBatch, texts: Texts, words: Words, keep: np.ndarray) -> pa.RecordBatch:
        data, sizes = joined_words(words, keep)
        raw, at = data.tobytes(), sizes[texts.offsets]
        gone = np.append(0, np.cumsum(~keep))[words.first]
        hashes = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(words.count), pa.array(np.diff(gone)), pa.array(hashes)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    fields = [
        docs.schema["doc_id"],
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("kept_sha256", StringType()),
    ]
    return _apply(keyed, spans, make, fields, window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``, each with the white space up to the next word that stays.

    Other columns and all rows stay; a text that is repeated as a whole becomes empty, a null text stays null.
    """
    _, spans = repeated(docs, window, k)
    text = F.coalesce("text", F.lit(""))
    others = [n for n in docs.columns if n != "text"]
    keyed = docs.select(
        F.struct(*others).alias("carried"),
        "text",
        F.xxhash64("doc_id", text).alias("k1"),
        F.xxhash64(text, "doc_id", F.lit(1)).alias("k2"),
    )
    names = docs.columns

    def make(rows: pa.RecordBatch, texts: Texts, words: Words, keep: np.ndarray) -> pa.RecordBatch:
        gone = ~keep
        stop = np.append(words.start[1:], len(texts.data))
        last = words.first[1:][words.count > 0] - 1
        stop[last] = texts.offsets[1:][words.count > 0]
        mark = np.zeros(len(texts.data) + 1, np.int64)
        np.add.at(mark, words.start[gone], 1)
        np.add.at(mark, stop[gone], -1)
        stay = np.cumsum(mark[:-1]) == 0
        at = np.append(0, np.cumsum(stay))[texts.offsets]
        raw = texts.data[stay].tobytes()
        out = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:])]
        valid = rows.column(1).is_valid().to_pylist()
        new = pa.array([t if ok else None for t, ok in zip(out, valid)], pa.string())
        own = dict(zip(others, rows.column(0).flatten()))
        return pa.RecordBatch.from_arrays([own.get(n, new) for n in names], names)

    return _apply(keyed, spans, make, docs.schema.fields, window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as k
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
rep as (select doc_id, i from win qualify min(doc_id) over (partition by k) < doc_id),
gone as (select doc_id, list(p) as spots, count(*) as n from (select distinct doc_id, i + j as p from rep, range(0, 50) r(j)) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when spots is null then w else list_filter(w, lambda x, i: not list_contains(spots, i)) end, ' ')) as kept_sha256
from d left join gone on gone.doc_id = d.doc_id
"""
