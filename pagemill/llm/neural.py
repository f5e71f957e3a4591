"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from pagemill.llm.common import row_blocks
from pagemill.session import cut_lineage

CLASSES = 1024
"""Word classes: the end, one for all rare words, the commonest words alone, and ranges of the other common words."""
COMMON, WORD_BYTES = 1 << 18, 64
"""Common words, each with vectors of its own: at most so many of at most so many bytes. Counts of others are joined."""
DIM, WORD_DIM = 16, 8
BATCH, NOISE, RATIO, RATE = 2048, 64, 10, 0.02
ROUNDS = ((0, 1), (1, 2), (2, 4), (4, 8))
"""Each training document belongs to one of eight parts by hash; a round trains on some parts, then averages."""
FAN = 64
TASK_TOKENS = 1 << 21
"""Tokens a training task should see at least, so that the parameters it sends stay small against its input."""
WORD_BATCH, WORD_NOISE, WORD_RATE, FAR, BOUND = 1 << 15, 2, 0.1, 0.5, 1.5
SPAN = 1 << 13
"""Numbers of words whose vectors are averaged together."""
END, OTHER, FIRST = 0, 1, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def held_out():
    """Rows kept from learning: a fifth by the checksum of the id, and rows without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))


def count_words(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) over all ``texts``. Tasks add up before they send, about ``most`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(seen.keys()), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for lo, hi in row_blocks(batch.column(0)):
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    seen.update(split(text))
                if len(seen) > most:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    parts = texts.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """score(w | a, b) = (near * input[b] + far * input[a]) . output[w] + bias[w] for the classes a, b before class w."""

    def __init__(self, flat: np.ndarray, classes: int, dim: int):
        sizes = [classes * dim, classes * dim, classes, dim, dim]
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        self.flat = flat
        self.input, self.output = parts[0].reshape(classes, dim), parts[1].reshape(classes, dim)
        self.bias, self.near, self.far = parts[2:]

    @classmethod
    def start(cls, share: np.ndarray, dim: int, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        n = len(share)
        parts = [rng.normal(0, 0.3, n * dim), rng.normal(0, 0.05, n * dim), np.log(share), np.ones(dim), np.full(dim, 0.5)]
        return cls(np.concatenate(parts).astype(np.float32), n, dim)

    def step(self, w: np.ndarray, b: np.ndarray, a: np.ndarray, noise: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Gradient of the noise-contrastive objective for one batch; ``known`` is log(RATIO * noise probability).

        Each word is told from RATIO noise words; the batch shares NOISE of them, weighted to count as RATIO.
        """
        classes, dim = self.input.shape
        rb, ra, out, away = self.input.take(b, 0), self.input.take(a, 0), self.output.take(w, 0), self.output[noise]
        q = rb * self.near
        q += ra * self.far
        own = (q * out).sum(1) + self.bias.take(w) - known.take(w)
        pull = 1 / (1 + np.exp(own))
        push = q @ away.T
        push += (self.bias - known)[noise]
        np.exp(np.negative(push, out=push), out=push)
        push += 1
        np.divide(RATIO / len(noise), push, out=push)
        out *= pull[:, None]
        d_q = np.subtract(out, push @ away, out=out)
        grad = Model(np.zeros(len(self.flat), np.float32), classes, dim)
        rows = np.concatenate([w, noise])
        _add(grad.output, rows, np.concatenate([pull[:, None] * q, -(push.T @ q)]))
        grad.bias += np.bincount(rows, np.concatenate([pull, -push.sum(0)]), classes).astype(np.float32)
        _add(grad.input, np.concatenate([b, a]), np.concatenate([d_q * self.near, d_q * self.far]))
        grad.near += (d_q * rb).sum(0)
        grad.far += (d_q * ra).sum(0)
        return np.divide(grad.flat, len(w), out=grad.flat)

    def train(self, w: np.ndarray, b: np.ndarray, a: np.ndarray, share: np.ndarray, state: dict) -> None:
        rng, known = state["rng"], np.log(RATIO * share).astype(np.float32)
        order = rng.permutation(len(w))
        draws = rng.choice(len(share), (-(-len(w) // BATCH), NOISE), p=share / share.sum())
        for i, noise in enumerate(draws):
            pick = order[i * BATCH : (i + 1) * BATCH]
            grad = self.step(w[pick], b[pick], a[pick], noise, known)
            state["t"] += 1
            state["m"] += 0.1 * (grad - state["m"])
            state["v"] += 0.01 * (grad * grad - state["v"])
            scale = np.sqrt(1 - 0.99 ** state["t"]) / (1 - 0.9 ** state["t"])
            self.flat += np.float32(state["rate"] * scale) * state["m"] / (np.sqrt(state["v"]) + 1e-6)


def _add(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for i in range(to.shape[1]):
        to[:, i] += np.bincount(rows, values[:, i], len(to))


class Vocabulary:
    """The common words with their counts, numbered by falling count after END and OTHER, and cut into classes.

    A class is a range of numbers. Half of the classes hold one word each; the rest share the other words so that the
    square roots of their counts sum up alike, which keeps the number of words tried per token low.
    """

    def __init__(self, words: bytes, counts: np.ndarray, total: int, distinct: int, docs: int, classes: int):
        self.words, self.counts = words, counts
        self.total, self.distinct, self.docs = total, distinct, docs
        self.rest, self.rest_kinds = total - int(counts.sum()), distinct - len(counts)
        weight = np.concatenate([[docs, self.rest], counts]).astype(float) + 0.5
        self.start = class_starts(counts, max(1, classes - FIRST))
        self.stop = np.append(self.start[1:], len(weight))
        self.classes = len(self.start)
        self.kind = np.repeat(np.arange(self.classes), self.stop - self.start)
        mass = np.add.reduceat(weight, self.start)
        self.share = mass / mass.sum()
        self.upto = np.concatenate([[0.0], np.cumsum(weight)])
        self.inner = np.log(weight / mass[self.kind]).astype(np.float32)  # share of a word in its class

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b"\n"), FIRST)} if len(self.counts) else {}

    def draw(self, rng: np.random.Generator, number: np.ndarray) -> np.ndarray:
        """WORD_NOISE words from the class of each word, by their counts."""
        kind = self.kind[number]
        lo, hi = self.start[kind][:, None], self.stop[kind][:, None]
        at = (self.upto[lo] + rng.random((len(number), WORD_NOISE)) * (self.upto[hi] - self.upto[lo])).ravel()
        order = np.argsort(at)  # sorted places are found several times faster
        found = np.empty(len(at), np.int64)
        found[order] = np.searchsorted(self.upto, at[order], "right") - 1
        return np.clip(found.reshape(len(number), WORD_NOISE), lo, hi - 1)


def class_starts(counts: np.ndarray, room: int) -> np.ndarray:
    """The first numbers of all classes; at most ``room`` of them beside END and OTHER."""
    single = len(counts) if len(counts) <= room else room // 2
    mass = np.cumsum(np.sqrt(counts[single:]))
    cuts = np.arange(single)
    if len(mass):
        steps = np.arange(room - single) / (room - single) * mass[-1]
        cuts = np.concatenate([cuts, single + np.searchsorted(mass, steps)])
    return np.unique(np.concatenate([[END, OTHER], cuts + FIRST])).astype(np.int64)


class Words:
    """Words within their class: score(w | a, b) = (input[b] + FAR * input[a]) . output[w] + log share of w there.

    All coordinates stay within BOUND, so no score can leave the range of exp().
    """

    def __init__(self, flat: np.ndarray, dim: int):
        self.input, self.output = flat.reshape(2, -1, dim)

    @staticmethod
    def start(n: int, dim: int, seed: int = 12) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(0, 0.3, n * dim).clip(-1, 1), np.zeros(n * dim)]).astype(np.float16)

    def query(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        q = self.input.take(far, 0)
        q *= FAR
        return np.add(self.input.take(near, 0), q, out=q)

    def train(self, vocab: Vocabulary, w: np.ndarray, near: np.ndarray, far: np.ndarray, state: dict) -> None:
        """Words that are alone in their class teach nothing here; of the others each is told from noise of its class."""
        kind = vocab.kind[w]
        pick = np.flatnonzero(vocab.stop[kind] - vocab.start[kind] > 1)
        for i in range(0, len(pick), WORD_BATCH):
            at = pick[i : i + WORD_BATCH]
            self.step(w[at], near[at], far[at], vocab.draw(state["rng"], w[at]), state)

    def step(self, w: np.ndarray, near: np.ndarray, far: np.ndarray, noise: np.ndarray, state: dict) -> None:
        """One step up the noise-contrastive objective. The noise has the shares of the class, so they cancel out."""
        tried = np.concatenate([w[:, None], noise], 1)
        q, out = self.query(near, far), self.output.take(tried, 0)
        pull = -1 / (1 + np.exp(math.log(noise.shape[1]) - np.einsum("td,tjd->tj", q, out)))
        pull[:, 0] += 1
        d_q = np.einsum("tj,tjd->td", pull, out)
        d_out = pull[:, :, None] * q[:, None, :]
        dim = q.shape[1]
        for name, rows, values in (
            ("output", tried.ravel(), d_out.reshape(-1, dim)),
            ("input", np.concatenate([near, far]), np.concatenate([d_q, FAR * d_q])),
        ):
            param, square, seen = getattr(self, name), state[name], state[name + "_seen"]
            times = np.bincount(rows, minlength=len(param))
            seen += times
            at = np.flatnonzero(times > 0)
            place = np.empty(len(param), np.int64)
            place[at] = np.arange(len(at))
            grad = np.zeros((len(at), dim), np.float32)
            _add(grad, place.take(rows), values)
            scale = square.take(at, 0)
            scale += grad * grad
            square[at] = scale
            moved = state["rate"] * grad / np.sqrt(scale, out=scale)
            moved += param.take(at, 0)
            param[at] = np.clip(moved, -BOUND, BOUND, out=moved)

    def log_inner(self, vocab: Vocabulary, w: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """log of P(word | its class, words before), exactly normalised over the class; 0 for words alone in theirs."""
        out = np.zeros(len(w))
        kind = vocab.kind[w]
        pick = np.flatnonzero(vocab.stop[kind] - vocab.start[kind] > 1)
        pick = pick[np.argsort(kind[pick], kind="stable")]
        cuts = np.flatnonzero(np.diff(kind[pick], prepend=-1, append=-1)) if len(pick) else []
        q, place, found = self.query(near[pick], far[pick]), w[pick] - vocab.start[kind[pick]], np.empty(len(pick))
        for a, b in zip(cuts[:-1], cuts[1:]):
            c = kind[pick[a]]
            lo, hi = vocab.start[c], vocab.stop[c]
            vectors, share = self.output[lo:hi].T.copy(), vocab.inner[lo:hi]
            step = max(1, (1 << 18) // (hi - lo))  # what fits a core's cache
            for i in range(a, b, step):
                j = min(b, i + step)
                s = q[i:j] @ vectors
                s += share
                own = s[np.arange(j - i), place[i:j]].astype(float)
                found[i:j] = own - np.log(np.exp(s, out=s).sum(1))
        out[pick] = found
        return out


def tokens(vocab: Vocabulary, index: dict[bytes, int], texts: list[str | None]) -> tuple:
    """(numbers with one end per text, number one before, number two before, row, end?) and the words."""
    own = [split(t) for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    words = list(chain.from_iterable(own))
    row = np.repeat(np.arange(len(own)), sizes + 1)
    stop = np.cumsum(sizes + 1) - 1
    is_end = np.zeros(len(row), bool)
    is_end[stop] = True
    number = np.full(len(row), END)
    number[~is_end] = np.fromiter(map(index.get, words, repeat(OTHER)), np.int64, len(words))
    near, far = np.full(len(row), END), np.full(len(row), END)
    near[1:], far[2:] = number[:-1], number[:-2]  # before a text stand ends
    far[stop[:-1] + 1] = END
    return number, near, far, row, is_end, words


PARTIAL = "span long, part long, ids binary, weights binary, vectors binary"


def partials(span: int, part: int, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> tuple:
    """A row of PARTIAL. Span -1 holds the numbers of the class model one by one, the others vectors of words."""
    kind = np.float32 if span < 0 else np.float16
    return span, part, ids.astype(np.int32).tobytes(), weights.astype(np.float32).tobytes(), vectors.astype(kind).tobytes()


def opened(row: tuple | pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, width = (np.float32, 1) if row[0] < 0 else (np.float16, dim)
    return np.frombuffer(row[2], np.int32), np.frombuffer(row[3], np.float32), np.frombuffer(row[4], kind).reshape(-1, width)


def average(parts: DataFrame, tasks: int, dim: int) -> list[tuple]:
    """Per span one row of PARTIAL: means of what tasks learnt, weighted by what each saw. At most FAN meet at once."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        found = [opened(r, dim) for r in rows[["span", "part", "ids", "weights", "vectors"]].itertuples(index=False)]
        ids, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        weights = np.concatenate([f[1] for f in found]).astype(float)
        vectors = np.concatenate([f[2] for f in found]).astype(float) * weights[:, None]
        total = np.bincount(back, weights)
        sums = np.stack([np.bincount(back, v) for v in vectors.T], 1)
        row = partials(rows["span"].iloc[0], rows["part"].iloc[0], ids, total, sums / total[:, None])
        return pd.DataFrame([row], columns=["span", "part", "ids", "weights", "vectors"])

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("span", "part").applyInPandas(mean, PARTIAL)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return [tuple(r) for r in parts.collect()]


def vocabulary(train: DataFrame, classes: int, common: int) -> tuple[DataFrame, Vocabulary]:
    """The counts of all training words as a table, and the common ones as a :class:`Vocabulary`.

    The table is read for the words of at most WORD_BYTES whose count reaches the level that at most ``common`` of them
    reach; the level comes from a histogram over powers of two and their sixteenths.
    """
    counts = cut_lineage(count_words(train.select("text")))
    step = F.floor(F.log2("n") * 16).cast("int")
    short = F.octet_length("word") <= WORD_BYTES
    steps = (
        counts.groupBy(step.alias("step"), short.alias("short"))
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
        .collect()
    )
    total, distinct = sum(r["n"] for r in steps), sum(r["kinds"] for r in steps)
    level, room = None, common
    for r in sorted((r for r in steps if r["short"]), key=lambda r: -r["step"]):
        room -= r["kinds"]
        if room < 0:
            break
        level = r["step"]
    chosen = (step >= level) & short if level is not None else F.lit(False)
    near = counts.where(chosen)
    top = near.select("word", "n").toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    blob = "\n".join(words[i] for i in order).encode()
    vocab = Vocabulary(blob, n[order].astype(np.int64), total, distinct, train.count(), classes)
    return counts.where(~chosen), vocab


def train_model(train: DataFrame, vocab: Vocabulary, dim: int = DIM, word_dim: int = WORD_DIM) -> tuple[Model, np.ndarray]:
    """The class model and the vectors of all words, fitted on all training documents.

    Tasks train on their own part; after each round their parameters are averaged. A task sends vectors of the words it
    met only. Small partitions are read together, without a shuffle, until a task has about TASK_TOKENS tokens.
    """
    model, flat_words = Model.start(vocab.share, dim), Words.start(len(vocab.kind), word_dim)
    tasks = max(1, (vocab.total + vocab.docs) // TASK_TOKENS)
    for nth, (lo, hi) in enumerate(ROUNDS):
        part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS[-1][1]))
        flat = model.flat.copy()

        def run(batches: Iterator[pa.RecordBatch], flat=flat, flat_words=flat_words, nth=nth) -> Iterator[pa.RecordBatch]:
            own, task, weight = Model(flat.copy(), vocab.classes, dim), TaskContext.get().partitionId(), 0
            inner = Words(flat_words.astype(np.float32), word_dim)
            index = vocab.index()
            zeros = np.zeros(len(flat), np.float32)
            rate, rng = 1 / (1 + nth), np.random.default_rng([nth, task])
            state = {"rng": rng, "t": 0, "m": zeros.copy(), "v": zeros, "rate": RATE * rate}
            words = {"rng": rng, "rate": np.float32(WORD_RATE * rate)}
            for name in ("input", "output"):
                words |= {name: np.ones_like(inner.input), name + "_seen": np.zeros(len(vocab.kind), np.int64)}
            for batch in batches:
                for a, b in row_blocks(batch.column(0)):
                    number, near, far, *_ = tokens(vocab, index, batch.column(0).slice(a, b - a).to_pylist())
                    own.train(vocab.kind[number], vocab.kind[near], vocab.kind[far], vocab.share, state)
                    inner.train(vocab, number, near, far, words)
                    weight += len(number)
            if not weight:
                return
            rows = [partials(-1, task, np.arange(len(flat)), np.full(len(flat), weight), own.flat)]
            seen = np.concatenate([words["input_seen"], words["output_seen"]])
            vectors = np.concatenate([inner.input, inner.output])
            met = np.flatnonzero(seen)
            for span in np.unique(met // SPAN):
                ids = met[np.searchsorted(met, span * SPAN) : np.searchsorted(met, (span + 1) * SPAN)]
                rows.append(partials(int(span), task, ids, seen[ids], vectors[ids]))
            for row in rows:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x], pa.int64()) for x in row[:2]), *(pa.array([x], pa.binary()) for x in row[2:])],
                    ["span", "part", "ids", "weights", "vectors"],
                )

        texts = train.where((part >= lo) & (part < hi)).select("text").coalesce(tasks)
        vectors = flat_words.reshape(-1, word_dim).copy()
        for row in average(texts.mapInArrow(run, PARTIAL), tasks, word_dim):
            ids, _, found = opened(row, word_dim)
            if row[0] < 0:
                model = Model(found.ravel().astype(np.float32), vocab.classes, dim)
            else:
                vectors[ids] = found
        flat_words = vectors.ravel()
    return model, flat_words


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """log of the sum of exp(score) over all classes, for every pair of words before; row: two before."""
    classes, dim = model.input.shape
    flat = model.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(flat, classes, dim)
        for batch in batches:
            for far in batch.column(0).to_pylist():
                s = (own.input * own.near + own.input[far] * own.far) @ own.output.T + own.bias
                top = s.max(1)
                z = (top + np.log(np.exp(s - top[:, None]).sum(1))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([far]), pa.array([z.tobytes()])], ["far", "z"])

    rows = spark.range(classes).mapInArrow(run, "far long, z binary").collect()
    return np.stack([np.frombuffer(r["z"], np.float32) for r in sorted(rows, key=lambda r: r["far"])])


SCORED = ["n_tokens", "n_common", "n_rare", "base", "score"]


def score_texts(docs: DataFrame, vocab: Vocabulary, model: Model, words_flat: np.ndarray, dim: int, z: np.ndarray):
    """Per row the sums over common words and ends, and its rare words with their numbers of occurrences."""
    classes, class_dim = model.input.shape
    flat = model.flat
    held = docs.select("doc_id", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    fields = [
        held.schema["doc_id"],
        StructField("held_out", BooleanType()),
        StructField("row", LongType()),
        *(StructField(n, LongType()) for n in SCORED[:3]),
        *(StructField(n, DoubleType()) for n in SCORED[3:]),
        StructField("rare", ArrayType(StringType())),
        StructField("times", ArrayType(IntegerType())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, within = Model(flat, classes, class_dim), Words(words_flat.astype(np.float32), dim)
        index = vocab.index()
        by_near = (own.input * own.near) @ own.output.T + own.bias  # [word before, word]
        by_far = (own.input * own.far) @ own.output.T
        known = np.log10(np.concatenate([[vocab.docs, 0.5], vocab.counts]) + 0.5)  # 0 for OTHER: added by word
        for batch in batches:
            for lo, hi in row_blocks(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                n = len(part)
                number, near, far, row, is_end, words = tokens(vocab, index, part.column(3).to_pylist())
                kind, before, second = vocab.kind[number], vocab.kind[near], vocab.kind[far]
                lp = by_near[before, kind].astype(float) + by_far[second, kind] - z[second, before]
                lp = (lp + within.log_inner(vocab, number, near, far)) / np.log(10)
                base = known[number]
                rare = number == OTHER
                sums = [np.bincount(row, x, n) for x in (np.ones(len(row)), ~rare, rare, base, lp)]
                sums[4] -= sums[2] * np.log10(vocab.rest + 0.5 * (vocab.rest_kinds + 1))  # words drawn within OTHER
                lists, times = [], []
                word_row = row[~is_end]
                at = np.flatnonzero(rare[~is_end])
                cuts = np.searchsorted(word_row[at], np.arange(n + 1))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    found = Counter([words[i] for i in at[a:b]])
                    lists.append(list(found.keys()))
                    times.append(list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        *(pa.array(s.astype(np.int64)) for s in sums[:3]),
                        *map(pa.array, sums[3:]),
                        pa.array(lists, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                        pa.array(times, pa.list_(pa.int32())),
                    ],
                    [f.name for f in fields],
                )

    return held.mapInArrow(run, StructType(fields))


def score_documents(
    docs: DataFrame, classes: int = CLASSES, common: int = COMMON, dim: int = DIM, word_dim: int = WORD_DIM
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Words of all training texts are counted. P(word | context) is P(class | classes before) times
    P(word | class, words before), both log-bilinear, trained against noise and exactly normalised. Every common word
    has vectors of its own, as a word and as context; a rare word is scored by its class OTHER times its share there, with
    one more place for words never seen, so probabilities sum to one. Counts of rare words reach the documents that hold
    them in a join on the word. A null or empty text consists of its end. Rows without a doc_id are held out; equal rows
    are scored each; a very long text is one block of tokens; other columns are left out. Without training texts every
    word is new and the network stays as it began.
    """
    train = docs.where(~held_out()).select("doc_id", "text")
    rare, vocab = vocabulary(train, classes, common)
    total = vocab.total + vocab.docs
    kinds = vocab.distinct + (vocab.docs > 0)
    model, vectors = train_model(train, vocab, dim, word_dim)
    z = normalisers(docs.sparkSession, model)
    scored = cut_lineage(score_texts(docs, vocab, model, vectors, word_dim, z))
    single = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("word"), F.col("x.times").alias("times")
    )
    seen = F.coalesce("n", F.lit(0))
    by_row = (
        single.join(rare, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(seen + 0.5)).alias("rare_log"),
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    extra = F.coalesce("rare_log", F.lit(0.0))
    end_known = 1 if vocab.docs else 0
    return scored.join(by_row, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") - (1 - end_known) + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (kinds + 1))))).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
