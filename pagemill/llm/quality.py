"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pagemill.llm.common import Texts, row_blocks

CHUNK, STRIDE = 256, 224
WIDTH, FILTERS, HIDDEN = 7, 24, 16
SAMPLE = 1500
"""Labelled documents of each class that the network is fitted on, at most; picked by a hash of their id."""
SAMPLE_BYTES = 12_000_000
"""Bytes of text of each class that are fitted on, at most; documents beyond are left out whole."""
STEPS, BATCH, RATE = 600, 32, 0.01
THRESHOLD = 0.7


class Chunks:
    """Overlapping chunks that cover whole texts: byte positions, and the rows they belong to.

    Texts are laid out one after another with ``WIDTH - 1`` zero bytes behind each, so that a filter never sees two
    texts. A text of any length, an empty one too, has at least one chunk.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        pad = WIDTH - 1
        spots = np.maximum(sizes, 1)  # places where a filter may begin
        self.first = np.append(0, np.cumsum(spots + pad))
        self.data = np.zeros(int(self.first[-1]) + CHUNK + pad, np.uint8)
        self.data[np.arange(len(data)) + np.repeat(self.first[:-1] - offsets[:-1], sizes)] = data
        self.count = np.maximum(1, -(-(spots - CHUNK) // STRIDE) + 1)
        self.row = np.repeat(np.arange(len(sizes)), self.count)
        nth = np.arange(len(self.row)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.begin = self.first[self.row] + nth * STRIDE
        self.end = np.minimum(self.begin + CHUNK, self.first[self.row] + spots[self.row])


class Network:
    """Filters over bytes, a maximum over each chunk, a hidden layer (which also sees how much of the
    chunk is empty), its mean and maximum over chunks, one logit.

    A filter of ``WIDTH`` places has one weight for each place and byte value, which is a convolution over one-hot
    bytes; its response is a sum of ``WIDTH`` table rows.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.inner = rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS + 1, HIDDEN)).astype(np.float32)
        self.inner_bias = np.zeros(HIDDEN, np.float32)
        self.outer = rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
        self.outer_bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.inner, self.inner_bias, self.outer, self.outer_bias]

    def responses(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - WIDTH + 1
        out = self.table[0][data[:n]]
        for j in range(1, WIDTH):
            out += self.table[j][data[j : n + j]]
        return out

    def pool(self, chunks: Chunks, lo: int, hi: int, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in chunks lo..hi-1, and where it stands."""
        begin, end = int(chunks.begin[lo]), int(chunks.end[lo:hi].max())
        out = self.responses(chunks.data[begin : end + WIDTH - 1])
        a, b = chunks.begin[lo:hi] - begin, chunks.end[lo:hi] - begin
        if not where:
            bounds = np.stack([a, b], 1).ravel()
            bounds = np.minimum(bounds, len(out) - 1)
            top = np.maximum.reduceat(out, bounds, axis=0)[::2]
            return np.maximum(top, out[np.minimum(b, len(out)) - 1]), None
        top, spot = np.empty((hi - lo, FILTERS), np.float32), np.empty((hi - lo, FILTERS), np.int64)
        for i, (x, y) in enumerate(zip(a, b)):
            at = out[x:y].argmax(axis=0)
            top[i], spot[i] = out[x + at, np.arange(FILTERS)], begin + x + at
        return top, spot

    def forward(self, chunks: Chunks, where: bool = False) -> dict[str, np.ndarray]:
        tops, spots, lo = [], [], 0
        while lo < len(chunks.row):  # about 1 MB of bytes at a time
            hi = int(np.searchsorted(chunks.begin, chunks.begin[lo] + (1 << 18), side="left"))
            hi = max(hi, lo + 1)
            top, spot = self.pool(chunks, lo, hi, where)
            tops.append(top)
            spots.append(spot)
            lo = hi
        top = np.concatenate(tops) + self.bias
        room = 1 - (chunks.end - chunks.begin) / np.float32(CHUNK)  # a short chunk has less to find its maxima in
        pooled = np.concatenate([np.maximum(top, 0), room[:, None].astype(np.float32)], axis=1)
        hidden = np.tanh(pooled @ self.inner + self.inner_bias)
        edge = np.cumsum(chunks.count) - chunks.count
        mean = np.add.reduceat(hidden, edge, axis=0) / chunks.count[:, None]
        most = np.maximum.reduceat(hidden, edge, axis=0)
        both = np.concatenate([mean, most], axis=1)
        logit = both @ self.outer + self.outer_bias[0]
        return {
            "top": top, "pooled": pooled, "hidden": hidden, "most": most, "both": both, "logit": logit,
            "spot": np.concatenate(spots) if where else np.zeros(0),
        }

    def gradients(self, chunks: Chunks, label: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
        f = self.forward(chunks, where=True)
        p = 1 / (1 + np.exp(-f["logit"]))
        loss = float(-(weight * np.where(label, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())
        d_logit = ((p - label) * weight).astype(np.float32)
        d_outer = f["both"].T @ d_logit
        d_both = d_logit[:, None] * self.outer
        row = chunks.row
        d_hidden = d_both[row, :HIDDEN] / chunks.count[row, None]
        is_most = f["hidden"] == f["most"][row]
        ties = np.add.reduceat(is_most.astype(np.float32), np.cumsum(chunks.count) - chunks.count, axis=0)
        d_hidden += d_both[row, HIDDEN:] * is_most / ties[row]
        d_inner_in = d_hidden * (1 - f["hidden"] ** 2)
        d_inner = f["pooled"].T @ d_inner_in
        d_top = (d_inner_in @ self.inner[:FILTERS].T) * (f["top"] > 0)
        d_table = np.zeros_like(self.table)
        columns = np.broadcast_to(np.arange(FILTERS), d_top.shape)
        for j in range(WIDTH):
            np.add.at(d_table[j], (chunks.data[f["spot"] + j], columns), d_top)
        return [d_table, d_top.sum(0), d_inner, d_inner_in.sum(0), d_outer, np.array([d_logit.sum()], np.float32)], loss

    def scores(self, texts: Texts) -> np.ndarray:
        logit = self.forward(Chunks(texts.data, texts.offsets))["logit"].astype(float)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(texts: list[str], labels: list[int], odds: float = 1.0, seed: int = 7) -> Network:
    """Adam on batches of whole documents in which both classes weigh the same, then shifted to the ``odds`` of class 1.

    With one class only, the network answers with that class; without labels it answers one half.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    label = np.array(labels, float)
    if len(set(labels)) < 2:
        net.outer[:] = 0
        net.outer_bias[:] = 0 if not labels else (4.0 if labels[0] else -4.0)
        return net
    share = np.where(label == 1, label.mean(), 1 - label.mean())
    weights = 0.5 / share
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    column = pa.array(texts, pa.large_string())
    step = 0
    while step < STEPS:
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            own = Texts(column.take(pa.array(pick)))
            grads, _ = net.gradients(Chunks(own.data, own.offsets), label[pick], weights[pick] / len(pick))
            step += 1
            rate = RATE * max(1 - step / STEPS, 0.02)
            for p, g, (m, v) in zip(net.parameters(), grads, state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.outer_bias += np.float32(np.log(odds))
    return net


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, most_bytes: int
) -> tuple[list[str], list[int], float]:
    """Up to ``per_class`` whole labelled documents of each class, in an order given by a hash of their id, and the odds
    of class 1 among all labelled documents.

    Ids and sizes are ranked first, so only texts that are used come to the driver. A document labelled twice in
    different ways, or without a doc_id, is left out.
    """
    marks = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
        .where("quality = high")
        .select("doc_id", "quality")
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    sized = texts.select("doc_id", F.struct("hash", F.octet_length("text").alias("size")).alias("one"))
    # Of rows that share an id the text with the smallest hash counts, once.
    known = sized.groupBy("doc_id").agg(F.min("one").alias("one")).select("doc_id", "one.*").join(marks, "doc_id")
    known = known.withColumn("mark", F.xxhash64("doc_id", F.lit(7)))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = counts.get(1, 0) / max(counts.get(0, 0), 1) or 1.0
    chosen = []
    for quality in (0, 1):
        left = most_bytes
        for row in known.where(F.col("quality") == quality).orderBy("mark", "doc_id").limit(per_class).collect():
            if row["size"] <= left:
                left -= row["size"]
                chosen.append((row["doc_id"], row["hash"], row["mark"], int(quality)))
    if not chosen:
        return [], [], odds
    schema = StructType([docs.schema["doc_id"], *(StructField(n, LongType()) for n in ("hash", "mark", "quality"))])
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, schema))  # 2 * per_class rows at most
    picked = texts.join(wanted, ["doc_id", "hash"]).dropDuplicates(["doc_id"]).orderBy("mark", "text")
    rows = picked.select("text", "quality").collect()
    return [r["text"] for r in rows], [int(r["quality"]) for r in rows], odds


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) for each row; a null text counts as empty. Only doc_id and text are read. No shuffle."""
    keys = docs.select("doc_id", "text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column(1)):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(net.scores(Texts(rows.column(1))))], ["doc_id", "score"]
                )

    return keys.mapInArrow(run, StructType([keys.schema["doc_id"], StructField("score", DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning; a row without an id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted): the probability of quality 1, learned from labelled rows not held out."""
    open_docs = docs.where(~held_out())
    net = fit(*labelled_sample(open_docs, labels, per_class, most_bytes))
    return score_quality(docs, net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )
