"""Each operator against a brute-force version, over rows with every kind of oddity, and over an empty table."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagemill.llm import lines, minhash, mixing, neural, packing, quality, sharding, substrings, tokens, topk, words_bpe
from tests.llm import data
from tests.llm.data import frame, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return data.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def bag(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs, 8).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    counts = collections.Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert sharding.shard_documents(empty, 8).count() == 0


def test_sharding_moves_little(spark):
    keys = spark.range(4000).withColumnRenamed("id", "key")
    few = {r.key: (r.home, r.shard) for r in sharding.assign(keys, ["key"], 8, slack=0.1).collect()}
    more = {r.key: (r.home, r.shard) for r in sharding.assign(keys, ["key"], 9, slack=0.1).collect()}
    assert max(collections.Counter(s for _, s in few.values()).values()) <= 550
    home = sum(few[k][0] != more[k][0] for k in few)
    assert all(more[k][0] == 8 for k in few if few[k][0] != more[k][0])  # a new shard only takes
    assert home < 4000 / 9 * 1.5
    assert sum(few[k][1] != more[k][1] for k in few) < 4000 * 0.4


def test_place():
    plan = sharding.place([(0, 0, 10), (1, 1, 0), (2, 2, 2)], [4, 4, 4])
    assert plan == [(0, 0, 4, 0, 0), (2, 0, 2, 2, 0), (0, 4, 8, 1, 0), (0, 8, 10, 2, 2)]


def test_token_counts(docs, rows, empty):
    tokenizer = Tokenizer.from_file(PATH)
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (64, 8)):
        got = bag(tokens.count_tokens(docs, PATH, chunk, overlap), "doc_id", "n_bytes", "n_tokens")
        assert got == collections.Counter(
            (r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows
        )
    assert tokens.count_tokens(empty, PATH).count() == 0


def test_long_texts_are_spliced(docs):
    out = {r.doc_id: r for r in tokens.count_tokens(docs, PATH, 4096, 64).collect()}
    assert max(r.n_chunks for r in out.values()) > 5
    assert any(r.n_widened for r in out.values())  # the text without white space


def test_splices_widen_and_decide():
    """A cut inside a word gives other tokens than the word has: only a boundary that both chunks prove is right."""
    tokenizer = Tokenizer.from_file(PATH)

    def whole(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    prose = " ".join(f"internationalisation{i % 7} of, CUMHUR\u0130YET\u0130," for i in range(300))
    count, chunks, widened = tokens.count_long(tokenizer, prose, 100, 40)
    assert (count, widened > 0) == (whole(prose), True) and chunks > 50
    cut = sum(whole(prose[i : i + 100]) for i in range(0, len(prose), 100))
    assert cut != count  # chunks put together without a splice
    solid = "antidisestablishment" * 40
    text = prose[:3000] + " " + solid + " " + prose[:3000]
    assert tokens.count_long(tokenizer, text, 200, 16)[0] == whole(text)
    assert tokens.count_long(tokenizer, text, 200, 16)[2] > 3  # the solid part shares no boundary until it is whole
    left, right = tokens.Encoded(tokenizer, text, 0, 200), tokens.Encoded(tokenizer, text, 100, 300)
    at = tokens.splice(left, right, text)
    assert at and text[at - 1] == " " and at in left.starts and at in right.starts


def test_words_end_in_marks():
    """Every letter, alone and in a word, before a full stop and a comma: the store's ids are the library's."""
    tokenizer = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() and c < 0x30000]
    letters = [x for i, x in enumerate(letters) if ord(x) < 0x3000 or i % 97 == 0]
    texts = [x + end for x in letters for end in (".", ",")] + ["CUMHUR\u0130YET\u0130,", "\u015e\u0130RKET\u0130.", "a" * 200, "a" * 200 + "."]
    enc = words_bpe.WordEncoder(PATH, room=4000)
    for lo in range(0, len(texts), 1000):
        part = texts[lo : lo + 1000]
        slots, n_words = enc.rows(pa.array([*part, None, " "]))
        assert n_words.tolist() == [1] * len(part) + [0, 0]
        ids, sizes = enc.gather(slots)
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert len(enc.keys) <= 4000
    assert enc.rows(pa.array(["a b a"]))[0].tolist()[0] == enc.rows(pa.array(["a"]))[0].tolist()[0]


def test_mixing(docs, rows, empty):
    out = mixing.copies(docs).collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(n for n in size if n is not None) + [None] * (None in size)
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        level = (total - sum(3 * size[n] for n in capped)) / sum(weight[n] for n in free)
        more = {n for n in free if level * weight[n] > 3 * size[n]}
        if not more:
            break
        capped |= more
    target = {n: 3 * size[n] if n in capped else level * weight[n] for n in names}
    taken = collections.Counter()
    for r in out:
        source = None if r.no_source else r.source
        assert r.source_size == size[source] and math.isclose(r.target, target[source])
        assert 0 <= r.copies <= 3
        taken[source] += r.copies * r.size
    longest = {n: max(len(words(r[1])) for r in rows if r[3] == n) for n in names}
    assert all(abs(taken[n] - target[n]) <= longest[n] for n in names)
    assert bag(mixing.copies(docs), "doc_id", "size", "copies") == bag(mixing.copies(docs), "doc_id", "size", "copies")
    assert mixing.copies(empty).count() == 0


def test_mix_documents(docs, empty):
    out = mixing.mix_documents(docs)
    assert out.schema == docs.schema
    plan = collections.Counter()
    for r in mixing.copies(docs.withColumn("_hash", mixing.text_hash(docs["text"])), extra=["_hash"]).collect():
        plan[r.doc_id, r.size] += r.copies
    got = collections.Counter((r.doc_id, len(words(r.text))) for r in out.collect())
    once = [k for k, n in collections.Counter((r.doc_id, len(words(r.text))) for r in docs.collect()).items() if n == 1]
    assert all(got[k] == plan[k] for k in once)
    assert mixing.mix_documents(empty).count() == 0


def test_mix_documents_deals_out_repeats(spark):
    """Rows that agree in doc_id, source and text are emitted as often as the plan says, all together."""
    rest = [None] * 11
    rows = [(1, "a b c", "en", "a", 0, *rest)] * 40 + [(2, "d e f g", "en", "a", 0, *rest), (2, "other", "en", "a", 0, *rest)]
    rows += [(None, "h i", "en", None, 0, *rest)] * 9 + [(3, "big " * 300, "en", "b", 0, *rest), (4, None, "en", "a", 0, *rest)]
    rows += [(5, "j k l", "en", "c", 0, f"row {i}", *rest[1:]) for i in range(20)]
    table = frame(spark, rows)
    plan = collections.Counter()
    for r in mixing.copies(table.withColumn("_hash", mixing.text_hash(table["text"])), extra=["_hash"]).collect():
        plan[r.doc_id, None if r.no_source else r.source, r.size] += r.copies
    out = mixing.mix_documents(table).collect()
    assert collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in out) == +plan
    assert plan[1, "a", 3] > 1 and plan[None, None, 2] > 1  # else nothing is told apart
    assert max(collections.Counter(r.k1 for r in out if r.doc_id == 5).values()) <= 3


def test_lm_scores(spark, docs, rows, empty):
    out = neural.score_documents(docs, classes=40, common=60).collect()
    own = [(r[0], [w.translate(data.LOWER) for w in words(r[1])] + ["\n"]) for r in rows]
    held = [d is None or zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in own]
    count = collections.Counter(w for (_, ws), h in zip(own, held) if not h for w in ws)
    n, bottom = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    want = collections.Counter(
        (d, h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10(count[w] + 0.5) - bottom for w in ws), 4))
        for (d, ws), h in zip(own, held)
    )
    got = collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out
    )
    assert got == want
    assert all(r.score < 0 for r in out)
    assert neural.score_documents(empty).count() == 0


def log_softmax(scores):
    top = max(scores)
    total = top + math.log(sum(math.exp(x - top) for x in scores))
    return [x - total for x in scores]


class SlowModel:
    """P(word | two words before) from the parameters alone, one score at a time."""

    def __init__(self, vocab, model, vectors, dim):
        self.vocab, self.model = vocab, model
        self.input, self.output = vectors.astype(float).reshape(2, -1, dim)
        self.number = {w: i + 2 for i, w in enumerate(vocab.words.split(b"\n"))}

    def distribution(self, far, near):
        """log10 P of the end, of all rare words together, and of each common word."""
        v, m = self.vocab, self.model
        q = m.input[v.kind[near]] * m.near + m.input[v.kind[far]] * m.far
        by_class = log_softmax([float(q @ m.output[c] + m.bias[c]) for c in range(v.classes)])
        own = self.input[near] + neural.FAR * self.input[far]
        out = []
        for c in range(v.classes):
            members = [i for i, k in enumerate(v.kind) if k == c]
            weight = [(v.docs if i == 0 else v.rest if i == 1 else int(v.counts[i - 2])) + 0.5 for i in members]
            out += [by_class[c] + x for x in log_softmax([math.log(n) + own @ self.output[i] for i, n in zip(members, weight)])]
        return [x / math.log(10) for x in out]

    def score(self, ws, count):
        number = [self.number.get(w.encode(), 1) for w in ws] + [0]
        total, bottom = 0.0, math.log10(self.vocab.rest + 0.5 * (self.vocab.rest_kinds + 1))
        for i, n in enumerate(number):
            total += self.distribution(number[i - 2] if i > 1 else 0, number[i - 1] if i else 0)[n]
            if n == 1:
                total += math.log10(count[ws[i]] + 0.5) - bottom
        return total


def test_lm_scores_follow_the_model(spark):
    docs = data.frame(spark, [r for r in data.documents(n=12) if len(r[1] or "") < 1000])
    train = docs.where(~neural.held_out()).select("doc_id", "text")
    _, vocab = neural.vocabulary(train, 20, 60)
    model, vectors = neural.train_model(train, vocab)
    assert vectors.astype(float).reshape(2, -1, neural.WORD_DIM)[1].any()  # words in shared classes were learnt
    slow = SlowModel(vocab, model, vectors, neural.WORD_DIM)
    for far, near in ((0, 0), (1, 5), (30, len(vocab.kind) - 1)):
        ps = [10**x for x in slow.distribution(far, near)]
        assert len(ps) == len(vocab.kind) > 40 and abs(sum(ps) - 1) < 1e-9
    rows = [(r.doc_id, [w.translate(data.LOWER) for w in words(r.text)]) for r in docs.collect()]
    learnt = {r.text for r in train.collect()}
    count = collections.Counter(w.translate(data.LOWER) for r in train.collect() for w in words(r.text))
    assert learnt and vocab.total == sum(count.values())
    want = sorted((str(d), round(slow.score(ws, count), 2)) for d, ws in rows)
    got = sorted((str(r.doc_id), r.score) for r in neural.score_documents(docs, 20, 60).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    assert all(abs(a - b) < 0.02 + 1e-4 * abs(b) for (_, a), (_, b) in zip(got, want))


def test_lm_words_within_classes_descend():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 50, 30))[::-1].astype(np.int64)
    vocab = neural.Vocabulary(b"\n".join(b"w%d" % i for i in range(30)), counts, int(counts.sum()) + 9, 33, 5, 12)
    assert vocab.classes == 12 and vocab.start[0] == 0 and vocab.stop[-1] == 32
    assert [int(b) for b in vocab.stop[:-1]] == [int(a) for a in vocab.start[1:]]
    number = rng.integers(0, 32, 500)
    drawn = vocab.draw(rng, number)
    assert (vocab.kind[drawn] == vocab.kind[number][:, None]).all()
    # One step moves along the gradient of the noise-contrastive objective.
    flat = rng.normal(0, 0.3, 2 * 32 * 3)
    w, near, far, noise = number[:40], number[40:80], number[80:120], drawn[:40]

    def objective(x):
        m = neural.Words(x, 3)
        q = m.input[near] + neural.FAR * m.input[far]
        s = np.einsum("td,tjd->tj", q, m.output[np.concatenate([w[:, None], noise], 1)]) - np.log(noise.shape[1])
        return -np.log1p(np.exp(-s[:, 0])).sum() - np.log1p(np.exp(s[:, 1:])).sum()

    numeric = np.zeros_like(flat)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        numeric[i] = (objective(up) - objective(down)) / 2e-5
    moved = neural.Words(flat.copy(), 3)
    state = {"rate": 1e-6}
    for name in ("input", "output"):
        state |= {name: np.full((32, 3), 1e12), name + "_seen": np.zeros(32, np.int64)}
    moved.step(w, near, far, noise, state)
    step = (np.concatenate([moved.input, moved.output]).ravel() - flat) * 1e12
    assert np.allclose(step, numeric, atol=2e-3)


def test_lm_steps_take_the_fast_way(monkeypatch):
    """Noise is looked up in order of its places, and steps and scores are to the bit those of the plain formulas."""
    rng = np.random.default_rng(5)
    counts = np.sort(rng.integers(1, 90, 400))[::-1].astype(np.int64)
    vocab = neural.Vocabulary(b"\n".join(b"w%d" % i for i in range(400)), counts, int(counts.sum()) + 9, 403, 5, 20)
    number, near, far = rng.integers(0, 402, (3, 3000))
    kind, plain, ordered = vocab.kind[number], np.searchsorted, []
    lo, hi = vocab.start[kind][:, None], vocab.stop[kind][:, None]
    at = vocab.upto[lo] + np.random.default_rng(6).random((3000, 2)) * (vocab.upto[hi] - vocab.upto[lo])
    want = np.clip(plain(vocab.upto, at, "right") - 1, lo, hi - 1)

    def spy(table, places, side):
        ordered.append(bool((np.diff(places) >= 0).all()))
        return plain(table, places, side)

    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", spy)
        drawn = vocab.draw(np.random.default_rng(6), number)
    assert ordered == [True] and np.array_equal(drawn, want)

    flat = rng.normal(0, 0.3, 2 * 402 * 8).astype(np.float32)
    old, new = neural.Words(flat.copy(), 8), neural.Words(flat.copy(), 8)
    state = {"rate": np.float32(0.1)}
    for name in ("input", "output"):
        state |= {name: np.ones((402, 8), np.float32), name + "_seen": np.zeros(402, np.int64)}
    new.step(number, near, far, drawn, state)
    tried = np.concatenate([number[:, None], drawn], 1)
    q, out = old.input[near] + neural.FAR * old.input[far], old.output[tried]
    pull = -1 / (1 + np.exp(math.log(2) - np.einsum("td,tjd->tj", q, out)))
    pull[:, 0] += 1
    d_q = np.einsum("tj,tjd->td", pull, out)
    d_out = (pull[:, :, None] * q[:, None, :]).reshape(-1, 8)
    for param, rows, values in (
        (old.output, tried.ravel(), d_out),
        (old.input, np.concatenate([near, far]), np.concatenate([d_q, neural.FAR * d_q])),
    ):
        grad = np.stack([np.bincount(rows, v, 402) for v in values.T], 1).astype(np.float32)
        moved = param + np.float32(0.1) * grad / np.sqrt(1 + grad * grad)
        met = np.unique(rows)
        param[met] = np.clip(moved, -neural.BOUND, neural.BOUND)[met]
    assert np.array_equal(old.output, new.output) and np.array_equal(old.input, new.input)
    assert np.array_equal(state["output_seen"], np.bincount(tried.ravel(), minlength=402))

    share = np.full(30, 1 / 30)
    model, known = neural.Model.start(share, 4), np.log(neural.RATIO * share).astype(np.float32)
    w, b, a = rng.integers(0, 30, (3, 200))
    noise = rng.integers(0, 30, 8)
    got = neural.Model(model.step(w, b, a, noise, known), 30, 4)
    q = model.input[b] * model.near + model.input[a] * model.far
    pull = 1 / (1 + np.exp((q * model.output[w]).sum(1) + model.bias[w] - known[w]))
    other = q @ model.output[noise].T + (model.bias - known)[noise]
    push = (neural.RATIO / 8) / (1 + np.exp(-other))
    d_q = pull[:, None] * model.output[w] - push @ model.output[noise]
    both, parts = np.concatenate([b, a]), np.concatenate([d_q * model.near, d_q * model.far])
    grad = np.stack([np.bincount(both, v, 30) for v in parts.T], 1).astype(np.float32)
    assert np.array_equal(got.input, grad / 200) and np.array_equal(got.near, (d_q * model.input[b]).sum(0) / 200)


def test_lm_averages_meet_in_steps(spark, monkeypatch):
    monkeypatch.setattr(neural, "FAN", 3)
    rng, rows, want = np.random.default_rng(4), [], {}
    for part in range(20):
        ids = np.unique(rng.integers(0, 9, 5))
        weights, vectors = rng.integers(1, 5, len(ids)), rng.integers(-4, 5, (len(ids), 2)) / 4
        rows.append(neural.partials(0, part, ids, weights, vectors))
        for i, n, x in zip(ids, weights, vectors):
            a, b = want.get(i, (0, 0))
            want[i] = (a + n, b + n * x)
    (row,) = neural.average(spark.createDataFrame(rows, neural.PARTIAL), 20, 2)
    ids, weights, vectors = neural.opened(row, 2)
    assert [*ids] == sorted(want)
    assert all(n == want[i][0] and np.allclose(v, want[i][1] / n, atol=5e-3) for i, n, v in zip(ids, weights, vectors))


def test_lm_beats_unigrams(spark):
    sf = "/root/testdata/sf0.01"
    out = [r for r in neural.query(spark, sf).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.03


def kept_by_hand(rows, window=50):
    first = {}
    for d, ws in sorted((r[0], words(r[1])) for r in rows if r[0] is not None):
        for i in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[i : i + window]), d)
    out = []
    for r in rows:
        ws, gone = words(r[1]), set()
        if r[0] is not None:
            for i in range(len(ws) - window + 1):
                if first[tuple(ws[i : i + window])] < r[0]:
                    gone.update(range(i, i + window))
        out.append((r[0], ws, [w for i, w in enumerate(ws) if i not in gone]))
    return out


def test_substring_dedup(docs, rows, empty):
    want = collections.Counter(
        (d, len(ws), len(ws) - len(keep), hashlib.sha256(" ".join(keep).encode()).hexdigest())
        for d, ws, keep in kept_by_hand(rows)
    )
    assert any(k[2] for k in want)
    assert bag(substrings.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.digests(empty).count() == 0


def test_short_windows(docs, rows):
    want = collections.Counter((d, len(ws) - len(keep)) for d, ws, keep in kept_by_hand(rows, 6))
    assert bag(substrings.digests(docs, window=6, k=3), "doc_id", "n_removed") == want


def test_remove_repeats(docs, rows, empty):
    out = substrings.remove_repeats(docs)
    assert out.schema == docs.schema
    got = collections.Counter((r.doc_id, r.text is None, tuple(words(r.text))) for r in out.collect())
    null = {(r[0], r[1] is None, tuple(words(r[1]))) for r in rows if r[1] is None}
    want = collections.Counter((d, (d, True, tuple(ws)) in null, tuple(keep)) for d, ws, keep in kept_by_hand(rows))
    assert sum(got.values()) == sum(want.values())
    assert {(d, w) for d, _, w in got} == {(d, w) for d, _, w in want}
    untouched = {(d, tuple(ws)) for d, ws, keep in kept_by_hand(rows) if ws == keep}
    texts = {r[1] for r in rows if (r[0], tuple(words(r[1]))) in untouched}
    assert {r.text for r in out.collect()} >= texts
    assert substrings.remove_repeats(empty).count() == 0


def test_quality_scores(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    found = [r for r in out.where("held_out").join(labels, "doc_id").collect()]
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    odd = quality.classify(docs, labels.limit(0)).collect()
    assert len(odd) == docs.count() and all(r.score == 0.5 for r in odd)
    net = quality.Network()
    assert sum(quality.score_quality(docs, net).count() for _ in "a") == docs.count()
    assert quality.classify(empty, labels).count() == 0


def test_network_sees_whole_texts():
    net = quality.Network()
    texts = ["", "a", "b" * 255, "c" * 256, "d" * 263, "e" * 10_000 + "###" + "e" * 77, "f" * 481]
    import pyarrow as pa

    together = net.scores(quality.Texts(pa.array(texts)))
    alone = [net.scores(quality.Texts(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)
    column = quality.Texts(pa.array(["e" * 10_000]))
    assert abs(net.scores(column)[0] - together[5]) > 0
    for t in texts:  # brute force: every place of every chunk
        b = np.frombuffer(t.encode() + b"\0" * quality.WIDTH, np.uint8)
        spots = max(len(t), 1)
        full = np.array([sum(net.table[j][b[i + j]] for j in range(quality.WIDTH)) for i in range(spots)])
        chunks = quality.Chunks(*(lambda x: (x.data, x.offsets))(quality.Texts(pa.array([t]))))
        got = net.forward(chunks)["top"]
        begins = chunks.begin - chunks.first[0]
        assert begins[0] == 0 and (chunks.end[-1] - chunks.first[0]) == spots
        assert np.allclose(got, [full[x : x + quality.CHUNK].max(0) for x in begins], atol=1e-4)


def test_network_gradient():
    import pyarrow as pa

    net = quality.Network()
    for i, p in enumerate(net.parameters()):
        p[:] = p.astype(np.float32)
    texts = quality.Texts(pa.array(["some text here", "other $$$ ### text " * 30]))
    chunks = quality.Chunks(texts.data, texts.offsets)
    label, weight = np.array([1.0, 0.0]), np.array([0.5, 0.5])
    grads, _ = net.gradients(chunks, label, weight)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parameters(), grads):
        for _ in range(3):
            flat = np.abs(g).ravel()
            at = np.unravel_index(int(flat.argmax()) if _ == 0 else int(rng.integers(g.size)), g.shape)
            old, eps = p[at], 1e-3
            p[at] = old + eps
            high = net.gradients(chunks, label, weight)[1]
            p[at] = old - eps
            low = net.gradients(chunks, label, weight)[1]
            p[at] = old
            assert abs((high - low) / (2 * eps) - g[at]) < 5e-3


def base_by_hand(text):
    ws, seen, doubled = words(text), set(), 0
    for part in (text or "").split("\n"):
        if words(part):
            doubled += part in seen
            seen.add(part)
    spots = collections.defaultdict(list)
    for i in range(len(ws) - 7):
        spots[tuple(ws[i : i + 8])].append(i)
    again = {i + j for at in spots.values() if len(at) > 1 for i in at for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, doubled, len(again)


def test_quality_rules(docs, rows, empty):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = collections.Counter()
    for r in rows:
        base = base_by_hand(r[1])
        want[(r[0], *base, base[0] < 20 or 100 * base[4] > 30 * base[0])] += 1
    out = lines.apply_rules(docs)
    assert bag(out, *names) == want
    assert out.where("base_failed and kept").count() == 0
    assert lines.apply_rules(empty).count() == 0


def test_line_rules(spark):
    prose = " ".join(f"word{i}" for i in range(30))
    texts = {
        1: prose + "\nhome | news | sport | more | contact\n" + prose.upper(),
        2: "a$$$ b### c%%% " * 20,
        3: prose + "\n" + "go go go stop stop stop wait wait wait turn turn turn",
        4: prose + "\nReleased under the MIT License.\n" + prose,
        5: prose,
    }
    rows = [(i, t, "en", "s", 0, *([None] * 11)) for i, t in texts.items()]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in lines.apply_rules(docs, with_text=True).collect()}
    assert got[1].kept and got[1].clean_text == prose + "\n" + prose.upper()
    assert not got[2].kept
    assert got[3].kept and got[3].clean_text == prose
    assert not got[4].kept and got[4].base_failed and got[4].clean_text == prose  # half of it repeats
    assert got[5].kept and got[5].clean_text == prose
    clean = lines.clean_documents(docs)
    assert clean.schema == docs.schema
    assert {r.doc_id: r.n_chars for r in clean.collect()} == {1: 2 * len(prose) + 1, 3: len(prose), 5: len(prose)}


def test_phrases_in_running_prose(spark):
    """A phrase in a long line of prose costs neither the line nor the document; short lines go as before."""
    words_500 = [f"word{i}" for i in range(500)]
    texts = {}
    for i, phrase in enumerate(["our privacy policy", "click here", "released under the MIT License", "All rights reserved"]):
        texts[i] = " ".join([*words_500[:250], phrase, *words_500[250:]])
        texts[10 + i] = texts[i] + "\n" + phrase + "\n" + " ".join(words_500[::-1])
    texts[20] = "\n".join(f"Part {i} of {i + 1} is licensed under licence {i}" for i in range(10))  # notices alone
    rows = [(i, t, "en", "s", 0, *([None] * 11)) for i, t in texts.items()]
    got = {r.doc_id: r.text for r in lines.clean_documents(frame(spark, rows)).collect()}
    want = {i: t for i, t in texts.items() if i < 10}
    want |= {i: "\n".join(t.split("\n")[::2]) for i, t in texts.items() if 10 <= i < 20}
    assert got == want


def test_packing(docs, rows, empty):
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[r[0], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    out = packing.pack(docs, PATH)
    assert bag(out, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want
    rows_out, sequences = out.collect(), collections.defaultdict(list)
    for r in rows_out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 4096
    total = sum(r.length for r in rows_out)
    assert len(sequences) <= math.ceil(total / 4096 * 1.1) + 1
    assert packing.pack(empty, PATH).count() == 0


def test_patterns():
    rng = np.random.default_rng(1)
    for kinds, most in ((5, 40), (60, 30), (90, 12)):
        histogram = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 257), kinds, False), rng.integers(1, most, kinds))}
        got, used = collections.Counter(), 0
        for pattern, times in packing.patterns(histogram):
            assert sum(k * n for k, n in pattern.items()) <= 256 and times > 0
            used += times
            for k, n in pattern.items():
                got[k] += n * times
        assert got == collections.Counter(histogram)
        bins: list[int] = []  # first fit by falling size
        for k in sorted(got.elements(), reverse=True):
            at = next((i for i, room in enumerate(bins) if room >= k), None)
            if at is None:
                bins.append(256 - k)
            else:
                bins[at] -= k
        assert used <= 1.01 * len(bins) + 1
    assert packing.patterns({}) == []


def test_knapsack():
    value, best = np.array([2.0, 3.1, 7.0]), 0.0
    kinds = np.array([2, 3, 7])
    for a in range(6):
        for b in range(4):
            for c in range(2):
                if 2 * a + 3 * b + 7 * c <= 11:
                    best = max(best, 2 * a + 3.1 * b + 7 * c)
    gain, counts = packing.best_pattern(value, kinds, 11)
    assert math.isclose(gain, best) and math.isclose(counts @ value, best) and counts @ kinds <= 11


def vectors():
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 0.3, (6, 24))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 6] + rng.normal(0, 0.05, 24)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)]  # ties
    rows += [(None, rows[3][1]), (1100, None), (1150, [None] + rows[1][1][1:]), (1151, [math.inf] + rows[1][1][1:])]
    rows += [(1152, [math.nan] + rows[1][1][1:]), (1200, [0.5, 1.0]), (1201, [0.25, -1.0]), (1250, []), rows[7], (1300, [3e16] * 24)]
    return rows


def test_top_k(spark):
    rows = vectors()
    want = collections.Counter()
    whole = [
        (i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    for q, v in whole:
        if q % 50 == 0:
            score = [(-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in whole if i != q and len(w) == len(v)]
            for rank, (s, i) in enumerate(sorted(score)[:5], 1):
                want[q, rank, i, -s] += 1
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, nth int").repartition(4)
    from pyspark.sql import functions as F

    is_query = F.col("vec_id") % 50 == 0
    for block in (topk.BLOCK, 4):
        assert bag(topk.top_k(table, is_query, block=block), "query_id", "rank", "vec_id", "score") == want
    assert topk.top_k(table.limit(0), is_query).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, v = rng.integers(-300, 300, (20, 37)), rng.integers(-300, 300, (50, 37))
    exact = topk.products(q, v)
    assert (exact == q @ v.T).all()
    last = None
    for segments in topk.LEVELS:
        bound = topk.segment_statistics(q.astype(float), segments) @ topk.segment_statistics(v.astype(float), segments).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or bound.sum() < last
        last = bound.sum()


def components_by_hand(rows, percent, width):
    sets, root = {}, {}
    for i, r in enumerate(rows):
        ws = [w.translate(data.LOWER) for w in words(r[1])]
        sets[i] = frozenset(tuple(ws[j : j + width]) for j in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)] if ws else [])
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, r in enumerate(rows):
        for j in range(i):
            if rows[j][0] is None or r[0] is None:
                continue
            both = len(sets[i] & sets[j])
            near = sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if near or r[0] == rows[j][0] and sets[i] == sets[j]:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else low[find(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("percent,width,bands", [(85, 3, minhash.BANDS), (80, 5, minhash.BANDS_80)])
def test_near_duplicates(docs, rows, empty, percent, width, bands):
    out = minhash.near_duplicates(docs, percent, width, bands)
    want = collections.Counter(components_by_hand(rows, percent, width))
    assert bag(out, "doc_id", "n_shingles", "component_id") == want
    assert out.where("not (kept <=> (doc_id <=> component_id))").isEmpty()
    if width == 3:
        assert minhash.near_duplicates(empty).count() == 0
    else:
        one = minhash.keep_one(docs, percent=percent, width=width, bands=bands)
        assert one.schema == docs.schema
        assert {r.doc_id for r in one.collect()} == {c for d, _, c in want if d == c}


def test_keep_one_of_repeated_rows(spark):
    """Rows that repeat the kept doc_id and text, and rows without a doc_id, leave one as well."""
    import random

    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    texts = [(1, a)] * 5 + [(1, a.upper()), (1, b), (2, a + " end"), (None, a), (None, c), (None, c), (None, c + " end")]
    texts += [(3, d), (None, None), (None, ""), (4, ""), (4, None)]
    table = frame(spark, [(i, t, "en", "s", 0, *([None] * 11)) for i, t in texts])
    out = [(r.doc_id, (r.text or "").lower()) for r in minhash.keep_one(table).collect()]
    ended = sorted(t for i, t in out if i is None and t)
    assert ended in ([c], [c + " end"])
    assert collections.Counter((i, t) for i, t in out if i is not None or not t) == collections.Counter(
        [(1, a), (1, b), (3, d), (None, ""), (None, ""), (4, "")]
    )


def test_no_link_is_lost_where_the_hub_misses(spark, monkeypatch):
    """Chains of near copies: neighbours are linked, most are not linked to any hub. Small blocks take part too."""
    import random

    rng = random.Random(9)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    copy, rows = [f"w{rng.randrange(10**6)}" for _ in range(150)], []
    for i in range(40):
        copy = list(copy)
        copy[rng.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(copy), "en", "s", 0, *([None] * 11)))
    rng.shuffle(rows)
    got = bag(minhash.near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == collections.Counter(components_by_hand(rows, 85, 3))


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.concatenate([both, a]), np.concatenate([both, b]), both[:1], both[:0]]
    first = np.append(0, np.cumsum([len(s) for s in sets]))
    out = minhash.sketches(np.concatenate(sets), first, 400)
    assert (out[:3] < minhash._TOP).all() and (out[3] == minhash._TOP).all()
    assert abs((out[0] == out[1]).mean() - 0.8) < 0.08


def test_components(spark):
    from pagemill.llm.components import components

    chain = [(i, i + 1) for i in range(0, 100)] + [(200, 201), (205, 201), (300, 300), (400, 401), (401, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 205: 200, 400: 400, 401: 400}


def test_few_links_take_few_tasks(spark, monkeypatch, docs, rows):
    """Tables of few links have few partitions, whatever the number of shuffle partitions; so files stay few."""
    from pagemill import session
    from pagemill.llm import components as links

    stored = []

    def store(df):
        out = session.cut_lineage(df)
        stored.append(out.rdd.getNumPartitions())
        return out

    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(links, "cut_lineage", store)
    monkeypatch.setattr(minhash, "cut_lineage", store)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
        got = {r.node: r.component for r in links.components(chain).collect()}
        assert got == dict.fromkeys(range(61), 0)
        assert stored[0] == 40 and len(stored) > 8 and max(stored[1:]) <= 2
        stored.clear()
        want = collections.Counter(components_by_hand(rows, 85, 3))
        assert bag(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == want
        assert sum(n >= 40 for n in stored) <= 8
        # Many tasks, each for few links.
        monkeypatch.setattr(links, "in_few_tasks", lambda df, n: session.in_few_tasks(df, n, 7))
        got = {r.node: r.component for r in links.components(chain).collect()}
        assert got == dict.fromkeys(range(61), 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        path = os.path.join(str(tmp_path), name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    first = [(r.doc_id, r.text) for r in kept[0]]
    near = {d for d, _, c in components_by_hand(first, 80, 5) if d == c}
    assert {r.doc_id for r in kept[1]} == near
    second = [(r.doc_id, r.text) for r in kept[1]]
    assert {r.doc_id: words(r.text) for r in kept[2]} == {d: keep for d, _, keep in kept_by_hand(second)}
    ids = collections.Counter(r.doc_id for r in kept[3])
    assert set(ids) <= near and max(ids.values()) <= 3
    pieces = collections.Counter(r.doc_id for r in kept[4] if r.start == 0)
    assert pieces == ids


def test_quality_sample_is_bounded_with_repeated_ids(spark):
    """Thousands of rows with one labelled id bring one text to the driver."""
    rows = [(1, f"text {i % 3}") for i in range(3000)] + [(i, f"own {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    texts, marks, _ = quality.labelled_sample(docs, labels, 10, 10_000)
    assert len(texts) == len(marks) == 20 and sum(t.startswith("text") for t in texts) <= 1


def test_repeated_rows_cost_their_number(spark):
    """The list of a document's pieces does not grow with the number of its rows."""
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150 ", "other ")
    rows = [(2, base)] * 400 + [(1, near), (3, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = bag(substrings.digests(docs), "doc_id", "n_removed")
    assert got == collections.Counter({(1, 0): 1, (2, 299): 400, (3, 300): 1})
