"""Hard negatives, the prefix trie and the n-gram join against brute force, with every kind of odd row."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from pagemill.llm import mining, sigtree, trie
from tests.llm import data
from tests.llm.data import frame, words

VECTORS = "vec_id long, embedding array<float>, label int, entry int, score string, rank int, times int, v string"
TURNS = "conv_id long, turn long, role string, text string, path int, depth string, pos int, p int, h string"


# The n-gram join.


def shingle_set(text: str | None) -> frozenset:
    w = [x.translate(data.LOWER) for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def joined(rows) -> collections.Counter:
    """Brute force over all pairs of rows."""
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[0] is None or b[0] is None or not sets[i] or not sets[j]:
                continue
            inter = len(sets[i] & sets[j])
            if a[0] == b[0] or 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), None if r[0] is None else low[find(i)]) for i, r in enumerate(rows))


def bag(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("members", [1024, 3])
def test_ngram_join(spark, monkeypatch, members):
    """Also with trees so small that they are dealt out over several tasks."""
    monkeypatch.setattr(sigtree, "MEMBERS", members)
    rows = data.documents()
    rng = random.Random(3)
    base = words(rows[0][1]) * 2 + [f"w{i}" for i in range(60)]
    for k in range(14):  # around the threshold
        own = list(base)
        for _ in range(k % 4):
            own[rng.randrange(len(own))] = f"x{k}"
        rows.append((1000 + k, " ".join(own), *rows[0][2:]))
    assert bag(sigtree.jaccard_join(frame(spark, rows))) == joined(rows)


def test_ngram_join_of_nothing(spark):
    assert sigtree.jaccard_join(frame(spark, [])).count() == 0
    blank = [(1, None, *[None] * 14), (2, " ", *[None] * 14), (None, "a b", *[None] * 14)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in sigtree.jaccard_join(frame(spark, blank)).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (None, 1, None)}


@pytest.mark.parametrize("seed", range(6))
def test_tree_traversal_loses_no_link(seed):
    rng = np.random.default_rng(seed)
    common = np.unique(rng.integers(0, 2**63, 40, dtype=np.uint64))
    sets = []
    for _ in range(40):
        own = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        if rng.random() < 0.5:
            own = np.unique(np.concatenate([own, common]))
        for _ in range(rng.integers(1, 5)):
            sets.append(np.unique(np.where(rng.random(len(own)) < 0.05, rng.integers(0, 2**63, len(own), dtype=np.uint64), own)))
    got = sigtree.links(sets, np.arange(len(sets)), 80)
    bits, sizes = [sigtree.bitmap(s, sigtree.width_of(len(s))) for s in sets], np.array([len(s) for s in sets])
    has = sigtree.partners(bits, sizes, np.array([s[0] for s in sets]), 80)
    assert all(has[i] for pair in got for i in pair)
    root = list(range(len(sets)))

    def find(i, r):
        while r[i] != i:
            i = r[i]
        return i

    for a, b in got:
        inter = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter)
        root[find(a, root)] = find(b, root)
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                assert find(i, root) == find(j, root)


def test_tree_prunes():
    """Sets that share one token only are told apart by bitmaps: hardly any pair is compared in full."""
    rng = np.random.default_rng(1)
    sets = [np.unique(np.append(rng.integers(0, 2**63, 100, dtype=np.uint64), np.uint64(7))) for _ in range(300)]
    calls = []
    before, sigtree.overlap = sigtree.overlap, lambda a, b: calls.append(1) or 0
    try:
        assert sigtree.links(sets, np.arange(300), 80) == []
    finally:
        sigtree.overlap = before
    assert len(calls) < 0.1 * 300 * 299 / 2


# The prefix trie.


def conversations(seed: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 40), 100, 101, 150, 199, 205, 300, 1234]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é", None, ""])))
    rows += [(400, t, "user", "long") for t in range(70)] + [(401 + k, t, "user", "long") for k in range(6) for t in range(60 + k)]
    rows += [(7, None, "user", "first"), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "lost")]
    rows += [(900 + k, t, "user", "same") for k in range(30) for t in range(7)]
    rng.shuffle(rows)
    return [(*r, 1, "d", 2, 3, "h") for r in rows]


def brute_trie(rows) -> collections.Counter:
    own = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == node)
        above = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), above, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("chunk", [4096, 8])
def test_prefix_trie(spark, monkeypatch, chunk):
    """Also with chunks so small that conversations and lists of ids span several."""
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = conversations()
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    assert collections.Counter(map(tuple, trie.prefix_trie(table).select(*NODE).collect())) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = [(c, 0, None, None, 1, "d", 2, 3, "h") for c in (1, 2, None)]  # one turn each, which their base lacks
    table = spark.createDataFrame(one, TURNS)
    assert collections.Counter(map(tuple, trie.prefix_trie(table).select(*NODE).collect())) == brute_trie(one)


# Hard negatives.


def vectors(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        row = [rng.gauss(0, 1) + (i % 3 == j) for j in range(8)]
        rows.append((i, row, rng.choice([0, 1, 2])))
    rows += [(200 + i, rows[10][1], rows[10][2]) for i in range(12)]  # ties
    rows += [rows[20], rows[20], (20, rows[21][1], rows[20][2]), (300, [0.0] * 8, 1), (320, [1.0, 2.0], 1), (321, [2.0, 1.0], 2)]
    rows += [(340, [1.0, 1.0], 1), (341, [0.5, 0.5], 2), (360, [], 1), (400, None, 1), (420, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(440, [1.0, None] + [0.0] * 6, 1), (460, [float("nan")] + [0.0] * 7, 1), (480, [float("inf")] + [0.0] * 7, 2)]
    rng.shuffle(rows)
    return [(*r, 1, "s", 2, 3, "v") for r in rows]


def brute_negatives(rows, every: int) -> collections.Counter:
    ready = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = collections.Counter()
    for n, (a, label, v) in enumerate(ready):
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, lab == label) for m, (i, lab, w) in enumerate(ready) if m != n and len(w) == len(v)]
        for best, i, same in [s for s in sorted(score) if s[2]][:5]:
            band = [s for s in sorted(score) if not s[2] and 30 * -best <= 100 * -s[0] <= 90 * -best]
            for rank, (got, j, _) in enumerate(band[:10], 1):
                out[a, i, rank, j, -best, -got] += 1
    return out


MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block, rows_at_a_time", [(4096, 4096), (5, 16)])
def test_hard_negatives(spark, monkeypatch, block, rows_at_a_time):
    """Also in several blocks of anchors, with short lists."""
    monkeypatch.setattr(mining, "ROWS", rows_at_a_time)
    monkeypatch.setattr(mining, "CLUSTER", 4)
    monkeypatch.setattr(mining, "STEP", 8)
    rows = vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    out = mining.mine(table, table["vec_id"] % 20 == 0, block=block)
    got = collections.Counter(tuple(r) for r in out.select(*MINED).collect())
    assert got == brute_negatives(rows, 20)


def test_hard_negatives_of_nothing(spark):
    table = spark.createDataFrame([], VECTORS)
    assert mining.mine(table, table["vec_id"] % 20 == 0).count() == 0


def test_walks_end_early():
    """Members of a tight cluster leave the list long before its end."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    near = np.repeat(np.arange(20), 200)
    matrix = np.floor(256 * (centre[near] + 0.05 * rng.normal(size=(4000, 16)))).astype(np.int64)
    picked = np.arange(0, 4000, 100)
    anchors = mining.Anchors(picked, near[picked], matrix[picked])
    best = mining.Best(np.full(len(picked), mining._NONE, np.int64), 6)

    def wanted(cluster, members, ids, labels, score):
        q, i = np.nonzero((anchors.labels[members][:, None] == labels) & (score >= best.need[members][:, None]))
        best.add(cluster, members[q], ids[i], score[q, i])

    scored = mining.walk(anchors, np.arange(4000), near, matrix, wanted, lambda members: best.need[members])
    assert scored < 0.5 * len(picked) * 4000
    for n, a in enumerate(picked):
        score = matrix @ matrix[a]
        want = sorted((-score[i], i) for i in range(4000) if near[i] == near[a])[:6]
        entry, ids, score = best.all()
        assert list(zip(-score[entry == n], ids[entry == n])) == want
