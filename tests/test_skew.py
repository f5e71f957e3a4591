"""Operators that cut long groups into chunks, against brute force, with tiny chunks and a hot key."""

import os
import random

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagemill.operators import chains, ordered, search, segment, store
from pagemill.session import cut_lineage
from pagemill.sources.catalog import lookup_source
from pagemill.sources.sinks import read_sections, write_sections
from pagemill.streaming import jobs
from pagemill.streaming import processors


def outcome(log):
    n = dict(saved=0, skipped=0, failed=0)
    streak, reason = 0, None
    for what, code in log:
        if what == "store_error":
            reason = "store_error"
            break
        n[what] += 1
        streak = streak + 1 if what == "failed" else 0
        if what == "failed" and code in (403, 429):
            reason = "refused"
        elif streak >= 3:
            reason = "failing"
        if reason:
            break
    return (len(log), n["saved"], n["skipped"], n["failed"], reason)


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_backfill_outcome(spark, chunk):
    rnd = random.Random(chunk)
    rows, expect = [], {}
    for run in range(60):
        size = 300 if run == 0 else rnd.randint(1, 25)
        ords = sorted(rnd.sample(range(size * 3), size))
        # The hot run stops late; some runs hold long stretches of failures across chunks.
        weights = (30, 6, 1, 0) if run == 0 else (3, 1, 4, 0.3)
        log = []
        for _ in ords:
            what = rnd.choices(["saved", "skipped", "failed", "store_error"], weights)[0]
            log.append((what, rnd.choice([500, 500, 500, 429]) if what == "failed" else None))
        rows += [(run, o, w, c) for o, (w, c) in zip(ords, log)]
        expect[run] = outcome(log)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id int, ord long, outcome string, http_status int")
    got = store.backfill_outcome(df, chunk=chunk).collect()
    assert {r.run_id: (r.total, r.saved, r.skipped, r.failed, r.reason) for r in got} == expect


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_neighbours(spark, chunk):
    rows = [(k, i, f"{k}-{i}") for k, n in ((0, 50), (1, 1), (2, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, idx int, v string")
    out = ordered.neighbours(df, ["k"], "idx", {"prev": ("v", -1), "next": ("v", 1), "second": ("v", 2)}, chunk=chunk)
    known = {(k, i): v for k, i, v in rows}
    got = {(r.k, r.idx): (r.prev, r.next, r.second) for r in out.collect()}
    assert got == {(k, i): (known.get((k, i - 1)), known.get((k, i + 1)), known.get((k, i + 2))) for k, i, _ in rows}


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_running_max(spark, chunk):
    rnd = random.Random(7)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), i, rnd.randint(0, 99)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o long, v int")
    got = {r.o: r.m for r in ordered.running_max(df, ["k"], "o", "v", "m", chunk=chunk).collect()}
    tops, expect = {}, {}
    for k, o, v in rows:
        tops[k] = max(v, tops.get(k, v))
        expect[o] = tops[k]
    assert got == expect


def test_dense_index(spark):
    rows = [(0, p, i) for p in (3, 1, 2) for i in range(10 * p)] + [(1, 5, 0)]
    df = spark.createDataFrame(rows, "k int, p int, i int")
    got = {(r.k, r.p, r.i): r.idx for r in ordered.dense_index(df, ["k"], F.col("p"), [F.col("i")]).collect()}
    for k in (0, 1):
        mine = sorted(x for x in rows if x[0] == k)
        assert [got[x] for x in mine] == list(range(len(mine)))


def test_chains(spark):
    links = [(f"u{i}", f"u{i + 1}") for i in range(40)] + [("a", "b"), ("b", "c"), ("c", "b"), ("s", "s"), ("x", "")]
    starts = [("long", "u0"), ("mid", "u35"), ("loop", "a"), ("self", "s"), ("none", "x"), ("gone", "nowhere")]
    out = chains.follow(
        spark.createDataFrame(starts, "k string, url string"), spark.createDataFrame(links, "url string, next_url string"), ["k"], 20
    )
    got = {}
    for r in out.orderBy("k", "page_no").collect():
        got.setdefault(r.k, []).append(r.url)
    assert got == {
        "long": [f"u{i}" for i in range(20)],
        "mid": [f"u{i}" for i in range(35, 41)],
        "loop": ["a", "b", "c"],
        "self": ["s"],
        "none": ["x"],
        "gone": ["nowhere"],
    }


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10 000 pages and a cycle of 3 000 behind a run-up, in less than 20 stored rounds."""
    rounds = []
    before = chains.cut_lineage
    monkeypatch.setattr(chains, "cut_lineage", lambda df: rounds.append(1) or before(df))
    links = [(f"u{i}", f"u{i + 1}") for i in range(9_999)] + [(f"c{i}", f"c{i + 1}") for i in range(3_499)] + [("c3499", "c500")]
    starts = [("long", "u0"), ("cycle", "c0"), ("inside", "c700"), ("end", "u9998")]
    out = chains.follow(spark.createDataFrame(starts, "k string, url string"), spark.createDataFrame(links, "url string, next_url string"), ["k"])
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.page_no] = r.url
    assert [got["long"][i + 1] for i in range(10_000)] == [f"u{i}" for i in range(10_000)] and len(got["long"]) == 10_000
    assert [got["cycle"][i + 1] for i in range(3_500)] == [f"c{i}" for i in range(3_500)] and len(got["cycle"]) == 3_500
    assert [got["inside"][i + 1] for i in range(3_000)] == [f"c{500 + (200 + i) % 3000}" for i in range(3_000)] and len(got["inside"]) == 3_000
    assert got["end"] == {1: "u9998", 2: "u9999"}
    assert len(rounds) < 2 * 20


def part_files(path):
    return {f"{folder}/{name}" for folder, _, names in os.walk(path) for name in names if name.startswith("part-")}


def test_stored_parts(spark, tmp_path):
    """Only the parts that a batch reaches are read and written; a cleared part stays empty."""
    path = str(tmp_path / "store")
    schema = "book_id long, source_url string, book_url string, chapter_url string, content string, seq long"
    rows = [(b, "s", "u", f"c{c}", "text", 1) for b in range(40) for c in range(8)] + [(7, "s", "u", f"x{c}", "text", 1) for c in range(300)]
    store.write_parts(spark.createDataFrame(rows, schema), path)
    first = part_files(path)
    new = [(3, "s", "u", "c1", "newer", 2), (3, "s", "u", "c2", " ", 2), (41, "s", "u", "c0", "added", 1)]
    store.merge_parts(spark, path, spark.createDataFrame(new, schema), ["seq"])
    second = part_files(path)
    assert 0 < len(first - second) <= 3  # the rest keep their files
    got = {(r.book_id, r.chapter_url): r.content for r in store.read_parts(spark, path).collect()}
    want = {(b, c): t for b, _, _, c, t, _ in rows} | {(3, "c1"): "newer", (41, "c0"): "added"}
    assert got == want
    parts = spark.read.parquet(path).where(F.col("part").isin([1, 2]))
    assert "PartitionFilters: [" in parts._jdf.queryExecution().toString() and "part" in parts._jdf.queryExecution().toString()
    store.clear_parts(spark, path, spark.createDataFrame([(3,), (7,)], "book_id long"))
    got = {(r.book_id, r.chapter_url): r.content for r in store.read_parts(spark, path).collect()}
    assert got == {k: t for k, t in want.items() if k[0] not in (3, 7)}
    assert len(second - part_files(path)) <= 2 * store.SPREAD
    store.merge_parts(spark, path, spark.createDataFrame([], schema), ["seq"])
    assert store.read_parts(spark, path).count() == len(got)


def cut_points(text):
    """Brute force: every allowed place is looked at."""
    pos, out = 0, []
    while pos < len(text):
        if len(text) - pos <= 8000:
            out.append(len(text))
            break
        places = range(pos + 4000, pos + 8001)
        ends = [p for p in places if text[p - 1] == "\n"]
        stops = [p for p in places if text[p - 1] in "。！？.!?"]
        late = [p for p in stops if p >= pos + 6000]
        if ends:
            cut = min(ends, key=lambda p: (abs(p - pos - 6000), -p))
        elif stops:
            cut = min(late) if late else max(stops)
        else:
            cut = pos + 6000
        out.append(cut)
        pos = cut
    return out


def test_cuts(spark):
    rnd = random.Random(3)
    texts = []
    for n in (0, 1, 7999, 8000, 8001, 20000, 45000, 123456):
        for density in (0, 1, 3, 40):
            body = ["字"] * n
            for _ in range(density * n // 8000):
                body[rnd.randrange(n)] = rnd.choice("\n\n。.!")
            texts.append("".join(body))
    edge = ["x"] * 30000
    edge[5998] = edge[6000] = "\n"
    texts.append("".join(edge))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "i int, text string")
    for r in df.select("i", segment.cuts(F.col("text")).alias("c")).collect():
        assert r.c == cut_points(texts[r.i]), r.i


def test_section_rows_cover_long_texts(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(12):
        parts = [f"第{k}章 名{k}\n" + "".join(rnd.choice("文字。\n") for _ in range(rnd.choice([50, 9000, 30000]))) for k in range(1, 6)]
        rows.append((i, "开头\n" * (i % 3) + "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = segment.section_rows(segment.segment(df), ["doc_id"]).collect()
    for i, text in rows:
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.idx)
        assert "".join(r.section_text for r in mine) == text
        assert all(r.end - r.start <= 20000 for r in mine)
        assert [r.idx for r in mine] == list(range(len(mine)))


def test_sections_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, "第1章 a\nx\n第2章 b\ny") for i in range(30)], "doc_id int, text string")
    write_sections(segment.section_rows(segment.segment(df), ["doc_id"]), str(tmp_path / "s"), "doc_id", buckets=4)
    back = read_sections(spark, str(tmp_path / "s"))
    assert back.count() == 60
    assert back.select("book_id", "chapter_id").distinct().count() == 60
    with pytest.raises(Exception):
        write_sections(segment.section_rows(segment.segment(df), ["doc_id"]), str(tmp_path / "s"), "doc_id")


def test_bursts_over_batches(spark, tmp_path):
    """Bursts grow, are joined by a late write, and close; their last form is the one a single pass would give."""
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda ms: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)
    batches = [
        [(1, 0, 1), (1, 400, 2), (2, 100, 1)],
        [(1, 1300, 3), (2, 600, 2)],  # a second burst of 1; the first write of 2 was exactly the quiet time before
        [(1, 850, 4)],  # bridges both bursts of 1
        [(1, 9000, 5), (2, 9000, 9)],
        [(1, 9400, 6), (3, 9500, 1)],
    ]
    for rows in batches:
        df = spark.createDataFrame([(n, at(ms), q) for n, ms, q in rows], "name long, ts timestamp, seq long").coalesce(1)
        df.write.mode("append").parquet(landing)
        jobs.keep_bursts(spark.readStream.schema(df.schema).parquet(landing), path, late="2 seconds")
    got = {(r.name, r.seq, r.ms, r.n_writes) for r in jobs.current_bursts(spark, path).withColumn("ms", F.unix_millis("ts")).collect()}
    base = int(at(0).timestamp() * 1000)
    want = {(1, 3, 1300, 4), (2, 2, 600, 2), (1, 6, 9400, 2), (2, 9, 9000, 1), (3, 1, 9500, 1)}
    assert got == {(n, q, base + ms, k) for n, q, ms, k in want}


def test_busy_keys_send_few_rows(spark):
    """What one key brings is thinned out before it reaches its state."""
    rows = spark.range(20_000, numPartitions=2)
    busy = rows.select(F.lit("k").alias("key"), F.col("id").alias("ord"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("seq"))
    assert processors.record_highs(busy).count() < 2000
    writes = rows.select(F.lit(1).cast("long").alias("name"), F.timestamp_millis(F.col("id") * 100).alias("ts"), F.col("id").alias("seq"))
    parts = processors.partial_bursts(writes, "500 milliseconds")
    assert parts.count() < 200 and parts.agg(F.sum("n_writes")).first()[0] == 20_000


def test_stale_responses_over_batches(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("k", 0, 5), ("k", 1, 3), ("j", 2, 1)], [("k", 3, 4), ("k", 4, 5), ("j", 5, 1), ("j", 6, 0)], [("k", 7, 9)]]
    for rows in batches:
        df = spark.createDataFrame(rows, "key string, ord long, seq long")
        df.write.mode("append").parquet(landing)
        jobs.drop_stale(spark.readStream.schema(df.schema).parquet(landing), path)
    kept = sorted(r.ord for r in jobs.read_appended(spark, path).collect())
    assert kept == [0, 2, 4, 5, 7]


@pytest.fixture
def small_partitions(spark):
    """Sizes at which a few thousand rows are a skewed partition, and no side is broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def split_joins(df):
    """The rows, and whether Spark split a partition of a join while it made them."""
    rows = df.collect()
    return rows, "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def hot_rows(spark, n=20_000):
    """Rows (key, source, address, page) of which 60 % have one key."""
    key = F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    return spark.range(n, numPartitions=6).select(
        key.alias("group_key"),
        key.alias("search"),
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source_url"),
        F.concat(F.lit("/b/"), F.sha2(F.col("id").cast("string"), 256)).alias("book_url"),
        (F.col("id") % 4 + 1).cast("int").alias("page"),
        "id",
    )


def test_a_hot_title_is_split(spark, small_partitions):
    rows, split = split_joins(search.with_alternatives(search.variants(hot_rows(spark), ["page", "id"])))
    assert split and len(rows) == 20_000
    hot = [r for r in rows if r.group_key == "hot"]
    assert {r.n_alternatives for r in hot} == {12_000} and [r.id for r in hot if r.is_first] == [0]


def test_a_hot_search_is_split(spark, small_partitions):
    read, limits = search.merge_pages(hot_rows(spark), ["search"])
    rows, split = split_joins(read)
    assert split and sum(r.search == "hot" for r in rows) == 12_000
    assert [r.last_page for r in limits.collect() if r.search == "hot"] == [4]


def test_a_hot_source_is_split(spark, small_partitions):
    books = hot_rows(spark).withColumn("source_url", F.col("group_key")).select("source_url", "book_url", "id")
    sources = spark.range(900).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("source_url"), F.lit("n").alias("source_name"), F.col("id").alias("ord")
    )
    sources = sources.union(spark.createDataFrame([("hot", "busy", 2), ("hot", "busier", 1)], sources.schema))
    rows, split = split_joins(lookup_source(books, sources))
    assert split and len(rows) == 20_000
    assert {r.found_name for r in rows if r.source_url == "hot"} == {"busier"}
    assert all(r.source_missing == (r.source_url != "hot" and int(r.source_url[1:]) >= 900) for r in rows)


def test_checkpoint_folder_is_respected(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    assert spark.sparkContext.getCheckpointDir()


def test_new_shelf_rows_are_found_by_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 50)
    rows = [(f"s{i % 7}", f"/b{0 if i % 2 else i % 40}", f"n{i}", None if i % 5 == 0 else i % 90, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "source_url string, book_url string, name string, page int, ord int")
    own = spark.createDataFrame([("s1", "/b0"), ("s2", "/b2")], "source_url string, book_url string")
    out = search.add_to_shelf(own, df, ["page", "ord"])
    want = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[4])):
        want.setdefault(r[:2], r[2])
    want = {k: v for k, v in want.items() if k not in {("s1", "/b0"), ("s2", "/b2")}}
    assert {(r["source_url"], r["book_url"]): r["name"] for r in out.collect()} == want
    assert out.count() == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 20\n") == 2 and "_place" in plan  # 20 tasks of 50 rows; as many as the session says before


def test_variants_of_one_micro_batch_are_not_grouped_again(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "group_key string, source_url string, book_url string, name string, page int"

    def land(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        jobs.group_results(spark.readStream.schema(schema).parquet(landing), path, ["page"])
        return jobs.current_variants(spark, path, ["page"])

    first = [("g", "s1", "/a", "late", 4), ("g", "s1", "/a", "mid", 3), ("g", "s2", "/a", "x", 1), (None, "s1", "/b", "y", 2)]
    found = land(first)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = search.variants(spark.createDataFrame(first, schema), ["page"])
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    more = [("g", "s1", "/a", "early", 2), ("g", "s2", "/a", "z", 9)]
    found = land(more)
    want = search.variants(spark.createDataFrame(first + more, schema), ["page"])
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_state_of_variants_is_kept_on_disk_in_bounded_memory(spark, tmp_path, monkeypatch):
    landing, path, prefix = str(tmp_path / "in"), str(tmp_path / "out"), "spark.sql.streaming.stateStore."
    schema = "group_key string, source_url string, book_url string, name string, page int"
    names = ["providerClass", "rocksdb.maxMemoryUsageMB", *jobs.MANY_KEYS]
    settings, held, run = lambda: {n: spark.conf.get(prefix + n, None) for n in names}, [], jobs.run_batches
    monkeypatch.setattr(jobs, "run_batches", lambda *a, **k: (held.append(settings()), run(*a, **k)))
    spark.conf.set(prefix + "rocksdb.maxMemoryUsageMB", "64")  # the session's own choice
    try:
        before, rows = settings(), []
        for start in range(3):  # pages fall, so that later starts find earlier sightings of old variants
            more = [(f"g{i % 5}", f"s{i % 3}", f"/b{i % (40 + 20 * start)}", f"n{start}.{i}", 900 - 300 * start + i) for i in range(90)]
            rows += more
            spark.createDataFrame(more, schema).repartition(3).write.mode("append").parquet(landing)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(landing)
            jobs.group_results(stream, path, ["page"])
        assert settings() == before
    finally:
        spark.conf.unset(prefix + "rocksdb.maxMemoryUsageMB")
    assert held == [before | jobs.MANY_KEYS | {"providerClass": held[0]["providerClass"], "rocksdb.maxMemoryUsageMB": "64"}] * 3
    assert held[0]["providerClass"].endswith("RocksDBStateStoreProvider")
    kinds = {f.suffix for f in (tmp_path / "out/checkpoint/state/0").rglob("*") if not f.name.startswith(("_", "."))}
    assert ".sst" in kinds and not kinds & {".delta", ".snapshot"}
    found = jobs.current_variants(spark, path, ["page"])
    want = search.variants(spark.createDataFrame(rows, schema), ["page"])
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
