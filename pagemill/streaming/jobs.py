"""Stream transformations, and jobs that run them to the end of what has landed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as se
from ..operators import shelf
from ..operators.purify import Rule, apply_rules
from .processors import BURST, Bursts, NewestRequest, partial_bursts, record_highs

# Fixed value: how long a name must be quiet before its last write counts.
QUIET = "500 milliseconds"
# For a state with very many keys: an executor's stores share so many MB, are closed (and gone from its disk) as soon as a
# task has saved them, and do not look each key up once more to count it.
MANY_KEYS = {
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "256",
    "rocksdb.trackTotalNumberOfRows": "false",
    "unloadOnCommit": "true",
}


# --- transformations -------------------------------------------------------------------------


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest position per book, for update mode. Rows are combined per task before the shuffle, and the position
    of each book is kept in Spark's state store."""
    return shelf.latest_progress(events)


def debounce(events: DataFrame, late: str = "1 second", quiet: str = QUIET) -> DataFrame:
    """Bursts of writes per name (name, first, last, seq of the last write, n_writes), as they grow; a burst ends when
    nothing comes for longer than ``quiet``. Every micro-batch gives the new form of the bursts it changed, so the last
    ones need no later event to become visible. ``name`` and ``seq`` are integers; the session's time zone is UTC."""
    parts = partial_bursts(events, quiet).withWatermark("last", late)
    return parts.groupBy("name").transformWithStateInPandas(Bursts(quiet), BURST, "Update", "EventTime")


def newest_only(responses: DataFrame) -> DataFrame:
    """Responses (key, ord, seq) that no newer request was seen before, per key; ``ord`` is the order of arrival and
    rises from micro-batch to micro-batch. The newest request of each key is kept in Spark's state store."""
    rows = record_highs(responses.select("key", "ord", "seq"))
    return rows.groupBy("key").transformWithStateInPandas(NewestRequest(), rows.schema, "Append", "None")


def skip_stored(wanted: DataFrame, store: DataFrame, late: str = "30 days") -> DataFrame:
    """Chapters still to fetch, each asked for once. ``wanted`` has book_id, url and ts."""
    have = store.select("book_id", F.col("chapter_url").alias("url"))
    pending = wanted.withWatermark("ts", late).join(have, ["book_id", "url"], "left_anti")
    return pending.dropDuplicatesWithinWatermark(["book_id", "url"])


def purify_stream(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules on each arriving text; stateless."""
    return apply_rules(texts, rules)


# --- jobs ------------------------------------------------------------------------------------


def run_to_files(stream: DataFrame, path: str) -> None:
    """Append the stream's rows under ``path`` until everything that has landed is processed."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch that runs again overwrites its own folder."""
    return lambda rows, i: rows.write.mode("overwrite").parquet(f"{path}/data/batch={i}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def keep_latest_progress(events: DataFrame, path: str) -> None:
    """Write the positions that each micro-batch changed."""
    run_batches(latest_progress(events), path, _write_batch(path), mode="update")


def current_progress(spark: SparkSession, path: str) -> DataFrame:
    """The last change of each book."""
    return shelf.latest_progress(read_appended(spark, path))


def drop_stale(responses: DataFrame, path: str) -> None:
    """Keep a response (key, ord, seq) only if no newer request was seen before it, per key. A micro-batch only touches
    the keys it brings."""
    with rocks_state(responses.sparkSession):
        run_to_files(newest_only(responses), path)


def keep_bursts(events: DataFrame, path: str, late: str = "1 second", quiet: str = QUIET) -> None:
    """Write the bursts that each micro-batch changed."""
    with rocks_state(events.sparkSession):
        run_batches(debounce(events, late, quiet), path, _write_batch(path), mode="update")


def current_bursts(spark: SparkSession, path: str) -> DataFrame:
    """(name, ts, seq, n_writes): the last form of each burst."""
    rows = read_appended(spark, path)
    last = rows.groupBy("name", "first").agg(F.max(F.struct("batch", "last", "seq", "n_writes")).alias("r"))
    return last.where("r.n_writes > 0").select("name", F.col("r.last").alias("ts"), "r.seq", "r.n_writes")


@contextmanager
def rocks_state(spark: SparkSession, **more: str) -> Iterator[None]:
    """Values per key need the state store that keeps them on disk; the session's own choice comes back afterwards.

    ``more`` are settings of the state store that hold where the session has none of its own.
    """
    prefix = "spark.sql.streaming.stateStore."
    name = prefix + "providerClass"
    before = spark.conf.get(name)
    extra = {prefix + k: v for k, v in more.items() if spark.conf.get(prefix + k, None) is None}
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, v in extra.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        spark.conf.set(name, before)
        for k in extra:
            spark.conf.unset(k)


def group_results(results: DataFrame, path: str, order: list[str]) -> None:
    """Follow the first sighting of every variant in Spark's state store, and write those that a micro-batch changed.

    ``results`` rows carry group_key, source_url, book_url and the ``order`` columns. Nearly every result can be a
    variant, so the store keeps them on disk (see MANY_KEYS); a further micro-batch fetches its files again.
    """
    with rocks_state(results.sparkSession, **MANY_KEYS):
        run_batches(se.variants(results, order), path, _write_batch(path), mode="update")


def current_variants(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """All variants seen so far; :func:`se.group_variants` of it gives the groups.

    A micro-batch writes a variant once, so only the rows of several batches have to be put together.
    """
    rows = read_appended(spark, path)
    if len(rows.select("batch").distinct().take(2)) < 2:
        return rows.drop("batch")
    return se.variants(rows.drop("first_seen", "batch"), order)
