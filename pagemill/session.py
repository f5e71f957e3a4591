"""Session settings and the shared folder used for checkpoints and stored tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pagemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for. A cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join partition even where that costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Join the bursts of a busy name inside each task before they are shuffled.
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Looking up the call site of every Column call costs seconds on long expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Page rows grow about tenfold when shredded, so keep the Arrow batches small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``); a private one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="pagemill-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stored table, under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so later steps neither recompute nor depend on executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_few_tasks(df: DataFrame, rows: int, each: int = 8192) -> DataFrame:
    """Merge partitions, without a shuffle, so that a table of ``rows`` small rows has a task per ``each`` of them at most.

    Every task of a stored table or a shuffle costs files of its own, however few its rows are.
    """
    return df.coalesce(max(1, -(-rows // each)))


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Unlike a checkpoint, the table forgets how its rows were dealt out and tells its size: a join shuffles it, so that
    Spark can split a hot key of the other side, or broadcasts it where it is small.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy work on a table that was read in fewer partitions than there are cores.

    Large tables have more partitions than that and pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Use a task per so many rows for heavy work on small rows, of which one part of a file can hold very many."""
    wanted = -(-df.count() // rows)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
