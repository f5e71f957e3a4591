"""Storing and moving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import chapter_id


ROWS_PER_TASK = 4096


def write_sections(sections: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Store section rows under ``book_bucket=`` folders; Spark's commit makes them visible at once.

    One shuffle puts each part of a bucket into one task and one file. Buckets have as many parts as
    there are shuffle partitions for them, and a book goes to a further task after every 4096 sections.
    """
    parts = max(1, int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    hashed = F.xxhash64(F.col(key).cast("string"))
    out = sections.select(
        F.sha2(F.col(key).cast("string"), 256).alias("book_id"),
        chapter_id(F.col("idx")).alias("chapter_id"),
        "title",
        F.sha2("section_text", 256).alias("content_hash"),
        F.col("section_text").alias("content"),
        F.pmod(hashed, F.lit(buckets)).cast("int").alias("book_bucket"),
        F.pmod(F.floor(hashed / buckets), F.lit(parts)).alias("_part"),
        F.floor(F.col("idx") / ROWS_PER_TASK).alias("_stretch"),
    )
    spread = out.repartition("book_bucket", "_part", "_stretch").drop("_part", "_stretch")
    spread.write.mode("errorifexists").partitionBy("book_bucket").parquet(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_shelf(shelf: DataFrame, path: str) -> None:
    shelf.write.mode("overwrite").json(path)


def read_shelf(spark: SparkSession, path: str, schema) -> DataFrame:
    """An exported shelf, checked against the expected schema."""
    return spark.read.schema(schema).json(path)
