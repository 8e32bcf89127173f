"""Continuous form of re-running ingest: new review files are picked up as they arrive.

Every batch is stored under its own number, so a batch that is repeated after a failure
replaces itself. The current reviews are the newest stored row of each id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from echotide.functions.fixed_values import HEADER_ALIASES
from echotide.plans.incremental import BUCKETS, apply_batch
from echotide.schemas import REVIEWS_RAW
from echotide.sources.review_files import latest_per_review, typed_reviews


def _files(spark: SparkSession, folder: str, headers: list[str], quoted_newlines: bool) -> DataFrame:
    schema = ", ".join(f"`{h}` string" for h in headers)
    source = (
        spark.readStream.schema(schema).option("header", True).option("multiLine", quoted_newlines)
        .option("escape", '"').csv(folder)
    )
    return typed_reviews(source)


def follow_review_files(spark: SparkSession, folder: str, headers: list[str], log: str, checkpoint: str,
                        quoted_newlines: bool = False) -> StreamingQuery:
    """Read all files now in the folder and stop; the checkpoint remembers which were read."""

    def store(batch: DataFrame, number: int) -> None:
        latest_per_review(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (
        _files(spark, folder, headers, quoted_newlines).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def keep_tables(spark: SparkSession, folder: str, headers: list[str], root: str, checkpoint: str,
                quoted_newlines: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Apply all files now in the folder to the stored tables of `root` and stop. A batch that is repeated after a failure is
    known by its number."""

    def store(batch: DataFrame, number: int) -> None:
        apply_batch(batch.sparkSession, root, number, batch, buckets=buckets)

    return (
        _files(spark, folder, headers, quoted_newlines).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_reviews(spark: SparkSession, log: str) -> DataFrame:
    """A later batch replaces the rows of an earlier one."""
    stored = spark.read.schema(f"{REVIEWS_RAW}, batch bigint").parquet(log)
    newest = Window.partitionBy("review_id").orderBy(F.desc("batch"))
    return stored.withColumn("newest", F.row_number().over(newest)).filter("newest = 1").select(*HEADER_ALIASES)
