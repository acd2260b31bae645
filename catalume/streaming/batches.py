"""Resumable batch work as streams: progress is in Spark's checkpoints, results of a batch are written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.numbering import with_places

#: Columns that an uploaded file must have.
UPLOAD = ("Authors", "Year", "Title", "DOI", "Open Access", "Abstract", "Id", "Source", "Language", "Country", "Database", "Journal")


def process_new_files(spark: SparkSession, path: str, schema, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet", key: str = "id", existing: str | None = None, files_a_batch: int = 100) -> StreamingQuery:
    """Runs ``transform`` on the rows of new files and writes them to ``out``, by batch number, until no file is left. Rows whose key stands in ``existing`` are left out. A batch that is run again replaces its own output."""

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch if existing is None else batch.join(spark.read.parquet(existing).select(key), key, "left_anti")
        transform(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(path)
    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_upload(df: DataFrame) -> DataFrame:
    missing = [c for c in UPLOAD if c.lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; what comes later than ``late`` is left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def status(query: StreamingQuery) -> str:
    """PENDING, SUCCESS or FAILURE."""
    if query.isActive:
        return "PENDING"
    return "FAILURE" if query.exception() else "SUCCESS"


def update_tracker(tracker: DataFrame, results: DataFrame) -> DataFrame:
    """source_name, processed_ids, failed_ids after a run: results (source_name, processed, failed as arrays) are added; what was retried and went well is no longer failed."""
    none = F.array().cast("array<bigint>")
    joined = tracker.join(results, "source_name", "full")
    done = F.array_union(F.coalesce("processed_ids", none), F.coalesce("processed", none))
    failed = F.array_union(F.array_except(F.coalesce("failed_ids", none), F.coalesce("processed", none)), F.coalesce("failed", none))
    return joined.select("source_name", F.array_sort(done).alias("processed_ids"), F.array_sort(failed).alias("failed_ids"), F.array_max(done).alias("last_processed_id"))


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def with_retry(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """``rows`` with `retry`: whether their key is among the failed ones."""
    mark = failed.select(key).distinct().withColumn("__failed", F.lit(True))
    return rows.join(mark, key, "left").withColumn("retry", F.col("__failed").isNotNull()).drop("__failed")


def in_batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with `batch`, numbers of groups of ``size`` in the order of a key."""
    return with_places(rows, key, name="__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")
