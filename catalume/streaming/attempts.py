"""Which items of a source are done, to be tried again or given up, from a stream of attempts: a small state for each item."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Attempts after which an item is given up.
LIMIT = 3
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class Attempts(StatefulProcessor):
    """State of an item (source, id): its attempts so far, and whether the last one went well. What comes after success or the last attempt is passed over."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "tries int, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tries, done = self.progress.get() if self.progress.exists() else (0, False)
        before = (tries, done)
        # no more attempts than are left can matter, so that a key with many rows needs no more memory
        for _, ok in heapq.nsmallest(self.limit - tries, ((r["at"], r["ok"]) for r in rows)) if not done else ():
            tries, done = tries + 1, ok
            if done:
                break
        if (tries, done) != before:
            self.progress.update((tries, done))
            yield Row(source=key[0], id=key[1], tries=tries, status="done" if done else "given_up" if tries >= self.limit else "retry")

    def close(self) -> None:
        pass


def track(attempts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """source, id, tries, status (`done`, `retry`, `given_up`) of each item whose state a batch of the stream ``attempts`` (source, id, at, ok) changes.

    Within a batch attempts count in the order of ``at`` (of equal ones failures first), batch after batch. A null or false
    ``ok`` is a failure; rows without an ``at`` are left out. Items are keyed one by one: no list of ids is kept anywhere.
    """
    rows = attempts.select("source", "id", "at", F.coalesce("ok", F.lit(False)).alias("ok")).where("at IS NOT NULL")
    kinds = dict(rows.dtypes)
    return rows.groupBy("source", "id").transformWithState(Attempts(limit), f"source {kinds['source']}, id {kinds['id']}, tries int, status string", "Update", "None")


def run(attempts: DataFrame, out: str, checkpoint: str, limit: int = LIMIT) -> StreamingQuery:
    """Writes the changes of all attempts that are there to ``out``, a folder for each batch; a batch that is run again replaces its own. Restarted with the same ``checkpoint`` it goes on where it stopped."""
    spark = attempts.sparkSession
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, PROVIDER)  # the stream keeps the setting that holds when it starts
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        return track(attempts, limit).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, old)


def latest(changes: DataFrame) -> DataFrame:
    """source, id, tries, status by the last of the written changes (with batch)."""
    return changes.groupBy("source", "id").agg(F.max_by(F.struct("tries", "status"), "batch").alias("x")).select("source", "id", "x.*")


def to_try(items: DataFrame, state: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``items`` (source, id, ...) that are new or failed and not given up, with `tries` so far and `retry`, whether they failed before."""
    told = items.join(state.select("source", "id", "tries", "status"), ["source", "id"], "left")
    open_ = F.col("status").isNull() | (F.col("status") == "retry") & (F.col("tries") < limit)
    return told.where(open_).select(*items.columns, F.coalesce("tries", F.lit(0)).alias("tries"), F.col("status").isNotNull().alias("retry"))
