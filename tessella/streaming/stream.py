"""Streaming forms: event-time windows, chunks carried by state, resumable runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A file stream of events with ``ts`` as a timestamp (event time needs one)."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and their sum per window and kind; rows later than ``late`` behind the watermark are left out."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def chunk_counts(stream: DataFrame, size: int = 12) -> DataFrame:
    """(user_id, chunks): chunks of ``size`` actions completed by each batch; the remainder is carried as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n % size,))
        if n >= size:
            yield pd.DataFrame({"user_id": [key[0]], "chunks": [n // size]})

    return stream.select("user_id").groupBy("user_id").applyInPandasWithState(run, "user_id long, chunks long", "carried long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint remembers what has been seen, so a later run goes on from it.

    Each batch is written to a folder of its own, so a batch that is tried again replaces itself.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}" if mode == "append" else f"{out}/batch=0")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
