"""Structured Streaming jobs over the append-only logs.

Each job is a transformation of a streaming DataFrame; run_available() drives one to the
end of what there is and returns what the sink holds. Batch and stream share their
aggregates, so a stream's result can be checked against its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ingest, logs


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream; its schema is read from the files."""
    path = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name}.parquet*")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time must be an instant: the files hold local timestamps."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def feedback_stats(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Feedback measures of each tumbling window."""
    grouped = logs.feedback(events).withWatermark("ts", delay).groupBy(F.window("ts", window))
    return grouped.agg(*logs.feedback_measures()).select(F.col("window.start").alias("start"), "total_feedback", "likes", "dislikes", "partial_correct", "corrections", "satisfaction_rate", "error_rate")


def audit_daily(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per day and action; in append mode a day appears once the watermark has passed it."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("action"))
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def sliding_counts(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Runs of one user's events with no gap of `gap` between them."""
    grouped = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def failure_alarms(events: DataFrame, least: int = 3) -> DataFrame:
    """user_id, opened_at: the stateful twin of failure_streaks. State is one small counter per user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        opened = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for failed, ts in zip(rows["event_type"] == "error", rows["ts"]):
            run = run + 1 if failed else 0
            if run == least:
                opened.append(ts)
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]] * len(opened), "opened_at": pd.to_datetime(pd.Series(opened), utc=True)})

    return events.select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandasWithState(step, "user_id long, opened_at timestamp", "run int", "append", "NoTimeout")


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a chunk table: batch n becomes the folder age=n.

    A batch costs what it holds, whatever the table's size, and a repeated batch overwrites
    its own folder. chunk_table() lets later batches win; compact() folds them into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest.chunk_rows(batch, batch_id).drop("age").write.mode("overwrite").parquet(f"{path}/age={batch_id}")

    return write


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """id, text, source, pos, age: the newest row of each text among all batches."""
    return ingest.newest_chunks(spark.read.parquet(path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The table as the one batch before all others of a new folder, to which batches go on."""
    chunk_table(spark, path).withColumn("age", F.lit(-1)).write.partitionBy("age").parquet(target)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What the stream's sink holds after one availableNow run. path is a fresh shared folder."""
    spark = stream.sparkSession
    if mode == "append":
        out = f"{path}/out"
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    out = f"{path}/latest"
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.foreachBatch(replace).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
