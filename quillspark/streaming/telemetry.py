"""Structured Streaming twins of the log and window operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.times import event_time, log_time
from quillspark.sources import artefacts, logs


def timing_stream(spark: SparkSession, path: str) -> DataFrame:
    """The timing log as a stream of records, with ``ts``."""
    return spark.readStream.schema(logs.TIMING_SCHEMA).json(path).withColumn("ts", log_time(F.col("log_ts")))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Request events as a stream; times without a zone are taken as UTC so that a watermark can be set."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return stream.withColumn("ts", event_time(stream, "ts"))


def first_lines(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each run once while its lines come within ``delay``; state older than that is dropped."""
    return runs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id"])


def windowed(events: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """(window_start, requests, errors, error_rate, latency_p95) per tumbling window, closed by a watermark.

    The percentile is approximate, as a stream keeps a sketch for a window and not its values.
    """
    error = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(error).alias("errors"), F.percentile_approx("value", 0.95, 1000).alias("latency_p95"))
        .select(F.col("w.start").alias("window_start"), "requests", "errors", F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"), "latency_p95")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, requests): bursts of a consumer's requests with gaps below ``gap``."""
    span = F.session_window("ts", gap).alias("s")
    counted = events.withWatermark("ts", delay).groupBy("user_id", span).agg(F.count(F.lit(1)).alias("requests"))
    return counted.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "requests")


def scale_outs(events: DataFrame, above: int, cooldown_s: int = 300) -> DataFrame:
    """(event_type, minute): minutes in which a target got more than ``above`` requests, with a cooldown between.

    The state of a target is the minute being counted, its count, and the last scale-out; a request older than
    the minute being counted is left out, as it can no longer change what was decided.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        minute, seen, last = state.get if state.exists else (-1, 0, -cooldown_s)
        hits = []
        seconds = sorted(int(t.timestamp()) for pdf in batches for t in pdf.ts if t is not pd.NaT)
        for at in (s // 60 * 60 for s in seconds):
            if at < minute:
                continue
            minute, seen = at, seen + 1 if at == minute else 1
            if seen > above and minute - last >= cooldown_s:
                hits.append(minute)
                last = minute
        state.update((minute, seen, last))
        yield pd.DataFrame({"event_type": [key[0]] * len(hits), "minute": pd.to_datetime(hits, unit="s")})

    return events.select("event_type", "ts").groupBy("event_type").applyInPandasWithState(
        walk, "event_type string, minute timestamp", "minute long, seen long, last long", "append", GroupStateTimeout.NoTimeout
    )


def ingest_stream(pages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Chunk each batch of new pages and append what the index does not have; a batch that comes again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        artefacts.add_to_index(artefacts.parent_table(batch), folder)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to parquet until what is there has been read."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
