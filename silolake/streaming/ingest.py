"""Structured Streaming ingest: source → parse/quarantine → dedup → lakehouse append.

Event time is ``2024-01-01 + step hours``: a base far from the epoch, because
with ``dropDuplicatesWithinWatermark`` the first watermark is 0 and a row at
1970-01-01 00:00:00 would count as late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolake.schemas import TRANSACTIONS
from silolake.sources.lake import parse_json_events

EVENT_BASE = "2024-01-01 00:00:00"


def kafka_options(topic: str, bootstrap_servers: str, starting_offsets: str = "earliest",
                  fail_on_data_loss: bool = False, max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    opts = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topic,
            "startingOffsets": starting_offsets, "failOnDataLoss": str(fail_on_data_loss).lower()}
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


def kafka_source(spark: SparkSession, topic: str, bootstrap_servers: str, **kw) -> DataFrame:
    """Subscribe to one topic (needs the spark-sql-kafka package on the classpath)."""
    return spark.readStream.format("kafka").options(**kafka_options(topic, bootstrap_servers, **kw)).load()


def file_stream_source(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Drop-in JSON-lines directory source: one ``value`` string per line, like Kafka's value column."""
    return (spark.readStream.schema("value STRING").option("maxFilesPerTrigger", max_files_per_trigger)
            .text(path))


def with_event_time(df: DataFrame, step: str = "step") -> DataFrame:
    base = F.unix_seconds(F.lit(EVENT_BASE).cast("timestamp"))
    return df.withColumn("event_time", F.timestamp_seconds(base + F.col(step).cast("long") * 3600))


def parse_transactions(raw: DataFrame, more: str = "") -> tuple[DataFrame, DataFrame]:
    """(parsed transactions with event_time, quarantined raw lines); ``more`` names further fields of the events."""
    good, bad = parse_json_events(raw, f"{TRANSACTIONS}, {more}" if more else TRANSACTIONS)
    return with_event_time(good), bad


def stream_dedup(df: DataFrame, delay: str = "2 days", key: str = "event_id") -> DataFrame:
    """Effectively-once on the event id: state kept only for the watermark delay.

    Size ``delay`` to the disorder of the source: with a short delay and
    unordered files, rows behind the watermark are dropped silently.
    """
    return df.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def lakehouse_sink(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                   partition_by: tuple[str, ...] = ("silo_id",)):
    """Streaming append to partitioned Parquet; ``trigger`` e.g. {"processingTime": "10 seconds"} or
    {"availableNow": True}."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").partitionBy(*partition_by)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def batch_writer(path: str, hook: Callable[[DataFrame, int], None] | None = None,
                 partition_by: tuple[str, ...] = ("silo_id",)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: write the batch as partition ``batch_id=<n>`` (overwrite of that
    partition only, so a replayed batch replaces itself), then run the per-batch hook."""

    def fn(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *partition_by).parquet(path))
        if hook is not None:
            hook(batch, batch_id)

    return fn


def lakehouse_sink_foreach_batch(df: DataFrame, path: str, checkpoint: str, hook=None, trigger: dict | None = None):
    return (df.writeStream.foreachBatch(batch_writer(path, hook)).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "10 seconds"})).start())


#: Rows of a replay file, about.
REPLAY_ROWS = 250_000


def replay_parts(df: DataFrame, files: int) -> int:
    """Files per block of a replay of ``df``, so that a file's size does not grow with the table."""
    return max(1, -(-df.count() // (files * REPLAY_ROWS)))


def write_json_replay(df: DataFrame, path: str, order_by: str = "step", files: int = 4,
                      close_after: int | None = None, parts: int = 1) -> str:
    """Write a table as event-time-ordered JSON-lines files, gzipped (the replay input of the file source).

    The file source processes files in modification-time order, so blocks of
    ``order_by`` are written one after another (block k strictly before k+1);
    files written in parallel would reach the source in arbitrary order and a
    watermark would drop the earlier blocks. ``close_after`` ends the replay
    with one closing record (event_id −1, all else null) that many ``order_by``
    units after the last row: it moves the watermark past every window, so
    append mode emits the last ones too; its own window stays open. With
    ``parts`` a block is that many files, each in order and written by a task of
    its own; blocks with fewer rows get empty files, so a source that takes
    ``parts`` files per trigger sees block by block, as with one file each.
    Returns the glob to read.
    """
    lo, hi = df.agg(F.min(order_by), F.max(order_by)).first()
    if lo is None:
        return f"{path}/*"
    width = (hi - lo + 1) / files
    blk = F.least(F.floor((F.col(order_by) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(files - 1))
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    spark = df.sparkSession
    for b in range(files):
        block, out = df.filter(blk == b), f"{path}/blk{b:05d}"
        if parts == 1:
            block.sort(order_by, "event_id").select(value).coalesce(1).write.mode("overwrite").text(out, compression="gzip")
            continue
        block.repartition(parts, "event_id").sortWithinPartitions(order_by, "event_id").select(value).write.mode("overwrite").text(out, compression="gzip")
        for _ in range(parts - len(spark.read.text(out).inputFiles())):
            spark.createDataFrame([], "value string").coalesce(1).write.mode("append").text(out, compression="gzip")
    if close_after is not None:
        names = df.columns
        last = spark.range(1).coalesce(1).select(*[F.lit({"event_id": -1, order_by: hi + close_after}.get(c)).alias(c) for c in names])
        last.select(F.to_json(F.struct(*names)).alias("value")).write.mode("overwrite").text(f"{path}/close", compression="gzip")
    return f"{path}/*"
