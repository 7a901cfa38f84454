"""Accounted ingest: every line of a micro-batch ends in exactly one place, and a batch counts once it is committed.

``foreachBatch`` gives each line one fate and writes them in one job to
``rows/batch_id=<n>/fate=<f>/silo_id=<s>``:

* ``accepted``: parsed, in time, first of its event id: the lake
* ``quarantined``: not a document of the schema, or without event id or time (the raw line is kept)
* ``late``: behind the watermark, i.e. the committed maximum event time less the delay
* ``duplicate``: its event id was accepted in an earlier batch that reaches the watermark, or earlier in this batch

A ledger row with the counts is written last and is the commit. All decisions
of batch n read only the ledger and rows of batches before n, and the write
replaces the batch's folder, so a batch that is run again, after a failure or
by a restarted query, leaves the same tables. Batches commit in order:
readers need one number, the last committed batch, which prunes partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silolake.schemas import TRANSACTIONS
from silolake.sources.lake import CORRUPT
from silolake.streaming.ingest import with_event_time

FATES = ("accepted", "quarantined", "late", "duplicate")
LEDGER = "batch_id LONG, n_in LONG, n_accepted LONG, n_quarantined LONG, n_late LONG, n_duplicate LONG, max_event_time TIMESTAMP"


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed batch; empty before the first commit."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{root}/ledger").select(*[c.split()[0] for c in LEDGER.split(", ")])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def read_rows(spark: SparkSession, root: str, fate: str, schema: str = TRANSACTIONS, upto_batch: int | None = None,
              silo: str | None = None) -> DataFrame:
    """Rows of one fate in committed batches (up to ``upto_batch``); batch, fate and silo prune partitions."""
    last = read_ledger(spark, root).agg(F.max("batch_id")).first()[0]
    full = f"{schema}, event_time TIMESTAMP, value STRING, batch_id LONG, fate STRING, silo_id STRING"
    if last is None:
        return spark.createDataFrame([], full).drop("fate")
    upto = last if upto_batch is None else min(last, upto_batch)
    df = spark.read.schema(full).parquet(f"{root}/rows").filter((F.col("batch_id") <= upto) & (F.col("fate") == fate))
    return (df if silo is None else df.filter(F.col("silo_id") == silo)).drop("fate")


def read_lake(spark: SparkSession, root: str, schema: str = TRANSACTIONS, upto_batch: int | None = None, silo: str | None = None) -> DataFrame:
    """The accepted transactions of committed batches."""
    return read_rows(spark, root, "accepted", schema, upto_batch, silo).drop("value")


def _parsed(lines: DataFrame, schema: str, key: str, mark: int | None) -> DataFrame:
    """Each line with its columns, event time and a first fate; what is left as ``accepted`` may still be a duplicate."""
    document = F.from_json(F.col("value"), f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = with_event_time(lines.withColumn("_d", document).select("value", "_d.*"))
    broken = F.col(CORRUPT).isNotNull() | F.col(key).isNull() | F.col("event_time").isNull()
    late = F.lit(False) if mark is None else F.unix_seconds("event_time") < mark
    return rows.withColumn("fate", F.when(broken, "quarantined").when(late, "late").otherwise("accepted")).drop(CORRUPT)


def _repeats(rows: DataFrame, key: str) -> DataFrame:
    """``_nth`` = 1 for one accepted row of each id: first inside each input task, then among those, so that neither a
    hot id nor many broken lines are sorted in one task."""
    candidate = F.col("fate") == "accepted"
    order = ["event_time", "value"]
    rows = rows.withColumn("_task", F.spark_partition_id()).withColumn("_key", F.when(candidate, F.col(key)))
    rows = rows.withColumn("_in_task", F.row_number().over(Window.partitionBy("_key", "_task").orderBy(*order)))
    group = F.when(candidate & (F.col("_in_task") == 1), -1).otherwise(F.col("_task"))
    among = F.row_number().over(Window.partitionBy("_key", group).orderBy(*order, "_task"))
    return rows.withColumn("_nth", F.when(F.col("_in_task") > 1, F.lit(2)).otherwise(among)).drop("_task", "_key", "_in_task")


def accounted_writer(root: str, delay_seconds: int, schema: str = TRANSACTIONS, key: str = "event_id", silo: Column | None = None,
                     hook: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body for a stream of raw lines (column ``value``).

    ``hook(accepted rows, batch_id)`` runs before the commit and must replace what it wrote for the same batch.
    """
    written = f"{schema}, event_time TIMESTAMP, value STRING, fate STRING, silo_id STRING"

    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_ledger(spark, root).filter(F.col("batch_id") < batch_id)
        newest = before.agg(F.unix_seconds(F.max("max_event_time"))).first()[0]
        mark = None if newest is None else newest - delay_seconds
        rows = _repeats(_parsed(batch.select(F.col("value").cast("string").alias("value")), schema, key, mark), key)
        repeated = F.col("_nth") > 1
        if mark is not None:  # earlier batches that reach back to the watermark may hold the same ids
            reach = before.filter(F.unix_seconds("max_event_time") >= mark).agg(F.min("batch_id")).first()[0]
            seen = read_rows(spark, root, "accepted", schema, batch_id - 1).filter(F.col("batch_id") >= reach)
            rows = rows.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
            repeated = repeated | F.col("_seen").isNotNull()
        rows = rows.withColumn("fate", F.when((F.col("fate") == "accepted") & repeated, "duplicate").otherwise(F.col("fate")))
        rows = rows.withColumn("value", F.when(F.col("fate") == "quarantined", F.col("value"))) \
            .withColumn("silo_id", F.coalesce(silo if silo is not None else F.lit("silo-0"), F.lit("none"))).drop("_nth", "_seen")
        path = f"{root}/rows/batch_id={batch_id}"
        rows.write.mode("overwrite").partitionBy("fate", "silo_id").parquet(path)
        out = spark.read.schema(written).parquet(path)
        counts = out.agg(*[F.count_if(F.col("fate") == f).alias(f"n_{f}") for f in FATES],
                         F.max(F.when(F.col("fate") != "quarantined", F.col("event_time"))).alias("max_event_time")).first()
        n_in = batch.count()
        if n_in != sum(counts[f"n_{f}"] for f in FATES):
            raise RuntimeError(f"batch {batch_id}: {n_in} lines read, but written {counts}")
        if hook is not None:
            hook(out.filter("fate = 'accepted'").drop("fate", "value"), batch_id)
        row = spark.createDataFrame([(n_in, *counts)], LEDGER.split(", ", 1)[1])
        row.coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch_id={batch_id}")

    return fn
