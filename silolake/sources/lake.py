"""Lakehouse tables: batch reads/writes, JSON events, result and metrics tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silolake.schemas import DRIFT_ALERTS, RESULTS, ROUNDS, SILO_METRICS, TRANSACTIONS
from silolake.session import cut_lineage

CORRUPT = "_corrupt"


def read_transactions(spark: SparkSession, path: str, silo: str | None = None, upto_batch: int | None = None) -> DataFrame:
    """Batch scan with the fixed schema; silo and batch filters prune partitions."""
    df = spark.read.schema(f"{TRANSACTIONS}, silo_id STRING, batch_id BIGINT").parquet(path)
    if silo is not None:
        df = df.filter(F.col("silo_id") == silo)
    return lakehouse_snapshot(df, upto_batch) if upto_batch is not None else df


def lakehouse_snapshot(df: DataFrame, upto_batch: int | None) -> DataFrame:
    """Only batches committed up to k: the input of a round is repeatable."""
    return df if upto_batch is None else df.filter(F.col("batch_id") <= F.lit(upto_batch))


def with_batch_id(df: DataFrame, steps_per_batch: int, time: str = "step") -> DataFrame:
    """Batch id an ordered replay would give each row (micro-batch = a block of steps)."""
    return df.withColumn("batch_id", F.floor(F.col(time) / F.lit(steps_per_batch)).cast("bigint"))


def write_lake(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("silo_id", "batch_id").parquet(path)


def parse_json_events(df: DataFrame, schema: str, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """bytes/string → typed columns; malformed documents go to a quarantine frame instead of NULL rows.

    Returns (parsed, quarantined).
    """
    struct_schema = f"{schema}, {CORRUPT} STRING"
    parsed = df.withColumn("_data", F.from_json(F.col(value_col).cast("string"), struct_schema,
                                                {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_data.{CORRUPT}").isNotNull() | F.col("_data").isNull()
    good = parsed.filter(~bad).select(*[c for c in df.columns if c != value_col], "_data.*").drop(CORRUPT)
    quarantine = parsed.filter(bad).select(*df.columns)
    return good, quarantine


def events_to_json(df: DataFrame, key_col: str | None = None) -> DataFrame:
    """One JSON document per row (NULL fields kept), optional message key."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    if key_col is None:
        return df.select(value)
    return df.select(F.col(key_col).cast("string").alias("key"), value)


def results_sink(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One row per round, partitioned by experiment id (ids never collide across scenarios)."""
    w = df.write.mode("append").partitionBy("experiment")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def results_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """All result files, with the file each row came from."""
    r = spark.read.schema(RESULTS.replace("experiment STRING, ", "") + ", experiment STRING")
    df = r.option("header", True).csv(path) if fmt == "csv" else r.parquet(path)
    return df.withColumn("source_file", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)$", 1))


METRIC_TABLES = {"rounds": ROUNDS, "silo_metrics": SILO_METRICS, "drift_alerts": DRIFT_ALERTS}


#: Rounds of one folder of a metrics table: with a folder each, a long run is as many folders, files and renames as rounds.
ROUNDS_PER_BLOCK = 1024


def _stored_metrics(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """A run's rows as they were written, with their block; None before the first append."""
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    data = [f for f in found.fields if f.name not in ("run_id", "block")]
    parts = [T.StructField("run_id", T.StringType()), T.StructField("block", T.IntegerType())]
    return spark.read.schema(T.StructType(data + parts)).parquet(path).filter(F.col("run_id") == run_id)


def metrics_append(df: DataFrame, root: str, table: str, run_id: str) -> None:
    """Adds rounds to a run's table; a round that is written again replaces itself.

    A folder holds a block of rounds. Where the run has rows already, those of the touched blocks' other rounds are written
    again beside the new ones; the folders are swapped once all rows are written.
    """
    path = f"{root}/{table}"
    new = df.withColumn("round", F.col("round").cast("int")).withColumn("run_id", F.lit(run_id)) \
        .withColumn("block", F.floor(F.col("round") / F.lit(ROUNDS_PER_BLOCK)).cast("int"))
    stored = _stored_metrics(df.sparkSession, path, run_id)
    if stored is not None:
        new = cut_lineage(new, "metrics")
        blocks, rounds = new.select(F.col("block").alias("_block")).distinct(), new.select(F.col("round").alias("_round")).distinct()
        kept = stored.join(blocks, F.col("block").eqNullSafe(F.col("_block")), "left_semi") \
            .join(rounds, F.col("round").eqNullSafe(F.col("_round")), "left_anti")
        new = new.unionByName(kept, allowMissingColumns=True)
    (new.repartition("block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "block").parquet(path))


def metrics_scan(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """Full ordered read (rounds by round, silo metrics by (round, silo), alerts newest first)."""
    schema = METRIC_TABLES[table] + ", run_id STRING"
    df = spark.read.schema(schema).parquet(f"{root}/{table}").select(*[c.split()[0] for c in schema.split(", ")])
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    order = {"rounds": ["round"], "silo_metrics": ["round", "silo_id"], "drift_alerts": [F.desc("ts")]}[table]
    return df.orderBy(*order)
