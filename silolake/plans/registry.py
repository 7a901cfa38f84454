"""Model versions as a table: (version, round, weights, metadata)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silolake.schemas import MODELS


def versions_from_aggregates(agg: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Version v+1 = version v + aggregate of round v (version 1 = ``initial`` or zeros).

    A running sum per coordinate (window partitioned by position; each
    partition holds one value per round), then one array per version.
    """
    w = Window.partitionBy("pos").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    run = agg.withColumn("_w", F.sum("v").over(w))
    if initial is not None:
        run = run.join(F.broadcast(initial.select("pos", F.col("w").alias("_w0"))), "pos") \
            .withColumn("_w", F.col("_w") + F.col("_w0"))
    wide = run.groupBy("round").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_w"))), lambda s: s["_w"]).alias("weights"))
    return wide.select((F.col("round") + 2).alias("version"), "round", "weights",
                       F.create_map(F.lit("source"), F.lit("aggregate")).alias("metadata"))


def latest_version(models: DataFrame) -> DataFrame:
    """The newest version (None-equivalent: empty when no model exists)."""
    return models.agg(F.max_by(F.struct("version", "round", "weights", "metadata"), "version").alias("m")) \
        .filter(F.col("m").isNotNull()).select("m.*")


def load_version(models: DataFrame, version: int) -> DataFrame:
    return models.filter(F.col("version") == version)


def save_version(spark: SparkSession, path: str, weights: list[float], round_: int, metadata: dict | None = None) -> int:
    """Append weights as the next version; returns the version number."""
    from pyspark.errors import AnalysisException
    try:
        models = spark.read.schema(MODELS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # any other failure must not restart the numbering
            raise
        models = None
    cur = 0 if models is None else models.agg(F.max("version")).first()[0] or 0
    md = {k: (v if isinstance(v, str) else json.dumps(v)) for k, v in (metadata or {}).items()}
    row = [(cur + 1, round_, [float(x) for x in weights], md)]
    spark.createDataFrame(row, MODELS).write.mode("append").parquet(path)
    return cur + 1
