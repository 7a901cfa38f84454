"""Per-silo feature statistics and standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolake.functions.features import FEATURE_COLS

STD_FLOOR = 1e-8


def silo_stats(feat: DataFrame, cols: list[str] = FEATURE_COLS, by: str = "silo_id") -> DataFrame:
    """(silo_id, feature, mean, std): one pass, population std, std < 1e-8 → 1.0.

    One aggregate over all columns (partial + final hash aggregate), then an
    unpivot of the tiny result.
    """
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    wide = feat.groupBy(by).agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(cols)]))
    long = wide.select(by, stacked.alias("x")).select(by, "x.*")
    return long.withColumn("std", F.when(F.coalesce(F.col("std"), F.lit(0.0)) < STD_FLOOR, F.lit(1.0))
                           .otherwise(F.col("std")))


def stats_wide(stats: DataFrame, cols: list[str] = FEATURE_COLS, by: str = "silo_id") -> DataFrame:
    """One row per silo: mean/std arrays in feature order (silos × 2 × 22 doubles)."""
    pos = {c: i for i, c in enumerate(cols)}
    idx = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    s = stats.withColumn("_p", idx[F.col("feature")])
    return s.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "mean"))), lambda x: x["mean"]).alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "std"))), lambda x: x["std"]).alias("std"))


def standardize(feat: DataFrame, stats: DataFrame, cols: list[str] = FEATURE_COLS, by: str = "silo_id") -> DataFrame:
    """(x − mean)/std with the row's own silo statistics (per-silo, not global).

    The stats table has silos × features rows, so it is broadcast.
    """
    w = stats_wide(stats, cols, by)
    j = feat.join(F.broadcast(w), by)
    return j.withColumns({c: (F.col(c) - F.col("mean")[i]) / F.col("std")[i] for i, c in enumerate(cols)}) \
        .drop("mean", "std")


def standardize_vector(fv: DataFrame, stats: DataFrame, by: str = "silo_id") -> DataFrame:
    """Standardise the ``features`` array column in place (zip_with, no explode)."""
    w = stats_wide(stats, FEATURE_COLS, by)
    j = fv.join(F.broadcast(w), by)
    z = F.zip_with(F.col("features"), F.arrays_zip("mean", "std"),
                   lambda x, ms: ((x.cast("double") - ms["mean"]) / ms["std"]).cast("float"))
    return j.withColumn("features", z).drop("mean", "std")
