"""Partition and run reports (small aggregate tables over big inputs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partition_report(stx: DataFrame, shares: list[float]) -> DataFrame:
    """Rows per (silo, type) with silo and grand subtotals (rollup), silo share and its error vs the target."""
    r = stx.rollup("silo_id", "type").agg(F.count(F.lit(1)).alias("n"))
    # the rollup's grand-total row gives the denominator; the rollup itself is silos × types rows
    grand = F.max(F.when(F.col("silo_id").isNull() & F.col("type").isNull(), F.col("n"))).over(Window.partitionBy())
    target = stx.sparkSession.createDataFrame([(f"silo-{i}", float(s) / sum(shares)) for i, s in enumerate(shares)],
                                              "silo_id string, target_share double")
    out = r.withColumn("_total", grand).join(F.broadcast(target), "silo_id", "left")
    share = F.when(F.col("silo_id").isNotNull() & F.col("type").isNull(), F.col("n") / F.col("_total"))
    return out.select("silo_id", "type", "n", share.alias("share"),
                      (share - F.col("target_share")).alias("share_error")).drop("_total")


def type_mix_chi2(stx: DataFrame) -> DataFrame:
    """Chi-square statistic of each silo's type mix against the global mix: Σ (o−e)²/e."""
    """Chi-square statistic of each silo's type mix against the global mix: Σ_t (o−e)²/e.

    Unobserved (silo, type) cells contribute e each and Σ_t e = silo size, so
    chi² = Σ_observed ((o−e)²/e − e) + silo size — no silos × types grid needed.
    """
    o = stx.groupBy("silo_id", "type").agg(F.count(F.lit(1)).alias("o"))
    silo_n = o.groupBy("silo_id").agg(F.sum("o").alias("sn"))
    type_n = o.groupBy("type").agg(F.sum("o").alias("tn")).withColumn("n", F.sum("tn").over(Window.partitionBy()))
    e = o.join(silo_n, "silo_id").join(type_n, "type").withColumn("e", F.col("sn") * F.col("tn") / F.col("n"))
    return e.groupBy("silo_id").agg(
        (F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e") - F.col("e")) + F.first("sn")).alias("chi2"))
