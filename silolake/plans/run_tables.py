"""The run's metric tables (rounds, silo_metrics, results) derived from the update table.

They are what a federated run appends round by round; here they come from
the ``updates`` fixture so every dashboard query reads tables that grow with
the input: per round, the assembled update set, its robustness flags, a DP
ledger entry, and validation metrics of fixed scores carried by the vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolake.functions.privacy import with_round_epsilon
from silolake.operators import metrics as M
from silolake.operators import rounds as RD
from silolake.operators import updates as U
from silolake.sources import tables as TB

DELTA_DP = 1e-5
CLIP = 1.0
EPS_BUDGET = 50.0
# Noise multiplier of each silo, by silo number mod 3.
SIGMAS = [0.5, 0.8, 1.2]


def assembled(spark: SparkSession, sf: str) -> DataFrame:
    return RD.round_updates(TB.updates(spark, sf), TB.rounds(spark, sf), TB.silos(spark, sf))


def silo_metrics(spark: SparkSession, sf: str) -> DataFrame:
    # a round may hold a silo's on-time update and its late one from r−1: flag per update
    ru = assembled(spark, sf).withColumn("ukey", F.concat("silo_id", F.lit("@"), F.col("src_round").cast("string")))
    long = ru.select(F.col("agg_round").alias("round"), F.col("ukey").alias("silo_id"), F.col("n_samples").alias("n"),
                     F.posexplode("delta").alias("pos", "v"))
    flags = U.qwra_reject(U.update_cosine(long), 0.0).withColumnRenamed("silo_id", "ukey")
    silo_no = F.regexp_extract("silo_id", r"(\d+)$", 1).cast("int")
    sigma = F.element_at(F.array(*[F.lit(s) for s in SIGMAS]), F.pmod(silo_no, F.lit(3)) + 1)
    base = ru.select(F.col("agg_round").alias("round"), "silo_id", "ukey", "n_samples", "train_loss", "staleness",
                     sigma.alias("sigma"), F.lit(DELTA_DP).alias("delta_dp"), F.lit(CLIP).alias("clip"))
    base = with_round_epsilon(base, "sigma", "delta_dp", "clip")
    j = base.join(flags.select("round", "ukey", "rejected"), ["round", "ukey"], "left")
    return j.select("round", "silo_id", "n_samples", "train_loss", F.lit(None).cast("double").alias("auc_roc"),
                    F.lit(None).cast("double").alias("auc_pr"), F.col("staleness").cast("int").alias("staleness"),
                    F.coalesce(F.col("rejected").cast("int"), F.lit(0)).alias("flagged"), "epsilon",
                    F.lit(None).cast("double").alias("psi"))


def eval_scores(spark: SparkSession, sf: str, k: int = 0) -> DataFrame:
    """Validation rows of a round: score = k-th vector coordinate, label = class ≥ 5."""
    e = TB.table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") / TB.UPDATES_PER_ROUND).cast("int").alias("round"),
                    F.col("embedding")[k].cast("double").alias("score"),
                    (F.col("label") >= 5).cast("double").alias("label"))


def rounds_table(spark: SparkSession, sf: str) -> DataFrame:
    ru = assembled(spark, sf)
    per = ru.groupBy(F.col("agg_round").alias("round")).agg(F.count(F.lit(1)).cast("int").alias("n_updates"),
                                                           F.max("wall_time_s").alias("wall_time_s"))
    ev = M.classification_report(eval_scores(spark, sf), ["round"])
    cal = TB.rounds(spark, sf)
    return (cal.join(per, "round").join(ev, "round", "left")
            .select("round", (F.col("round") + 2).alias("version"), "start_ts", "deadline",
                    F.col("auc_roc").alias("global_auc_roc"), F.col("auc_pr").alias("global_auc_pr"), "n_updates",
                    "wall_time_s", F.col("deadline").alias("ts")))


def results_table(spark: SparkSession, sf: str, seeds: int = 3) -> DataFrame:
    """Per-round results of ``seeds`` evaluation runs (seed s scores with coordinate s)."""
    ru = assembled(spark, sf)
    per = ru.groupBy(F.col("agg_round").alias("round")).agg(F.count(F.lit(1)).cast("int").alias("n_updates"),
                                                           F.avg("train_loss").alias("avg_loss"))
    out = None
    for s in range(seeds):
        ev = M.classification_report(eval_scores(spark, sf, s), ["round"]).join(per, "round")
        ev = ev.select(F.lit("E1").alias("experiment"), "round", "auc_roc", "auc_pr", "n_updates", "avg_loss",
                       F.lit("qwra").alias("agg_kind"), F.lit(42 + s).alias("seed"), F.lit(0.5).alias("alpha"))
        out = ev if out is None else out.unionByName(ev)
    return out


def drift_alert_table(alerts: DataFrame) -> DataFrame:
    """PSI alerts (silo, feature, window) in the drift_alerts schema; ts = window start (days after 1995-01-01)."""
    return alerts.select(F.col("win").cast("int").alias("round"), "silo_id", "psi", "feature",
                         F.timestamp_seconds(F.unix_seconds(F.lit("1995-01-01 00:00:00").cast("timestamp"))
                                             + (F.lit(1000) + F.col("win") * 250) * 86400).alias("ts"))
