"""Threshold-free classification metrics as aggregations.

Scores are first reduced to one row per (group, score) — partial aggregation,
so a hot score value costs nothing — and cumulative counts come from
``cumulative_desc`` (range-split, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolake.operators.ranking import cumulative_desc

PROB_CLIP = 1e-7


def score_curve(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by..., score, pos, neg, cum_pos, cum_neg, P, N): counts at thresholds score ≥ s."""
    y = (F.col(label) > 0.5).cast("long")
    keys = list(by) or ["_all"]
    d = df if by else df.withColumn("_all", F.lit(0))
    g = d.groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    c = cumulative_desc(g, keys, score, ["pos", "neg"])
    tot = g.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return c.join(F.broadcast(tot), keys)  # one row per group


def _agg(curve: DataFrame, by: list[str], *cols):
    return curve.groupBy(*by).agg(*cols) if by else curve.groupBy("_all").agg(*cols).drop("_all")


# Shares are taken row by row, before the group is known to have both classes: without one they are null, in ANSI mode too.

def _precision_step() -> Column:
    return F.try_divide("pos", "P") * F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg"))


def _best_recall(max_fpr: float) -> Column:
    ok = F.try_divide("cum_neg", "N") <= F.lit(max_fpr)
    return F.coalesce(F.max(F.when(ok, F.try_divide("cum_pos", "P"))), F.lit(0.0))


def auc_pr(df: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Average precision Σ (R_k − R_{k−1})·P_k over distinct thresholds (NULL without positives)."""
    by = list(by)
    c = score_curve(df, by, score, label)
    return _agg(c, by, F.when(F.first("P") > 0, F.sum(_precision_step())).alias("auc_pr"))


def auc_roc(df: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Area under ROC with tied scores counted half (NULL if one class is absent)."""
    by = list(by)
    c = score_curve(df, by, score, label)
    below = F.col("N") - F.col("cum_neg")
    term = F.col("pos") * (below + F.lit(0.5) * F.col("neg"))
    return _agg(c, by, F.when((F.first("P") > 0) & (F.first("N") > 0),
                              F.sum(term) / (F.first("P") * F.first("N"))).alias("auc_roc"))


def recall_at_fpr(df: DataFrame, by: list[str] = (), max_fpr: float = 0.01, score: str = "score",
                  label: str = "label") -> DataFrame:
    """Best recall among thresholds whose FPR ≤ max_fpr (0 if none)."""
    by = list(by)
    c = score_curve(df, by, score, label)
    return _agg(c, by, F.when(F.first("P") > 0, _best_recall(max_fpr)).alias("recall_at_fpr"))


def classification_report(df: DataFrame, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """AUC-ROC, AP and recall@1%FPR from one curve."""
    by = list(by)
    c = score_curve(df, by, score, label)
    roc = F.col("pos") * (F.col("N") - F.col("cum_neg") + F.lit(0.5) * F.col("neg"))
    return _agg(c, by,
                F.when((F.first("P") > 0) & (F.first("N") > 0), F.sum(roc) / (F.first("P") * F.first("N"))).alias("auc_roc"),
                F.when(F.first("P") > 0, F.sum(_precision_step())).alias("auc_pr"),
                F.when(F.first("P") > 0, _best_recall(0.01)).alias("recall_at_fpr"))


def class_balance(df: DataFrame, by: list[str] = ("silo_id",), label: str = "isFraud") -> DataFrame:
    """n_pos, n_neg and pos_weight = n_neg / max(n_pos, 1)."""
    y = (F.col(label) > 0.5).cast("long")
    return (df.groupBy(*by).agg(F.sum(y).alias("n_pos"), F.sum(F.lit(1) - y).alias("n_neg"))
            .withColumn("pos_weight", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))))


def bce_terms(p, y, pos_weight):
    pc = F.least(F.greatest(p, F.lit(PROB_CLIP)), F.lit(1 - PROB_CLIP))
    return -pos_weight * y * F.log(pc) - (F.lit(1.0) - y) * F.log(F.lit(1.0) - pc)


def weighted_bce(df: DataFrame, by: list[str] = ("silo_id",), prob: str = "score", label: str = "isFraud",
                 pos_weight: str | float = "pos_weight") -> DataFrame:
    """Mean weighted binary cross-entropy; positives weighted by ``pos_weight``."""
    pw = F.col(pos_weight) if isinstance(pos_weight, str) else F.lit(float(pos_weight))
    return df.groupBy(*by).agg(F.avg(bce_terms(F.col(prob), F.col(label).cast("double"), pw)).alias("bce"))
