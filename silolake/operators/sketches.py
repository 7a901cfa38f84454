"""Mergeable quantile sketches per (silo, feature, batch): approximate reference edges without rereading the batches.

Spark's KLL sketch of doubles. A sketch is kept per batch as a row of a table;
any range of batches is a merge of its rows, so moving the reference window
costs sketches, not data. A quantile's rank error is at most ``RANK_ERROR`` of
the rows with 99 % confidence for each single quantile, whatever was merged;
exact edges come from ``operators.drift.quantile_edges``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of the sketch (a few KB each) and its rank error.
K = 1600
RANK_ERROR = 0.005


def quantile_sketches(df: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """(by..., sketch, n, low, high): one row per group, e.g. (silo_id, feature, batch_id); null values are ignored."""
    x = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    return x.groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"),
                              F.min("_v").alias("low"), F.max("_v").alias("high"))


def merge_sketches(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"),
                                     F.min("low").alias("low"), F.max("high").alias("high"))


def sketch_edges(sketches: DataFrame, by: list[str], n_bins: int = 20) -> DataFrame:
    """(by..., edges): n_bins + 1 approximate percentiles; the outer two are exact."""
    inner = [F.kll_sketch_get_quantile_double("sketch", F.lit(i / n_bins)) for i in range(1, n_bins)]
    return sketches.select(*by, F.array(F.col("low"), *inner, F.col("high")).alias("edges"))


def rank_errors(df: DataFrame, value: str, by: list[str], edges: DataFrame) -> DataFrame:
    """(by..., p_idx, rank_error): how far each edge's rank in the data is from the one it stands for (0 inside its ties)."""
    n_bins = F.size("edges") - 1
    e = edges.select(*by, F.posexplode("edges").alias("p_idx", "_edge"), n_bins.alias("bins")).drop("_edge")
    x = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # a value is below the edges behind those that are <= it, and at most the edges behind those that are < it: each row is
    # reduced to these two places, and only their counts meet the edges
    at = x.join(edges.select(*by, "edges"), by).select(*by, *[F.size(F.filter("edges", f)).alias(c) for c, f in (
        ("lt", lambda q: q <= F.col("_v")), ("le", lambda q: q < F.col("_v")))])
    places = at.groupBy(*by, "lt", "le").agg(F.count(F.lit(1)).alias("_c"))

    def share(place: str) -> Column:
        return F.sum(F.when(F.col(place) <= F.col("p_idx"), F.col("_c")).otherwise(0)).cast("double") / F.sum("_c").cast("double")

    ranks = places.join(e, by).groupBy(*by, "p_idx", "bins").agg(share("lt").alias("lt"), share("le").alias("le"))
    p = F.col("p_idx") / F.col("bins")
    return ranks.select(*by, "p_idx", F.greatest(F.lit(0.0), F.col("lt") - p, p - F.col("le")).alias("rank_error"))
