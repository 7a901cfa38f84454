"""Feature pipeline: transactions → silos → features → per-silo standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silolake.functions.features import feature_vector, with_scalar_features
from silolake.operators.partition import DEFAULT_SHARES, DEFAULT_SILOS, dirichlet_partition
from silolake.operators.stats import silo_stats, standardize
from silolake.operators.windows import with_window_features
from silolake.schemas import TX_TYPES
from silolake.session import is_materialized, materialized
from silolake.sources.tables import transactions


def written_transactions(spark: SparkSession, sf_dir: str, source: str = "lineitem") -> DataFrame:
    """The transaction table, written once per application: splitting it reads it more than once."""
    return materialized(spark, ("tx", sf_dir, source), lambda: transactions(spark, sf_dir, source))


def siloed_transactions(spark: SparkSession, sf_dir: str, source: str = "lineitem", n_silos: int = DEFAULT_SILOS,
                        shares=DEFAULT_SHARES, alpha: float = 0.5, seed: int = 42, mode: str = "shares",
                        materialize: bool = True) -> DataFrame:
    """The silo-partitioned transaction table — the lakehouse every silo reads.

    Materialised once (reliable checkpoint in ``spark.checkpoint.dir``):
    downstream plans branch into per-account tables, statistics and joins, and
    differently pruned branches cannot share one exchange, so without this
    each branch would re-run the joins and the partitioning. With ``materialize`` False a plan that reads the rows once gets
    them from the table if another has written it, and else splits the transactions itself.
    """
    def build():
        tx = written_transactions(spark, sf_dir, source)
        return dirichlet_partition(tx, n_silos, alpha, shares, seed, mode=mode, types=TX_TYPES)

    key = ("silo_tx", sf_dir, source, n_silos, tuple(shares) if shares else None, alpha, seed, mode)
    if not materialize and not is_materialized(spark, key):
        return build()
    return materialized(spark, key, build)


def feature_columns(tx_with_silo: DataFrame) -> DataFrame:
    """Each silo computes its features over its own rows: windows keyed by (silo_id, account)."""
    return with_scalar_features(with_window_features(tx_with_silo, by=("silo_id",)))


def feature_table(spark: SparkSession, sf_dir: str, source: str = "lineitem", **kw) -> DataFrame:
    return feature_columns(siloed_transactions(spark, sf_dir, source, **kw))


def materialized_features(spark: SparkSession, sf_dir: str, source: str = "lineitem", **kw) -> DataFrame:
    """The round-invariant feature table; its window features are written once per application, with the transactions.

    The others need only their own row: they are computed as they are read. The two accounts have done their part when the
    windows are there, so they are not written, and the receiver does not travel with the rows when they are dealt by sender.
    """
    key = ("features", sf_dir, source, tuple(sorted((k, str(v)) for k, v in kw.items())))

    def build():
        return with_window_features(siloed_transactions(spark, sf_dir, source, **{**kw, "materialize": False}), by=("silo_id",)).drop("nameOrig", "nameDest")

    return with_scalar_features(materialized(spark, key, build))


def standardized_features(spark: SparkSession, sf_dir: str, source: str = "lineitem", **kw) -> DataFrame:
    feat = materialized_features(spark, sf_dir, source, **kw)
    return standardize(feat, silo_stats(feat))


def training_table(spark: SparkSession, sf_dir: str, source: str = "lineitem", **kw) -> DataFrame:
    """``features`` schema, standardised per silo — the round-invariant input of training."""
    feat = materialized_features(spark, sf_dir, source, **kw)
    return feature_vector(standardize(feat, silo_stats(feat)))
