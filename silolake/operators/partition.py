"""Reproducible non-IID silo partitioning without one giant sort.

Rows are ordered inside each group (transaction type) by md5(seed:event_id).
An exact row number over a group would normally sort the whole group in one
task; ``distributed_rank`` instead buckets by the md5 hex prefix (which is
monotone in the md5 order), numbers rows inside (group, bucket), and adds the
prefix count of all earlier buckets taken from a tiny count table. Where only
a few ranks matter (silo cuts, hold-out quotas), ``rank_class`` ranks the rows
of the buckets that these fall into and takes all others by their bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silolake.functions.rand import order_key

DEFAULT_SILOS = 5
# Size shares of the five-silo scenarios.
DEFAULT_SHARES = [0.25, 0.25, 0.2, 0.15, 0.15]


def rank_bucket_hex(df: DataFrame, n_groups: int = 1) -> int:
    """Hex digits of the rank bucket: ~4 buckets per shuffle partition per group, 16..65,536 buckets.

    Tied to the configured parallelism, which a cluster sizes to its data.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    want = max(16, 4 * parts)
    return max(1, min(4, math.ceil(math.log(want, 16))))


def distributed_rank(df: DataFrame, group: list[str], order: Column, tie: str, bucket_hex: int | None = None,
                     name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by group order by order, tie)`` for a hex-string ``order``.

    Work is spread over ``16**bucket_hex`` buckets per group; only the
    (group, bucket) count table — bounded by groups × buckets — is combined.
    Rows are shuffled once on (group, bucket) — uniform, since the bucket is an
    md5 prefix — and the count table and the ranking window both read that one
    exchange. ``total`` optionally adds the group size as a column.
    """
    bucket_hex = bucket_hex or rank_bucket_hex(df)
    d = df.withColumn("_ord", order).withColumn("_bkt", F.substring("_ord", 1, bucket_hex)) \
        .repartition(*group, "_bkt")
    counts = d.groupBy(*group, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wcum = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wcum), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_cnt").over(Window.partitionBy(*group)))
    offsets = offsets.drop("_cnt")
    w = Window.partitionBy(*group, "_bkt").orderBy("_ord", tie)
    ranked = d.withColumn("_local", F.row_number().over(w))
    return (ranked.join(offsets, [*group, "_bkt"])
            .withColumn(name, F.col("_local") + F.col("_off"))
            .drop("_ord", "_bkt", "_local", "_off"))


def rank_class(df: DataFrame, group: list[str], order: Column, tie: str, with_cuts: Callable[[DataFrame], DataFrame], n_cuts: int,
               name: str) -> DataFrame:
    """Adds how many of ``n_cuts`` ranks of its group lie strictly below a row's rank, as :func:`distributed_rank` ranks them.

    ``with_cuts`` adds the ranks, ``_at ARRAY<BIGINT>``, to a table of (group, bucket) that has the group's size ``_n``.
    Between two cuts the rank itself does not matter: a bucket that no cut falls into is of one class, so only the rows of
    the at most ``n_cuts`` other buckets of a group are shuffled and sorted. ``df`` is read three times: give a written table.
    """
    d = df.withColumn("_ord", order).withColumn("_bkt", F.substring("_ord", 1, rank_bucket_hex(df)))
    counts = d.groupBy(*group, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wcum = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wcum), F.lit(0))) \
        .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(*group)))

    def below(rank: Column) -> Column:
        return sum((F.col("_at")[i] < rank).cast("int") for i in range(n_cuts))

    buckets = with_cuts(offsets).select(*group, "_bkt", "_off", "_at", below(F.col("_off") + 1).alias("_first"),
                                        below(F.col("_off") + F.col("_cnt")).alias("_last"))
    j = d.join(F.broadcast(buckets), [*group, "_bkt"])  # groups × buckets, like the count table
    w = Window.partitionBy(*group, "_bkt").orderBy("_ord", tie)
    whole = j.filter("_first = _last").withColumn(name, F.col("_first"))
    cut = j.filter("_first < _last").withColumn(name, below(F.row_number().over(w) + F.col("_off")))
    return whole.unionByName(cut).drop("_ord", "_bkt", "_off", "_at", "_first", "_last")


def share_fractions(shares: list[float]) -> list[float]:
    """Cumulative cut fractions, last forced to exactly 1."""
    f = np.asarray(shares, dtype=float)
    cum = np.cumsum(f / f.sum())
    cum[-1] = 1.0
    return [float(x) for x in cum]


def dirichlet_cuts(types: list[str], n_silos: int, alpha: float, size_shares: list[float] | None,
                   seed: int, mode: str = "shares") -> dict[str, list[float]]:
    """Per type, cumulative cut fractions over silos (drawn once on the driver: types × silos).

    mode ``shares``: size shares when given, else Dirichlet(α) rows (the coded behaviour);
    mode ``both``: share_k · Dirichlet_k renormalised, so α matters with shares too.
    Types are sorted so the draw does not depend on scan order.
    """
    rng = np.random.default_rng(seed)
    types = sorted(types)
    props = rng.dirichlet([alpha] * n_silos, size=len(types))
    out = {}
    for i, t in enumerate(types):
        if size_shares is not None and mode == "shares":
            out[t] = share_fractions(size_shares)
        elif size_shares is not None and mode == "both":
            out[t] = share_fractions(list(np.asarray(size_shares) / np.sum(size_shares) * props[i]))
        else:
            out[t] = share_fractions(list(props[i]))
    return out


def _assign(tx: DataFrame, group: list[str], seed: int, cum: Callable[[DataFrame], DataFrame], n_silos: int) -> DataFrame:
    """silo = number of cuts strictly below the row number (first silo whose cut covers it)."""
    def cuts(offsets: DataFrame) -> DataFrame:
        # the last cut is the size itself, so only the first n_silos − 1 cuts can lie below a row number
        return cum(offsets).withColumn("_at", F.array(*[F.floor(F.col("_cum")[i] * F.col("_n")) for i in range(n_silos - 1)]).cast("array<bigint>"))

    out = rank_class(tx, group, order_key(seed, "event_id"), "event_id", cuts, n_silos - 1, "_silo") if n_silos > 1 else \
        tx.filter(F.col("event_id").isNotNull()).withColumn("_silo", F.lit(0))
    return out.withColumn("silo_id", F.concat(F.lit("silo-"), F.col("_silo").cast("string"))).drop("_silo", *group)


def dirichlet_partition(tx: DataFrame, n_silos: int = DEFAULT_SILOS, alpha: float = 0.5,
                        size_shares: list[float] | None = DEFAULT_SHARES, seed: int = 42,
                        label_col: str = "type", mode: str = "shares", types: list[str] | None = None) -> DataFrame:
    """Every row lands in exactly one silo; returns ``tx`` + ``silo_id``.

    ``types`` may be given; otherwise the distinct labels are collected (bounded
    by the label vocabulary, not by rows). Rows whose label is null or not among
    ``types`` are one more label, cut by the size shares (or evenly without them).
    """
    if types is None:
        types = [r[0] for r in tx.select(label_col).distinct().collect()]
    cuts = dirichlet_cuts([t for t in types if t is not None], n_silos, alpha, size_shares, seed, mode)
    spark = tx.sparkSession
    cut_df = spark.createDataFrame([(t, c) for t, c in cuts.items()], f"{label_col} string, _cum array<double>")
    other = F.array(*[F.lit(c) for c in share_fractions(size_shares or [1.0] * n_silos)])
    known = F.col(label_col).isin(list(cuts)) if cuts else F.lit(False)
    labelled = tx.withColumn("_label", F.when(known, F.col(label_col)).otherwise(F.lit("")))

    def cum(offsets: DataFrame) -> DataFrame:
        # the cut table is bounded by the label vocabulary
        named = F.broadcast(cut_df.withColumnRenamed(label_col, "_label"))
        return offsets.join(named, "_label", "left").withColumn("_cum", F.coalesce("_cum", other))

    return _assign(labelled, ["_label"], seed, cum, n_silos)


def partition_by_size_shares(tx: DataFrame, size_shares: list[float] = DEFAULT_SHARES, seed: int = 42) -> DataFrame:
    """Same cut over the whole table (one group)."""
    g = tx.withColumn("_all", F.lit(0))
    fractions = F.array(*[F.lit(x) for x in share_fractions(size_shares)])
    return _assign(g, ["_all"], seed, lambda offsets: offsets.withColumn("_cum", fractions), len(size_shares))


def hash_partition(tx: DataFrame, size_shares: list[float] = DEFAULT_SHARES, seed: int = 42) -> DataFrame:
    """Fast mode: silo by a seeded hash threshold — no rank, shares within sampling error (±1 %)."""
    from silolake.functions.rand import hash01
    u = hash01(seed, "silo", "event_id")
    cum = share_fractions(size_shares)
    idx = sum((u >= F.lit(c)).cast("int") for c in cum[:-1])
    return tx.withColumn("silo_id", F.concat(F.lit("silo-"), idx.cast("string")))
