"""Hold-out splits, expressed as one ``split`` column (complements need no anti join)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silolake.functions.rand import order_key
from silolake.operators.partition import rank_class
from silolake.operators.ranking import exact_quantiles
from silolake.session import cut_lineage


def public_holdout(tx: DataFrame, n_rows: int, seed: int = 42, strat: str = "type") -> DataFrame:
    """Stratified public validation slice: quotas n_rows · n_t / N by largest remainder (ties: smaller stratum
    name), so exactly min(n_rows, N) rows, the first of each stratum in md5 order."""
    n = tx.groupBy(strat).agg(F.count(F.lit(1)).alias("_nt"))
    everything = Window.partitionBy()  # one row per stratum
    total = F.sum("_nt").over(everything)
    wanted = F.least(F.lit(n_rows).cast("long"), total)
    n = n.withColumn("_left", (wanted * F.col("_nt")) % total).withColumn("_quota", F.floor(wanted * F.col("_nt") / total))
    place = F.row_number().over(Window.orderBy(F.desc("_left"), strat))
    n = n.withColumn("_quota", F.col("_quota") + (place <= wanted - F.sum("_quota").over(everything)).cast("long")).drop("_left")

    def quota(offsets: DataFrame) -> DataFrame:
        return offsets.join(F.broadcast(n), strat).withColumn("_at", F.array("_quota"))  # one row per stratum

    j = rank_class(tx, [strat], order_key(seed, F.lit("holdout"), "event_id"), "event_id", quota, 1, "_after")
    return j.withColumn("split", F.when(F.col("_after") == 0, "public").otherwise("train")).drop("_after")


def with_public_split(feat: DataFrame, tx: DataFrame, n_rows: int, seed: int = 42) -> DataFrame:
    """``feat``, a table with one row per row of ``tx``, with the split that :func:`public_holdout` gives ``tx``. Give written tables."""
    return public_split(feat, tx, n_rows, seed)(feat)


def public_split(feat: DataFrame, tx: DataFrame, n_rows: int, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Adds the split that :func:`public_holdout` gives ``tx`` to ``feat`` or any other table with its rows' ids and types.

    The split depends on event_id and type only, which ``feat`` has too, so where each event_id comes once the public ones,
    ``n_rows`` at most, are drawn and written once, and every reader of the split meets them without ranking rows again. Where
    some repeat, every row meets every split of its event_id. Give written tables.
    """
    repeated = tx.groupBy("event_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    if not repeated.isEmpty():
        drawn = public_holdout(tx, n_rows, seed).select("event_id", "split")
        return lambda rows: cut_lineage(rows.join(drawn, "event_id"))
    public = cut_lineage(public_holdout(feat.select("event_id", "type"), n_rows, seed).filter("split = 'public'").select("event_id"))

    def split(rows: DataFrame) -> DataFrame:
        known = rows.filter(F.col("event_id").isNotNull() & F.col("type").isNotNull())  # others have no place in the draw
        named = F.when(F.col("_public"), "public").otherwise("train").alias("split")
        return known.join(F.broadcast(public.withColumn("_public", F.lit(True))), "event_id", "left").select(*rows.columns, named)

    return split


def temporal_holdout(tx: DataFrame, frac: float = 0.1, time: str = "step") -> DataFrame:
    """Latest ``frac`` by time is the test set: rows with time > the (1 − frac) quantile."""
    g = tx.select(F.lit(0).alias("_g"), time)
    cut = exact_quantiles(g, time, ["_g"], [1.0 - frac]).first()["q"]
    return tx.withColumn("split", F.when(F.col(time) > F.lit(cut), "test").otherwise("train"))


def split_disjoint_check(full: DataFrame, a: DataFrame, b: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: sizes, overlap (a ∩ b) and rows missing from a ∪ b — both must be 0.

    One pass: the keys of the three tables are counted together, each with its own counter.
    """
    def marked(df: DataFrame, *bits: int) -> DataFrame:
        return df.select(F.col(key).alias("_key"), *[F.lit(x).cast("long").alias(c) for c, x in zip(("_f", "_a", "_b"), bits)])

    every = marked(full, 1, 0, 0).unionAll(marked(a, 0, 1, 0)).unionAll(marked(b, 0, 0, 1))
    per = every.groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("_f", "_a", "_b")])
    missing = F.greatest(F.col("_f") - F.col("_a") - F.col("_b"), F.lit(0))
    sums = {"n_total": F.sum("_f"), "n_a": F.sum("_a"), "n_b": F.sum("_b"), "n_missing": F.sum(missing)}
    return per.agg(*[F.coalesce(v, F.lit(0)).alias(c) for c, v in sums.items()],
                   F.count_if((F.col("_a") > 0) & (F.col("_b") > 0)).alias("n_overlap"))
