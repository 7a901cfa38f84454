"""Round assembly as queries over the ``updates`` and ``rounds`` tables (no timers)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def updates_registered(updates: DataFrame, silos: DataFrame) -> DataFrame:
    return updates.join(silos.select("silo_id"), "silo_id", "left_semi")


def updates_rejected(updates: DataFrame, silos: DataFrame) -> DataFrame:
    return updates.join(silos.select("silo_id"), "silo_id", "left_anti")


def join_update_sizes(updates: DataFrame, silos: DataFrame) -> DataFrame:
    """Registered size per update, 1 when unknown."""
    return updates.join(silos.select("silo_id", "n_rows"), "silo_id", "left") \
        .withColumn("n_rows", F.coalesce(F.col("n_rows"), F.lit(1).cast("bigint")))


def update_latest(updates: DataFrame) -> DataFrame:
    """One update per (round, silo): the last arrival wins.

    A ``max_by`` aggregate (partial per map task), so a silo that resubmits
    many times never gathers its copies in one window partition.
    """
    cols = [c for c in updates.columns if c not in ("round", "silo_id")]
    latest = updates.groupBy("round", "silo_id").agg(F.max_by(F.struct(*cols), "arrived_at").alias("_u"))
    return latest.select("round", "silo_id", *[F.col(f"_u.{c}").alias(c) for c in cols]).select(*updates.columns)


def join_drift_epochs(silos: DataFrame, alerts: DataFrame, local_epochs: int = 2, factor: float = 1.5) -> DataFrame:
    """Silos with a drift alert get ⌈epochs × factor⌉ local epochs: (silo_id, local_epochs, max_psi)."""
    alerted = alerts.groupBy("silo_id").agg(F.max("psi").alias("max_psi"))
    j = silos.select("silo_id").join(alerted, "silo_id", "left")
    more = F.when(F.col("max_psi").isNotNull(), F.ceil(F.lit(local_epochs) * factor)).otherwise(F.lit(local_epochs))
    return j.select("silo_id", more.cast("int").alias("local_epochs"), "max_psi")


#: Width of the time buckets of the interval join.
BUCKET_SECONDS = 3600


def _bucket(at: str) -> Column:
    return F.floor(F.unix_seconds(at) / F.lit(BUCKET_SECONDS))


def join_round_window(updates: DataFrame, rounds: DataFrame) -> DataFrame:
    """Arrival → the round whose (start_ts, deadline] contains it (interval join).

    Each round is exploded to the time buckets that it touches; arrivals meet
    the rounds of their own bucket in an equi-join and the interval is the
    filter after it. So both sides may grow: neither is broadcast by force, and
    a bucket holds the arrivals and rounds of one hour.
    """
    r = rounds.select(F.col("round").alias("window_round"), "start_ts", "deadline")
    r = r.withColumn("_bucket", F.explode(F.sequence(_bucket("start_ts"), _bucket("deadline"))))
    inside = (F.col("arrived_at") > F.col("start_ts")) & (F.col("arrived_at") <= F.col("deadline"))
    keyed = updates.withColumn("_bucket", _bucket("arrived_at"))
    return keyed.alias("u").join(r.alias("r"), (F.col("u._bucket") == F.col("r._bucket")) & inside, "left") \
        .drop(F.col("r._bucket")).drop("_bucket")


def update_staleness(assigned: DataFrame) -> DataFrame:
    """staleness = window round − update round (≥ 0); accepted iff equal."""
    s = F.greatest(F.col("window_round") - F.col("round"), F.lit(0))
    return assigned.withColumn("staleness", s).withColumn("accepted", F.col("window_round") == F.col("round"))


def join_carry_late(updates: DataFrame, rounds: DataFrame) -> DataFrame:
    """Updates that missed their own deadline, joined to the next round (u.round + 1 = r.round)."""
    own = rounds.select("round", F.col("deadline").alias("_own_deadline"))
    nxt = rounds.select((F.col("round") - 1).alias("round"), F.col("round").alias("next_round"), F.col("deadline").alias("next_deadline"))
    late = updates.join(own, "round").filter(F.col("arrived_at") > F.col("_own_deadline"))
    return late.join(nxt, "round").drop("_own_deadline")


def round_updates(updates: DataFrame, rounds: DataFrame, silos: DataFrame, quorum_frac: float = 0.6,
                  lam: float = 0.5) -> DataFrame:
    """The update set of every round.

    A round closes at its deadline if ⌈q·K⌉ registered silos sent an update by
    then, else at deadline + (deadline − start)/2 if that reaches quorum, else
    it is skipped. Each silo counts with its latest arrival up to the close, so
    a resubmission after it cannot displace an update that was in time. What
    arrives after the close, but within the next round's, joins round r+1 with
    staleness 1 and weight λ (the latest per silo); older ones are dropped.
    """
    k = silos.select("silo_id").distinct().count()  # registered silos: a small table
    quorum = int(math.ceil(quorum_frac * k))
    cal = rounds.select("round", "start_ts", "deadline",
                        (F.col("deadline") + (F.col("deadline") - F.col("start_ts")) / 2).alias("ext"))
    nxt = cal.select((F.col("round") - 1).alias("round"), F.col("deadline").alias("n_deadline"), F.col("ext").alias("n_ext"))
    own = updates_registered(updates, silos)
    # the times that can matter, per (round, silo): the first arrival, and the last by each possible close of this and the next round
    at = F.col("arrived_at")
    times = own.select("round", "silo_id", "arrived_at").join(cal, "round").join(nxt, "round", "left").filter(at > F.col("start_ts"))
    ends = ("deadline", "ext", "n_deadline", "n_ext")
    times = times.groupBy("round", "silo_id", "deadline", "ext").agg(
        F.min(at).alias("first"), *[F.max(F.when(at <= F.col(e), at)).alias(f"by_{e}") for e in ends])
    closes = times.groupBy("round", "deadline", "ext").agg(
        F.count_if(F.col("first") <= F.col("deadline")).alias("n_on"), F.count_if(F.col("first") <= F.col("ext")).alias("n_late"))
    close = F.when(F.col("n_on") >= quorum, F.col("deadline")).when(F.col("n_late") >= quorum, F.col("ext"))
    closes = closes.select("round", close.alias("close_ts"), (F.col("n_on") >= quorum).alias("on_time")).filter(F.col("close_ts").isNotNull())
    after = closes.select((F.col("round") - 1).alias("round"), F.col("on_time").alias("n_on_time"))
    decided = times.join(closes, "round").join(after, "round", "left")
    late = F.when(F.col("n_on_time"), F.col("by_n_deadline")).when(~F.col("n_on_time"), F.col("by_n_ext"))
    choices = F.array(F.struct(F.lit(0).alias("staleness"), F.when(F.col("on_time"), F.col("by_deadline")).otherwise(F.col("by_ext")).alias("at")),
                      F.struct(F.lit(1).alias("staleness"), F.when(late > F.col("close_ts"), late).alias("at")))
    chosen = decided.select("round", "silo_id", F.explode(choices).alias("_c")).filter("_c.at is not null").select(
        "round", "silo_id", F.col("_c.staleness").alias("staleness"), F.col("_c.at").alias("_at"))
    cols = ["base_version", "delta", "n_samples", "train_loss", "wall_time_s", "arrived_at"]
    hit = own.join(chosen, ["round", "silo_id"]).filter(F.col("arrived_at") == F.col("_at"))
    # equal arrival times of a silo: the larger record
    one = hit.groupBy("round", "silo_id", "staleness").agg(F.max(F.struct("train_loss", "n_samples", "base_version", "wall_time_s", "arrived_at", "delta")).alias("u"))
    return one.select((F.col("round") + F.col("staleness")).alias("agg_round"), F.col("round").alias("src_round"), "silo_id",
                      *[F.col(f"u.{c}").alias(c) for c in cols], "staleness") \
        .withColumn("weight", F.pow(F.lit(lam), F.col("staleness").cast("double")))


def union_late_updates(on_time: DataFrame, late: DataFrame, lam: float = 0.5) -> DataFrame:
    """On-time updates ∪ λ-decayed late ones."""
    from silolake.operators.updates import staleness_decay
    return on_time.withColumn("staleness", F.lit(0)).unionByName(
        staleness_decay(late.withColumn("staleness", F.lit(1)), lam), allowMissingColumns=True)
