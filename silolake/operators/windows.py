"""Velocity and degree features over trailing step frames.

A frame ``[step-(N-1), step]`` depends only on (account, step), so rows are
first pre-aggregated per (account, step) — map-side combined, immune to a hot
account — and the range window then runs over at most one row per distinct
step of an account. The result joins back on (account, step); AQE's skew-join
split handles a hot (account, step) on the big side. ``with_window_features``,
which needs every column of the rows anyway, runs the same frames over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VELOCITY_FRAMES = (1, 24, 168)


def velocity_table(tx: DataFrame, key: str = "nameOrig", frames=VELOCITY_FRAMES,
                   by: tuple[str, ...] = (), time: str = "step", value: str = "amount") -> DataFrame:
    """(by..., key, step) → velocity_{N}h_count / _sum for every N in ``frames``."""
    per_step = tx.groupBy(*by, key, time).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    w = Window.partitionBy(*by, key).orderBy(time)
    cols = {}
    for n in frames:
        wf = w.rangeBetween(-(n - 1), 0)
        cols[f"velocity_{n}h_count"] = F.sum("_n").over(wf).cast("double")
        cols[f"velocity_{n}h_sum"] = F.sum("_s").over(wf)
    return per_step.withColumns(cols).drop("_n", "_s")


def in_degree_table(tx: DataFrame, key: str = "nameDest", frame: int = 24, by: tuple[str, ...] = (),
                    time: str = "step", name: str = "in_degree_24h", keep: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, step) → rows of the trailing frame; with ``keep``, one row per row of ``tx`` that has all of these, and its ``keep``.

    Rows then get their frame where they lie, after one shuffle by account; joining the table to them would take four.
    """
    if keep:
        known = tx.select(*by, key, time, *keep)
        for c in (*by, key, time):
            known = known.filter(F.col(c).isNotNull())
        wf = Window.partitionBy(*by, key).orderBy(time).rangeBetween(-(frame - 1), 0)
        return known.withColumn(name, F.count(F.lit(1)).over(wf).cast("double"))
    per_step = tx.groupBy(*by, key, time).agg(F.count(F.lit(1)).alias("_n"))
    wf = Window.partitionBy(*by, key).orderBy(time).rangeBetween(-(frame - 1), 0)
    return per_step.withColumn(name, F.sum("_n").over(wf).cast("double")).drop("_n")


def distinct_in_degree_table(tx: DataFrame, key: str = "nameDest", other: str = "nameOrig", frame: int = 24,
                             by: tuple[str, ...] = (), time: str = "step",
                             name: str = "in_degree_24h_distinct") -> DataFrame:
    """Distinct senders of ``key`` within the trailing frame, exactly, without collecting sets.

    A sender seen at steps t₁<t₂<… covers the union of [tᵢ, tᵢ+frame-1]. Each
    maximal covered run contributes +1 at its start and −1 one past its end;
    a running sum of these deltas per receiver is the distinct count at every
    step. State per row is O(1): no frame-sized set is ever materialised. Rows
    are shuffled once, by (receiver, sender); the rows of a pair at one step
    need not be made distinct, since the first starts a run and the last ends it.
    """
    w_pair = Window.partitionBy(*by, key, other).orderBy(time)
    prev_t, next_t = F.lag(time).over(w_pair), F.lead(time).over(w_pair)
    first, last = F.lag(F.lit(True)).over(w_pair).isNull(), F.lead(F.lit(True)).over(w_pair).isNull()
    t = F.col(time)
    starts = first | (t.isNotNull() & prev_t.isNull()) | (t - prev_t > frame)
    ends = last | (next_t - t > frame)
    ev = tx.select(*by, key, other, time).select(*by, key, time, F.when(starts, 1).otherwise(0).cast("bigint").alias("_start"),
                                                 F.when(ends, 1).otherwise(0).alias("_end"))
    here = F.struct(t.alias(time), F.col("_start").alias("_d"), F.lit(1).alias("_q"))
    after = F.struct((t + frame).alias(time), F.lit(-1).cast("bigint").alias("_d"), F.lit(0).alias("_q"))
    deltas = (ev.select(*by, key, F.explode(F.when(F.col("_end") == 1, F.array(here, after)).otherwise(F.array(here))).alias("_x"))
              .select(*by, key, "_x.*").groupBy(*by, key, time).agg(F.sum("_d").alias("_d"), F.max("_q").alias("_q")))
    running = deltas.withColumn(
        name, F.sum("_d").over(Window.partitionBy(*by, key).orderBy(time)
                               .rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    # keep only steps where the receiver has transactions
    return running.filter("_q = 1").drop("_d", "_q")


def with_window_features(tx: DataFrame, by: tuple[str, ...] = (), distinct_in_degree: bool = False) -> DataFrame:
    """Attach the six velocity columns and ``in_degree_24h`` (optionally the distinct variant).

    Every row gets its frame where it lies: rows are dealt by receiver, then by sender, and no table is joined back. The
    receiver comes first, since its one column travels with the rows and the sender's six would. Rows of one step share a
    frame, which is added up once, so the work is rows × frame steps at most. Without an account or a step the columns are
    null.
    """
    def frames(key: str):
        known = F.col(key).isNotNull() & F.col("step").isNotNull()
        w = Window.partitionBy(*by, key).orderBy("step")
        return lambda n, agg: F.when(known, agg.over(w.rangeBetween(-(n - 1), 0)))

    sent, got = frames("nameOrig"), frames("nameDest")
    velocity = {}
    for n in VELOCITY_FRAMES:
        velocity[f"velocity_{n}h_count"] = sent(n, F.count(F.lit(1))).cast("double")
        velocity[f"velocity_{n}h_sum"] = sent(n, F.sum("amount"))
    out = tx.withColumn("in_degree_24h", got(24, F.count(F.lit(1))).cast("double")).withColumns(velocity)
    out = out.select(*[c for c in out.columns if c != "in_degree_24h"], "in_degree_24h")
    if distinct_in_degree:
        out = out.join(distinct_in_degree_table(tx, by=by), [*by, "nameDest", "step"], "left")
    return out
