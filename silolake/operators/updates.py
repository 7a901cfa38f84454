"""Coordinate-wise aggregation of model updates.

Updates are kept in long form (round, silo_id, n, pos, v): every rule below
is a grouped aggregation or a window over (round, pos), whose groups hold one
value per silo — all rounds of an experiment aggregate in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silolake.functions.rand import normal01

NORM_FLOOR = 1e-10


def to_long(updates: DataFrame, delta: str = "delta", n: str = "n_samples",
            keys: tuple[str, ...] = ("round", "silo_id")) -> DataFrame:
    return updates.select(*keys, F.col(n).alias("n"), F.posexplode(delta).alias("pos", "v"))


def to_wide(long: DataFrame, keys: list[str], value: str = "v", name: str = "delta") -> DataFrame:
    """Back to one array per key, ordered by position (array length = model size)."""
    return long.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias(name))


def fedavg(long: DataFrame, size_exp: float = 0.5, server_lr: float = 1.0, by: str = "round") -> DataFrame:
    """(round, pos, v): Σ wᵢ dᵢ with wᵢ = nᵢ^e / Σ nⱼ^e, × server_lr. Empty input → empty output."""
    w = F.pow(F.col("n").cast("double"), F.lit(size_exp))
    return long.groupBy(by, "pos").agg((F.sum(w * F.col("v")) / F.sum(w) * F.lit(server_lr)).alias("v"))


def coordinate_median(long: DataFrame, by: str = "round") -> DataFrame:
    return long.groupBy(by, "pos").agg(F.median("v").alias("v"))


def trimmed_mean(long: DataFrame, trim_frac: float = 0.2, server_lr: float = 1.0, by: str = "round") -> DataFrame:
    """Per coordinate drop trim = max(1, int(n·frac)) lowest and highest, mean of the rest, × lr.

    With n ≤ 2·trim nothing would remain: the coordinate median is used instead.
    """
    w = Window.partitionBy(by, "pos")
    x = (long.withColumn("_k", F.count(F.lit(1)).over(w))
         .withColumn("_rk", F.row_number().over(w.orderBy("v", "silo_id"))))
    trim = F.greatest(F.lit(1), F.floor(F.col("_k") * F.lit(trim_frac)).cast("int"))
    x = x.withColumn("_trim", trim)
    keep = (F.col("_rk") > F.col("_trim")) & (F.col("_rk") <= F.col("_k") - F.col("_trim"))
    agg = x.groupBy(by, "pos").agg(
        F.avg(F.when(keep, F.col("v"))).alias("_tm"), F.median("v").alias("_med"),
        F.first("_k").alias("_k"), F.first("_trim").alias("_trim"))
    v = F.when(F.col("_k") <= 2 * F.col("_trim"), F.col("_med")).otherwise(F.col("_tm")) * F.lit(server_lr)
    return agg.select(by, "pos", v.alias("v"))


def update_cosine(long: DataFrame, ref: DataFrame | None = None, by: str = "round") -> DataFrame:
    """(round, silo_id, cos): cosine of each update to the coordinate median (+1e-10 in the
    denominator); every cosine is 1 when the median's norm is below 1e-10."""
    ref = coordinate_median(long, by) if ref is None else ref
    m = ref.withColumnRenamed("v", "_m")
    j = long.join(m, [by, "pos"])
    per = j.groupBy(by, "silo_id").agg(F.sum(F.col("v") * F.col("_m")).alias("_dot"),
                                       F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"))
    mn = m.groupBy(by).agg(F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_mnorm"))
    c = per.join(mn, by)
    cos = F.when(F.col("_mnorm") < NORM_FLOOR, F.lit(1.0)).otherwise(
        F.col("_dot") / (F.col("_norm") * F.col("_mnorm") + F.lit(NORM_FLOOR)))
    return c.select(by, "silo_id", cos.alias("cos"))


def qwra_reject(cos: DataFrame, tau: float = 0.0, by: str = "round") -> DataFrame:
    """rejected = cos < τ; when nobody survives a round, everyone is kept and no one is flagged."""
    rej = F.col("cos") < F.lit(tau)
    any_survivor = F.max((~rej).cast("int")).over(Window.partitionBy(by))
    return cos.withColumn("rejected", rej & (any_survivor == 1))


def qwra(long: DataFrame, quality: DataFrame | None = None, tau: float = 0.0, size_exp: float = 0.5,
         server_lr: float = 1.0, fallback_ratio: float = 5.0, trim_frac: float = 0.2, reference: str = "trimmed",
         by: str = "round") -> tuple[DataFrame, DataFrame]:
    """Quality-weighted robust aggregation; returns (aggregate (round, pos, v, fallback), flags).

    uᵢ = nᵢ^e · qᵢ over surviving updates, normalised (Σ + 1e-10); d = Σ uᵢ dᵢ × lr.
    If ‖d − d_ref‖ / (‖d_ref‖ + 1e-10) > ratio, the trimmed mean replaces d.
    ``reference`` picks d_ref: the trimmed mean (default) or the median.
    ``quality`` holds (round, silo_id, q); without it q = 1.
    """
    flags = qwra_reject(update_cosine(long, by=by), tau, by)
    x = long.join(flags.select(by, "silo_id", "rejected"), [by, "silo_id"]).filter(~F.col("rejected"))
    if quality is not None:
        x = x.join(quality.select(by, "silo_id", "q"), [by, "silo_id"], "left").fillna(1.0, ["q"])
    else:
        x = x.withColumn("q", F.lit(1.0))
    u = F.pow(F.col("n").cast("double"), F.lit(size_exp)) * F.col("q")
    per_silo = x.select(by, "silo_id", u.alias("_u")).distinct()
    tot = per_silo.groupBy(by).agg(F.sum("_u").alias("_su"))
    xw = x.withColumn("_u", u).join(tot, by)
    d = xw.groupBy(by, "pos").agg((F.sum(F.col("_u") / (F.col("_su") + F.lit(NORM_FLOOR)) * F.col("v"))
                                   * F.lit(server_lr)).alias("_d"))
    tm = trimmed_mean(long, trim_frac, server_lr, by).withColumnRenamed("v", "_tm")
    ref = tm if reference == "trimmed" else coordinate_median(long, by).withColumnRenamed("v", "_tm")
    cmp = d.join(tm, [by, "pos"]).join(ref.withColumnRenamed("_tm", "_ref"), [by, "pos"])
    ratio = cmp.groupBy(by).agg(
        (F.sqrt(F.sum((F.col("_d") - F.col("_ref")) ** 2)) / (F.sqrt(F.sum(F.col("_ref") ** 2)) + F.lit(NORM_FLOOR)))
        .alias("_ratio"))
    out = cmp.join(ratio, by).select(
        by, "pos", F.when(F.col("_ratio") > F.lit(fallback_ratio), F.col("_tm")).otherwise(F.col("_d")).alias("v"),
        (F.col("_ratio") > F.lit(fallback_ratio)).alias("fallback"))
    return out, flags


# ---- array-form operators (one row per update) --------------------------------------------

def l2_norm(delta: Column) -> Column:
    return F.sqrt(F.aggregate(delta, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_clip(updates: DataFrame, clip_norm: float, delta: str = "delta") -> DataFrame:
    """Scale the whole vector by min(1, C / max(‖d‖, 1e-10))."""
    scale = F.least(F.lit(1.0), F.lit(float(clip_norm)) / F.greatest(l2_norm(F.col(delta)), F.lit(NORM_FLOOR)))
    return updates.withColumn(delta, F.transform(delta, lambda x: x * scale))


def gaussian_noise(updates: DataFrame, sigma: float, clip_norm: float, seed: int = 42, run: str = "run",
                   delta: str = "delta") -> DataFrame:
    """Add N(0, σ·C) per coordinate, keyed by (run, round, silo, position) — a fresh draw every round."""
    sd = float(sigma) * float(clip_norm)
    return updates.withColumn(delta, F.transform(
        delta, lambda x, i: x + F.lit(sd) * normal01(seed, f"noise/{run}", "round", "silo_id", i)))


def dp_release(updates: DataFrame, clip_norm: float, sigma: float | None, seed: int = 42, run: str = "run") -> DataFrame:
    """Clip always; add noise when σ is given."""
    c = l2_clip(updates, clip_norm)
    return gaussian_noise(c, sigma, clip_norm, seed, run) if sigma else c


def staleness_decay(updates: DataFrame, lam: float = 0.5, staleness: str = "staleness", delta: str = "delta") -> DataFrame:
    """delta · λ^s."""
    f = F.pow(F.lit(lam), F.col(staleness).cast("double"))
    return updates.withColumn(delta, F.transform(delta, lambda x: x * f))


def apply_update(weights: Column, delta: Column) -> Column:
    """w' = w + d, elementwise."""
    return F.zip_with(weights, delta, lambda w, d: w + d)
