"""Population stability index between a reference and current samples, many at once.

All PSIs of a job — every (silo, feature, window) — are computed by the same
few aggregations; the group keys must be a bounded set (silos × features ×
windows), which keeps the edge and count tables small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silolake.operators.ranking import count_below, exact_quantiles

N_BINS = 20
EPS = 1e-6
PSI_THRESHOLD = 0.2


def quantile_edges(ref: DataFrame, value: str, by: list[str], n_bins: int = N_BINS) -> DataFrame:
    """(by..., edges ARRAY<DOUBLE>): n_bins+1 linear-interpolated percentiles of the reference."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(ref, value, by, probs)
    return q.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", "q"))),
                                          lambda s: s["q"]).alias("edges"))


def psi_edges(ref: DataFrame, cur: DataFrame, value: str, by: list[str], cur_by: list[str],
              n_bins: int = N_BINS, eps: float = EPS, ref_edges: DataFrame | None = None) -> DataFrame:
    """Edges per (by + cur_by): reference quantiles opened to cover ref ∪ current, or equal-width
    bins over the combined range when the reference has < 2 distinct edges (``degenerate``)."""
    edges = ref_edges if ref_edges is not None else quantile_edges(ref, value, by, n_bins)
    rng_ref = ref.groupBy(*by).agg(F.min(value).alias("_rmin"), F.max(value).alias("_rmax"),
                                   F.count(F.lit(1)).alias("n_ref"))
    rng_cur = cur.groupBy(*by, *cur_by).agg(F.min(value).alias("_cmin"), F.max(value).alias("_cmax"))
    j = rng_cur.join(rng_ref, by).join(edges, by)
    lo = F.least("_rmin", "_cmin") - F.lit(eps)
    hi = F.greatest("_rmax", "_cmax") + F.lit(eps)
    width = (hi - lo) / F.lit(float(n_bins))
    linspace = F.concat(F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: lo + i * width), F.array(hi))
    opened = F.concat(F.array(F.least(F.col("edges")[0], lo)), F.slice("edges", 2, n_bins - 1),
                      F.array(F.greatest(F.col("edges")[n_bins], hi)))
    degenerate = F.size(F.array_distinct("edges")) < 2
    return j.select(*by, *cur_by, F.when(degenerate, linspace).otherwise(opened).alias("edges"),
                    degenerate.alias("degenerate"), "n_ref", F.col("_rmin").alias("ref_min"))


def bin_index(value, edges, n_bins: int = N_BINS):
    """np.histogram bin: [e_i, e_{i+1}), last bin closed; duplicate edges leave empty bins.

    (number of edges ≤ value) − 1, clamped; the count is a binary search
    unrolled into a CASE tree, so it stays inside whole-stage codegen.
    """
    below = count_below(value, edges, n_bins + 1, inclusive=True)
    return F.least(F.greatest(below - 1, F.lit(0)), F.lit(n_bins - 1))


def histogram_counts(df: DataFrame, value: str, keys: list[str], edges: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """(keys..., bin, cnt) including empty bins (0). ``edges`` has one row per key (bounded)."""
    e = edges.select(*keys, "edges")
    j = df.join(F.broadcast(e), keys)
    counts = j.groupBy(*keys, bin_index(F.col(value), F.col("edges"), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"))
    grid = e.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").fillna(0, ["cnt"])


def psi(ref: DataFrame, cur: DataFrame, value: str, by: list[str], cur_by: list[str],
        n_bins: int = N_BINS, eps: float = EPS) -> DataFrame:
    """(by..., cur_by..., psi): Σ (r−c)·ln(r/c) over smoothed, renormalised bin shares.

    ``by`` keys both samples (e.g. silo, feature); ``cur_by`` splits the
    current sample (e.g. window) and every slice is compared with the same
    reference. Opening the outer edges never moves a reference value to another
    bin, so the reference histogram is counted once per group; only a constant
    reference (equal-width fallback) is re-binned per slice, from its count alone.
    """
    ref = ref.filter(F.col(value).isNotNull())
    cur = cur.filter(F.col(value).isNotNull())
    ref_edges = quantile_edges(ref, value, by, n_bins)
    slices = psi_edges(ref, cur, value, by, cur_by, n_bins, eps, ref_edges)
    keys = [*by, *cur_by]
    ref_hist = histogram_counts(ref, value, by, ref_edges, n_bins).withColumnRenamed("cnt", "_rc")
    cc = histogram_counts(cur, value, keys, slices, n_bins).withColumnRenamed("cnt", "cc")
    h = cc.join(F.broadcast(slices), keys).join(ref_hist, [*by, "bin"], "left")
    const_bin = bin_index(F.col("ref_min"), F.col("edges"), n_bins)
    rc = F.when(F.col("degenerate"), F.when(F.col("bin") == const_bin, F.col("n_ref")).otherwise(F.lit(0))) \
        .otherwise(F.coalesce(F.col("_rc"), F.lit(0)))
    tot = Window.partitionBy(*keys)
    h = (h.withColumn("rc", rc).withColumn("_cn", F.sum("cc").over(tot))
         .withColumn("_r", F.col("rc") / F.greatest("n_ref", F.lit(1)) + F.lit(eps))
         .withColumn("_c", F.col("cc") / F.greatest("_cn", F.lit(1)) + F.lit(eps)))
    h = h.withColumn("_r", F.col("_r") / F.sum("_r").over(tot)).withColumn("_c", F.col("_c") / F.sum("_c").over(tot))
    return h.groupBy(*keys).agg(
        F.when((F.first("n_ref") == 0) | (F.first("_cn") == 0), F.lit(0.0))
        .otherwise(F.sum((F.col("_r") - F.col("_c")) * F.log(F.col("_r") / F.col("_c")))).alias("psi"))


def drift_alerts(psi_df: DataFrame, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """Alert rows where PSI exceeds the threshold (strict)."""
    return psi_df.filter(F.col("psi") > F.lit(threshold))


def long_features(feat: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Unpivot chosen feature columns to (keep..., feature, value) for many-PSI jobs."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return feat.select(*keep, F.explode(arr).alias("_x")).select(*keep, "_x.feature", "_x.value")
