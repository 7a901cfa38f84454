"""Exact order statistics and cumulative sums without an unpartitioned window.

Both split each group into value ranges whose bounds come from
``percentile_approx`` (a mergeable sketch: bounded memory per group); a tiny
(group, range) count table supplies prefix offsets, and exact work happens
inside ranges, in parallel. Results are exact — the sketch only balances load.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_RANGES = 64


def count_below(value: Column, sorted_arr: Column, n: int, inclusive: bool = False) -> Column:
    """Number of elements of a sorted array column that are < value (≤ with ``inclusive``).

    A binary search unrolled into a CASE tree of depth ⌈log2 n⌉: one
    comparison per level, fully code-generated, correct with duplicates.
    """
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cond = (sorted_arr[mid] <= value) if inclusive else (sorted_arr[mid] < value)
        return F.when(cond, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, n)


def _with_range(df: DataFrame, by: list[str], value: str, n_ranges: int) -> DataFrame:
    probs = [i / n_ranges for i in range(1, n_ranges)]
    if not by:
        raise ValueError("give at least one group key (a constant column for a single group)")
    bounds = df.groupBy(*by).agg(F.percentile_approx(value, probs, 1000).alias("_bounds"))
    j = df.join(F.broadcast(bounds), by)  # groups × ranges doubles: ``by`` must be a bounded grouping
    # ties share a range: strictly-below count is monotone in value
    return j.withColumn("_rg", count_below(F.col(value), F.col("_bounds"), n_ranges - 1)).drop("_bounds")


def ranked_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., value, _n, _upto): each distinct value with its count and the rank of its last row in the group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_upto", F.sum("_n").over(w))


def exact_quantiles(df: DataFrame, value: str, by: list[str], probs: list[float], n_ranges: int = DEFAULT_RANGES,
                    name: str = "q") -> DataFrame:
    """(by..., p_idx, p, q): linear-interpolated quantiles (NumPy 'linear' = SQL quantile_cont).

    An action, like ``approxQuantile``: three small jobs whose driver-side
    results are bounded by groups × ranges — (1) range bounds from the sketch,
    (2) row counts per (group, range), (3) the order statistics themselves,
    read only from the ≤ 2·len(probs) ranges per group that hold them. There
    equal values are counted first (map-side) and ranks run over (value, count),
    so a value that half of the rows share is one row where it is sorted. NULL
    values are ignored; ``by`` must be a bounded grouping.
    """
    spark = df.sparkSession
    key_schema = T.StructType([df.schema[c] for c in by])
    d = df.select(*by, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    rng_probs = [i / n_ranges for i in range(1, n_ranges)]
    bounds = d.groupBy(*by).agg(F.percentile_approx(value, rng_probs, 10000).alias("_bounds")).collect()
    bdf = spark.createDataFrame([(*[r[c] for c in by], r["_bounds"]) for r in bounds],
                                T.StructType([*key_schema.fields, T.StructField("_bounds", T.ArrayType(T.DoubleType()))]))
    d2 = d.join(F.broadcast(bdf), by).withColumn(
        "_rg", count_below(F.col(value), F.col("_bounds"), n_ranges - 1)).drop("_bounds")
    counts: dict[tuple, dict[int, int]] = {}
    for r in d2.groupBy(*by, "_rg").agg(F.count(F.lit(1)).alias("_c")).collect():
        counts.setdefault(tuple(r[c] for c in by), {})[r["_rg"]] = r["_c"]
    # which (group, range, local rank) hold each needed global rank
    plan, need = {}, set()
    for key, per in counts.items():
        n = sum(per.values())
        offs, acc = {}, 0
        for rg in sorted(per):
            offs[rg] = acc
            acc += per[rg]
        loc = {}
        for i, p in enumerate(probs):
            pos = p * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            plan[(key, i)] = (lo, hi, pos - lo, p)
            for rank in (lo, hi):
                rg = max(g for g in offs if offs[g] <= rank)
                loc[rank] = (rg, rank - offs[rg])
                need.add((*key, rg, rank - offs[rg] + 1))
        plan[key] = loc
    need_schema = T.StructType([*key_schema.fields, T.StructField("_rg", T.IntegerType()),
                                T.StructField("_local", T.LongType())])
    ndf = spark.createDataFrame(sorted(need, key=repr), need_schema)
    picked = ranked_values(d2.join(F.broadcast(ndf.select(*by, "_rg").distinct()), [*by, "_rg"]), [*by, "_rg"], value)
    hit = F.broadcast(ndf.withColumnRenamed("_rg", "_nrg").withColumnsRenamed({c: f"_n_{c}" for c in by}))
    cond = (F.col("_rg") == F.col("_nrg")) & (F.col("_local") > F.col("_upto") - F.col("_n")) & (F.col("_local") <= F.col("_upto"))
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    got = {(tuple(r[c] for c in by), r["_rg"], r["_local"] - 1): float(r[value]) for r in picked.join(hit, cond).collect()}
    rows = []
    for key in counts:
        loc = plan[key]
        for i in range(len(probs)):
            lo, hi, frac, p = plan[(key, i)]
            vlo, vhi = got[(key, *loc[lo])], got[(key, *loc[hi])]
            rows.append((*key, i, float(p), vlo + (vhi - vlo) * frac))
    out_schema = T.StructType([*key_schema.fields, T.StructField("p_idx", T.IntegerType()),
                               T.StructField("p", T.DoubleType()), T.StructField(name, T.DoubleType())])
    return spark.createDataFrame(rows, out_schema)


def cumulative_desc(df: DataFrame, by: list[str], order: str, sums: list[str], n_ranges: int = DEFAULT_RANGES) -> DataFrame:
    """For rows unique per (by, order): adds ``cum_<c>`` = Σ c over rows with order ≥ this row's order."""
    d = _with_range(df, by, order, n_ranges)
    tot = d.groupBy(*by, "_rg").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # ranges above this one (descending order = higher range ids first)
    w_above = Window.partitionBy(*by).orderBy(F.desc("_rg")).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_rg", *[F.coalesce(F.sum(f"_t_{c}").over(w_above), F.lit(0)).alias(f"_o_{c}") for c in sums])
    w_in = Window.partitionBy(*by, "_rg").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    j = d.join(off, [*by, "_rg"])
    return j.withColumns({f"cum_{c}": F.col(f"_o_{c}") + F.sum(c).over(w_in) for c in sums}) \
        .drop("_rg", *[f"_o_{c}" for c in sums])


def global_rank(df: DataFrame, by: list[str], order: str, n_ranges: int = DEFAULT_RANGES, name: str = "rank") -> DataFrame:
    """Exact ascending ``row_number`` per group (ties broken arbitrarily within equal values)."""
    d = _with_range(df, by, order, n_ranges)
    cnt = d.groupBy(*by, "_rg").agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.select(*by, "_rg", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*by).orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return d.join(off, [*by, "_rg"]).withColumn(
        name, F.col("_o") + F.row_number().over(Window.partitionBy(*by, "_rg").orderBy(order))).drop("_rg", "_o")


def top_k_per_group(df: DataFrame, by: list[str], order: list, k: int, key: str = "event_id",
                    salts: int = 64) -> DataFrame:
    """Exact top-k rows per group by ``order`` without sorting a whole group in one task.

    Phase 1 keeps the top k inside each (group, salt) slice — a hot group is
    spread over ``salts`` tasks by a hash of the unique ``key``; phase 2 ranks
    the ≤ k·salts survivors per group. ``order`` must end with a unique
    tie-breaker so the answer is deterministic.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    w1 = Window.partitionBy(*by, "_salt").orderBy(*order)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*by).orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def newest_per_group(df: DataFrame, by: list[str], w: int, time: str = "step", key: str = "event_id", key_bits: int = 12) -> DataFrame:
    """The ``w`` newest rows of each group by (time, key), key unique in the group: a threshold, then one filter.

    Counts per time find the time that the w-th newest row has; counts per block
    of 2**key_bits keys at that time find its block; only that block's rows, at
    most 2**key_bits of them, are ranked. So no group is sorted or gathered, and
    the window costs the same whatever ``w`` is. Groups with fewer rows are kept
    whole; rows with a null time or key are left out.
    """
    rows = df.filter(F.col(time).isNotNull() & F.col(key).isNotNull())
    block = F.floor(F.col(key) / F.lit(1 << key_bits)).cast("long")

    def cut(counts: DataFrame, col: str, left: Column, keep: list[Column]) -> DataFrame:
        """The value of ``col`` at which the newest ``left`` rows of each group end, and how many are still wanted there."""
        after = Window.partitionBy(*by).orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, 0)
        run = counts.withColumn("_run", F.sum("_c").over(after))
        hit = run.filter((F.col("_run") >= left) & (F.col("_run") - F.col("_c") < left))
        return hit.select(*by, *keep, F.col(col).alias(f"_cut_{col}"), (left - F.col("_run") + F.col("_c")).alias("_left"))

    times = cut(rows.groupBy(*by, time).agg(F.count(F.lit(1)).alias("_c")), time, F.lit(w), [])
    at_time = rows.join(times, by).filter(F.col(time) == F.col(f"_cut_{time}")).withColumn("_block", block)
    per_block = at_time.groupBy(*by, f"_cut_{time}", "_left", "_block").agg(F.count(F.lit(1)).alias("_c"))
    blocks = cut(per_block, "_block", F.col("_left"), [F.col(f"_cut_{time}")])
    newest = Window.partitionBy(*by).orderBy(F.desc(key))
    last = (at_time.drop("_left").join(blocks.drop(f"_cut_{time}"), by).filter(F.col("_block") == F.col("_cut__block"))
            .withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") == F.col("_left"))
            .select(*by, F.col(f"_cut_{time}"), F.col(key).alias("_cut_key")))
    inside = F.col("_cut_key").isNull() | (F.col(time) > F.col(f"_cut_{time}")) | ((F.col(time) == F.col(f"_cut_{time}")) & (F.col(key) >= F.col("_cut_key")))
    return rows.join(last, by, "left").filter(inside).select(*df.columns)
