"""Quantiles with ties, mergeable sketches, newest-W selection, interval join, membership check, keyed writes, lost rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silolake.operators import holdout as HO
from silolake.operators import partition as P
from silolake.operators import rounds as RD
from silolake.operators import sketches as SK
from silolake.operators.ranking import exact_quantiles, newest_per_group, ranked_values
from silolake.schemas import TX_TYPES
from silolake.sources import lake as LK

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tied(spark):
    """Half of the rows share one value, some are null; group b is constant."""
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=2000).round(3)] + [("a", 0.25)] * 2000 + [("a", None)] * 50 + [("b", 7.0)] * 300
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(5).cache()


def test_exact_quantiles_with_half_equal_values(tied):
    probs = [i / 20 for i in range(21)]
    got = {(r["g"], r["p_idx"]): r["q"] for r in exact_quantiles(tied, "v", ["g"], probs, n_ranges=16).collect()}
    for g in "ab":
        v = np.array([r["v"] for r in tied.filter((F.col("g") == g) & F.col("v").isNotNull()).collect()])
        assert np.allclose([got[g, i] for i in range(21)], np.quantile(v, probs), atol=1e-12)


def test_ties_are_counted_before_they_are_sorted(tied):
    ranked = ranked_values(tied.filter("v is not null"), ["g"], "v")
    text = plan(ranked)
    assert text.count("HashAggregate") == 2 and text.index("Window") < text.index("HashAggregate")  # counts, map-side, below the window
    assert ranked.filter("g = 'b'").collect()[0]["_upto"] == 300 and ranked.filter("v = 0.25").first()["_n"] >= 2000


def test_merged_sketches_stay_within_the_stated_rank_error(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{i % 3}", int(b), float(v)) for i, (b, v) in enumerate(zip(np.arange(30_000) // 2500, np.where(rng.random(30_000) < .5, 1.0, rng.lognormal(0, 2, 30_000))))]
    df = spark.createDataFrame(rows, "silo string, batch long, v double").union(spark.createDataFrame([("s0", 1, None)], "silo string, batch long, v double"))
    batches = SK.quantile_sketches(df, "v", ["silo", "batch"])
    assert batches.count() == 36
    for lo, hi in ((0, 11), (3, 6)):
        merged = SK.merge_sketches(batches.filter(F.col("batch").between(lo, hi)), ["silo"])
        some = df.filter(F.col("batch").between(lo, hi))
        assert merged.agg(F.sum("n")).first()[0] == some.filter("v is not null").count()
        edges = SK.sketch_edges(merged, ["silo"])
        errors = SK.rank_errors(some, "v", ["silo"], edges).collect()
        assert len(errors) == 63 and max(r["rank_error"] for r in errors) <= SK.RANK_ERROR
        for r in edges.collect():
            v = [x["v"] for x in some.filter((F.col("silo") == r["silo"]) & F.col("v").isNotNull()).collect()]
            assert r["edges"][0] == min(v) and r["edges"][-1] == max(v) and r["edges"] == sorted(r["edges"])


@pytest.mark.parametrize("w", [1, 7, 100, 250, 1000])
def test_newest_rows_match_a_sort(spark, w):
    rnd = random.Random(w)
    rows = [(rnd.choice("abbbbbb"), rnd.choice([1, 2, 3, 3, 3, 3]), i) for i in rnd.sample(range(5000), 600)] + [("c", 1, 9999), ("c", None, 9998), (None, 5, 9997)]
    df = spark.createDataFrame(rows, "g string, step int, event_id long").repartition(4)
    got = sorted(r["event_id"] for r in newest_per_group(df, ["g"], w, key_bits=4).collect())
    want = []
    for g in "abc":
        want += [e for _, e in sorted(((s, e) for h, s, e in rows if h == g and s is not None), reverse=True)[:w]]
    assert [e for e in got if e != 9997] == sorted(want)


def test_interval_join_needs_no_nested_loop(spark):
    cal = spark.createDataFrame([(r, T0 + dt.timedelta(minutes=47 * r), T0 + dt.timedelta(minutes=47 * r + 130)) for r in range(40)],
                                "round int, start_ts timestamp, deadline timestamp")  # rounds overlap, and span hours
    rows = [(i % 40, f"s{i}", T0 + dt.timedelta(minutes=7 * i - 30)) for i in range(300)] + [(1, "null", None)]
    upd = spark.createDataFrame(rows, "round int, silo_id string, arrived_at timestamp")
    got = RD.join_round_window(upd, cal)
    text = plan(got)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    want = []
    for r, s, at in rows:
        hit = [c["round"] for c in cal.collect() if at and c["start_ts"] < at <= c["deadline"]]
        want += [(s, h) for h in hit] or [(s, None)]
    assert sorted(map(str, want)) == sorted(str((r["silo_id"], r["window_round"])) for r in got.collect())
    assert got.columns[:3] == upd.columns and "_bucket" not in got.columns
    assert "NestedLoop" not in plan(RD.join_carry_late(upd, cal)) + plan(RD.update_staleness(got))


def test_membership_check_counts_a_spoilt_split(spark):
    full = spark.range(100).withColumnRenamed("id", "event_id")
    a, b = full.filter("event_id < 30"), full.filter("event_id >= 20 and event_id < 90")
    check = HO.split_disjoint_check(full, a, b)
    assert check.first().asDict() == {"n_total": 100, "n_a": 30, "n_b": 70, "n_missing": 10, "n_overlap": 10}
    assert plan(check).count("Range (") == 3
    assert HO.split_disjoint_check(full.limit(0), a.limit(0), b.limit(0)).first().asDict() == dict.fromkeys(check.columns, 0)


def test_rounds_written_twice_are_kept_once(spark, tmp_path):
    schema = LK.METRIC_TABLES["silo_metrics"]
    rows = [(r, f"s{i}", 5, 0.5 * r, None, None, 0, 0, None, None) for r in (1, 2) for i in range(3)]
    for part in (rows, rows[3:], rows[:3]):
        LK.metrics_append(spark.createDataFrame(part, schema), str(tmp_path), "silo_metrics", "run")
    LK.metrics_append(spark.createDataFrame(rows[:3], schema), str(tmp_path), "silo_metrics", "other")
    got = LK.metrics_scan(spark, str(tmp_path), "silo_metrics", "run")
    assert [tuple(r)[:10] for r in got.collect()] == rows and LK.metrics_scan(spark, str(tmp_path), "silo_metrics").count() == 9


@pytest.mark.parametrize("mode", ["shares", "both"])
def test_no_row_is_lost_in_the_partition(spark, mode):
    types = ["PAYMENT", None, "REFUND", "DEBIT", ""]
    tx = spark.createDataFrame([(i, types[i % 5]) for i in range(500)], "event_id long, type string")
    for given in (TX_TYPES, None, []):
        got = P.dirichlet_partition(tx, 5, 0.5, P.DEFAULT_SHARES, mode=mode, types=given)
        assert got.count() == 500 and got.columns == ["event_id", "type", "silo_id"]
        assert got.select("event_id").distinct().count() == 500
    few = {r["silo_id"]: r["count"] for r in P.dirichlet_partition(tx, 4, 0.5, None, types=TX_TYPES).filter("type = 'REFUND' or type is null").groupBy("silo_id").count().collect()}
    assert set(few) <= {f"silo-{i}" for i in range(4)} and sum(few.values()) == 200


def test_equal_arrivals_of_a_silo_are_one_update(spark):
    at = T0 + dt.timedelta(seconds=5)
    schema = "round int, silo_id string, base_version int, delta array<double>, n_samples long, train_loss double, wall_time_s double, arrived_at timestamp"
    upd = spark.createDataFrame([(0, "s0", 0, [1.0], 1, 0.1, 0.0, at), (0, "s0", 0, [2.0], 1, 0.2, 0.0, at)], schema)
    cal = spark.createDataFrame([(0, T0, T0 + dt.timedelta(seconds=60))], "round int, start_ts timestamp, deadline timestamp")
    got = RD.round_updates(upd, cal, spark.createDataFrame([("s0", 1)], "silo_id string, n_rows long")).collect()
    assert [(r["delta"], r["staleness"]) for r in got] == [([2.0], 0)]


def test_rank_errors_count_each_row_once(spark):
    """Rank errors of given edges, with ties, duplicate edges and NaN, against counts in NumPy; rows are not multiplied by the edges."""
    import numpy as np

    from silolake.operators import sketches as SK
    rng = np.random.default_rng(4)
    groups = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 400), ("b", 37))}
    groups["b"][:3] = np.nan
    edges = {"a": [-3.0, -0.5, -0.5, 0.0, 0.7, 4.0], "b": [-1.0, 0.1, 0.2, 2.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, value double")
    edf = spark.createDataFrame(list(edges.items()), "g string, edges array<double>")
    err = SK.rank_errors(df, "value", ["g"], edf)
    got = {(r["g"], r["p_idx"]): r["rank_error"] for r in err.collect()}
    want = {}
    for g, vs in groups.items():
        for i, q in enumerate(edges[g]):
            p, n = i / (len(edges[g]) - 1), len(vs)
            want[g, i] = max(0.0, (vs < q).sum() / n - p, p - (vs <= q).sum() / n)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = err._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the edges', not the rows'
