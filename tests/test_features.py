import math

import numpy as np
from pyspark.sql import functions as F

from silolake.functions.features import FEATURE_COLS, feature_vector, with_scalar_features
from silolake.operators.stats import silo_stats, standardize
from silolake.operators.windows import distinct_in_degree_table, velocity_table, with_window_features

TX = ("event_id BIGINT, step INT, type STRING, amount DOUBLE, nameOrig STRING, oldbalanceOrg DOUBLE, newbalanceOrig DOUBLE, "
      "nameDest STRING, oldbalanceDest DOUBLE, newbalanceDest DOUBLE, isFraud INT, isFlaggedFraud INT")


def test_window_fixture(spark):
    # hand-computed trailing frames (current row and same-step peers included)
    rows = [(1, 0, 10.0), (2, 5, 20.0), (3, 5, 30.0), (4, 23, 40.0), (5, 24, 50.0), (6, 167, 60.0), (7, 168, 70.0)]
    df = spark.createDataFrame([(i, s, "PAYMENT", a, "C1", 0.0, 0.0, "M1", 0.0, 0.0, 0, 0) for i, s, a in rows], TX)
    out = {r["step"]: r for r in velocity_table(df).collect()}
    expect = {0: (1, 1, 1, 10, 10, 10), 5: (2, 3, 3, 50, 60, 60), 23: (1, 4, 4, 40, 100, 100),
              24: (1, 4, 5, 50, 140, 150), 167: (1, 1, 6, 60, 60, 210), 168: (1, 2, 6, 70, 130, 270)}
    for step, e in expect.items():
        r = out[step]
        got = (r["velocity_1h_count"], r["velocity_24h_count"], r["velocity_168h_count"],
               r["velocity_1h_sum"], r["velocity_24h_sum"], r["velocity_168h_sum"])
        assert got == e, (step, got, e)


def test_distinct_in_degree_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 80)), "PAYMENT", 1.0, f"C{rng.integers(0, 6)}", 0.0, 0.0, f"M{rng.integers(0, 3)}",
             0.0, 0.0, 0, 0) for i in range(400)]
    df = spark.createDataFrame(rows, TX)
    got = {(r["nameDest"], r["step"]): r["in_degree_24h_distinct"] for r in distinct_in_degree_table(df).collect()}
    for dest, step in got:
        senders = {r[4] for r in rows if r[7] == dest and step - 23 <= r[1] <= step}
        assert got[(dest, step)] == len(senders)


def test_distinct_in_degree_shuffles_rows_once(spark):
    """Rows of a pair at one step, null accounts included, count one sender; three shuffles in all."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 60)), f"C{rng.integers(0, 5)}" if i % 9 else None, f"M{rng.integers(0, 3)}") for i in range(300)]
    got = distinct_in_degree_table(spark.createDataFrame(rows * 2, "step int, nameOrig string, nameDest string"))
    want = {(d, s): float(len({o for t, o, x in rows if x == d and s - 23 <= t <= s})) for s, _, d in rows}
    assert {(r["nameDest"], r["step"]): r["in_degree_24h_distinct"] for r in got.collect()} == want
    assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Initial Plan")[-1].count("Exchange hashpartitioning") == 3


def test_features_two_rows(spark):
    rows = [(1, 1, "PAYMENT", 100.0, "C1", 500.0, 400.0, "M1", 0.0, 0.0, 0, 0),
            (2, 2, "TRANSFER", 200.0, "C2", 600.0, 500.0, "M2", 100.0, 50.0, 1, 0)]
    df = with_scalar_features(with_window_features(spark.createDataFrame(rows, TX)))
    fv = feature_vector(df).orderBy("event_id").collect()
    assert len(fv) == 2 and all(len(r["features"]) == 22 for r in fv)
    assert all(not math.isnan(x) for r in fv for x in r["features"])
    assert [r["label"] for r in fv] == [0.0, 1.0]
    f0 = dict(zip(FEATURE_COLS, fv[0]["features"]))
    assert abs(f0["log1p_amount"] - math.log1p(100)) < 1e-5
    assert f0["balance_delta_orig"] == 0.0 and f0["type_PAYMENT"] == 1.0 and f0["zero_balance_dest"] == 1.0


def test_unknown_type_and_nulls(spark):
    rows = [(1, 3, "WIRE", 5.0, "C1", None, None, "M1", None, None, None, None)]
    fv = feature_vector(with_scalar_features(spark.createDataFrame(rows, TX))).first()
    assert all(x == x for x in fv["features"])  # no NaN
    assert sum(fv["features"][5:10]) == 0.0


def test_stats_and_standardize(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0), ("s", 3.0, 4.0), ("s", 5.0, 6.0)], "silo_id string, a double, b double")
    st = {r["feature"]: r for r in silo_stats(df, ["a", "b"]).collect()}
    assert abs(st["a"]["std"] - 1.632993) < 1e-6 and st["a"]["mean"] == 3.0
    const = spark.createDataFrame([("s", 7.0), ("s", 7.0)], "silo_id string, a double")
    assert silo_stats(const, ["a"]).first()["std"] == 1.0
    x = spark.createDataFrame([("s", 0.0, 10.0), ("s", 10.0, 20.0)], "silo_id string, a double, b double")
    stats = spark.createDataFrame([("s", "a", 5.0, 5.0), ("s", "b", 15.0, 5.0)], "silo_id string, feature string, mean double, std double")
    z = sorted((r["a"], r["b"]) for r in standardize(x, stats, ["a", "b"]).collect())
    assert z == [(-1.0, -1.0), (1.0, 1.0)]


def test_row_frames_equal_the_joined_tables(spark):
    """The frames over rows are those of the per-step tables, and no table is joined back; null accounts and steps have none."""
    from silolake.operators import windows as W
    rows = [(i, f"silo-{i % 2}", f"C{i % 7}" if i % 11 else None, f"S{i % 5}" if i % 13 else None, (i * 37) % 300 if i % 17 else None,
             float(i % 23) if i % 19 else None) for i in range(700)] + [(3, "silo-1", "C3", "S3", 111, 3.0)] * 2
    tx = spark.createDataFrame(rows, "event_id long, silo_id string, nameOrig string, nameDest string, step int, amount double")
    got = W.with_window_features(tx, ("silo_id",))
    want = tx.join(W.velocity_table(tx, by=("silo_id",)), ["silo_id", "nameOrig", "step"], "left") \
        .join(W.in_degree_table(tx, by=("silo_id",)), ["silo_id", "nameDest", "step"], "left")
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_in_degree_of_rows_takes_one_shuffle(spark):
    """Rows kept by the operator have the frames of its table joined to them; rows without a silo, an account or a step are left out."""
    from silolake.operators import windows as W
    rows = [(i, f"silo-{i % 2}" if i % 7 else None, f"S{i % 5}" if i % 13 else None, (i * 37) % 300 if i % 17 else None)
            for i in range(700)] + [(3, "silo-1", "S3", 111)] * 3 + [(None, "silo-1", "S3", 112)]
    tx = spark.createDataFrame(rows, "event_id long, silo_id string, nameDest string, step int")
    keys = ["silo_id", "nameDest", "step"]
    got = W.in_degree_table(tx, by=("silo_id",), keep=("event_id",))
    want = tx.join(W.in_degree_table(tx, by=("silo_id",)), keys)
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("Initial Plan")[-1].count("Exchange") == 1
