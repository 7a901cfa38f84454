import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from silolake.functions.rand import hash01, order_key
from silolake.operators.amplify import amplify
from silolake.operators.inject import inject_drift, inject_label_flip
from silolake.operators.partition import dirichlet_partition, distributed_rank, partition_by_size_shares
from silolake.sources.tables import tx_events

from conftest import SF_SMALL


def test_partition_keeps_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate("AABBC")], "event_id long, type string")
    out = dirichlet_partition(df, 2, 0.5, [0.5, 0.5], 42)
    assert sorted(r["event_id"] for r in out.collect()) == list(range(5))


def test_shares_exact(spark):
    df = spark.range(100).withColumnRenamed("id", "event_id")
    out = partition_by_size_shares(df, [0.5, 0.3, 0.2])
    counts = {r["silo_id"]: r["count"] for r in out.groupBy("silo_id").count().collect()}
    assert counts == {"silo-0": 50, "silo-1": 30, "silo-2": 20}


def test_distributed_rank_equals_row_number(spark):
    tx = tx_events(spark, SF_SMALL)
    a = distributed_rank(tx, ["type"], order_key(3, "event_id"), "event_id", bucket_hex=1)
    w = Window.partitionBy("type").orderBy(order_key(3, "event_id"), "event_id")
    b = tx.withColumn("rn", F.row_number().over(w))
    assert a.select("event_id", "rn").exceptAll(b.select("event_id", "rn")).count() == 0


def test_layout_invariance(spark):
    tx = tx_events(spark, SF_SMALL)
    ref = {(r["event_id"], r["silo_id"]) for r in dirichlet_partition(tx).collect()}
    for n in (1, 7):
        got = {(r["event_id"], r["silo_id"]) for r in dirichlet_partition(tx.repartition(n)).collect()}
        assert got == ref
    h1 = tx.select("event_id", hash01(42, "x", "event_id").alias("h")).collect()
    h7 = tx.repartition(7).select("event_id", hash01(42, "x", "event_id").alias("h")).collect()
    assert sorted(h1) == sorted(h7)


def test_flip_all_and_drift(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate([0, 0, 1, 1, 0])], "event_id long, isFraud int")
    assert [r["isFraud"] for r in inject_label_flip(df, 1.0).orderBy("event_id").collect()] == [1, 1, 0, 0, 1]
    d = spark.createDataFrame([(s, 100.0 * s) for s in range(1, 6)], "step int, amount double")
    assert [r["amount"] for r in inject_drift(d, 3, 2.0).orderBy("step").collect()] == [100, 200, 600, 800, 1000]


def test_amplify(spark):
    rows = [(1, 1, "PAYMENT", 10.0, "C1", 5.0, 4.0, "M1", 1.0, 2.0, 0, 0), (2, 2, "TRANSFER", 20.0, "C2", 6.0, 5.0, "M2", 3.0, 4.0, 1, 0)]
    schema = ("event_id BIGINT, step INT, type STRING, amount DOUBLE, nameOrig STRING, oldbalanceOrg DOUBLE, newbalanceOrig DOUBLE, "
              "nameDest STRING, oldbalanceDest DOUBLE, newbalanceDest DOUBLE, isFraud INT, isFlaggedFraud INT")
    a = amplify(spark.createDataFrame(rows, schema), 3).collect()
    assert len(a) == 6
    c0 = [r for r in a if r["copy"] == 0]
    assert sorted(r["amount"] for r in c0) == [10.0, 20.0]
    assert all(r["nameOrig"].endswith(f"_amp{r['copy']}") for r in a if r["copy"] > 0)
    assert sum(r["isFraud"] for r in a) == 3


def test_amplify_noise_statistics(spark):
    tx = tx_events(spark, SF_SMALL)
    a = amplify(tx, 5, 42, 0.1).alias("a").join(tx.alias("t"), "event_id").filter("a.copy > 0")
    rows = a.select(F.log(F.col("a.amount") / F.col("t.amount")).alias("la"),
                    F.log(F.col("a.newbalanceDest") / F.col("t.newbalanceDest")).alias("lb"),
                    (F.col("a.step") - F.col("t.step")).alias("off"), F.col("a.copy").alias("copy")).collect()
    la, lb = np.array([r["la"] for r in rows]), np.array([r["lb"] for r in rows])
    assert abs(la.mean()) < 0.01 and abs(la.std() - 0.1) < 0.01
    assert abs(np.corrcoef(la, lb)[0, 1]) < 0.1  # each column draws its own noise
    offs = {}
    for r in rows:
        offs.setdefault(r["copy"], set()).add(r["off"])
    assert all(len(v) == 1 and 1 <= next(iter(v)) < 100 for v in offs.values())  # one offset per copy


def test_type_mix_chi2_brute_force(spark):
    from silolake.plans.reports import type_mix_chi2
    rows = [(i, t, s) for i, (t, s) in enumerate(
        [("A", "s0")] * 30 + [("B", "s0")] * 5 + [("A", "s1")] * 10 + [("C", "s1")] * 20 + [("B", "s2")] * 7)]
    df = spark.createDataFrame(rows, "event_id long, type string, silo_id string")
    got = {r["silo_id"]: r["chi2"] for r in type_mix_chi2(df).collect()}
    types, silos = ["A", "B", "C"], ["s0", "s1", "s2"]
    o = np.array([[sum(1 for _, t, s in rows if t == ty and s == si) for ty in types] for si in silos], dtype=float)
    e = o.sum(axis=1, keepdims=True) * o.sum(axis=0, keepdims=True) / o.sum()
    exp = ((o - e) ** 2 / e).sum(axis=1)
    assert np.allclose([got[s] for s in silos], exp)


def test_label_flip_one_silo(spark):
    tx = dirichlet_partition(tx_events(spark, SF_SMALL))
    flipped = inject_label_flip(tx, 0.5, 42, silo="silo-1")
    j = flipped.alias("f").join(tx.alias("t"), "event_id").select(
        F.col("t.silo_id").alias("silo_id"), (F.col("f.isFraud") != F.col("t.isFraud")).cast("int").alias("flip"))
    rates = {r["silo_id"]: r["rate"] for r in j.groupBy("silo_id").agg(F.avg("flip").alias("rate")).collect()}
    assert 0.4 < rates["silo-1"] < 0.6
    assert all(v == 0 for k, v in rates.items() if k != "silo-1")


def test_rank_class_equals_ranks_and_shuffles_no_rows(spark, tmp_path):
    """Classes by rank, with ids that repeat or are null and a null label; rows of buckets without a cut stay where they are."""
    from pyspark.sql import functions as F

    from silolake.functions.rand import order_key
    from silolake.operators.partition import dirichlet_partition, distributed_rank, rank_class
    rows = [(i, "AB"[i % 2], float(i)) for i in range(3000)] + [(7, "B", 7.0), (7, "B", 7.0), (None, "A", 1.0), (5, None, 5.0)]
    spark.createDataFrame(rows, "event_id long, type string, amount double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cuts = [0, 40, 40, 1200]
    got = rank_class(df, ["type"], order_key(3, "event_id"), "event_id", lambda t: t.withColumn("_at", F.array(*[F.lit(c).cast("long") for c in cuts])), 4, "c")
    rank = distributed_rank(df, ["type"], order_key(3, "event_id"), "event_id")
    want = rank.withColumn("c", sum((F.lit(c) < F.col("rn")).cast("int") for c in cuts))
    assert got.columns == ["type", "event_id", "amount", "c"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    # only rows of the buckets with a cut reach a sort or an exchange that is not an aggregate or a broadcast
    split = dirichlet_partition(df, types=["A", "B"])
    assert split.filter("type is null").count() == 1 and split.count() == 3003
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan


def test_public_split_meets_features_without_a_join(spark, tmp_path):
    from silolake.operators.holdout import public_holdout, with_public_split
    once = [(i, "ABC"[i % 3], float(i)) for i in range(600)]
    for name, rows in {"once": once, "twice": once + once[:50]}.items():
        spark.createDataFrame(rows, "event_id long, type string, x double").write.parquet(str(tmp_path / name))
        tx = spark.read.parquet(str(tmp_path / name))
        got = with_public_split(tx, tx, 90)
        want = tx.join(public_holdout(tx, 90).select("event_id", "split"), "event_id")
        assert sorted(map(tuple, got.select("event_id", "type", "x", "split").collect())) == sorted(map(tuple, want.select("event_id", "type", "x", "split").collect()))
        if name == "once":
            assert got.filter("split = 'public'").count() == 90
            assert not any(w in got._jdf.queryExecution().executedPlan().toString() for w in ("SortMergeJoin", "ShuffledHashJoin"))


def test_public_rows_are_drawn_once_for_all_readers(spark, tmp_path):
    """Readers of the split rank nothing; rows without event_id or type are in neither part."""
    from silolake.operators.holdout import public_holdout, with_public_split
    rows = [(i if i else None, "ABC"[i % 3] if i % 50 else None) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, type string").write.parquet(str(tmp_path / "t"))
    tx = spark.read.parquet(str(tmp_path / "t"))
    got = with_public_split(tx, tx, 60)
    assert got.columns == ["event_id", "type", "split"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, public_holdout(tx, 60).select(*got.columns).collect()))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scale_up_deals_events_before_it_copies_them(spark, tmp_path):
    """One file of one row group: its copies are made by many tasks and not written; the summary is that of written copies."""
    import datetime as dt

    from silolake.operators import partition as P
    from silolake.plans import catalog as C
    from silolake.plans import pipeline as PL
    from silolake.session import cut_lineage
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), i % 9 if i % 8 else None, ["view", "click", "purchase", "error", None][i % 5],
             float(i * 31 % 400) if i % 11 else None) for i in range(300)]
    rows += rows[:20]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    ev.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = C.q_amplify_features_x10(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    copies = [c for c in plan.split("Generate explode(")[1:] if "RoundRobinPartitioning" in c.split("FileScan")[0]]
    assert copies and len(copies) == plan.count("Generate explode(")
    assert "silolake-copies" not in plan and "silolake-amplified" not in plan
    a = amplify(tx_events(spark, str(tmp_path)), 10, 42, 0.1)
    a = a.withColumn("event_id", F.col("event_id") * 16 + F.col("copy")).drop("copy")
    feat = PL.feature_columns(cut_lineage(P.dirichlet_partition(cut_lineage(a), types=list(C.P_TYPES()))))
    want = C.rounded(feat.groupBy("silo_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("velocity_24h_count").alias("avg_velocity_24h_count"),
        F.avg("velocity_168h_sum").alias("avg_velocity_168h_sum"), F.sum("in_degree_24h").alias("sum_in_degree_24h"),
        F.avg("log1p_amount").alias("avg_log1p_amount")), 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sum(r["n"] for r in got.collect()) == 10 * len(rows)


def test_replayed_copies_are_made_of_dealt_events(spark, tmp_path, monkeypatch):
    """The monitor's copies share that step."""
    import datetime as dt

    import pytest

    from silolake.plans import catalog as C
    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i), i, "view", 1.0) for i in range(9)],
                               "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    ev.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    def spy(tx, *_):
        seen.append(tx)
        raise KeyError("seen")
    monkeypatch.setattr(C.AMP, "amplify", spy)
    with pytest.raises(KeyError, match="seen"):
        C._stream_binned_by_silo(spark, str(tmp_path), copies=20)
    assert "RoundRobinPartitioning" in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].count() == 9
