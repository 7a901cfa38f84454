import numpy as np
import pandas as pd
import pytest

from silolake.functions import model as MLP
from silolake.functions.privacy import analytic_gaussian_epsilon, compose_epsilons
from silolake.plans.train import TrainConfig, train_mode_a, train_mode_b

SF_SMALL = "/root/testdata/sf0.001"


def test_gradient_check():
    rng = np.random.default_rng(0)
    sizes = [5, 4, 3, 1]
    # generic point: non-zero biases keep every ReLU off its kink, p stays away from the 1e-7 clip
    w = MLP.init_weights(sizes, 1) * 2 + rng.normal(0, 0.05, MLP.n_params(sizes))
    x, y = rng.normal(size=(20, 5)), (rng.random(20) < 0.4).astype(float)
    g, _ = MLP.grad_sums(x, y, w, sizes, pos_weight=3.0)
    h = 1e-6
    for i in rng.choice(len(w), 25, replace=False):
        e = np.zeros_like(w)
        e[i] = h
        num = (MLP.grad_sums(x, y, w + e, sizes, 3.0)[1] - MLP.grad_sums(x, y, w - e, sizes, 3.0)[1]) / (2 * h)
        assert abs(num - g[i]) <= 1e-5 * max(1.0, abs(num))


def _table(spark, n=400, f=6, silos=2):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, f))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.8).astype(float)
    pdf = pd.DataFrame({"event_id": np.arange(n), "silo_id": [f"silo-{i % silos}" for i in range(n)],
                        "features": [list(map(float, r)) for r in x], "label": y})
    return spark.createDataFrame(pdf, "event_id long, silo_id string, features array<double>, label double").repartition(4), x, y


def test_mode_a_equals_full_batch_gd(spark):
    df, x, y = _table(spark)
    cfg = TrainConfig(hidden=(4,), lr=0.1, momentum=0.9, prox_mu=0.01, pos_weight=2.0)
    sizes = MLP.layer_sizes(x.shape[1], [4])
    w0 = MLP.init_weights(sizes, 7)
    got = {r.silo_id: np.array(r.delta) for r in train_mode_a(df, w0, cfg, steps=3).itertuples()}
    for s in range(2):
        m = np.arange(len(x)) % 2 == s
        ref = MLP.gd_reference(x[m], y[m], w0, sizes, 3, 0.1, 0.9, 0.01, 2.0) - w0
        assert np.allclose(got[f"silo-{s}"], ref, atol=1e-6)


def test_mode_b_shapes_and_determinism(spark):
    df, x, _ = _table(spark)
    cfg = TrainConfig(hidden=(4,), batch_size=32, shard_rows=70)
    sizes = MLP.layer_sizes(x.shape[1], [4])
    w0 = MLP.init_weights(sizes)
    a = train_mode_b(df, w0, cfg)
    b = train_mode_b(df.repartition(3), w0, cfg)
    assert set(a["silo_id"]) == {"silo-0", "silo-1"} and all(len(d) == MLP.n_params(sizes) for d in a["delta"])
    assert (a["train_loss"] >= 0).all() and a["n_samples"].sum() == len(x)
    a, b = a.sort_values("silo_id"), b.sort_values("silo_id")
    assert all(np.allclose(p, q) for p, q in zip(a["delta"], b["delta"]))


def test_mlp_forward():
    sizes = MLP.layer_sizes(30)
    w = MLP.init_weights(sizes, 42)
    p = MLP.forward(np.random.default_rng(0).normal(size=(10, 30)), w, sizes)
    assert p.shape == (10,) and ((p > 0) & (p < 1)).all()
    assert np.array_equal(w, MLP.init_weights(sizes, 42))


def test_epsilon_values():
    got = [analytic_gaussian_epsilon(s, 1e-5) for s in (0.5, 0.8, 1.2)]
    assert np.allclose(got, [9.9973, 5.6796, 3.5487], atol=1e-4)
    assert compose_epsilons([1.0, 2.0], 1e-5) == (3.0, 2e-5)
    assert analytic_gaussian_epsilon(0.0, 1e-5) == float("inf")


def test_ledger_scales_the_noise_with_the_clip(spark):
    """The noise is sigma * C, so epsilon depends on sigma alone: literals of the analytic Gaussian mechanism."""
    from silolake.functions.privacy import analytic_gaussian_epsilon, with_round_epsilon

    rows = spark.createDataFrame([(0.8, 1e-5, c) for c in (0.5, 1.0, 2.0)], "sigma double, delta_dp double, clip double")
    got = [r["epsilon"] for r in with_round_epsilon(rows).collect()]
    assert all(abs(e - 5.68) < 0.01 for e in got)
    assert abs(analytic_gaussian_epsilon(1.6, 1e-5, 2.0) - got[0]) < 1e-8


def test_shards_are_resident(spark):
    """≥ 2 shards per silo, a bucket each, and no exchange of the training table in an epoch."""
    from silolake.plans.train import epoch_models, shard_layout

    df, x, _ = _table(spark, n=900, silos=3)
    df = df.unionByName(df.filter("silo_id = 'silo-1'").withColumn("event_id", df["event_id"] + 10_000))
    layout = shard_layout(df, TrainConfig(hidden=(4,), shards=9))
    assert layout.shards == {"silo-0": 2, "silo-1": 5, "silo-2": 2} and sum(n for n, _ in layout.silos.values()) == 1200
    per = layout.rows.groupBy("silo_id", "shard", "slot").count().collect()
    assert len(per) == 9 and len({r["slot"] for r in per}) == 9 and sum(r["count"] for r in per) == 1200
    assert len(layout.rows.inputFiles()) == 9  # a bucket is one file
    sizes = MLP.layer_sizes(x.shape[1], [4])
    state = spark.sparkContext.broadcast({s: dict.fromkeys(layout.silos, MLP.init_weights(sizes)) for s in "wg"} | {"pw": dict.fromkeys(layout.silos, 1.0)})
    models = epoch_models(layout.rows, state, sizes, TrainConfig(hidden=(4,)), 0, 0)
    assert len(models.collect()) == 9
    assert "Exchange" not in models._jdf.queryExecution().executedPlan().toString()


def test_mode_b_does_not_depend_on_the_input_layout(spark):
    df, x, _ = _table(spark)
    cfg = TrainConfig(hidden=(4,), batch_size=32, shards=6)
    w0 = MLP.init_weights(MLP.layer_sizes(x.shape[1], [4]))
    a, b = (train_mode_b(t, w0, cfg, epochs={"silo-0": 3}).sort_values("silo_id") for t in (df, df.repartition(7)))
    assert all(np.allclose(p, q) for p, q in zip(a["delta"], b["delta"]))


def test_shards_are_dealt_by_rows():
    from silolake.plans.train import deal_shards

    assert deal_shards({"a": 100}, 5) == {"a": 5}
    assert deal_shards({"a": 90, "b": 5, "c": 5}, 20) == {"a": 18, "b": 2, "c": 2}
    assert deal_shards({"a": 1, "b": 1, "c": 1}, 3) == {"a": 2, "b": 2, "c": 2}
    assert deal_shards({}, 4) == {}


def test_shard_rows_stay_packed():
    """A shard comes in batches, in any order, and takes the bytes of its floats, not of Python objects."""
    import tracemalloc

    import pyarrow as pa

    from silolake.plans.train import shard_rows
    n, f = 200_000, 22
    ids = np.random.default_rng(1).permutation(n)

    def batches():
        for at in range(0, n, 10_000):
            part = ids[at:at + 10_000]
            x = np.repeat(part.astype(np.float32)[:, None], f, axis=1)
            yield pa.RecordBatch.from_pydict({
                "silo_id": ["silo-1"] * len(part), "shard": pa.array([3] * len(part), pa.int32()), "event_id": pa.array(part, pa.int64()),
                "features": pa.ListArray.from_arrays(np.arange(0, x.size + 1, f, dtype=np.int32), x.ravel()),
                "label": pa.array((part % 2).astype(np.float32))})

    tracemalloc.start()
    silo, shard, x, y, order = shard_rows(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (silo, shard, x.dtype, x.shape) == ("silo-1", 3, np.float32, (n, f))
    assert (x[order][:, 5] == np.arange(n)).all() and (y[order] == np.arange(n) % 2).all()
    assert peak < 280 * n  # numpy's own count holds the arrays twice while they are gathered


def test_a_shard_is_read_whole_without_a_sort(spark):
    """However large files may be split or put together elsewhere: a shard is a partition, and nothing is sorted for it."""
    from pyspark.sql import functions as F

    from silolake.plans.train import epoch_models, shard_layout

    df, x, _ = _table(spark, n=900, silos=3)
    cfg = TrainConfig(hidden=(4,), shards=7)
    layout = shard_layout(df, cfg)
    per = layout.rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("slot").alias("slots"), F.count("*").alias("n")).collect()
    assert [r["slots"] for r in per] == [1] * 7 and sum(r["n"] for r in per) == 900
    assert sorted(map(tuple, layout.table.collect())) == sorted(map(tuple, layout.rows.collect()))
    sizes = MLP.layer_sizes(x.shape[1], [4])
    state = spark.sparkContext.broadcast({s: dict.fromkeys(layout.silos, MLP.init_weights(sizes)) for s in "wg"} | {"pw": dict.fromkeys(layout.silos, 1.0)})
    plan = epoch_models(layout.rows, state, sizes, cfg, 0, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    with pytest.raises(Exception, match="rows of several shards came together"):
        epoch_models(layout.rows.coalesce(1), state, sizes, cfg, 0, 0).collect()


def test_shards_are_whole_where_files_hold_several(spark, monkeypatch):
    """Rows dealt to another number of files than asked for, and files split or put together as the session likes."""
    from pyspark.sql import functions as F

    from silolake.plans.train import shard_layout

    df, x, _ = _table(spark, n=900, silos=3)
    cfg = TrainConfig(hidden=(4,), batch_size=32, shards=7)
    w0 = MLP.init_weights(MLP.layer_sizes(x.shape[1], [4]))
    want = train_mode_b(df, w0, cfg).sort_values("silo_id")
    real = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, n, *c: real(self, 3 if c else n, *c))
    layout = shard_layout(df, cfg)
    assert len(layout.rows.inputFiles()) <= 3
    per = layout.rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("slot").alias("slots"), F.count("*").alias("n")).collect()
    assert [r["slots"] for r in per] == [1] * 7 and sum(r["n"] for r in per) == 900
    got = train_mode_b(layout, w0, cfg).sort_values("silo_id")
    assert all(np.array_equal(p, q) for p, q in zip(want["delta"], got["delta"]))


def test_mode_b_writes_the_training_rows_once(spark, monkeypatch):
    """A training table that is a plan is not written but as shards, and a run that was stopped reads the shards again."""
    from silolake import session
    from silolake.plans import catalog as C
    from silolake.plans import train as TR

    written, laid = [], []
    real, layout = session.write_table, TR.shard_layout
    monkeypatch.setattr(session, "write_table", lambda df, name="table": (written.append((name, df.columns, df.count())), real(df, name))[1])
    for m in (TR, C.FED):
        monkeypatch.setattr(m, "shard_layout", lambda t, c: (laid.append(1), layout(t, c))[1])
    assert C.q_federated_fit_resumed(spark, SF_SMALL).count() == 2
    assert len(laid) == 1
    assert not [n for name, cols, n in written if "features" in cols and n > 2000] and not any(name == "silo_tx" for name, _, _ in written)
