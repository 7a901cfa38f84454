"""The federated run: stopping and continuing, late updates, drift response, poisoning, quality."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from silolake.functions import model as MLP
from silolake.plans import federate as FED
from silolake.plans.runs import RunStore
from silolake.plans.train import TrainConfig

TRAIN = TrainConfig(hidden=(4,), batch_size=32, shards=6, lr=0.1, local_epochs=2, pos_weight=2.0)


def make(spark, n=600, silos=3, seed=3, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) > 0.6).astype(float)
    pdf = pd.DataFrame({"event_id": np.arange(n), "silo_id": [f"silo-{i % silos}" for i in range(n)],
                        "features": [list(map(float, r + [shift, 0, 0, 0, 0])) for r in x], "label": y})
    return spark.createDataFrame(pdf, "event_id long, silo_id string, features array<double>, label double").repartition(3).cache()


@pytest.fixture(scope="module")
def tables(spark):
    return make(spark), make(spark, n=300, seed=9)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_stopped_run_continues_as_if_unbroken(spark, tables, tmp_path, monkeypatch):
    train, val = tables
    cfg = FED.FedConfig(rounds=4, agg="qwra", clip=1.0, sigma=0.3, train=TRAIN, experiment="x")
    delays = spark.createDataFrame([(2, "silo-1", 200.0), (3, "silo-2", 150.0)], "round int, silo_id string, delay_s double")
    whole = FED.federated_fit(train, val, cfg, store=RunStore(spark, str(tmp_path / "a"), "r"), delays=delays)
    store = RunStore(spark, str(tmp_path / "b"), "r")
    real, calls = FED.evaluate, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 3:  # in round 3, after its updates were written
            raise RuntimeError("stopped")
        return real(*args)

    monkeypatch.setattr(FED, "evaluate", breaks)
    with pytest.raises(RuntimeError, match="stopped"):
        FED.federated_fit(train, val, cfg, store=store, delays=delays)
    assert store.last_round() == 2 and store.read("results").count() == 2 and store.recent("updates", 3, 3).count() == 3
    monkeypatch.setattr(FED, "evaluate", real)
    again = FED.federated_fit(train, val, cfg, store=store, delays=delays)
    assert rows(whole[0]) == rows(again[0]) and rows(whole[1]) == rows(again[1]) and np.array_equal(whole[2], again[2])
    assert [r["version"] for r in store.read("models").orderBy("round").collect()] == [1, 2, 3, 4, 5]
    # nothing is left to do: the finished run is read, not run again
    monkeypatch.setattr(FED, "train_mode_b", None)
    assert np.array_equal(FED.federated_fit(train, val, cfg, store=store)[2], whole[2])


def test_late_update_is_decayed_into_the_next_round(spark, tables):
    train, _ = tables
    cfg = FED.FedConfig(rounds=2, agg="fedavg", size_exp=0.0, train=TRAIN)
    delays = spark.createDataFrame([(1, "silo-0", 130.0)], "round int, silo_id string, delay_s double")
    store = RunStore(spark, FED.checkpoint_dir(spark) + "/late", "r")
    _, metrics, w = FED.federated_fit(train, None, cfg, store=store, delays=delays)
    got = sorted((r["round"], r["silo_id"], r["staleness"]) for r in metrics.collect())
    assert got == [(1, "silo-1", 0), (1, "silo-2", 0), (2, "silo-0", 0), (2, "silo-0", 1), (2, "silo-1", 0), (2, "silo-2", 0)]
    upd = {(r["round"], r["silo_id"]): np.array(r["delta"]) for r in store.read("updates").collect()}
    models = {r["round"]: np.array(r["weights"]) for r in store.read("models").collect()}
    one = (upd[1, "silo-1"] + upd[1, "silo-2"]) / 2
    two = (upd[2, "silo-0"] + upd[2, "silo-1"] + upd[2, "silo-2"] + 0.5 * upd[1, "silo-0"]) / 4
    assert np.allclose(models[1], models[0] + one) and np.allclose(models[2], models[1] + two) and np.array_equal(models[2], w)


def test_a_round_without_quorum_leaves_the_model(spark, tables):
    train, val = tables
    delays = spark.createDataFrame([(1, s, 1000.0) for s in ("silo-0", "silo-1")], "round int, silo_id string, delay_s double")
    results, metrics, w = FED.federated_fit(train, val, FED.FedConfig(rounds=1, agg="fedavg", train=TRAIN), delays=delays)
    assert results.first()["n_updates"] == 0 and metrics.count() == 0
    assert np.array_equal(w, MLP.init_weights(MLP.layer_sizes(5, [4]), TRAIN.seed))


def test_alert_raises_the_epochs_of_the_round_after(spark, tables, monkeypatch):
    train, val = tables
    seen = []
    real = FED.train_mode_b
    monkeypatch.setattr(FED, "train_mode_b", lambda t, w, c, r, e: (seen.append((r, dict(e))), real(t, w, c, r, e))[1])
    cfg = FED.FedConfig(rounds=3, agg="fedavg", train=TRAIN, drift_round=2, drift_features=(0,))
    _, metrics, _ = FED.federated_fit(train, val, cfg, drifted=make(spark, shift=3.0))
    assert seen == [(1, {}), (2, {}), (3, {f"silo-{i}": 3 for i in range(3)})]
    psi = {r["round"]: r["psi"] for r in metrics.collect()}
    assert psi[1] is None and psi[2] > 0.2 and psi[3] > 0.2


def test_drift_is_measured_once_and_over_the_watched_places_only(spark, tables, monkeypatch):
    """Later rounds see the same two tables, so they take the first one's answer; unwatched places do not become rows."""
    train, val = tables
    shifted, calls = make(spark, shift=3.0), []
    every = {(r["silo_id"], r["feature"]): r["psi"] for r in FED.drift_psi(train, shifted).collect()}
    some = {(r["silo_id"], r["feature"]): r["psi"] for r in FED.drift_psi(train, shifted, (3, 0, 99)).collect()}
    assert some == {k: v for k, v in every.items() if k[1] in ("f0", "f3")} and len(some) == 6
    real = FED.drift_psi
    monkeypatch.setattr(FED, "drift_psi", lambda *a: (calls.append(1), real(*a))[1])
    cfg = FED.FedConfig(rounds=3, agg="fedavg", train=TRAIN, drift_round=2, drift_features=(0,))
    _, metrics, _ = FED.federated_fit(train, val, cfg, drifted=shifted)
    psi = {(r["round"], r["silo_id"]): r["psi"] for r in metrics.collect()}
    assert len(calls) == 1 and all(psi[2, s] == psi[3, s] == every[s, "f0"] for s in ("silo-0", "silo-1", "silo-2"))


def test_the_drifted_table_is_written_as_shards_only(spark, monkeypatch):
    from silolake.plans import scenarios as SC
    written = []
    real = SC.cut_lineage
    monkeypatch.setattr(SC, "cut_lineage", lambda df, *a: (written.append((df.columns, df.count())), real(df, *a))[1])
    train, val, drifted = SC.scenario_tables(spark, "/root/testdata/sf0.001", SC.SCENARIOS["E4"], public_rows=500)
    assert max(n for _, n in written) <= 500
    a, b = ({r["event_id"]: r for r in t.collect()} for t in (train, drifted))
    assert set(a) == set(b) and len(a) == 6000 - 500 and val.count() == 500
    assert any(a[k]["features"] != b[k]["features"] for k in a) and all(a[k]["silo_id"] == b[k]["silo_id"] and a[k]["label"] == b[k]["label"] for k in a)


def test_label_flip_reaches_one_silo_only(spark, tables):
    train, _ = tables
    cfg = FED.FedConfig(rounds=1, agg="fedavg", train=TRAIN)
    runs = {}
    for frac in (0.0, 1.0):
        store = RunStore(spark, FED.checkpoint_dir(spark) + f"/flip{frac}", "r")
        FED.federated_fit(train, None, replace(cfg, flip_silo="silo-1", flip_frac=frac), store=store)
        runs[frac] = {r["silo_id"]: r["delta"] for r in store.read("updates").collect()}
    assert [runs[0.0][s] == runs[1.0][s] for s in ("silo-0", "silo-1", "silo-2")] == [True, False, True]


def test_poisoned_silo_is_flagged_and_qwra_beats_fedavg(spark):
    train, val = make(spark, n=1000, silos=5), make(spark, n=300, seed=9)
    cfg = FED.FedConfig(rounds=4, train=TRAIN, poison_silo="silo-1", gamma=5.0)
    out = {agg: FED.federated_fit(train, val, replace(cfg, agg=agg, experiment=agg)) for agg in ("qwra", "fedavg")}
    flags = out["qwra"][1].collect()
    assert np.mean([r["flagged"] for r in flags if r["silo_id"] == "silo-1"]) >= 0.7
    final = {a: o[0].filter("round = 4").first()["auc_pr"] for a, o in out.items()}
    assert final["qwra"] >= final["fedavg"] + 0.03


def test_federated_reaches_the_pooled_baseline(spark, tables):
    train, val = tables
    cfg = FED.FedConfig(rounds=6, agg="fedavg", train=TRAIN, silo_eval=True)
    results, metrics, _ = FED.federated_fit(train, val, cfg)
    auc = {r["round"]: r["auc_pr"] for r in results.collect()}
    pooled = FED.centralized_fit(train, val, cfg)[0].filter("round = 6").first()["auc_pr"]
    assert auc[6] > auc[1] and auc[6] >= 0.9 * pooled
    local = FED.local_only_fit(train, val, replace(cfg, rounds=1))
    assert set(local) == {"silo-0", "silo-1", "silo-2"} and all(0 < m["auc_pr"] <= 1 for m in local.values())
    assert all(r["auc_roc"] > 0.5 for r in metrics.filter("round = 6").collect())


def plain_ap(score, label):
    """Average precision over distinct scores, highest first."""
    total, ap, seen, hits = label.sum(), 0.0, 0, 0.0
    for s in sorted(set(score), reverse=True):
        m = score == s
        seen += m.sum()
        hits += label[m].sum()
        ap += label[m].sum() / total * hits / seen
    return ap


def test_quality_is_the_gain_in_average_precision(spark, tables):
    _, val = tables
    sizes = MLP.layer_sizes(5, [4])
    rng = np.random.default_rng(1)
    base = MLP.init_weights(sizes, 1)
    deltas = {f"silo-{i}": rng.normal(0, 0.3, len(base)) for i in range(3)}
    pdf = val.select("features", "label").toPandas()
    x, y = np.stack(pdf["features"].to_numpy()), pdf["label"].to_numpy()
    plain = {s: plain_ap(MLP.forward(x, base + d, sizes), y) for s, d in {**deltas, "base": 0 * base}.items()}
    for r in FED.qwra_quality(val, base, deltas, sizes, 2).collect():
        assert abs(r["q"] - (max(plain[r["silo_id"]] - plain["base"], 0) + FED.QUALITY_FLOOR)) < 1e-9
    ev = FED.evaluate(val, base, sizes)
    assert abs(ev["auc_pr"] - plain["base"]) < 1e-9
