"""Federated training as a run of rounds over round-invariant tables, which can be stopped and continued.

Per round: silos with a drift alert get more local epochs → every silo trains
(one job per epoch, all silos together) → optional poisoning / DP release →
the updates are stored with their arrival times → the round's update set is
assembled by ``round_updates`` (quorum, one deadline extension, late updates of
the round before decayed by λ) → aggregation (FedAvg, trimmed mean or QWRA with
validation quality) → a new model version → evaluation → metrics. All of it
goes to a :class:`~silolake.plans.runs.RunStore`, the round's commit last;
everything random is keyed by seed, round and silo, so a run that continues
after a stop ends as one that was never stopped. Only weights (silos ×
parameters) and metrics cross the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolake.functions import model as MLP
from silolake.functions.privacy import analytic_gaussian_epsilon
from silolake.operators import drift as DR
from silolake.operators import inject as INJ
from silolake.operators import metrics as M
from silolake.operators import rounds as RD
from silolake.operators import updates as U
from silolake.plans.runs import RunStore
from silolake.plans.train import ShardLayout, TrainConfig, score_column, shard_layout, silo_sizes, train_mode_a, train_mode_b
from silolake.schemas import DRIFT_ALERTS, MODELS, RESULTS, SILO_METRICS
from silolake.session import checkpoint_dir, ship_package

QUALITY_FLOOR = 1e-4


@dataclass
class FedConfig:
    rounds: int = 3
    agg: str = "qwra"  # fedavg | trimmed_mean | qwra
    mode: str = "B"
    size_exp: float = 0.5
    server_lr: float = 1.0
    cos_tau: float = 0.0
    trim_frac: float = 0.2
    clip: float | None = None
    sigma: float | None = None
    delta_dp: float = 1e-5
    poison_silo: str | None = None
    gamma: float = 0.0
    experiment: str = "run"
    alpha: float = 0.5
    quorum_frac: float = 0.6
    staleness_lambda: float = 0.5
    round_deadline_s: int = 120
    flip_silo: str | None = None  # label flip: this silo trains on flipped labels
    flip_frac: float = 0.0
    drift_round: int | None = None  # from this round on silos train on the drifted table
    drift_factor: float = 1.5  # local epochs after an alert
    drift_features: tuple[int, ...] = ()  # places in the feature vector that are watched; all where empty
    silo_eval: bool = False  # AUC of the new model on each silo's own rows
    train: TrainConfig = field(default_factory=TrainConfig)


RUN_START = "2024-01-01 00:00:00"


def _calendar(spark: SparkSession, first: int, last: int, deadline_s: int) -> DataFrame:
    """Rounds ``first`` to ``last``: one starts where the extension of the one before ends."""
    base = F.unix_seconds(F.lit(RUN_START).cast("timestamp"))
    start = base + F.col("id") * (deadline_s + (deadline_s + 1) // 2)
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("round"), F.timestamp_seconds(start).alias("start_ts"),
                                               F.timestamp_seconds(start + deadline_s).alias("deadline"))


def _updates_df(spark: SparkSession, pdf: pd.DataFrame, round_: int) -> DataFrame:
    rows = spark.createDataFrame(pdf[["silo_id", "delta", "n_samples", "train_loss"]],
                                 "silo_id string, delta array<double>, n_samples long, train_loss double")
    return rows.withColumn("round", F.lit(round_))


def drift_psi(reference: DataFrame, current: DataFrame, places: tuple[int, ...] = ()) -> DataFrame:
    """(silo_id, feature, psi) of chosen places of the feature vector."""
    def long(rows: DataFrame) -> DataFrame:
        if places:  # only these become rows; a place behind the end of a vector is none
            here = F.array(*[F.struct(F.lit(p).alias("place"), F.get("features", F.lit(p)).alias("v")) for p in sorted(set(places))])
            x = rows.select("silo_id", F.size("features").alias("_n"), F.explode(here).alias("_x")).filter("_x.place < _n").select("silo_id", "_x.*")
        else:
            x = rows.select("silo_id", F.posexplode("features").alias("place", "v"))
        return x.select("silo_id", F.concat(F.lit("f"), F.col("place").cast("string")).alias("feature"), F.col("v").cast("double").alias("value"))

    return DR.psi(long(reference), long(current), "value", ["silo_id", "feature"], [])


def candidates_x_validation(val: DataFrame, base: np.ndarray, deltas: dict[str, np.ndarray], sizes: list[int]) -> DataFrame:
    """(label, scores): every validation row once, with the scores of the base model and of each base + dᵢ, in the order
    of :func:`candidate_names`.

    Candidates (≤ silos + 1 vectors) are broadcast; validation is streamed in Arrow batches and features are read once for
    all of them.
    """
    ship_package(val.sparkSession)
    bc = val.sparkSession.sparkContext.broadcast([base, *[base + deltas[s] for s in candidate_names(deltas)[1:]]])

    def part(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
            scores = np.stack([MLP.forward(x, w, sizes) for w in bc.value], 1)
            yield pd.DataFrame({"label": pdf["label"].to_numpy(dtype=np.float64), "scores": list(scores)})

    return val.select("features", "label").mapInPandas(part, "label double, scores array<double>")


def candidate_names(deltas: dict[str, np.ndarray]) -> list[str]:
    return ["__base__", *sorted(deltas)]


def by_candidate(scored: DataFrame, deltas: dict[str, np.ndarray]) -> DataFrame:
    """(candidate, score, label) of the rows of :func:`candidates_x_validation`."""
    names = F.array(*[F.lit(n) for n in candidate_names(deltas)])
    return scored.select("label", F.posexplode("scores").alias("_i", "score")) \
        .select(names[F.col("_i")].alias("candidate"), "score", "label")


def qwra_quality(val: DataFrame, base: np.ndarray, deltas: dict[str, np.ndarray], sizes: list[int], round_: int) -> DataFrame:
    """q = max(AP(w + dᵢ) − AP(w), 0) + 1e-4 per silo."""
    scored = candidates_x_validation(val, base, deltas, sizes).persist()  # the curve reads the scores more than once
    ap = M.auc_pr(by_candidate(scored, deltas), ["candidate"])
    rows = {r["candidate"]: (r["auc_pr"] or 0.0) for r in ap.collect()}
    scored.unpersist()
    b = rows.get("__base__", 0.0)
    q = [(round_, s, max(rows.get(s, 0.0) - b, 0.0) + QUALITY_FLOOR) for s in deltas]
    return val.sparkSession.createDataFrame(q, "round int, silo_id string, q double")


def evaluate(val: DataFrame, weights: np.ndarray, sizes: list[int]) -> dict:
    s = val.select(score_column(F.col("features"), weights, sizes).alias("score"), "label")
    r = M.classification_report(s).first()
    return {"auc_roc": r["auc_roc"], "auc_pr": r["auc_pr"], "recall_at_fpr": r["recall_at_fpr"]}


def _aggregate(long: DataFrame, updates: DataFrame, val: DataFrame | None, w: np.ndarray, sizes: list[int], cfg: FedConfig,
               round_: int) -> tuple[DataFrame, DataFrame | None]:
    if cfg.agg == "fedavg":
        return U.fedavg(long, cfg.size_exp, cfg.server_lr), None
    if cfg.agg == "trimmed_mean":
        return U.trimmed_mean(long, cfg.trim_frac, cfg.server_lr), None
    quality = None
    if val is not None:
        deltas = {row["ukey"]: np.array(row["delta"]) for row in updates.collect()}
        quality = qwra_quality(val, w, deltas, sizes, round_)
    return U.qwra(long, quality, cfg.cos_tau, cfg.size_exp, cfg.server_lr, trim_frac=cfg.trim_frac)


def silo_auc(table: DataFrame, weights: np.ndarray, sizes: list[int]) -> dict[str, tuple]:
    """silo → (AUC-ROC, AP) of the model on each silo's own rows."""
    s = table.select("silo_id", score_column(F.col("features"), weights, sizes).alias("score"), "label")
    return {r["silo_id"]: (r["auc_roc"], r["auc_pr"]) for r in M.classification_report(s, ["silo_id"]).collect()}


def federated_fit(train: DataFrame | ShardLayout, val: DataFrame | None, cfg: FedConfig, w0: np.ndarray | None = None,
                  epochs: dict[str, int] | None = None, store: RunStore | None = None, delays: DataFrame | None = None,
                  drifted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Returns (results, silo_metrics, final weights). ``val`` should be persisted by the caller.

    In mode B ``train`` and ``drifted`` are written once, by shard, and read from there, so they may be plans; a
    :func:`shard_layout` that the caller keeps for several runs is read as it is. In mode A they should be persisted too.
    ``store`` names the run: one that has whole rounds is continued behind them
    (without it the run is new). ``delays`` (round, silo_id, delay_s) makes
    updates arrive late; without it all are in time. From ``cfg.drift_round`` on
    the silos train on ``drifted``, whose alerts raise the epochs of the round
    after. A round without a quorum leaves the model as it is.
    """
    if cfg.sigma and not cfg.clip:
        raise ValueError("noise needs a clip norm: without one nothing is released through the mechanism")
    kept = train if isinstance(train, ShardLayout) else None
    train = kept.table if kept else train
    spark = train.sparkSession
    store = store or RunStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/silolake-run-{uuid.uuid4().hex}", cfg.experiment)
    n_features = len(train.select("features").first()[0])
    sizes = MLP.layer_sizes(n_features, list(cfg.train.hidden))
    if cfg.flip_silo and cfg.flip_frac:
        kept = None
        train = INJ.inject_label_flip(train, cfg.flip_frac, cfg.train.seed, "label", cfg.flip_silo)
        drifted = None if drifted is None else INJ.inject_label_flip(drifted, cfg.flip_frac, cfg.train.seed, "label", cfg.flip_silo)
    eps_round = (analytic_gaussian_epsilon(cfg.sigma, cfg.delta_dp, 1.0) if cfg.sigma else None)
    last = store.last_round()
    if last is None:
        w = MLP.init_weights(sizes, cfg.train.seed) if w0 is None else np.asarray(w0)
        store.put("models", 0, spark.createDataFrame([(1, 0, [float(x) for x in w], {"source": "initial"})], MODELS))
        store.commit(0, 1, 0)
        last = 0
    else:
        w = np.array(store.read("models").filter(F.col("round") == last).first()["weights"])
    inputs: dict[bool, DataFrame | ShardLayout] = {}
    if kept and cfg.mode == "B":
        inputs[False] = kept

    def table(moved: bool) -> DataFrame | ShardLayout:
        if moved not in inputs:
            rows = drifted if moved else train
            inputs[moved] = shard_layout(rows, cfg.train) if cfg.mode == "B" else rows
        return inputs[moved]

    def rows_of(moved: bool) -> DataFrame:
        t = table(moved)
        return t.table if isinstance(t, ShardLayout) else t

    if last < cfg.rounds:
        silos = sorted(table(False).silos if cfg.mode == "B" else silo_sizes(train))
        registered = spark.createDataFrame([(s,) for s in silos], "silo_id string")
    found: DataFrame | None = None  # the tables that drift is measured between do not change from round to round

    def on_drifted(r: int) -> bool:
        return drifted is not None and cfg.drift_round is not None and r >= cfg.drift_round

    for r in range(last + 1, cfg.rounds + 1):
        moved = on_drifted(r)
        more = dict(epochs or {})
        if on_drifted(r - 1):  # alerts of the round before
            alerts = store.recent("drift_alerts", r - 1, r - 1)
            rows = RD.join_drift_epochs(registered, alerts, cfg.train.local_epochs, cfg.drift_factor)
            more |= {x["silo_id"]: max(x["local_epochs"], more.get(x["silo_id"], 0)) for x in rows.collect()}
        local = train_mode_b(table(moved), w, cfg.train, r, more) if cfg.mode == "B" else train_mode_a(table(moved), w, cfg.train)
        upd = _updates_df(spark, local, r)
        if cfg.poison_silo and cfg.gamma:
            upd = INJ.inject_model_poison(upd, cfg.poison_silo, cfg.gamma)
        if cfg.clip:
            upd = U.dp_release(upd, cfg.clip, cfg.sigma, cfg.train.seed, cfg.experiment)
        cal = _calendar(spark, r - 1, r, cfg.round_deadline_s)
        late = F.lit(1.0) if delays is None else F.coalesce("delay_s", F.lit(1.0))
        if delays is not None:
            upd = upd.join(delays.filter(F.col("round") == r).select("silo_id", F.col("delay_s").cast("double").alias("delay_s")), "silo_id", "left")
        upd = upd.join(cal.select("round", "start_ts"), "round")
        store.put("updates", r, upd.select("round", "silo_id", F.lit(r).alias("base_version"), "delta", "n_samples", "train_loss",
                                           late.alias("wall_time_s"), F.timestamp_micros(F.unix_micros("start_ts") + (late * 1_000_000).cast("long"))
                                           .alias("arrived_at")))
        got = RD.round_updates(store.recent("updates", r - 1, r), cal, registered, cfg.quorum_frac, cfg.staleness_lambda)
        got = U.staleness_decay(got.filter(F.col("agg_round") == r), cfg.staleness_lambda)
        got = got.select(F.col("agg_round").alias("round"), F.concat("silo_id", F.lit("@"), F.col("src_round").cast("string")).alias("ukey"),
                         "silo_id", "delta", "n_samples", "train_loss", "staleness").persist()
        n_updates = got.count()
        flagged: dict[str, bool] = {}
        if n_updates:
            long = U.to_long(got.select("round", F.col("ukey").alias("silo_id"), "delta", "n_samples")).persist()
            agg, flags = _aggregate(long, got, val, w, sizes, cfg, r)
            w = w + np.array([x["v"] for x in agg.orderBy("pos").select("v").collect()])
            flagged = {} if flags is None else {x["silo_id"]: bool(x["rejected"]) for x in flags.collect()}
            long.unpersist()
        per_silo = got.select("ukey", "silo_id", "n_samples", "train_loss", "staleness").collect()
        got.unpersist()
        psi: dict[str, float] = {}
        alerts = spark.createDataFrame([], DRIFT_ALERTS)
        if moved:
            if found is None:
                found = drift_psi(rows_of(False), rows_of(True), cfg.drift_features).persist()
            psi = {x["silo_id"]: x["psi"] for x in found.groupBy("silo_id").agg(F.max("psi").alias("psi")).collect()}
            alerts = DR.drift_alerts(found).select(F.lit(r).alias("round"), "silo_id", "psi", "feature", F.lit(RUN_START).cast("timestamp").alias("ts"))
        store.put("drift_alerts", r, alerts)
        auc = silo_auc(rows_of(moved), w, sizes) if cfg.silo_eval else {}
        ev = evaluate(val, w, sizes) if val is not None else {"auc_roc": None, "auc_pr": None}
        loss = float(np.mean([x["train_loss"] for x in per_silo])) if per_silo else None
        store.put("models", r, spark.createDataFrame([(r + 1, r, [float(x) for x in w], {"source": cfg.agg})], MODELS))
        store.put("results", r, spark.createDataFrame([(cfg.experiment, r, ev["auc_roc"], ev["auc_pr"], n_updates, loss, cfg.agg,
                                                        cfg.train.seed, cfg.alpha)], RESULTS))
        rows = [(r, x["silo_id"], x["n_samples"], x["train_loss"], *auc.get(x["silo_id"], (None, None)), x["staleness"],
                 int(flagged.get(x["ukey"], False)), eps_round, psi.get(x["silo_id"])) for x in sorted(per_silo, key=lambda x: x["ukey"])]
        store.put("silo_metrics", r, spark.createDataFrame(rows, SILO_METRICS))
        store.commit(r, r + 1, n_updates)
    if found is not None:
        found.unpersist()
    return store.read("results"), store.read("silo_metrics"), w


def centralized_fit(train: DataFrame, val: DataFrame | None, cfg: FedConfig) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Pooled baseline: the same trainer with one silo holding every row."""
    return federated_fit(train.withColumn("silo_id", F.lit("pooled")), val,
                         replace(cfg, agg="fedavg", experiment=cfg.experiment + "-central"))


def local_only_fit(train: DataFrame, val: DataFrame | None, cfg: FedConfig) -> dict[str, dict]:
    """Each silo alone (no aggregation): validation metrics per silo."""
    layout = shard_layout(train, cfg.train)
    n_features = len(layout.table.select("features").first()[0])
    sizes = MLP.layer_sizes(n_features, list(cfg.train.hidden))
    w = MLP.init_weights(sizes, cfg.train.seed)
    ws = {s: w.copy() for s in layout.silos}
    for r in range(1, cfg.rounds + 1):
        local = train_mode_b(layout, ws, cfg.train, r)
        for row in local.itertuples():
            ws[row.silo_id] = ws[row.silo_id] + np.array(row.delta)
    return {s: evaluate(val, ws[s], sizes) for s in ws} if val is not None else {}
