"""Distributed local training of every silo at once.

Mode A — exact synchronous full-batch gradient descent: each step one job;
every partition returns per-silo gradient sums (``mapInArrow``), a grouped
aggregate over (silo, position) adds them (partial + final = a tree
aggregate), the driver applies momentum to silos × parameters numbers.

Mode B — shard-local SGD with per-epoch averaging. The training table is laid
out by shard once (``shard_layout``): an explicit number of shards is dealt to
the silos by their rows, so a hot silo gets more shards, not bigger ones; rows
get a seeded shard, and each shard is one file, read as one partition. Every
epoch of every round reads it without an exchange or a sort:
``mapInArrow`` runs one SGD epoch per shard from the broadcast weights, on rows
that come in batches and stay packed floats (some 130 bytes a row), and shard models are averaged by shard size per coordinate.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silolake.functions import model as MLP
from silolake.session import checkpoint_dir, ship_package


@dataclass
class TrainConfig:
    hidden: tuple[int, ...] = (64, 32)
    local_epochs: int = 2
    batch_size: int = 4096
    lr: float = 0.05
    momentum: float = 0.9
    prox_mu: float = 0.01
    pos_weight: float | str = "auto"
    shards: int = 16  # of all silos together; at least 2 each
    shard_rows: int | None = None  # where given: shards of at most this many rows instead
    seed: int = 42


def shard_rows(batches: Iterator[pa.RecordBatch]) -> tuple[str, int, np.ndarray, np.ndarray, np.ndarray]:
    """Silo, shard, features, labels and the order by event_id (null last) of one shard that comes in Arrow batches.

    Features stay the floats that they are stored as, in one array: each batch is let go as it is copied there. Without
    rows the arrays are empty.
    """
    silo, shard, xs, ys, ids = "", 0, [], [], []
    for b in batches:
        if not b.num_rows:
            continue
        of = [b.column(c).unique().to_pylist() for c in ("silo_id", "shard")]
        if [len(x) for x in of] != [1, 1] or xs and of != [[silo], [shard]]:
            raise RuntimeError(f"rows of several shards came together: {of}")
        (silo,), (shard,) = of
        xs.append(b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy())
        ys.append(b.column("label").to_numpy(zero_copy_only=False).copy())
        ids.append(b.column("event_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).copy())
        del b
    if not xs:
        return silo, shard, np.empty((0, 0)), np.empty(0), np.empty(0, dtype=np.int64)
    order = np.argsort(np.concatenate(ids), kind="stable")  # the seeded shuffle must not depend on arrival order
    ids.clear()
    x, at = np.empty((len(order), xs[0].shape[1]), xs[0].dtype), 0
    for i, part in enumerate(xs):
        x[at:at + len(part)] = part
        at += len(part)
        xs[i] = None
    return silo, shard, x, np.concatenate(ys), order


def silo_sizes(table: DataFrame) -> dict[str, tuple[int, int]]:
    """silo → (rows, positives): one small aggregate."""
    rows = table.groupBy("silo_id").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum((F.col("label") > 0.5).cast("long")).alias("pos")).collect()
    return {r["silo_id"]: (int(r["n"]), int(r["pos"] or 0)) for r in rows}


def pos_weights(sizes: dict[str, tuple[int, int]], cfg: TrainConfig) -> dict[str, float]:
    if cfg.pos_weight != "auto":
        return {s: float(cfg.pos_weight) for s in sizes}
    return {s: (n - p) / max(p, 1) for s, (n, p) in sizes.items()}


@dataclass(frozen=True)
class ShardLayout:
    #: silo_id, shard, slot, event_id, features, label; a file and a partition per shard
    rows: DataFrame
    #: the same files, read in partitions of the usual size
    table: DataFrame
    #: silo → (rows, positives)
    silos: dict[str, tuple[int, int]]
    #: silo → shards
    shards: dict[str, int]


def deal_shards(sizes: dict[str, int], total: int) -> dict[str, int]:
    """``total`` shards dealt to the silos by their rows (largest remainders); at least 2 each, so small silos may add to the total."""
    rows = sum(sizes.values())
    share = {s: total * n / max(rows, 1) for s, n in sizes.items()}
    out = {s: max(2, int(x)) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s)):
        if sum(out.values()) >= total:
            break
        out[s] += share[s] >= 2
    return out


def _partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each partition of a table dealt to ``n`` by an integer column, a number that falls into it."""
    upto = 4 * n
    while True:
        ids = spark.range(upto).select(F.col("id").cast("int").alias("id"))
        rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("b")).agg(F.min("id").alias("id")).collect()  # n rows at most
        if len(rows) == n:
            return [r["id"] for r in sorted(rows, key=lambda r: r["b"])]
        upto *= 2


def _by_shard(spark: SparkSession, path: str, schema: T.StructType, slots: list[int]) -> DataFrame:
    """A Parquet table with a partition per slot, whatever its files are: where a file holds one slot, the others' are skipped by
    their statistics. The plan has a branch per slot.

    Rows without a slot, which there are none of, are in at most two more partitions: a union of single partitions alone would
    be put together to one.
    """
    rows = spark.read.schema(schema).parquet(path)
    return reduce(DataFrame.unionAll, [rows.filter(F.col("slot").isNull()).coalesce(2), *[rows.filter(F.col("slot") == k).coalesce(1) for k in slots]])


def shard_layout(table: DataFrame, cfg: TrainConfig) -> ShardLayout:
    """``table`` (event_id, silo_id, features, label) written once by shard in the shared folder.

    A task trains a whole shard, so choose ``cfg.shards`` for a shard to fit in a worker. The split depends on the seed and
    the silos' shares only, not on the layout of ``table``. Rows are shuffled once and go from there into their shard's
    file: they are not sorted, neither here nor where they are read.
    """
    import uuid

    spark = table.sparkSession
    silos = silo_sizes(table)
    shards = deal_shards({s: n for s, (n, _) in silos.items()}, cfg.shards) if cfg.shard_rows is None else \
        {s: max(1, math.ceil(n / cfg.shard_rows)) for s, (n, _) in silos.items()}
    path = f"{checkpoint_dir(spark).rstrip('/')}/silolake-shards-{uuid.uuid4().hex}"
    total = max(1, sum(shards.values()))
    numbers = _partition_keys(spark, total)
    keys = iter(numbers)
    slots = F.create_map(*[x for s in sorted(shards) for x in (F.lit(s), F.array(*[F.lit(next(keys)) for _ in range(shards[s])]))]) \
        if shards else F.create_map(F.lit(""), F.array(F.lit(0)))
    of_silo = slots[F.col("silo_id")]
    keyed = table.select("silo_id", F.pmod(F.xxhash64("event_id", F.lit(cfg.seed)), F.size(of_silo)).cast("int").alias("shard"),
                         "event_id", "features", "label")
    keyed = keyed.withColumn("slot", F.element_at(of_silo, F.col("shard") + 1))
    keyed.repartition(total, "slot").write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    return ShardLayout(_by_shard(spark, path, keyed.schema, numbers), spark.read.schema(keyed.schema).parquet(path), silos, shards)


def _avg_by_silo(rows: DataFrame, weight: str, value: str = "w") -> dict[str, np.ndarray]:
    """Σ weight·vector / Σ weight per silo, coordinate-wise in Spark; returns silos × params to the driver."""
    long = rows.select("silo_id", F.col(weight).cast("double").alias("_n"), F.posexplode(value).alias("pos", "v"))
    avg = long.groupBy("silo_id", "pos").agg((F.sum(F.col("_n") * F.col("v")) / F.sum("_n")).alias("v"))
    wide = avg.groupBy("silo_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a")).collect()
    return {r["silo_id"]: np.array([s["v"] for s in r["a"]]) for r in wide}


def epoch_models(rows: DataFrame, state, sizes: list[int], cfg: TrainConfig, round_: int, epoch: int) -> DataFrame:
    """One SGD epoch of every shard, a partition of ``rows``: (silo_id, shard, n, loss, batches, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        silo, shard, x, y, order = shard_rows(batches)
        if not len(x):
            return
        rng = np.random.default_rng([cfg.seed, round_, epoch, zlib.crc32(silo.encode()), shard])
        w, loss, nb = MLP.sgd_epoch(x, y, state.value["w"][silo].copy(), state.value["g"][silo], sizes, cfg.lr, cfg.momentum,
                                    cfg.prox_mu, state.value["pw"][silo], cfg.batch_size, rng, order)
        yield pa.RecordBatch.from_pydict({"silo_id": [silo], "shard": pa.array([shard], pa.int32()), "n": [len(x)], "loss": [float(loss)],
                                          "batches": [nb], "w": pa.array([w], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, "silo_id string, shard int, n long, loss double, batches long, w array<double>")


def mode_b_epoch(layout: ShardLayout, weights: dict[str, np.ndarray], w_global: dict[str, np.ndarray],
                 pw: dict[str, float], sizes: list[int], cfg: TrainConfig, round_: int, epoch: int) -> tuple[dict, dict]:
    """Averaged weights and mean loss per silo after one epoch of the silos in ``weights``."""
    spark = layout.rows.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast({"w": weights, "g": w_global, "pw": pw})
    rows = layout.rows if len(weights) == len(layout.silos) else layout.rows.filter(F.col("silo_id").isin(list(weights)))
    out = epoch_models(rows, bc, sizes, cfg, round_, epoch).persist()
    new_w = _avg_by_silo(out, "n")
    sums = out.groupBy("silo_id").agg(F.sum("loss").alias("l"), F.sum("batches").alias("b"), F.sum("n").alias("n"),
                                      F.count(F.lit(1)).alias("models"), F.count_distinct("shard").alias("shards")).collect()
    out.unpersist()
    bc.unpersist()
    if any(r["models"] != r["shards"] or r["n"] != layout.silos[r["silo_id"]][0] for r in sums):
        raise RuntimeError("a shard was not trained whole, or more than once")
    return new_w, {r["silo_id"]: r["l"] / max(r["b"], 1) for r in sums}


def train_mode_b(table: DataFrame | ShardLayout, w_global: np.ndarray | dict[str, np.ndarray], cfg: TrainConfig,
                 round_: int = 0, epochs: dict[str, int] | None = None) -> pd.DataFrame:
    """All silos' local training from their start weights; returns silo_id, delta, n_samples, train_loss.

    Give a :func:`shard_layout` where the same table is trained on again; a plain table is laid out first.
    ``epochs`` may raise a silo's local epochs (drift response).
    """
    layout = table if isinstance(table, ShardLayout) else shard_layout(table, cfg)
    n_features = len(layout.rows.select("features").first()[0])
    sizes = MLP.layer_sizes(n_features, list(cfg.hidden))
    counts = layout.silos
    start = w_global if isinstance(w_global, dict) else {s: np.asarray(w_global) for s in counts}
    pw = pos_weights(counts, cfg)
    weights = {s: start[s].copy() for s in counts}
    loss_tot = {s: 0.0 for s in counts}
    max_epochs = max((epochs or {}).values(), default=cfg.local_epochs)
    for e in range(max(cfg.local_epochs, max_epochs)):
        active = [s for s in counts if e < (epochs or {}).get(s, cfg.local_epochs)]
        if not active:
            break
        new_w, losses = mode_b_epoch(layout, {s: weights[s] for s in active}, {s: start[s] for s in active},
                                     {s: pw[s] for s in active}, sizes, cfg, round_, e)
        for s in active:
            weights[s] = new_w[s]
            loss_tot[s] += losses[s]
    rows = []
    for s, (n, _) in counts.items():
        ep = (epochs or {}).get(s, cfg.local_epochs)
        rows.append({"silo_id": s, "delta": (weights[s] - start[s]).tolist(), "n_samples": n,
                     "train_loss": loss_tot[s] / max(ep, 1)})
    return pd.DataFrame(rows)


def mode_a_gradients(table: DataFrame, weights: dict[str, np.ndarray], pw: dict[str, float],
                     sizes: list[int]) -> tuple[dict[str, np.ndarray], dict[str, int], dict[str, float]]:
    """One job: per-silo gradient sums, row counts and loss sums over the whole table."""
    ship_package(table.sparkSession)
    bc = table.sparkSession.sparkContext.broadcast({"w": weights, "pw": pw})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = bc.value
        acc: dict[str, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = b.column("label").to_numpy(zero_copy_only=False)
            silos = b.column("silo_id").dictionary_encode()
            codes = silos.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, silo in enumerate(silos.dictionary.to_pylist()):
                at = codes == i
                gs, loss = MLP.grad_sums(x[at].astype(np.float64), y[at].astype(np.float64), state["w"][silo], sizes, state["pw"][silo])
                a = acc.setdefault(silo, [np.zeros_like(gs), 0, 0.0])
                a[0] += gs
                a[1] += int(at.sum())
                a[2] += loss
        if acc:
            yield pa.RecordBatch.from_pydict({"silo_id": list(acc), "g": pa.array([v[0] for v in acc.values()], pa.list_(pa.float64())),
                                              "n": [v[1] for v in acc.values()], "loss": [v[2] for v in acc.values()]})

    out = table.select("silo_id", "features", "label").mapInArrow(
        part, "silo_id string, g array<double>, n long, loss double").persist()
    long = out.select("silo_id", F.posexplode("g").alias("pos", "v"))
    sums = long.groupBy("silo_id", "pos").agg(F.sum("v").alias("v"))
    wide = sums.groupBy("silo_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("a")).collect()
    grads = {r["silo_id"]: np.array([s["v"] for s in r["a"]]) for r in wide}
    tot = {r["silo_id"]: (int(r["n"]), float(r["l"])) for r in
           out.groupBy("silo_id").agg(F.sum("n").alias("n"), F.sum("loss").alias("l")).collect()}
    out.unpersist()
    bc.unpersist()
    return grads, {s: t[0] for s, t in tot.items()}, {s: t[1] for s, t in tot.items()}


def train_mode_a(table: DataFrame, w_global: np.ndarray | dict[str, np.ndarray], cfg: TrainConfig,
                 steps: int | None = None) -> pd.DataFrame:
    """Exact full-batch GD with momentum and FedProx, all silos per job; one job per step."""
    n_features = len(table.select("features").first()[0])
    sizes = MLP.layer_sizes(n_features, list(cfg.hidden))
    counts = silo_sizes(table)
    start = w_global if isinstance(w_global, dict) else {s: np.asarray(w_global) for s in counts}
    pw = pos_weights(counts, cfg)
    w = {s: start[s].copy() for s in counts}
    v = {s: np.zeros_like(start[s]) for s in counts}
    losses = {s: 0.0 for s in counts}
    steps = cfg.local_epochs if steps is None else steps
    for _ in range(steps):
        g, n, loss = mode_a_gradients(table, w, pw, sizes)
        for s in counts:
            grad = g[s] / n[s] + cfg.prox_mu * (w[s] - start[s])
            v[s] = cfg.momentum * v[s] - cfg.lr * grad
            w[s] = w[s] + v[s]
            losses[s] += loss[s] / n[s]
    return pd.DataFrame([{"silo_id": s, "delta": (w[s] - start[s]).tolist(), "n_samples": counts[s][0],
                          "train_loss": losses[s] / max(steps, 1)} for s in counts])


def score_column(features, weights: np.ndarray, sizes: list[int]):
    """``mlp_score``: Arrow-batched pandas UDF over the features array (weights captured, ~30 KB)."""
    w = np.asarray(weights)
    ship_package(SparkSession.getActiveSession())

    def score(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=float)
        return pd.Series(MLP.forward(np.stack(col.to_numpy()).astype(np.float64), w, sizes))

    return F.pandas_udf(score, "double")(features)


def register_fraud_score(spark: SparkSession, weights: np.ndarray, sizes: list[int], name: str = "fraud_score") -> None:
    """SQL access to the model: ``SELECT fraud_score(features) FROM …`` (Arrow-batched)."""
    w = np.asarray(weights)
    ship_package(spark)

    def score(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=float)
        return pd.Series(MLP.forward(np.stack(col.to_numpy()).astype(np.float64), w, sizes))

    spark.udf.register(name, F.pandas_udf(score, "double"))
