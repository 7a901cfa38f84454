"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors. Every distinct
vector is described by its ``NEAREST`` nearest pivots in order, and posted in
the inverted lists of the first of them in pivot order, so many that two vectors with
``SHARED`` pivots in common share a list. Within a list, vectors with at least ``SHARED``
common pivots are candidates, and each is verified by its cosine in double
precision. A list is scanned as pairs of blocks of bounded size. A pair counts
in one list only (its first common one), so links are counted per vector
without a row per pair; a block emits link counts and a spanning forest.

Identical vectors of a label are one vector with a multiplicity from the start.

Defined results: vectors are compared only when their labels are equal and not
null, and their lengths are equal. A vector that is null, empty, zero or holds
a null or non-finite component, and one with a null vec_id, links with nothing.
Rows repeating a vec_id are vectors of their own. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored
from .components import components

#: Reference points: the bound of the sample that the index is fitted on.
PIVOTS = 128
#: Length of a description, and the common pivots that make a candidate.
NEAREST, SHARED = 10, 2
BLOCK = 512


def _pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector length: the ``count`` usable vectors that come first by a hash of the vector."""
    usable = vectors.where("vec is not null").select("dim", "vec", "wide").distinct()
    rows = usable.orderBy(F.xxhash64("vec"), "vec").limit(count).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(np.frombuffer(r["vec"], "<f8" if r["wide"] else "<f4").astype("f8"))
    return {d: np.stack([v / np.linalg.norm(v) for v in vs]) for d, vs in out.items()}


def _usable(table: DataFrame) -> DataFrame:
    """vec_id, label, dim, vec (little-endian bytes; null when the vector links with nothing), digest."""
    wide = "double" in dict(table.dtypes)["embedding"]
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id"), batch.column("label")
            column = batch.column("embedding")
            raw, dims, marks = [], [], []
            for i in range(batch.num_rows):
                v = column[i].values
                ok = ids[i].is_valid and labels[i].is_valid and v is not None and len(v) and not v.null_count
                v = v.to_numpy(zero_copy_only=False).astype("f8") if ok else np.zeros(0)
                ok = ok and np.isfinite(v).all() and 0 < np.linalg.norm(v) < np.inf
                raw.append((v + 0.0).astype(kind).tobytes() if ok else None)
                dims.append(len(v) if ok else None)
                marks.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(marks, pa.binary()), pa.array([wide] * len(raw), pa.bool_())],
                names=["vec_id", "label", "dim", "vec", "digest", "wide"])

    lean = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    return lean.mapInArrow(run, "vec_id long, label long, dim int, vec binary, digest binary, wide boolean")


def _described(distinct: DataFrame, pivots: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """With ``near`` (nearest pivots, the closest first) and ``lists`` (those it is posted under)."""
    shared_pivots = distinct.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared_pivots.value
        for batch in batches:
            near = []
            for raw, dim, wide in zip(*(batch.column(c).to_pylist() for c in ("vec", "dim", "wide")), strict=True):
                if dim in points:
                    near.append(np.argsort(-(points[dim] @ np.frombuffer(raw, "<f8" if wide else "<f4").astype("f8")), kind="stable")[:nearest].tolist())
                else:
                    near.append([0])  # no pivot of this length: one list for all
            lists = [sorted(n)[:max(1, len(n) - shared + 1)] for n in near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "near", "lists"])

    schema = distinct.select("*", F.array(F.lit(0)).alias("near"), F.array(F.lit(0)).alias("lists")).schema
    return distinct.mapInArrow(run, schema)


def _scan(group: dict[str, np.ndarray], threshold: float, shared: int, pivots: int):
    """Counts and spanning links of one pair of blocks."""
    ids, mult, mine, this = group["rep"], group["mult"], group["mine"], int(group["pivot"][0])
    kind = "<f8" if group["wide"][0] else "<f4"
    v = np.stack([np.frombuffer(x, kind) for x in group["vec"]]).astype("f8")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.zeros((len(v), pivots), np.float32)
    for k, n in enumerate(group["near"]):
        near[k, n] = 1
    posted = np.zeros((len(v), pivots), bool)
    for k, n in enumerate(group["lists"]):
        posted[k, n] = True
    need = np.minimum(shared, near.sum(1))
    close = (v @ v.T >= threshold) & (near @ near.T >= np.minimum(need[:, None], need[None, :]))
    close &= np.triu(np.ones(close.shape, bool), 1)
    if group["i"][0] != group["j"][0]:
        close &= mine[:, None] != mine[None, :]
    a, b = np.nonzero(close)
    earlier = (posted[a, :this] & posted[b, :this]).any(1)
    a, b = a[~earlier], b[~earlier]
    links = np.zeros(len(v), np.int64)
    np.add.at(links, a, mult[b])
    np.add.at(links, b, mult[a])
    root = np.arange(len(v))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    hit = np.flatnonzero(links)
    return ids[hit], ids[root[hit]], links[hit]


def _links(described: DataFrame, threshold: float, shared: int, pivots: int) -> DataFrame:
    """(rep, other, links): links that a block finds for a vector, and the first vector that they join it to."""
    posted = described.withColumn("pivot", F.explode("lists"))
    sizes = posted.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = posted.join(sizes, ["label", "dim", "pivot"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    names = ["label", "dim", "pivot", "i", "j", "mine", "rep", "mult", "wide", "vec", "near", "lists"]
    rows = rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: dict[str, np.ndarray], cuts: np.ndarray):
            parts = [_scan({c: x[a:b] for c, x in rows.items()}, threshold, shared, pivots) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1]
            columns = [np.concatenate([p[k] for p in parts] or [np.zeros(0, "i8")]) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "other", "links"])

        held: dict[str, np.ndarray] | None = None  # rows of the group that the last batch ended in: at most two blocks
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
            group = np.stack([rows[c].astype("i8") for c in names[:5]], 1)
            cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1])
            yield done({c: x[:cuts[-1]] for c, x in rows.items()}, cuts)
            held = {c: x[cuts[-1]:] for c, x in rows.items()}
        if held is not None:
            yield done(held, np.array([0, len(held["rep"])]))

    keys = names[:5]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, other long, links long")


def near_duplicates(table: DataFrame, threshold: float = 0.93, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, label, embedding)."""
    ship_package(table.sparkSession)
    vectors = stored(_usable(table), "vectors")
    first = (vectors.where("vec is not null").groupBy("label", "dim", "digest")
             .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("vec").alias("vec"), F.first("wide").alias("wide")))
    distinct = stored(_described(first, _pivots(vectors, pivots), nearest, shared), "described")
    links = stored(_links(distinct, threshold, shared, pivots), "vector-links")
    sums = links.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    labels = (distinct.select("label", "dim", "digest", "rep", "mult").join(sums, "rep", "left")
              .join(found.withColumnRenamed("id", "rep"), "rep", "left")
              .select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    linked = vectors.where("vec is not null").select("vec_id", "label", "dim", "digest").join(labels, ["label", "dim", "digest"])
    alone = vectors.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
