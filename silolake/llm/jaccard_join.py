"""Jaccard join of word n-gram sets, size-aware: subsets for small sets, inverted lists for large ones.

Sets with the same elements are one set from the start. For the others, all
elements have one global order (elements that are frequent in the corpus last),
and two sets that are similar enough share elements among their first ones:

* small (light) sets emit every 2-element subset of their prefix as a key, which is selective
* large (heavy) sets post each element of a shorter prefix in that element's inverted list
* sets near the boundary do both, so that a light and a heavy set meet

The boundary is the set size at which the postings of subsets cost as much as
the longer lists of single elements, from the corpus' size histogram and its
measured repetition (:func:`choose_boundary`). The order only decides the cost:
whatever counts it is made from, no link is lost.

Candidates come from the lists in two steps, so that a large group of copies
never turns into all its pairs. First each set meets one hub of each of its
lists (a linear number of pairs; two choices of hub), and the verified links
give components. Then the lists that still hold several components are scanned
in blocks. A pair must pass the size bound and a 512-bit parity sketch, whose
distance never exceeds the size of the symmetric difference, and then a wider
one of two bits per element: these tests are lossless, and both are made inside
the block. A first scan puts out a spanning forest of the pairs that pass, at
most one row less than a block has sets. Where all of its pairs link, the list holds no
other link between components; a second scan of the lists in which one did not
puts out every pair that passes and still lies between two components, so
nothing is lost. Verification counts the common elements of 64-bit hashed
n-grams.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; with
fewer than ``size`` words the whole sequence is the one element; null, empty
and blank texts have the empty set and link with nothing. A null doc_id links
with nothing and has a null component. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, batches_of, give_back, ship_package, stored
from .components import components
from .mphf import mix

#: Most elements that the global order knows as frequent (8 bytes each are broadcast).
FREQUENT = 1 << 19
#: Entries of an inverted list that are compared in one block.
BLOCK = 512
SKETCH_WORDS = 8
#: Bytes of the wide sketch that go through the blocks with each entry; larger sets' sketches are folded to it.
BLOCK_SKETCH = 1 << 9
#: Cells of the map that keeps texts without a candidate out of verification: at most so many numbers reach the driver.
CELLS = 1 << 22

_U = np.uint64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = mix(np.arange(256, dtype=_U), 7) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: bytes, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 ``data``, lower-cased in A-Z."""
    a = np.frombuffer(data.lower(), np.uint8)
    space = np.concatenate([[True], _SPACE[a], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    out, at = [], 0
    while at < len(starts):  # whole words, about ``chunk`` bytes at a time
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + chunk)))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _powers(high - low)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[a[low:high]] * up[:high - low])])
        s, e = starts[at:to] - low, ends[at:to] - low
        out.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U), 11))
        at = to
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """The distinct word n-grams of a text as sorted 64-bit hashes."""
    words = word_hashes(data or b"")
    if not len(words):
        return words
    take = min(size, len(words))
    h = np.full(len(words) - take + 1, take, _U)
    for k in range(take):
        h = mix(h ^ words[k:len(words) - take + 1 + k], 20 + k)
    return np.unique(h)


def needed(n: int, threshold: int) -> int:
    """Least common elements of a set of ``n`` with any set it links to."""
    return -(-threshold * n // 100)


def prefix_length(n: int, threshold: int, subset: int) -> int:
    """Elements among which two linked sets share ``subset`` ones."""
    return min(n, n - needed(n, threshold) + subset)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the elements' counts in 512 cells."""
    bits = np.bincount((s >> _U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def wide_sketch(s: np.ndarray) -> bytes:
    """Parities in 2**k cells, at least two for each element; a shorter one of the same set is its halves' xor."""
    bits = max(512, 1 << int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(x: bytes, size: int) -> bytes:
    """The sketch of the same set in at most ``size`` bytes."""
    a = np.frombuffer(x, np.uint8)
    while len(a) > size:
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return a.tobytes()


def distance_bound(x: bytes, y: bytes) -> int:
    """Least size of the symmetric difference of two sets, from their wide sketches."""
    size = min(len(x), len(y))
    a, b = (np.frombuffer(folded(v, size), np.uint8) for v in (x, y))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def choose_boundary(histogram: dict[int, int], repetition: float, threshold: int) -> int:
    """The set size from which lists of single elements are cheaper than 2-element subsets.

    ``histogram``: sets by size; ``repetition``: mean length of an element's list.
    A posting costs 1; scanning a list costs its length per posting; sets within
    a similarity of the boundary pay for both.
    """
    def light(n: int) -> float:
        p = prefix_length(n, threshold, 2)
        return p * (p - 1) / 2

    def heavy(n: int) -> float:
        return prefix_length(n, threshold, 1) * (1 + repetition)

    def cost(x: int) -> float:
        return sum(c * ((light(n) if n < x else heavy(n)) + (heavy(n) if threshold * x <= 100 * n < 100 * x else 0)) for n, c in histogram.items())

    return min(range(2, 401, 2), key=lambda x: (cost(x), x))


def _statistics(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: a row per document (n, digest of its set), and rows of elements repeated within a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            flat, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, _U), np.zeros(0, int))
            often = counts > 1
            n, k = len(sets), int(often.sum())
            digest = [int(mix(s, 3).sum(dtype=_U)) ^ (len(s) << 1) for s in sets], [int(mix(s, 5).sum(dtype=_U)) for s in sets]
            signed = lambda v: pa.array(np.array(v, _U).view("i8"), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("doc_id"), pa.nulls(k, pa.int64())]),
                 pa.array([*map(len, sets), *[None] * k], pa.int64()),
                 pa.concat_arrays([signed(digest[0]), pa.array(flat[often].view("i8"), pa.int64())]),
                 pa.concat_arrays([signed(digest[1]), pa.array(counts[often], pa.int64())])],
                names=["doc_id", "n", "x", "y"])

    return docs.mapInArrow(run, "doc_id long, n long, x long, y long")


def _frequent(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``FREQUENT`` most frequent elements (sorted by hash) and their ranks by count."""
    counts = stored(repeated.groupBy("x").agg(F.sum("y").alias("y")).where("y > 2"), "frequent")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(F.least("y", F.lit(1 << 14)).alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for level, count in sizes:
        total += count
        if total > FREQUENT:
            break
        least = level
    if least is None:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    rows = counts.where(F.col("y") >= least).toPandas()
    h, c = rows["x"].to_numpy("i8").view("u8"), rows["y"].to_numpy("i8")
    by_hash = np.argsort(h)
    h, c = h[by_hash], c[by_hash]
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(len(h))
    return h, rank


def ordered_prefix(s: np.ndarray, length: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first ``length`` elements of a set in the global order: others by hash, then frequent ones by count."""
    at = np.searchsorted(frequent, s)
    known = np.zeros(len(s), bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == s
    rare = s[~known][:length]
    if len(rare) == length:
        return rare
    often = s[known]
    return np.concatenate([rare, often[np.argsort(rank[at[known]])][:length - len(rare)]])


def keys_of(s: np.ndarray, boundary: int, threshold: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Keys under which a set meets every other set that it links to."""
    n = len(s)
    if needed(n, threshold) == n and 100 * n // threshold == n:
        return np.zeros(0, _U)  # links to equal sets only
    out = []
    if n < boundary:
        p = np.sort(ordered_prefix(s, prefix_length(n, threshold, 2), frequent, rank))
        i, j = np.triu_indices(len(p), 1)
        out.append(mix(mix(p[i], 31) ^ p[j], 32))
    if 100 * n >= threshold * boundary:
        out.append(ordered_prefix(s, prefix_length(n, threshold, 1), frequent, rank))
    return np.concatenate(out)


def _signatures(docs: DataFrame, size: int, threshold: int, boundary: int, frequent) -> DataFrame:
    """doc_id, n, sketch words, keys of each text that can link to a different set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value
        for batch in batches_of(batches, TEXT_BYTES):
            ids, ns, marks, wide, keys = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text, size)
                k = keys_of(s, boundary, threshold, often, rank)
                if len(k):
                    ids.append(doc_id)
                    ns.append(len(s))
                    marks.append(sketch(s))
                    wide.append(wide_sketch(s))
                    keys.append(k.view("i8"))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("i4")
            marks = np.array(marks, "i8").reshape(-1, SKETCH_WORDS)
            flat = np.concatenate(keys) if keys else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *(pa.array(marks[:, i]) for i in range(SKETCH_WORDS)),
                 pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", *_SKETCH, "wide", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, " + ", ".join(f"{c} long" for c in _SKETCH) + ", wide binary, keys array<long>")


def _likely(pairs: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that pass the test of their wide sketches, a sixteenth of the sets in size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)
            mask = pa.array([distance_bound(x, y) * (100 + threshold) <= (n + m) * (100 - threshold) for n, m, x, y in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    left = signed.select(F.col("doc_id").alias("a"), "n", F.col("wide").alias("x"))
    right = signed.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link, found on the whole sets of the documents they name."""
    pairs = stored(pairs, "pairs")
    named = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell")
    cells = np.zeros(CELLS, bool)
    cells[named.select(cell).distinct().toPandas()["cell"].to_numpy("int64")] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(cells))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed.value).astype(bool)
        for batch in batches_of(batches, TEXT_BYTES):
            batch = batch.filter(pa.array(wanted[batch.column("cell").to_numpy()]))
            out = [shingles(t, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "elements"])

    # texts never shuffle: the map lets all named documents through and few others, which the join drops
    whole = docs.select("doc_id", "text", cell).mapInArrow(sets, "doc_id long, elements binary")
    whole = stored(whole.join(named, "doc_id", "left_semi"), "pair-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            links = []
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * both >= threshold * (len(x) + len(y) - both))
            mask = pa.array(links, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    left = whole.select(F.col("doc_id").alias("a"), F.col("elements").alias("xs"))
    right = whole.select(F.col("doc_id").alias("b"), F.col("elements").alias("ys"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "xs", "ys").mapInArrow(check, "a long, b long"), "links")


def _close(threshold: int):
    """Size and sketch tests of columns ``n``, ``s0``… against ``m``, ``t0``…"""
    distance = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))))
    sizes = (F.col("n") * 100 >= F.col("m") * threshold) & (F.col("m") * 100 >= F.col("n") * threshold)
    return sizes & (distance * (100 + threshold) <= (F.col("n") + F.col("m")) * (100 - threshold))


def _hub_pairs(lists: DataFrame, marks: DataFrame, threshold: int, salt: int) -> DataFrame:
    """Distinct pairs of each set with the hub of each of its lists: the set that comes first by a hash."""
    first = F.min(F.struct(F.xxhash64("doc_id", F.lit(salt)).alias("h"), "doc_id", "component"))
    hubs = lists.groupBy("key").agg(first.alias("hub"))
    met = (lists.join(hubs, "key").where("doc_id <> hub.doc_id and component <> hub.component")
           .select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct())
    left = marks.withColumnRenamed("doc_id", "a")
    right = marks.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH_WORDS)])
    return met.join(left, "a").join(right, "b").where(_close(threshold)).select("a", "b")


class _Joined(dict):
    """Components that were joined, with path halving."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def _block_pairs(lists: DataFrame, marks: DataFrame, threshold: int, forest: bool) -> DataFrame:
    """(a, b, key): close pairs of different components in each list, or a spanning forest of them in each pair of blocks.

    Long lists are dealt out as pairs of blocks; ``marks`` has the sketches (``wide``, at least 64 bytes).
    """
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_lists = sizes.where("lo <> hi").select("key", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    rows = lists.join(open_lists, "key").join(marks, "doc_id")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine"), "doc_id",
                       F.col("n").cast("int").alias("n"), "component", "wide")
    names = rows.columns

    def narrow(wide: np.ndarray) -> np.ndarray:
        """All sketches folded to 64 bytes, in eight numbers each."""
        out = np.empty((len(wide), 64), np.uint8)
        size = np.fromiter(map(len, wide), np.int64, len(wide))
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            x = np.frombuffer(b"".join(wide[at]), np.uint8).reshape(-1, length)
            while x.shape[1] > 64:
                x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            out[at] = x
        return out.view("u8")

    def close(group: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
        order = np.argsort(group["n"], kind="stable")
        n, ids, comp, mine, wide = (group[c][order] for c in ("n", "doc_id", "component", "mine", "wide"))
        n = n.astype(np.int64)
        marks = narrow(wide)
        short: dict[tuple[int, int], int] = {}  # (entry, bytes) → its sketch as a number

        def number(k: int, size: int) -> int:
            if (k, size) not in short:
                short[k, size] = int.from_bytes(folded(wide[k], size), "little")
            return short[k, size]

        joined = _Joined()
        between = group["i"][0] != group["j"][0]
        found_a, found_b = [], []
        ends = np.searchsorted(n, n * 100 // threshold, "right")
        for k in range(len(n) - 1):
            other = np.arange(k + 1, ends[k])
            other = other[(comp[other] != comp[k]) & ((mine[other] != mine[k]) | (not between))]
            if len(other):
                far = np.bitwise_count(marks[other] ^ marks[k]).sum(1, dtype=np.int64)
                other = other[far * (100 + threshold) <= (n[other] + n[k]) * (100 - threshold)]
                for o in other.tolist():
                    a, b = joined.root(int(comp[k])), joined.root(int(comp[o]))
                    if a == b:
                        continue
                    size = min(len(wide[k]), len(wide[o]))
                    if (number(k, size) ^ number(o, size)).bit_count() * (100 + threshold) <= int(n[o] + n[k]) * (100 - threshold):
                        found_a.append(int(min(ids[k], ids[o])))
                        found_b.append(int(max(ids[k], ids[o])))
                        if forest:
                            joined[a] = b
        return found_a, found_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # rows of the group that the last batch ended in: at most two blocks

        def pairs(rows: dict[str, np.ndarray], cuts: np.ndarray):
            a, b, key = [], [], []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1:
                    some = close({c: v[x:y] for c, v in rows.items()})
                    a += some[0]
                    b += some[1]
                    key += [int(rows["key"][x])] * len(some[0])
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, key)], names=["a", "b", "key"])

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            rows = {c: np.concatenate([*(h[c] for h in held), new[c]]) for c in names}
            group = np.stack([rows["key"], rows["i"], rows["j"]], 1)
            cuts = np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1]) if len(group) else np.zeros(1, int)
            yield pairs({c: v[:cuts[-1]] for c, v in rows.items()}, cuts)
            held = [{c: v[cuts[-1]:] for c, v in rows.items()}]
        if held:
            rows = held[0]
            yield pairs(rows, np.array([0, len(rows["key"])]))
        give_back()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, key long")


def jaccard_components(docs: DataFrame, size: int = 3, threshold: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; ``threshold`` is the Jaccard similarity in per cent."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    seen = stored(_statistics(texts, size), "shingle-statistics")
    each, repeated = seen.where("n is not null"), seen.where("n is null")
    texts = texts.where("doc_id is not null")

    first = each.where("n > 0 and doc_id is not null").groupBy("n", "x", "y").agg(F.min("doc_id").alias("rep"))
    first = stored(first, "distinct-sets")
    histogram = {r["n"]: r["count"] for r in first.where("n <= 500").groupBy("n").count().collect()}
    total = each.agg(F.sum("n")).first()[0] or 0
    extra = repeated.agg(F.sum(F.col("y") - 1)).first()[0] or 0
    boundary = choose_boundary(histogram, total / max(1, total - extra), threshold)
    frequent = spark.sparkContext.broadcast(_frequent(repeated.select("x", "y")))

    signed = stored(_signatures(texts, size, threshold, boundary, frequent).join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "signatures")
    marks = signed.select("doc_id", "n", *_SKETCH)
    postings = signed.select("doc_id", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    lists = stored(postings.join(shared, "key"), "lists")

    links = None
    found = None  # (id, component) so far

    def labelled(rows: DataFrame) -> DataFrame:
        if found is None:
            return rows.withColumn("component", F.col("doc_id"))
        return rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = pa.array([folded(w, BLOCK_SKETCH) for w in batch.column("wide").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), wide], names=["doc_id", "n", "wide"])

    block_marks = signed.select("doc_id", "n", "wide").mapInArrow(folds, "doc_id long, n long, wide binary")

    def join(pairs: DataFrame) -> DataFrame:
        nonlocal links, found
        new = _verified(_likely(pairs, signed, threshold), texts, size, threshold)
        links = new if links is None else links.unionByName(new)
        found = stored(components(links), "components")
        return new

    for salt in (0, 1):
        join(_hub_pairs(labelled(lists), marks, threshold, salt))
    forest = stored(_block_pairs(labelled(lists), block_marks, threshold, True), "forest")
    linked = join(forest.select("a", "b").distinct())
    # where a pair of the forest does not link, others of its list may
    failed = stored(forest.join(linked, ["a", "b"], "left_anti").select("key").distinct(), "failed")
    rest = lists.join(failed, "key", "left_semi")
    join(_block_pairs(labelled(rest), block_marks, threshold, False).select("a", "b").distinct())
    labels = first.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("n", "x", "y", F.coalesce("component", "rep").alias("component_id"))
    same = each.where("n > 0 and doc_id is not null").join(labels, ["n", "x", "y"])
    alone = each.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return same.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def keep_one_of_each(docs: DataFrame, size: int = 3, threshold: int = 90) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each component, with its own columns; null doc_ids stay."""
    grouped = jaccard_components(docs, size, threshold).where("doc_id = component_id or doc_id is null")
    kept = stored(grouped.select(F.col("doc_id").alias("kept_id")).distinct(), "kept").alias("kept")
    return docs.alias("docs").join(kept, F.col("docs.doc_id").cast("long").eqNullSafe(F.col("kept.kept_id")), "left_semi")
