"""Jaccard join, pivot index and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from silolake.llm import jaccard_join, pivot_dedup
from silolake.llm.components import components


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_a_long_chain_and_a_star(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = [*zip(order, order[1:]), *((100, i) for i in range(101, 140)), (200, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable({i for link in links for i in link}, links)
    assert {i: c for i, c in got.items()} == {i: c for i, c in want.items() if i != 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed: int = 0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for size in (2, 3, 9, 11, 12, 30, 60, 300, 800):
        base = [rnd.choice(words) for _ in range(size)]
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 5, 12):
            copy = list(base)
            for _ in range(min(edits, size // 10 + 1)):
                copy[rnd.randrange(size)] = rnd.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join([*base, *base[:max(1, size // 20)]]))
    common = " ".join(rnd.choice(words) for _ in range(60))
    texts += [f"{common} {' '.join(rnd.choice(words) for _ in range(80))}" for _ in range(12)]
    return texts


@pytest.mark.parametrize("size, threshold", [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, size, threshold):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    texts = [*near_copies(), None, "", " \t\n ", "One two", "oNE\x0btwo", "É a b c", "é a b c"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y z", 1)], "doc_id long, text string, n int")
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs, size, threshold).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    links = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    want = smallest_reachable(sets, links)
    assert {i: got[i]["component_id"] for i in sets} == want
    assert {i: got[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert got[None]["component_id"] is None
    kept = jaccard_join.keep_one_of_each(docs, size, threshold)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {*want.values(), None}


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_share_keys_for_every_linked_pair():
    rnd = np.random.default_rng(3)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in (9, 10, 19, 25, 26, 40, 200):
        base = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
        for drop in range(0, n // 10 + 1):
            a, b = np.unique(base), np.unique(base[drop:])
            if 10 * len(b) >= 9 * len(a) and len(a) != len(b):
                for boundary in (2, 20, 26, 300):
                    assert np.intersect1d(jaccard_join.keys_of(a, boundary, 90, *none), jaccard_join.keys_of(b, boundary, 90, *none)).size


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(5)
    for n, m in ((10, 12), (600, 500), (5000, 4700)):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[:m // 2], rnd.integers(0, 1 << 63, m - m // 2, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count(jaccard_join.sketch(a).view("u8") ^ jaccard_join.sketch(b).view("u8")).sum() <= apart
        assert jaccard_join.distance_bound(jaccard_join.wide_sketch(a), jaccard_join.wide_sketch(b)) <= apart


def test_boundary_grows_with_the_lists():
    sizes = {n: 10 for n in range(9, 300)}
    assert jaccard_join.choose_boundary(sizes, 1.0, 90) < jaccard_join.choose_boundary(sizes, 20.0, 90)


def test_pivot_index_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(pivot_dedup, "BLOCK", 32)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[0 if i % 3 == 0 else i % 40] + rnd.normal(size=16) * rnd.choice([0.0, 0.1, 0.25])
        rows.append((i, [float(x) for x in v.astype("f4")], int(i % 2), "a"))
    odd = [(1000, None, 1, "a"), (1001, [0.0] * 16, 1, "a"), (1002, [float("nan")] * 16, 1, "a"), (1003, rows[0][1], None, "a"),
           (1004, [None] + rows[0][1][1:], 0, "a"), (1005, [], 0, "a"), (1006, [1.0, 2.0], 0, "a"), (1007, [2.0, 4.0], 0, "a"), (1008, [float("inf")] * 16, 0, "a")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, rep string")
    got = {r["vec_id"]: r for r in pivot_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows) + len(odd)
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(400)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    want = smallest_reachable(range(400), zip(*np.nonzero(near), strict=True))
    assert sum(got[i]["component_id"] != want[i] for i in range(400)) <= 4
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008))
    assert got[1007]["component_id"] == 1006 and not got[1007]["kept"]
    assert pivot_dedup.near_duplicates(table.limit(0)).count() == 0


def test_alike_unlinked_sets_do_not_come_out_of_the_blocks(spark, monkeypatch):
    """80 texts of 2,000 words share 1,600 of them (0.67 alike, unlinked); each has copies with a word changed."""
    rnd = random.Random(6)
    common = [f"c{i}" for i in range(1600)]
    rows = []
    for i in range(80):
        words = common + [f"o{i}x{k}" for k in range(400)]
        for k in range(3):
            copy = list(words)
            if k:
                copy[rnd.randrange(1600, 2000)] = f"n{i}x{k}"
            rows.append((i * 10 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real, made = jaccard_join._block_pairs, []

    def counted(lists, marks, threshold, forest):
        out = real(lists, marks, threshold, forest).cache()
        made.append((forest, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "_block_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i - i % 10 for i in got} and len(got) == 240
    assert [f for f, _ in made] == [True, False] and made[0][1] <= 160 and made[1][1] == 0


def test_a_forest_whose_links_fail_is_made_up_for(spark, monkeypatch):
    """Where every forest pair turns out not to link, the second scan still finds all links."""
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(30)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 1, 90).collect()}
    real, calls = jaccard_join._verified, []

    def fails(pairs, *args):
        calls.append(1)
        out = real(pairs, *args)
        return out.limit(0) if len(calls) < 4 else out

    monkeypatch.setattr(jaccard_join, "_verified", fails)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 1, 90).collect()} == plain
    assert len(calls) == 4 and len(set(plain.values())) < 40


def test_folded_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2 ** 63, n).astype("u8")) for n in (900, 9000))
    b = np.union1d(a, b)
    x, y = jaccard_join.wide_sketch(a), jaccard_join.wide_sketch(b)
    for size in (64, 128, 1024):
        assert jaccard_join.folded(jaccard_join.folded(y, 1024), size) == jaccard_join.folded(y, size)
        assert jaccard_join.distance_bound(jaccard_join.folded(x, size), jaccard_join.folded(y, size)) <= len(b) - len(a)
