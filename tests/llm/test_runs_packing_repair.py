"""Periodic runs, best-two-fit packing and conversation repair against plain versions."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silolake.llm import best_two_fit, conversation_repair, periodic_runs, planted
from silolake.llm.common import tokenizer_path
from silolake.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs ---------------------------------------------------------------------------

def plain_runs(w, exponent=4, shortest=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        j = 0
        while j < len(w) - q:
            e = j
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            if e > j and e + q - j >= max(shortest, exponent * q):
                found.setdefault((j, e + q), q)
            j = max(e, j + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def some_words(rnd):
    n, letters = rnd.choice([3, 30, 150]), rnd.choice([1, 2, 3, 40])
    kind = rnd.random()
    if kind < .4:
        return [rnd.randrange(letters) for _ in range(n)]
    w = []
    while len(w) < n:
        block = [rnd.randrange(letters) for _ in range(rnd.randint(1, max(1, n // 4)))]
        if kind < .6:
            block = [0] * len(block) + [1]
        w += (block * rnd.randint(1, 6))[:rnd.randint(1, 6 * len(block))] + [rnd.randrange(letters)] * rnd.randint(0, 2)
    return w


def test_runs_match_plain_search():
    rnd = random.Random(11)
    total = 0
    for _ in range(120):
        docs = [some_words(rnd) for _ in range(rnd.randint(1, 20))]
        sizes = np.array([len(d) for d in docs])
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(docs)), sizes)
        found = periodic_runs.find_runs(doc * 1000 + np.array([x for d in docs for x in d], np.int64), ends[doc])
        got = [[] for _ in docs]
        for s, e, q in zip(*(x.tolist() for x in found)):
            got[doc[s]].append((s - int(ends[doc[s]] - sizes[doc[s]]), q, e - s))
        assert got == [plain_runs(d) for d in docs]
        total += sum(map(len, got))
    assert total > 500


def test_higher_exponents_and_lower_ones():
    words, ends = np.array([0, 1] * 5 + [2] * 7), np.full(17, 17)
    assert [x.tolist() for x in periodic_runs.find_runs(words, ends, exponent=6)] == [[10], [17], [1]]
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs.find_runs(words, ends, exponent=3)


def test_wavelet_successor():
    values = np.random.default_rng(3).permutation(100)
    tree = periodic_runs.WaveletTree(values, 7)
    for left, right, bound in [(0, 100, 0), (10, 40, 50), (10, 40, 99), (5, 6, 3), (20, 21, 100)]:
        plain = min((v for v in values[left:right] if v >= bound), default=-1)
        assert tree.successor(np.array([left]), np.array([right]), np.array([bound]), -1)[0] == plain


def test_periodic_runs_of_odd_documents(spark):
    big = " ".join(f"w{i}" for i in range(30_000)) + " x y z" * 40_000
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "a b\tc a\x0bb c a b c a  b c d", "a\x85a a a", big, "q " * 9, "q " * 9]
    rows = [(i if i else None, t, 1, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs.union(docs.where("doc_id = 4"))).collect()}
    as_list = {i: [tuple(x) for x in r["runs"]] for i, r in got.items()}
    assert as_list[3] == [] and as_list[4] == [(0, 6, 1)] and as_list[5] == [(0, 12, 3)] and as_list[6] == [] and as_list[None] == []
    assert as_list[7] == [(30_000, 120_000, 3)] and got[7]["collapsed"].endswith("w29999 x y z") and got[7]["n_words"] == 150_000
    assert (got[4]["collapsed"], got[5]["collapsed"], got[1]["collapsed"]) == ("a", "a b c d", "") and as_list[8] == as_list[9] == [(0, 9, 1)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op11_digests(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert got.keys() == docs.keys()
    with_runs = 0
    for i, text in docs.items():
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        if len(w) > 3000:
            continue  # the plain search is quadratic
        runs = plain_runs(w)
        with_runs += bool(runs)
        dropped = {k for s, q, n in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
        r = got[i]
        assert (r["n_runs"], r["start"], r["period"], r["length"]) == (len(runs), *top)
        assert r["exponent_milli"] == (top[2] * 1000 // top[1] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest()
    assert with_runs > 5


# ---- packing ---------------------------------------------------------------------------------

def plan_of(lengths, capacity):
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    slots, classes = best_two_fit.plan(counts, capacity)
    bins = {}
    for n, c in counts.items():
        for rank in range(c):
            slot = classes[n] + rank
            first, sequence, each, offset = slots[np.searchsorted(slots[:, 0], slot, "right") - 1]
            bins.setdefault(int(sequence + (slot - first) // each), []).append((int(offset + (slot - first) % each * n), n))
    return bins


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        for i, g in enumerate(gaps):
            if g >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_no_worse_than_first_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = [10, 64, 97, 512][seed % 4]
    lengths = rng.integers(1, capacity + 1, 400) if seed < 4 else np.minimum(capacity, rng.lognormal(2.5, 1, 900).astype(int) + 1)
    bins = plan_of(lengths, capacity)
    assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths.tolist())
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    assert -(-int(lengths.sum()) // capacity) <= len(bins) <= first_fit_decreasing(lengths, capacity)


def test_smallest_is_replaced_with_the_tightest_two():
    left = np.zeros(11, np.int64)
    left[[6, 3, 2]] = 1, 1, 2  # greedy 6 + 3 leaves 1; 2 + 2 instead of 3 leaves nothing
    assert best_two_fit.fill(left) == {6: 1, 2: 2}
    left[2] = 1
    assert best_two_fit.fill(left) == {6: 1, 3: 1}
    assert best_two_fit.plan({}, 10)[0].shape == (0, 4)


def test_pack_matches_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [None, "", " ", "Hello, it's a TEST!\n\tnew\x0bÀé é 12 日本語 😀x \x1cfoo\x85bar baz", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ΣΑΣ. İI İ, ?!",
             "word " * 9000, "ab" * 30_000, "x.. y?! z; d'accord, l'é, á, é.", "same text.", "same text."]
    rows = [(i if i != 1 else None, t, 7) for i, t in enumerate(texts)] + [(9, "same text.", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    packed = best_two_fit.pack(docs)
    placed = [r.asDict() for r in packed.places.collect()]
    plain = []
    for i, t, _ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        plain += [(i if i is not None else -1, k, at, len(p := ids[at:at + 4096]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == sorted(plain)
    filled = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096 and len(filled) == -(-sum(p[3] for p in plain) // 4096)
    whole = {r["sequence_id"]: r for r in best_two_fit.sequences(packed).collect()}
    assert {k: len(r["ids"]) // 4 for k, r in whole.items()} == filled
    some = max(placed, key=lambda r: r["offset"])
    cut = bytes(whole[some["sequence_id"]]["ids"])[4 * some["offset"]:4 * (some["offset"] + some["length"])]
    assert zlib.crc32(cut) == some["ids_crc32"]
    assert best_two_fit.pack(docs.limit(0)).places.count() == 0


def test_memo_that_starts_anew_gives_the_same_ids(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(50)) for _ in range(40)]
    plain = best_two_fit.word_encoder(tokenizer_path("word_bpe_49k.json"))(pa.array(texts))
    monkeypatch.setattr(best_two_fit, "MEMO_WORDS", 30)
    small = best_two_fit.word_encoder(tokenizer_path("word_bpe_49k.json"))
    assert np.concatenate([small(pa.array(texts[k:k + 4]))[0] for k in range(0, 40, 4)]).tolist() == plain[0].tolist()


# ---- conversation repair -----------------------------------------------------------------------

def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines of one sorted conversation."""
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(conversation_repair.SPACES)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    goes = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        follow = [(c, n) for c, n in names.items() if c in goes[state]]
        if inserts < 4:
            for c, n in follow:
                cost, audit, out = best(i, goes[state][c], inserts + 1)
                options.append((cost + 2, "I" + audit, ((n, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, out = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit, out))
            if kinds[i] in (None, "truncated"):
                cut = kinds[i] == "truncated"
                for edit, c, n, price in [("K", role[:1], role, 0)] * (role[:1] in goes[state]) + [("R", c, n, 2) for c, n in follow]:
                    cost, audit, out = best(i + 1, goes[state][c], 0)
                    options.append((cost + price + cut, edit + audit, ((n, text), *out)))
        return min(options, default=(10 ** 6, "", ()))

    cost, audit, out = best(0, 0, 0)
    turns = sorted({t for t, _, _ in rows if t is not None})
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out))


def check_repair(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place long, conv string")
    edited = conversation_repair.edits(table)
    got = {r["conv"]: r for r in conversation_repair.summary(edited).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert len(got) == len(by)
    for conv, turns in by.items():
        turns.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        plain = plain_repair(turns)
        assert tuple(got[None if conv is None else str(conv)])[1:] == (*plain[:-1], hashlib.sha256(plain[-1].encode()).hexdigest()), turns
    return edited


def test_repair_matches_all_edits(spark):
    rnd = random.Random(13)
    rows = []
    for conv in range(150):
        turn = 2 ** 60 if conv == 7 else 0
        for _ in range(rnd.randint(1, 7)):
            turn += rnd.choice([1, 1, 1, 2, 0])
            rows.append((conv or None, None if rnd.random() < .05 else turn, rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         rnd.choice(["a.", "b.", "c", "d!", " ", None, "e? \n", "f.g", "\x0b"])))
    edited = check_repair(spark, rows)
    lines = conversation_repair.repaired(edited).collect()
    assert lines and all(re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in sorted(lines, key=lambda r: r["place"]) if r["conv_id"] == c))
                         for c in {r["conv_id"] for r in lines})


def test_state_is_carried_across_arrow_batches(spark):
    """One conversation of 3,000 turns and a very long text, seven turns a batch."""
    rnd = random.Random(2)
    rows = [(5, i, rnd.choice(["user", "assistant", "assistant"]), f"t{rnd.randrange(2500)}" + rnd.choice([".", "."," "])) for i in range(300)]
    rows.append((5, 300, "user", "long " * 200_000 + "!"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        import sys
        sys.setrecursionlimit(20_000)
        check_repair(spark, rows + [(6, 0, "system", "only.")])
    finally:
        spark.conf.set(key, before)


def test_the_conversation_is_shuffled_once(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edited = conversation_repair.edits(turns)
    assert edited._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert conversation_repair.summary(edited).count() == 0


def test_planted_faults_and_lost_conversations(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else None, f"Why {c} {t}?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in planted.with_faults(turns).collect()), key=repr)
    plain = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            row = (c, t, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
            plain += [row] * (2 if f == 3 else 1)
    assert got == sorted(plain, key=repr)
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Gone."), (None, None, None, None)], turns.schema).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out[lost] == nothing and out[None][-2] in ("D", "") and len(out) == 2
