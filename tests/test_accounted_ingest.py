"""The accounted ingest: fates, commits, replays, pruning."""

from __future__ import annotations

import json

import pytest

from silolake.schemas import TRANSACTIONS
from silolake.streaming import ledger as LG

COLS = [c.split()[0] for c in TRANSACTIONS.split(", ")]


def line(event_id, step, amount=1.0):
    return json.dumps({**dict.fromkeys(COLS), "event_id": event_id, "step": step, "type": "DEBIT", "amount": amount})


def batch(spark, lines, parts=3):
    return spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts)


BATCHES = [
    [line(1, 0), line(2, 5), line(2, 5), "{broken", None, line(None, 3), line(3, None)],
    [line(4, 100), line(2, 5), line(5, 60), "x"],  # the first batch reached hour 5: nothing is late yet
    [line(6, 20), line(7, 90), line(5, 60), line(4, 100), line(8, 101)],  # hour 100 less a day: 20 is late, 60 too
]
WANT = [(7, 2, 4, 0, 1), (4, 2, 1, 0, 1), (5, 2, 0, 2, 1)]


def ledger_rows(spark, root):
    return [tuple(r)[1:6] for r in LG.read_ledger(spark, root).orderBy("batch_id").collect()]


def lake_ids(spark, root, **kw):
    return sorted(r["event_id"] for r in LG.read_lake(spark, root, **kw).collect())


@pytest.fixture()
def root(spark, tmp_path):
    write = LG.accounted_writer(str(tmp_path), 86_400)
    for i, lines in enumerate(BATCHES):
        write(batch(spark, lines), i)
    return str(tmp_path)


def test_every_line_has_one_fate(spark, root):
    assert ledger_rows(spark, root) == WANT
    assert lake_ids(spark, root) == [1, 2, 4, 5, 7, 8]
    bad = [r["value"] for r in LG.read_rows(spark, root, "quarantined").collect()]
    assert sorted(map(str, bad)) == sorted(map(str, ["{broken", None, line(None, 3), line(3, None), "x"]))
    assert sorted(r["event_id"] for r in LG.read_rows(spark, root, "late").collect()) == [5, 6]


def test_a_batch_that_runs_again_changes_nothing(spark, root):
    write = LG.accounted_writer(root, 86_400)
    before = sorted(map(repr, LG.read_lake(spark, root).collect()))
    for i in (2, 1, 0, 1):
        write(batch(spark, BATCHES[i], parts=1 + i), i)
    assert ledger_rows(spark, root) == WANT
    assert sorted(map(repr, LG.read_lake(spark, root).collect())) == before


def test_an_uncommitted_batch_is_not_read(spark, root):
    def hook(rows, batch_id):
        raise RuntimeError("lost")

    lines = [line(9, 102), line(8, 101)]
    with pytest.raises(RuntimeError, match="lost"):
        LG.accounted_writer(root, 86_400, hook=hook)(batch(spark, lines), 3)
    assert spark.read.parquet(f"{root}/rows/batch_id=3").count() == 2
    assert lake_ids(spark, root) == [1, 2, 4, 5, 7, 8] and len(ledger_rows(spark, root)) == 3
    seen = []
    LG.accounted_writer(root, 86_400, hook=lambda rows, b: seen.append((b, rows.count())))(batch(spark, lines), 3)
    assert lake_ids(spark, root) == [1, 2, 4, 5, 7, 8, 9] and seen == [(3, 1)]
    assert lake_ids(spark, root, upto_batch=1) == [1, 2, 4, 5]


def test_readers_prune_partitions(spark, root):
    df = LG.read_lake(spark, root, upto_batch=1, silo="silo-0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(c in filters for c in ("batch_id", "fate", "silo_id"))
    files = {f.rsplit("batch_id=", 1)[1].split("/")[0] for f in df.inputFiles()} if filters else set()
    assert df.select("batch_id").distinct().count() == 2 and files


def test_hot_id_and_empty_batches(spark, tmp_path):
    root = str(tmp_path)
    write = LG.accounted_writer(root, 86_400)
    assert LG.read_lake(spark, root).count() == 0
    write(batch(spark, []), 0)
    write(batch(spark, [line(1, 1)] * 500 + [line(2, 1)] + ["broken"] * 300, parts=8), 1)
    write(batch(spark, []), 2)
    assert ledger_rows(spark, root) == [(0, 0, 0, 0, 0), (801, 2, 300, 0, 499), (0, 0, 0, 0, 0)]
