import numpy as np
from pyspark.sql import functions as F

from silolake.operators.holdout import public_holdout, split_disjoint_check, temporal_holdout
from silolake.sources.tables import tx_events

from conftest import SF_SMALL


def test_public_holdout_quotas_and_disjoint(spark):
    tx = tx_events(spark, SF_SMALL)
    s = public_holdout(tx, 100)
    n = {r["type"]: r["count"] for r in tx.groupBy("type").count().collect()}
    total = sum(n.values())
    got = {r["type"]: r["count"] for r in s.filter("split = 'public'").groupBy("type").count().collect()}
    assert sum(got.values()) == 100
    assert all(0 <= got.get(t, 0) - int(100 * c // total) <= 1 for t, c in n.items())
    chk = split_disjoint_check(s, s.filter("split = 'public'"), s.filter("split = 'train'")).first()
    assert chk["n_overlap"] == 0 and chk["n_missing"] == 0 and chk["n_a"] + chk["n_b"] == chk["n_total"] == total
    again = {r["event_id"] for r in public_holdout(tx.repartition(5), 100).filter("split = 'public'").collect()}
    assert again == {r["event_id"] for r in s.filter("split = 'public'").collect()}


def test_temporal_holdout_cut(spark):
    tx = tx_events(spark, SF_SMALL)
    steps = np.array([r["step"] for r in tx.select("step").collect()])
    cut = np.percentile(steps, 90)
    s = temporal_holdout(tx, 0.1)
    assert s.filter("split = 'test'").count() == int((steps > cut).sum())
    assert s.filter("split = 'test'").agg(F.min("step")).first()[0] > cut
