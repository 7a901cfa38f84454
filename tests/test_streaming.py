import json

import numpy as np
from pyspark.sql import functions as F

from silolake.functions.features import with_scalar_features
from silolake.operators.drift import bin_index, quantile_edges
from silolake.schemas import TRANSACTIONS
from silolake.sources.tables import tx_events
from silolake.streaming import drift as SD
from silolake.streaming import ingest as SI

from conftest import SF_SMALL

TIMEOUT = 90


def _replay(spark, tmp_path):
    """Ordered JSON files of tx_events + one extra file: 5 % re-sent ids, a malformed line, a late new row."""
    tx = tx_events(spark, SF_SMALL)
    src = str(tmp_path / "src")
    glob = SI.write_json_replay(tx, src, files=4)
    rows = [r.asDict() for r in tx.orderBy("event_id").collect()]
    extra = [json.dumps(r) for r in rows[:: 20]]
    extra.append("{not json")
    late = dict(rows[0], event_id=10 ** 9, step=0)
    extra.append(json.dumps(late))
    import os
    os.makedirs(f"{src}/zz-extra")
    with open(f"{src}/zz-extra/extra.txt", "w") as f:
        f.write("\n".join(extra) + "\n")
    return tx, rows, glob, len(extra)


def test_stream_ingest_accounts_for_every_row(spark, tmp_path):
    tx, rows, src, n_extra = _replay(spark, tmp_path)
    raw = SI.file_stream_source(spark, src, max_files_per_trigger=1)
    good, bad = SI.parse_transactions(raw)
    lake = str(tmp_path / "lake")
    q1 = SI.lakehouse_sink_foreach_batch(SI.stream_dedup(good, "2 days").withColumn("silo_id", F.lit("silo-0")),
                                         lake, str(tmp_path / "ck1"), trigger={"availableNow": True})
    q2 = (bad.writeStream.format("memory").queryName("quarantine").option("checkpointLocation", str(tmp_path / "ck2"))
          .trigger(availableNow=True).start())
    q1.awaitTermination(TIMEOUT)
    q2.awaitTermination(TIMEOUT)
    out = spark.read.parquet(lake)
    n_in = len(rows) + n_extra
    n_out = out.count()
    n_quarantined = spark.table("quarantine").count()
    dropped = n_in - n_out - n_quarantined  # duplicates + late
    assert n_quarantined == 1
    assert n_out == len(rows) and out.select("event_id").distinct().count() == len(rows)
    assert dropped == len(rows[::20]) + 1
    # replay of a batch overwrites only its own partition
    assert out.select("batch_id").distinct().count() >= 4


def test_stream_features_equal_batch(spark, tmp_path):
    tx, rows, src, _ = _replay(spark, tmp_path)
    raw = SI.file_stream_source(spark, src, 2)
    good, _ = SI.parse_transactions(raw)
    feats = with_scalar_features(SI.stream_dedup(good, "2 days")).drop("event_time")
    q = (feats.writeStream.format("memory").queryName("sfeat").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(TIMEOUT)
    batch = with_scalar_features(tx)
    streamed = spark.table("sfeat").select(*batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_windowed_drift_stream_equals_batch(spark, tmp_path):
    tx, rows, src, _ = _replay(spark, tmp_path)
    src = SI.write_json_replay(tx, str(tmp_path / "closed"), files=4, close_after=240)
    base = tx.withColumn("value", F.log1p("amount")).withColumn("silo_id", F.lit("silo-0")) \
        .withColumn("feature", F.lit("log1p_amount"))
    edges = quantile_edges(base.filter("step < 240"), "value", ["silo_id", "feature"])
    raw = SI.file_stream_source(spark, src, 1)
    good, _ = SI.parse_transactions(raw)
    s = SI.stream_dedup(good, "3 days").withColumn("value", F.log1p("amount")) \
        .withColumn("silo_id", F.lit("silo-0")).withColumn("feature", F.lit("log1p_amount"))
    hist = SD.drift_histogram_stream(SD.with_bins(s, edges, ["silo_id", "feature"]), ["silo_id", "feature"], "1 day")
    q = (hist.writeStream.format("memory").queryName("dhist").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(TIMEOUT)
    got = {(r["window"]["start"], r["bin"]): r["cnt"] for r in spark.table("dhist").collect()}
    b = SI.with_event_time(base).join(edges, ["silo_id", "feature"]).withColumn("bin", bin_index(F.col("value"), F.col("edges")))
    exp = {(r["start"], r["bin"]): r["cnt"] for r in
           b.groupBy(F.window("event_time", "1 day")["start"].alias("start"), "bin").agg(F.count(F.lit(1)).alias("cnt")).collect()}
    assert got == exp  # the closing record closes every window


def test_stateful_monitor_matches_numpy(spark, tmp_path):
    tx, rows, src, _ = _replay(spark, tmp_path)
    base = tx.withColumn("value", F.log1p("amount")).withColumn("silo_id", F.lit("silo-0")) \
        .withColumn("feature", F.lit("log1p_amount"))
    ref = base.filter("step < 240")
    edges = quantile_edges(ref, "value", ["silo_id", "feature"])
    e = np.array(edges.first()["edges"])
    ref_bins = np.array([r["bin"] for r in ref.join(edges, ["silo_id", "feature"])
                         .select(bin_index(F.col("value"), F.col("edges")).alias("bin")).collect()])
    share = np.bincount(ref_bins, minlength=20) / len(ref_bins)
    raw = SI.file_stream_source(spark, src, 1)
    good, _ = SI.parse_transactions(raw)
    s = SI.stream_dedup(good, "40 days").withColumn("value", F.log1p("amount") * 3) \
        .withColumn("silo_id", F.lit("silo-0")).withColumn("feature", F.lit("log1p_amount"))
    binned = SD.with_bins(s, edges, ["silo_id", "feature"])
    alerts = SD.drift_monitor_stateful(binned, ["silo_id", "feature"], {("silo-0", "log1p_amount"): share.tolist()},
                                       window_size=200)
    q = (alerts.writeStream.format("memory").queryName("alerts").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(TIMEOUT)
    got = spark.table("alerts").collect()
    assert got and all(r["psi"] > 0.2 and r["n"] >= 100 for r in got)
    assert len(e) == 21


def test_registered_monitor_windows_every_silo_and_feature(spark, monkeypatch):
    """W is 50,000 as registered; with a small one the same plan alerts for several silos and features."""
    from silolake.plans.catalog import PSI_FEATURES, QUERIES
    real, seen = SD.drift_monitor_stateful, {}

    def small(binned, keys, shares, window_size):
        seen.update(shares=shares, window_size=window_size)
        return real(binned, keys, shares, window_size=40)

    monkeypatch.setattr(SD, "drift_monitor_stateful", small)
    got = QUERIES["drift_monitor_stateful"](spark, SF_SMALL).collect()
    assert seen["window_size"] == 50_000
    assert {f for _, f in seen["shares"]} == set(PSI_FEATURES) and all(abs(sum(v) - 1) < 1e-9 and len(v) == 20 for v in seen["shares"].values())
    assert len({s for s, _ in seen["shares"]}) > 1 and len({r["silo_id"] for r in got}) > 1 and all(20 <= r["n"] <= 40 for r in got)


def test_kafka_options():
    o = SI.kafka_options("bank-1.tx", "broker:9092", max_offsets_per_trigger=1000)
    assert o["subscribe"] == "bank-1.tx" and o["startingOffsets"] == "earliest" and o["failOnDataLoss"] == "false"
    assert o["maxOffsetsPerTrigger"] == "1000"


def test_velocity_stream(spark, tmp_path):
    """Every (window, account) of the batch answer comes out of the closed replay."""
    tx = tx_events(spark, SF_SMALL)
    src = SI.write_json_replay(tx, str(tmp_path / "closed"), files=3, close_after=240)
    good, bad = SI.parse_transactions(SI.file_stream_source(spark, src, 2))
    v = SD.velocity_stream(SI.stream_dedup(good, "3 days"))
    q = (v.writeStream.format("memory").queryName("vel").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(TIMEOUT)
    batch = SD.velocity_stream(SI.with_event_time(tx))
    key = lambda df: {(r["window"]["start"], r["nameOrig"]): r["velocity_count"] for r in df.collect()}
    assert key(spark.table("vel")) == key(batch)
