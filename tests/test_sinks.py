import numpy as np
from pyspark.sql import functions as F

from silolake.plans import registry as RG
from silolake.plans.train import register_fraud_score
from silolake.functions import model as MLP
from silolake.schemas import DRIFT_ALERTS, RESULTS, ROUNDS
from silolake.sources import lake as LK
from silolake.sources.tables import tx_events
from silolake.streaming import ingest as SI
from silolake.streaming.drift import drift_alert_writer

from conftest import SF_SMALL


def test_results_sink_and_scan(spark, tmp_path):
    rows = [("E1", r, 0.9, 0.5, 3, 0.1, "qwra", 42, 0.5) for r in range(1, 4)] + [("E3", 1, 0.8, 0.4, 3, 0.2, "fedavg", 42, 0.1)]
    df = spark.createDataFrame(rows, RESULTS)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        LK.results_sink(df, path, fmt)
        back = LK.results_scan(spark, path, fmt)
        assert back.count() == 4 and back.filter("experiment = 'E3'").count() == 1
        assert back.select("source_file").distinct().count() >= 2


def test_metrics_append_scan(spark, tmp_path):
    root = str(tmp_path)
    r = spark.createDataFrame([(2, 2, None, None, 0.8, 0.4, 5, 1.5, None), (1, 1, None, None, 0.7, 0.3, 5, 1.2, None)], ROUNDS)
    LK.metrics_append(r, root, "rounds", "run-a")
    LK.metrics_append(r, root, "rounds", "run-b")
    got = LK.metrics_scan(spark, root, "rounds", "run-a").collect()
    assert [x["round"] for x in got] == [1, 2]
    a = spark.createDataFrame([(1, "silo-1", 0.3, "log1p_amount", None)], DRIFT_ALERTS)
    LK.metrics_append(a, root, "drift_alerts", "run-a")
    assert LK.metrics_scan(spark, root, "drift_alerts").count() == 1


def test_a_long_run_is_few_folders_and_rounds_still_replace_themselves(spark, tmp_path):
    def rounds(ids, auc):
        return spark.createDataFrame([(r, r, None, None, auc, 0.4, 5, 1.5, None) for r in ids], ROUNDS)

    LK.metrics_append(rounds([*range(3000), None], 0.1), str(tmp_path), "rounds", "7")
    LK.metrics_append(rounds([5, None, 4000], 0.2), str(tmp_path), "rounds", "7")
    LK.metrics_append(rounds([5], 0.3), str(tmp_path), "rounds", "8")
    assert len(list(tmp_path.glob("rounds/run_id=7/*/*.parquet"))) < 20
    got = LK.metrics_scan(spark, str(tmp_path), "rounds", "7").collect()
    assert [r["round"] for r in got] == [None, *range(3000), 4000]
    assert {r["round"] for r in got if r["global_auc_roc"] == 0.2} == {5, None, 4000}
    assert [r["round"] for r in LK.metrics_scan(spark, str(tmp_path), "rounds", "8").collect()] == [5]


def test_model_registry(spark, tmp_path):
    path = str(tmp_path / "models")
    assert RG.save_version(spark, path, [0.0, 1.0], 0, {"kind": "init"}) == 1
    assert RG.save_version(spark, path, [0.5, 1.5], 1, {"kind": "qwra"}) == 2
    models = spark.read.parquet(path)
    latest = RG.latest_version(models).first()
    assert latest["version"] == 2 and latest["weights"] == [0.5, 1.5]
    assert RG.load_version(models, 1).first()["metadata"]["kind"] == "init"
    empty = models.filter("version > 99")
    assert RG.latest_version(empty).count() == 0


def test_lake_snapshot_and_sink(spark, tmp_path):
    tx = LK.with_batch_id(tx_events(spark, SF_SMALL).withColumn("silo_id", F.lit("silo-0")), 100)
    path = str(tmp_path / "lake")
    LK.write_lake(tx, path)
    full = LK.read_transactions(spark, path)
    snap = LK.read_transactions(spark, path, silo="silo-0", upto_batch=3)
    assert full.count() == tx.count()
    assert snap.count() == tx.filter("batch_id <= 3").count()
    filters = snap._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "silo_id" in filters and "batch_id" in filters


def test_parquet_stream_sink_and_alert_writer(spark, tmp_path):
    tx = tx_events(spark, SF_SMALL)
    src = SI.write_json_replay(tx, str(tmp_path / "src"), files=3)
    good, _ = SI.parse_transactions(SI.file_stream_source(spark, src, 1))
    q = SI.lakehouse_sink(good.withColumn("silo_id", F.lit("silo-0")), str(tmp_path / "lake"), str(tmp_path / "ck"),
                          trigger={"availableNow": True})
    q.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "lake")).count() == tx.count()
    alerts = good.filter("amount > 30").select(F.lit("silo-0").alias("silo_id"), F.col("amount").alias("psi"),
                                                F.lit("log1p_amount").alias("feature"))
    q2 = (alerts.writeStream.foreachBatch(drift_alert_writer(str(tmp_path / "alerts")))
          .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == tx.filter("amount > 30").count()


def test_fraud_score_sql(spark):
    sizes = [3, 2, 1]
    w = MLP.init_weights(sizes, 1)
    register_fraud_score(spark, w, sizes)
    df = spark.createDataFrame([([0.1, 0.2, 0.3],), ([1.0, -1.0, 0.5],)], "features array<double>")
    df.createOrReplaceTempView("fv")
    got = [r[0] for r in spark.sql("SELECT fraud_score(features) FROM fv").collect()]
    exp = MLP.forward(np.array([[0.1, 0.2, 0.3], [1.0, -1.0, 0.5]]), w, sizes)
    assert np.allclose(got, exp)
