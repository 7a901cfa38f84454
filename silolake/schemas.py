"""Canonical table schemas (Spark DDL)."""

TRANSACTIONS = (
    "event_id BIGINT, step INT, type STRING, amount DOUBLE, nameOrig STRING, oldbalanceOrg DOUBLE, "
    "newbalanceOrig DOUBLE, nameDest STRING, oldbalanceDest DOUBLE, newbalanceDest DOUBLE, "
    "isFraud INT, isFlaggedFraud INT"
)
FEATURES = "event_id BIGINT, silo_id STRING, step INT, features ARRAY<FLOAT>, label FLOAT"
SILO_STATS = "silo_id STRING, feature STRING, mean DOUBLE, std DOUBLE"
UPDATES = (
    "round INT, silo_id STRING, base_version INT, delta ARRAY<DOUBLE>, n_samples BIGINT, train_loss DOUBLE, "
    "wall_time_s DOUBLE, arrived_at TIMESTAMP"
)
SILOS = "silo_id STRING, n_rows BIGINT"
ROUNDS = (
    "round INT, version INT, start_ts TIMESTAMP, deadline TIMESTAMP, global_auc_roc DOUBLE, "
    "global_auc_pr DOUBLE, n_updates INT, wall_time_s DOUBLE, ts TIMESTAMP"
)
SILO_METRICS = (
    "round INT, silo_id STRING, n_samples BIGINT, train_loss DOUBLE, auc_roc DOUBLE, auc_pr DOUBLE, "
    "staleness INT, flagged INT, epsilon DOUBLE, psi DOUBLE"
)
DRIFT_ALERTS = "round INT, silo_id STRING, psi DOUBLE, feature STRING, ts TIMESTAMP"
MODELS = "version INT, round INT, weights ARRAY<DOUBLE>, metadata MAP<STRING,STRING>"
RESULTS = (
    "experiment STRING, round INT, auc_roc DOUBLE, auc_pr DOUBLE, n_updates INT, avg_loss DOUBLE, "
    "agg_kind STRING, seed INT, alpha DOUBLE"
)

# Transaction type vocabulary in feature order.
TX_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
