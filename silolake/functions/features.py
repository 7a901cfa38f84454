"""The 22 transaction features as native column expressions.

Every feature is a JVM-side expression (no UDF); missing inputs become 0.0,
and nothing NULL/NaN leaves ``feature_vector``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolake.schemas import TX_TYPES

# Feature order of the model input.
FEATURE_COLS = [
    "log1p_amount",
    "balance_delta_orig",
    "balance_delta_dest",
    "zero_balance_orig",
    "zero_balance_dest",
    "type_CASH_IN",
    "type_CASH_OUT",
    "type_DEBIT",
    "type_PAYMENT",
    "type_TRANSFER",
    "velocity_1h_count",
    "velocity_24h_count",
    "velocity_168h_count",
    "velocity_1h_sum",
    "velocity_24h_sum",
    "velocity_168h_sum",
    "in_degree_24h",
    "log1p_amount_orig_balance_ratio",
    "log1p_amount_dest_balance_ratio",
    "is_flagged_fraud",
    "hour_sin",
    "hour_cos",
]
N_FEATURES = len(FEATURE_COLS)


def _c(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def log1p_amount(amount: Column) -> Column:
    return F.log1p(F.greatest(amount, F.lit(0.0)))


def balance_delta(old: Column, new: Column, amount: Column) -> Column:
    return old - new - amount


def zero_balance(old: Column) -> Column:
    return F.coalesce((old == 0).cast("double"), F.lit(0.0))


def type_onehot(type_col: Column) -> dict[str, Column]:
    return {f"type_{t}": F.coalesce((type_col == F.lit(t)).cast("double"), F.lit(0.0)) for t in TX_TYPES}


def amount_balance_ratio(amount: Column, balance: Column) -> Column:
    return F.when(balance > 0, log1p_amount(amount) / F.log1p(balance)).otherwise(F.lit(0.0))


def hour_cyclic(step: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.pmod(step, F.lit(24)) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def clean(c: Column) -> Column:
    """NaN / NULL → 0.0 at the feature boundary."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def scalar_feature_columns(df: DataFrame) -> dict[str, Column]:
    """Feature expressions that need only the row itself (no window)."""
    amount, step = _c(df, "amount"), _c(df, "step")
    old_o, new_o = _c(df, "oldbalanceOrg"), _c(df, "newbalanceOrig")
    old_d, new_d = _c(df, "oldbalanceDest"), _c(df, "newbalanceDest")
    out: dict[str, Column] = {}
    if amount is not None:
        out["log1p_amount"] = log1p_amount(amount)
        if old_o is not None and new_o is not None:
            out["balance_delta_orig"] = balance_delta(old_o, new_o, amount)
        if old_d is not None and new_d is not None:
            out["balance_delta_dest"] = balance_delta(old_d, new_d, amount)
        if old_o is not None:
            out["log1p_amount_orig_balance_ratio"] = amount_balance_ratio(amount, old_o)
        if old_d is not None:
            out["log1p_amount_dest_balance_ratio"] = amount_balance_ratio(amount, old_d)
    if old_o is not None:
        out["zero_balance_orig"] = zero_balance(old_o)
    if old_d is not None:
        out["zero_balance_dest"] = zero_balance(old_d)
    type_col = _c(df, "type")
    out.update(type_onehot(type_col if type_col is not None else F.lit("")))
    flagged = _c(df, "isFlaggedFraud")
    out["is_flagged_fraud"] = flagged.cast("double") if flagged is not None else F.lit(0.0)
    if step is not None:
        out["hour_sin"], out["hour_cos"] = hour_cyclic(step)
    return out


def with_scalar_features(df: DataFrame) -> DataFrame:
    cols = scalar_feature_columns(df)
    return df.withColumns({k: clean(v) for k, v in cols.items()})


def feature_array(df: DataFrame) -> Column:
    """The 22 columns (absent ones = 0.0) as ARRAY<FLOAT>."""
    return F.array(*[(clean(F.col(c)) if c in df.columns else F.lit(0.0)).cast("float") for c in FEATURE_COLS])


def feature_vector(df: DataFrame, label_col: str = "isFraud") -> DataFrame:
    """Assemble the 22 columns (absent ones = 0.0) into ``features ARRAY<FLOAT>`` + ``label FLOAT``."""
    arr = feature_array(df)
    label = F.coalesce(F.col(label_col).cast("float"), F.lit(0.0)) if label_col in df.columns else F.lit(0.0).cast("float")
    keep = [c for c in ("event_id", "silo_id", "step") if c in df.columns]
    return df.select(*keep, arr.alias("features"), label.cast("float").alias("label"))
