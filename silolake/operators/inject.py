"""Attack and drift injectors (evaluation only), seeded by key — never ``rand()``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silolake.functions.rand import hash01


def inject_label_flip(df: DataFrame, frac: float, seed: int = 42, label_col: str = "isFraud",
                      silo: str | None = None, key: str = "event_id") -> DataFrame:
    """With probability ``frac`` set label to 1 − label; frac = 1 flips all; optionally one silo only."""
    hit = hash01(seed, "flip", key) < F.lit(float(frac))
    if silo is not None:
        hit = hit & (F.col("silo_id") == F.lit(silo))
    return df.withColumn(label_col, F.when(hit, F.lit(1) - F.col(label_col)).otherwise(F.col(label_col)))


def inject_drift(df: DataFrame, step_threshold: int, amount_scale: float = 3.0, amount_col: str = "amount") -> DataFrame:
    """amount × scale where step ≥ threshold (batch or stream)."""
    return df.withColumn(amount_col, F.when(F.col("step") >= step_threshold, F.col(amount_col) * F.lit(amount_scale))
                         .otherwise(F.col(amount_col)))


def inject_model_poison(updates: DataFrame, silo: str | None, gamma: float = 5.0, delta_col: str = "delta") -> DataFrame:
    """delta · (−γ) for one silo's updates (all when ``silo`` is None)."""
    poisoned = F.transform(delta_col, lambda x: x * F.lit(-float(gamma)))
    hit = F.lit(True) if silo is None else (F.col("silo_id") == F.lit(silo))
    return updates.withColumn(delta_col, F.when(hit, poisoned).otherwise(F.col(delta_col)))
