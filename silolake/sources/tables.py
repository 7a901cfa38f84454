"""Driver tables → the canonical transaction and update tables.

The driver ships TPC-H-like tables plus ``events`` and ``embeddings``. These
views give them the PaySim transaction layout and the model-update layout, so
every operator downstream reads real, growing tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Base instant of ``step`` (hours) for the events view, and the
# order-priority / event-type → transaction-type mappings.
EVENTS_BASE_MICROS = 1704067200000000  # 2024-01-01 00:00:00 UTC
LINEITEM_BASE_DATE = "1995-01-01"
EVENT_TYPE_TO_TX = {"view": "PAYMENT", "click": "CASH_IN", "purchase": "TRANSFER", "error": "CASH_OUT"}
PRIORITY_TO_TX = {"1-URGENT": "TRANSFER", "2-HIGH": "CASH_OUT", "3-MEDIUM": "PAYMENT", "4-NOT SPECIFIED": "CASH_IN"}
UPDATES_PER_ROUND = 10
EMBED_BASE_TS = "2024-01-01 00:00:00"
ROUND_SECONDS = 600
DEADLINE_SECONDS = 480
ARRIVAL_SPREAD_SECONDS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map_type(col, mapping: dict, default: str = "DEBIT"):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, v) if expr is None else expr.when(col == k, v))
    return expr.otherwise(default)


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transactions; step = hours since 2024-01-01."""
    e = table(spark, sf_dir, "events")
    bal = ((F.col("event_id") * 37) % 5000).cast("double")
    dest_bal = ((F.col("event_id") % 3) * 1000).cast("double")
    fraud = (F.col("event_type").isin("purchase", "error") & (F.col("value") > 150)) | (F.col("event_id") % 997 == 0)
    return e.select(
        F.col("event_id"),
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EVENTS_BASE_MICROS)) / F.lit(3600000000))
        .cast("int").alias("step"),
        _map_type(F.col("event_type"), EVENT_TYPE_TO_TX).alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        bal.alias("oldbalanceOrg"),
        F.greatest(bal - F.col("value"), F.lit(0.0)).alias("newbalanceOrig"),
        F.concat(F.lit("M"), ((F.col("event_id") * 7919) % 97).cast("string")).alias("nameDest"),
        dest_bal.alias("oldbalanceDest"),
        (dest_bal + F.col("value")).alias("newbalanceDest"),
        fraud.cast("int").alias("isFraud"),
        (F.col("value") > 300).cast("int").alias("isFlaggedFraud"),
    )


def lineitem_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a unique ``event_id``; (orderkey, linenumber) alone is not unique.

    The window's clustering (orderkey, linenumber) is satisfied by hash
    partitioning on orderkey, so the following join with ``orders`` reuses
    this exchange instead of shuffling lineitem a second time.
    """
    li = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        "l_shipdate", "l_returnflag", "l_linestatus")
    rn = F.row_number().over(w)
    return li.withColumn("event_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + rn)


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ (orders ⋈ customer) ⋈ supplier as transactions; step = days since 1995-01-01.

    Join strategies are left to AQE: customer/supplier are broadcast only when
    their measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    k = lineitem_keyed(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    # orders, with fewer and narrower rows than lineitem, are the side that is shuffled by customer
    oc = o.join(c, F.col("o_custkey") == c.c_custkey)
    j = (k.join(oc, k.l_orderkey == oc.o_orderkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey))
    price = F.col("l_extendedprice")
    sbal = F.greatest(F.col("s_acctbal"), F.lit(0.0))
    fraud = ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
             & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return j.select(
        "event_id",
        F.datediff(F.col("l_shipdate"), F.lit(LINEITEM_BASE_DATE).cast("date")).cast("int").alias("step"),
        _map_type(F.col("o_orderpriority"), PRIORITY_TO_TX).alias("type"),
        price.alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("oldbalanceOrg"),
        F.greatest(F.col("c_acctbal") - price, F.lit(0.0)).alias("newbalanceOrig"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("nameDest"),
        sbal.alias("oldbalanceDest"),
        (sbal + price).alias("newbalanceDest"),
        fraud.cast("int").alias("isFraud"),
        (price > 90000).cast("int").alias("isFlaggedFraud"),
    )


def transactions(spark: SparkSession, sf_dir: str, source: str = "lineitem") -> DataFrame:
    return tx_lineitem(spark, sf_dir) if source == "lineitem" else tx_events(spark, sf_dir)


def upd_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model updates in long form (round, silo_id, n, pos, v) from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        (F.col("vec_id") / UPDATES_PER_ROUND).cast("int").alias("round"),
        F.concat(F.lit("silo-"), (F.col("vec_id") % UPDATES_PER_ROUND).cast("string")).alias("silo_id"),
        (100 * (F.col("vec_id") % UPDATES_PER_ROUND + 1)).alias("n"),
        F.posexplode("embedding").alias("pos", "v"),
    ).withColumn("v", F.col("v").cast("double"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update records (``updates`` schema) from ``embeddings``: one per (round, silo).

    Arrivals spread over 720 s after the round opens (97 s apart per silo,
    shifted 31 s per round); the deadline is 480 s, so some rounds close on
    time with stragglers carried over, others need the deadline extension.
    """
    e = table(spark, sf_dir, "embeddings")
    rnd = (F.col("vec_id") / UPDATES_PER_ROUND).cast("int")
    offset = ((F.col("vec_id") % UPDATES_PER_ROUND) * 97 + rnd * 31) % ARRIVAL_SPREAD_SECONDS
    return e.select(
        rnd.alias("round"),
        F.concat(F.lit("silo-"), (F.col("vec_id") % UPDATES_PER_ROUND).cast("string")).alias("silo_id"),
        F.greatest(rnd - (F.col("vec_id") % 7 == 0).cast("int"), F.lit(0)).alias("base_version"),
        F.transform("embedding", lambda x: x.cast("double")).alias("delta"),
        (100 * (F.col("vec_id") % UPDATES_PER_ROUND + 1)).cast("bigint").alias("n_samples"),
        (F.col("label") / 10.0).cast("double").alias("train_loss"),
        ((F.col("vec_id") * 13) % 50 / 10.0).cast("double").alias("wall_time_s"),
        F.timestamp_seconds(F.unix_seconds(F.lit(EMBED_BASE_TS).cast("timestamp"))
                            + rnd * ROUND_SECONDS + offset).alias("arrived_at"),
    )


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round calendar (round, start_ts, deadline) for every round seen in the updates."""
    base = F.unix_seconds(F.lit(EMBED_BASE_TS).cast("timestamp"))
    r = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") / UPDATES_PER_ROUND).cast("int").alias("round")).distinct()
    return r.select(
        "round",
        F.timestamp_seconds(base + F.col("round") * ROUND_SECONDS).alias("start_ts"),
        F.timestamp_seconds(base + F.col("round") * ROUND_SECONDS + DEADLINE_SECONDS).alias("deadline"),
    )


def silos(spark: SparkSession, sf_dir: str, registered: int = 8) -> DataFrame:
    """Registered silos: the first ``registered`` silo ids, with registration sizes."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id") % UPDATES_PER_ROUND
    return (e.filter(k < registered)
            .select(F.concat(F.lit("silo-"), k.cast("string")).alias("silo_id"),
                    (1000 * (k + 1)).cast("bigint").alias("n_rows"))
            .distinct())
