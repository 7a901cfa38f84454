"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "false",
}


def get_spark(app: str = "silolake", master: str | None = None, shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Builder with the settings every job here relies on (UTC, AQE, Arrow, no UI)."""
    master = master or os.environ.get("SILOLAKE_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.environ.get("SILOLAKE_SHUFFLE_PARTITIONS", 8))
    conf.setdefault("spark.driver.memory", os.environ.get("SILOLAKE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting comes from the deployment and must be there; only a
    local master may go without, and then gets a scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="silolake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def write_table(df: DataFrame, name: str = "table") -> str:
    """Write ``df`` as Parquet under the shared checkpoint folder; returns the path."""
    import uuid

    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/silolake-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # these files are read by this application only
    return path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Lineage ends at the written files (never localCheckpoint: they survive
    executor loss); the read-back is columnar, so later plans get column
    pruning and filter pushdown on it.
    """
    return df.sparkSession.read.parquet(write_table(df, name))


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``silolake`` importable in Python workers (``addPyFile`` of a zip of the package).

    Needed wherever a pandas UDF / mapInPandas / applyInPandas closure lives in
    this package; done once per SparkContext.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="silolake-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


_TABLES: dict[tuple, str] = {}


def is_materialized(spark: SparkSession, key: tuple) -> bool:
    """Whether :func:`materialized` has written the table of ``key``."""
    return (spark.sparkContext.applicationId, *key) in _TABLES


def materialized(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A table written once per application under the checkpoint folder, keyed by ``key``.

    Round-invariant inputs (the silo-partitioned lake, the feature table) are
    read by many jobs; the first caller writes them (``build()`` → Parquet),
    later callers read the files.
    """
    full = (spark.sparkContext.applicationId, *key)
    if full not in _TABLES:
        _TABLES[full] = write_table(build(), name=str(key[0]))
    return spark.read.parquet(_TABLES[full])
