"""Session helpers: one place for the Spark settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, app: str = "linkloom", shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session.  On a cluster, pass the existing session instead."""
    master = master or os.environ.get("LINKLOOM_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("LINKLOOM_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LINKLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read it and
    never override it.  Only on a local master, where driver and executors are one
    process, do we pick a fresh folder when it is unset; elsewhere that folder
    would be a different disk on each machine, so it is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        sc = None
    current = sc.getCheckpointDir() if sc is not None and hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = _LOCAL_DIRS.get("dir") or tempfile.mkdtemp(
            prefix="linkloom-ckpt-", dir=os.environ.get("LINKLOOM_SCRATCH", "/tmp"))
        _LOCAL_DIRS["dir"] = conf_dir
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


_LOCAL_DIRS: dict = {}


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict:
    """Read the given parquet tables and register them as temp views."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
