"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

UTC = "UTC"
#: compression of written intermediate tables
CODEC = "zstd"


def get_spark(app: str = "tokenflow", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests, benches and scripts.

    On a cluster the session comes from the launcher; only runtime SQL
    settings are applied there (``pin_session``).
    """
    master = f"local[{cpus or '*'}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", UTC)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
         .config("spark.driver.memory", os.environ.get("TOKENFLOW_DRIVER_MEM", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    pin_session(spark)
    return spark


def pin_session(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on: UTC session time zone and
    a reliable checkpoint folder."""
    spark.conf.set("spark.sql.session.timeZone", UTC)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local master may go without: it gets a
    fresh scratch folder. On a cluster a machine-local folder would leave every
    executor with its own part of a table, so a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext on the client
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if not conf:
            conf = _local_scratch(spark.conf.get("spark.master", ""))
            spark.conf.set("spark.checkpoint.dir", conf)
        return conf
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not conf:
        conf = _local_scratch(sc.master)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def _local_scratch(master: str) -> str:
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share "
                         f"(master {master!r} is not local)")
    return tempfile.mkdtemp(prefix="tokenflow-ckpt-", dir="/tmp")


def app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for written intermediate
    tables (used instead of any machine-local temp folder)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tokenflow/{name}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Runtime settings (``__`` for a dot) that hold inside only."""
    old = {k: spark.conf.get(k, None) for k in (n.replace("__", ".") for n in values)}
    for k, v in zip(old, values.values()):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy_shuffles(spark: SparkSession):
    """Shuffle files of a statement run inside go when it ends; elsewhere they stay
    until the driver happens to collect its garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")
