"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(master: str, app: str = "creativeaudit", **conf: str) -> SparkSession:
    """A session for local runs and benchmarks; clusters bring their own."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.ui.enabled", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and streaming state.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local, as in tests on one machine, a temporary folder is
    made; on a cluster executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if configured:
        path = configured
    elif spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    else:
        path = tempfile.mkdtemp(prefix="creativeaudit-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Cut lineage through the shared folder, so that lost executors can be replaced."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
