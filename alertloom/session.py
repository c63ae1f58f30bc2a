"""Session defaults and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "alertloom", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and single-node use; on a cluster, spark-submit sets these."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset in local mode (tests) a folder of this machine is chosen; on a cluster that raises ValueError.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        ctx = spark.sparkContext
        path = ctx.getCheckpointDir()
        if not path:
            if not re.fullmatch(r"local(\[.*\])?", ctx.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = "file://" + tempfile.mkdtemp(prefix="alertloom-")
            ctx.setCheckpointDir(path)
    return path


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/alertloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder for what a query stores."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; a lost executor re-reads it, and the
    parquet statistics let the planner pick join strategies from real sizes."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.materialized_at = path
    return table


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize made, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table.materialized_at)


def drop_tables(spark: SparkSession) -> None:
    """Removes all tables of this application; call it when no result is read any more."""
    _delete(spark, _tables(spark))
