"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests) a temporary folder is made and remembered in the session; on a
    cluster it is an error, as executors would not see a local folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.shared.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.shared.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back: tasks lost later re-read the files.

    The job runs as this is called.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
