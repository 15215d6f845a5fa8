"""Tables that cut lineage: written once to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that drops a query's shuffle files as soon as it has ended, instead of when the driver next collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all runs in one process (tests) a
    temporary folder is made and remembered in the session; on a cluster it is an error.
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
    return f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    Tasks that are lost later re-read the files instead of running the whole lineage again.  The job runs as this is called; its
    shuffle files go when it ends, so that no two steps' files lie on disk together.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    out = df.write.option("compression", codec)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        (out.partitionBy(*by) if by else out).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
