"""Tables in the shared folder, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. A local master may go without: it gets a folder of its own.

    On a cluster an executor's local disk is no place for tables that others read, so an unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/strata-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs nothing but a reread."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition) if partition else out).parquet(path)
    return spark.read.parquet(path) if partition else spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the application's stored tables, once nothing reads its results any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
