"""Folders that the driver and all executors share, and tables written there between jobs."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that isn't set, a temporary one stands in, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lectern-")
    return f"{root.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write and reread: what follows reads the table and no longer depends on how df was made."""
    path = path or f"{shared_folder(df.sparkSession)}/table"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of what has been written: they go once neither Python nor the JVM refers to their plans."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that one task sorts or groups by a key, about.
ROWS = 1_000_000


def dealt(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """df by key, in as many parts as its rows (counted, if not given) ask for, so that a task's memory doesn't grow with the table; few
    rows stay as they are. What is then grouped, ordered or joined by the key isn't shuffled again."""
    parts = -(-(rows or df.count()) // ROWS)
    return df.repartition(parts, key) if parts > 1 else df


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
