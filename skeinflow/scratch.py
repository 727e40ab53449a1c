"""Intermediate tables in the folder that all executors share.

A table written here cuts the lineage: a lost executor costs a re-read, not a
recomputation.  The folder is spark.checkpoint.dir; where that is unset, a single
machine makes a local one, and a cluster is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a local one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="skeinflow-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinflow/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._skeinflow_path = path
    return kept


def drop(df: DataFrame) -> None:
    """Delete a table made by keep() that no later plan reads."""
    path = getattr(df, "_skeinflow_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
