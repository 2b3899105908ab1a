"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share.

    That is spark.checkpoint.dir.  Where it is unset, a local master (tests) takes a temporary folder and a cluster
    its warehouse, never a folder of one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        top = tempfile.mkdtemp(prefix="ledgerwave-") if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and the folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, with short lineage, safe from lost executors."""
    return stored_at(df)[0]
