"""Shared working tables: lineage is cut by writing Parquet below spark.checkpoint.dir and reading it again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for working tables, from spark.checkpoint.dir.  Only where that is unset (tests), a local one."""
    conf = spark.sparkContext.getConf()
    known = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written once and read back: later reads survive lost executors and give the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
