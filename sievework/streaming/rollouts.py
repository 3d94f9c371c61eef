"""Structured Streaming over rollout logs: an extension, as the logs grow while a run goes on."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_rollouts(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def once(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each request once; state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def rates(stream: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Verdict counts of tumbling windows."""
    v = F.col("verdict")
    return stream.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(v == "correct").alias("correct"), F.count_if(v == "incorrect").alias("incorrect"))


def replace_steps(stream: DataFrame, path: str, checkpoint: str, step: str = "step", attempt: str | int | None = None):
    """A step done again replaces what it wrote before.  Rows go to step, attempt and batch folders: batches of one
    attempt add up, a batch run again replaces itself, and older attempts of a step go once a newer one is written.

    attempt: a column, or the number of this run; without it each call is a newer attempt, so a call that was cut
    short is resumed with the number that it had.  Rows of an attempt older than one already seen are left out.  Rows
    without a step (null or empty) are one step; a null attempt is older than all others."""
    number = time.time_ns() if attempt is None else attempt

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        which = F.col(number) if isinstance(number, str) else F.lit(number)
        # a folder cannot tell an empty step from a null one, so both are one step; _step names it without a null
        folder = F.nullif(F.col(step).cast("string"), F.lit(""))
        named = {"_step": F.coalesce(F.concat(F.lit("="), folder), F.lit("")), "_attempt": F.coalesce(which.cast("long"), F.lit(-1))}
        rows = batch.withColumns(named).persist()
        newest = {r["_step"]: r["a"] for r in rows.groupBy("_step").agg(F.max("_attempt").alias("a")).collect()}  # a row a step of the batch
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        folders = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils  # spells nulls and escapes as the writer does
        old = []
        for s, a in newest.items():
            at = jvm.org.apache.hadoop.fs.Path(root, folders.getPartitionPathString(step, s[1:] if s else None))
            for f in fs.listStatus(at) if fs.exists(at) else []:
                seen = int(f.getPath().getName().split("=")[1])
                newest[s] = max(newest[s], seen)
                if seen < a:
                    old.append(f.getPath())
        best = F.create_map(*[x for s, a in newest.items() for x in (F.lit(s), F.lit(a))]) if newest else F.create_map().cast("map<string,bigint>")
        kept = rows.where(F.col("_attempt") == best[F.col("_step")]).withColumns({"attempt": F.col("_attempt"), "batch": F.lit(batch_id)}).drop("_step", "_attempt")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step, "attempt", "batch").parquet(path)
        for p in old:
            fs.delete(p, True)
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_steps(spark: SparkSession, path: str, step: str = "step") -> DataFrame:
    """What replace_steps wrote, each step's newest attempt only: older ones lie there while a write goes on."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(F.col(step).alias("_s")).agg(F.max("attempt").alias("_a"))
    return rows.join(last, F.col(step).eqNullSafe(F.col("_s")) & (F.col("attempt") == F.col("_a"))).drop("_s", "_a")
