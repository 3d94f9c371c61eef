"""Tables that are written, audited and only then published, as numbered versions in one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.operators.checks import CheckFailed


def _folder(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which knows all addresses that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, source: str, to: str) -> None:
    """Fails where `to` exists (the rename of a plain file system would move the source below it)."""
    hadoop, (fs, at) = spark._jvm.org.apache.hadoop.fs, _folder(spark, source)
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(at, _folder(spark, to)[1], none)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, from the first; staged and other folders are none."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; a reader keeps the one that it began with, as versions are never changed."""
    if not (known := versions(spark, path)):
        raise FileNotFoundError(f"nothing is published in {path}")
    return spark.read.parquet(f"{path}/v{known[-1]}")


def publish(df: DataFrame, path: str, rules: dict[str, Column], *audits: Callable[[DataFrame], DataFrame], least: int = 0) -> int:
    """Writes df as the next version below path, if it passes, and returns the version's number.

    Rules are columns that hold for a good row (null: broken).  They are counted while the staged table is written, in no
    pass of their own; a task that runs twice may count a broken row twice, but never makes a broken table a good one.
    Audits are checks of the whole table, such as those of `checks`; they read the staged table, so what is published is
    what they saw.  `least` is the fewest rows.  Where one fails, CheckFailed names all that did, the staged table goes and
    the version before stays.  Publishing is one rename: of two at once with the same number, one fails.

    An empty table passes unless `least` says otherwise.  Names of rules may be those of columns."""
    spark = df.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    seen = Observation()
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_b{i}") for i, ok in enumerate(rules.values())]
    number = max(versions(spark, path), default=0) + 1
    fs, at = _folder(spark, staged)
    try:
        df.observe(seen, F.count(F.lit(1)).alias("_rows"), *broken).write.parquet(staged)
        counts = seen.get
        failed = [f"{name}: {counts[f'_b{i}']} violations" for i, name in enumerate(rules) if counts[f"_b{i}"]]
        if counts["_rows"] < least:
            failed.append(f"rows: {counts['_rows']} of at least {least}")
        table = spark.read.schema(df.schema).parquet(staged)
        for audit in audits:
            failed += [f"{r['name']}: {r['detail']}" for r in audit(table).where("not passed").collect()]  # one row a check
        if failed:
            raise CheckFailed("; ".join(failed))
        _rename(spark, staged, f"{path}/v{number}")
    finally:
        if fs.exists(at):
            fs.delete(at, True)
    return number
