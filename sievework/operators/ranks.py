"""Places in an order, without sorting a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.work import stored

#: Hex digits of a hash that name its bucket: a group is ranked in 16 ** DIGITS parts.
DIGITS = 3


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has (in any case), made of the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def hash_ranked(df: DataFrame, by: list[str], rank: Column, *ties: str) -> DataFrame:
    """Adds _r, the place from 1 of each row in the hash order of its group, and _n, the group's rows, in the stead of
    columns of these names.

    The leading digits of the hash cut a group into ordered buckets of even size.  Buckets are counted (at most
    16 ** DIGITS counts a group), their running sums are the buckets' offsets, and rows are ranked within a bucket: a
    group that holds most rows is spread over the cluster.  Null groups are groups."""
    df = df.drop("_r", "_n")
    h, b = free(df, "_h", "_b")
    keyed = df.withColumn(h, rank).withColumn(b, F.substring(h, 1, DIGITS))
    return _ranked(keyed, by, [h, *ties], b).select(*df.columns, "_r", "_n")


def order_ranked(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """As hash_ranked, for any order: rows are dealt by ranges of group and order, which the executors sample, and the
    ranges are the buckets.  They are stored, as a range drawn anew could be another one."""
    df = df.drop("_r", "_n")
    keys = free(df, *[f"_o{i}" for i in range(len(order))])
    keyed = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, order, strict=True)})
    (b,) = free(keyed, "_b")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(keyed.repartitionByRange(parts, *by, *keys).withColumn(b, F.spark_partition_id()), "ranges")
    return _ranked(dealt, by, keys, b).select(*df.columns, "_r", "_n")


def _ranked(keyed: DataFrame, by: list[str], order: list[str], bucket: str) -> DataFrame:
    """Adds _r and _n to rows whose bucket rises with the order."""
    c, kb, before, *ks = free(keyed, "_c", "_kb", "_before", *[f"_k{i}" for i in range(len(by))])
    whole = Window.partitionBy(*by)
    earlier = F.sum(c).over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sizes = keyed.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias(c))
    sizes = sizes.select(*[F.col(x).alias(k) for x, k in zip(by, ks, strict=True)], F.col(bucket).alias(kb), F.coalesce(earlier, F.lit(0)).alias(before), F.sum(c).over(whole).alias("_n"))
    same = [F.col(x).eqNullSafe(F.col(k)) for x, k in zip(by, ks, strict=True)]
    joined = keyed.join(sizes, reduce(lambda x, y: x & y, same, F.col(bucket) == F.col(kb)))
    place = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) + F.col(before)
    return joined.withColumn("_r", place)
