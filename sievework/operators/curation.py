"""Pools of cases: reasons instead of silent drops, deduplication, conflicts, limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.textkeys import blank
from sievework.operators.ranks import free


def missing_reason(fields: dict[str, Column]) -> Column:
    """`missing_field:a,b` for blank fields in their order, else empty."""
    names = F.concat_ws(",", *[F.when(blank(c), F.lit(n)) for n, c in fields.items()])
    return F.when(names == "", F.lit("")).otherwise(F.concat(F.lit("missing_field:"), names))


def first_reason(rules: list[tuple[Column, Column | str]]) -> Column:
    """The reason of the first rule that holds; empty if none does."""
    out = F.lit("")
    for test, reason in reversed(rules):
        out = F.when(test, reason if isinstance(reason, Column) else F.lit(reason)).otherwise(out)
    return out


def exclusion_table(df: DataFrame, by: str, reason: str = "reason") -> DataFrame:
    """Rows for each group and reason; duplicates, whose reasons name a row, are folded."""
    folded = F.when(F.col(reason).startswith("duplicate_record_of:"), F.lit("duplicate_record")).otherwise(F.col(reason))
    return df.groupBy(by, folded.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def pool(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the first in source order, with the number of rows.  An aggregate, so a frequent key is
    combined before the shuffle; the places of all rows are those of pool_sources."""
    rest = [c for c in df.columns if c not in key]
    agg = df.groupBy(*key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    return agg.select(*key, *[F.col(f"first.{c}").alias(c) for c in rest], "n_rows")


def pool_sources(df: DataFrame, key: list[str], source: str, order: str) -> DataFrame:
    """(key, source_ids): the sources of each key's rows, in source order.  A key's rows meet in one array, so this is
    for keys with a bounded number of copies; with more, join the rows to `pool` by key."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(source).alias("s"))))
    return df.groupBy(*key).agg(F.transform(listed, lambda x: x["s"]).alias("source_ids"))


def pool_stats(df: DataFrame, key: list[str], reason: str = "reason") -> DataFrame:
    """One row: records read, eligible ones, distinct keys among them and duplicates."""
    keyed = df.where(F.col(reason) == "").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    sums = keyed.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("eligible_records"), F.count(F.lit(1)).alias("unique_requests"))
    read = df.agg(F.count(F.lit(1)).alias("records_read"))  # one row each
    return read.join(sums).select("records_read", "eligible_records", "unique_requests", (F.col("eligible_records") - F.col("unique_requests")).alias("duplicate_records"))


def duplicate_reason(df: DataFrame, key: list[str], id_: str, reason: str = "reason") -> DataFrame:
    """Rows not yet excluded whose key an eligible smaller id has get `duplicate_record_of:<id>`.  Null keys are equal."""
    first, *ks = free(df, "_least", *[f"_k{i}" for i in range(len(key))])
    least = df.where(F.col(reason) == "").groupBy(*key).agg(F.min(id_).alias(first))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(key, ks, strict=True)])
    out = df.join(least.select(first, *[F.col(c).alias(k) for c, k in zip(key, ks, strict=True)]), same, "left")
    later = (F.col(reason) == "") & (F.col(id_) > F.col(first))
    return out.withColumn(reason, F.when(later, F.concat(F.lit("duplicate_record_of:"), F.col(first).cast("string"))).otherwise(F.col(reason))).select(*df.columns)


def label_conflicts(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys with more than one distinct label over all rows, with the labels."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)


def drop_long_anchors(df: DataFrame, anchor: str, size: str, most: int) -> DataFrame:
    """All rows of an anchor go if one of them is over the limit."""
    over = df.where(F.col(size) > most).select(anchor).distinct()
    return df.join(over, anchor, "left_anti")


def overlap(df: DataFrame, dataset: str, group: str) -> DataFrame:
    """Groups that each pair of datasets shares."""
    d = df.select(F.col(dataset).alias("d"), F.col(group).alias("g")).distinct()
    # datasets are few, groups many: a group's datasets are listed once and paired there
    listed = d.groupBy("g").agg(F.array_sort(F.collect_set("d")).alias("ds")).where(F.size("ds") > 1)
    pairs = listed.select(F.explode("ds").alias("dataset_a"), "ds").select("dataset_a", F.explode("ds").alias("dataset_b")).where("dataset_a < dataset_b")
    return pairs.groupBy("dataset_a", "dataset_b").agg(F.count(F.lit(1)).alias("n_groups"))


def drift(now: DataFrame, saved: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows that one side lacks or that differ."""
    a = now.select(F.col(key), F.struct(*values).alias("now"))
    b = saved.select(F.col(key), F.struct(*values).alias("saved"))
    return a.join(b, key, "full_outer").where(~F.col("now").eqNullSafe(F.col("saved")))


def with_fallback(base: DataFrame, other: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """A column of another run where it has the row."""
    return base.join(other.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(text)))
