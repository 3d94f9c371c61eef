"""Labels put back on raw rows, and verdicts on rollouts, with the counts that must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, labels: DataFrame, key: list[str], label: str) -> DataFrame:
    """Rows with their label.  A row without a label, a label without a row, or one with two of either fails."""
    if label in rows.columns:
        raise ValueError(f"the rows already have a column {label!r}")
    count = F.count(F.lit(1))
    left = rows.groupBy(*key).agg(count.alias("_rows"))
    right = labels.groupBy(*key).agg(count.alias("_labels"), F.min(F.struct(label)).alias("_l"))
    # the checks are part of the label's expression, so no plan that returns labels can leave them out
    joined = left.join(right, key, "full_outer")
    whole = F.col("_rows").eqNullSafe(1) & F.col("_labels").eqNullSafe(1)
    checked = joined.select(*key, F.when(whole, F.col("_l")).otherwise(F.raise_error(F.lit("rows and labels don't match one to one"))).getField(label).alias(label))
    return checked.join(rows, key, "left").select(*rows.columns, label)


def row_identity(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a row as JSON with sorted names, nulls written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in leave]), {"ignoreNullFields": "false"}), 256)


def attach_by_identity(rows: DataFrame, labelled: DataFrame, label: str) -> DataFrame:
    """Labels of exact copies stored elsewhere.  A row that no labelled row equals fails; of several labels of equal
    rows the smallest is taken."""
    known = labelled.select(row_identity(labelled, (label,)).alias("_key"), label).groupBy("_key").agg(F.min(F.struct(label)).alias("_l"))
    joined = rows.withColumn("_key", row_identity(rows)).join(known, "_key", "left")
    found = F.when(F.col("_l").isNotNull(), F.col("_l")).otherwise(F.raise_error(F.lit("no identical row among the labelled ones")))
    return joined.select(*rows.columns, found.getField(label).alias(label))


def with_verdicts(rollouts: DataFrame, verdicts: DataFrame, key: list[str], verdict: str, n: int) -> DataFrame:
    """Rollouts with the sorted array of their n verdicts; any other number fails."""
    per = verdicts.groupBy(*key).agg(F.array_sort(F.collect_list(verdict)).alias("verdicts"))
    right = F.coalesce(F.size("verdicts"), F.lit(0)) == n
    checked = F.when(right, F.col("verdicts")).otherwise(F.raise_error(F.lit(f"a rollout without exactly {n} verdicts")))
    return rollouts.join(per, key, "left").withColumn("verdicts", checked)
