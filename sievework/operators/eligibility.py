"""What may enter a run: taxonomies, hold-outs, label conflicts, allow-lists and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.order_stats import quantile_cont


class NotAllowed(ValueError):
    """A table breaks a condition that it must fulfil before anything is made of it."""


def _some(bad: DataFrame, *columns: str) -> list[tuple]:
    """A few of the offending keys, for a message."""
    return [tuple(r) for r in bad.select(*columns).distinct().orderBy(*columns).limit(10).collect()]


def select_run(rows: DataFrame, id_: str, dataset: str, datasets: list[str] | None = None, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The rows of a run in the order of dataset and id: of some datasets, of some ids (each must be among them), and
    with a limit, which is the caller's, the first of them."""
    out = rows if datasets is None else rows.where(F.col(dataset).isin(datasets))
    if ids is not None:
        wanted = ids.select(F.col(id_).alias("_id")).distinct()
        if missing := _some(wanted.join(out, F.col("_id") == out[id_], "left_anti"), "_id"):
            raise NotAllowed(f"ids that the rows don't have: {missing}")
        out = out.join(wanted, out[id_] == F.col("_id"), "left_semi")
    out = out.orderBy(dataset, id_)
    return out if limit is None else out.limit(limit)


def resolve_types(cases: DataFrame, taxonomy: DataFrame, dataset: str, label: str) -> DataFrame:
    """Adds type_id and type_status (adopted or excluded) from a taxonomy of (dataset, alias, type_id, status), in which
    an alias stands once.  A label that it doesn't know stops the run."""
    twice = taxonomy.groupBy("dataset", "alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if known := _some(twice, "dataset", "alias"):
        raise NotAllowed(f"aliases with several types: {known}")
    dim = taxonomy.select(F.col("dataset").alias("_d"), F.col("alias").alias("_a"), "type_id", F.col("status").alias("type_status"))
    out = cases.join(dim, (F.col(dataset) == F.col("_d")) & (F.col(label) == F.col("_a")), "left").drop("_d", "_a")
    if unknown := _some(out.where("type_status is null"), dataset, label):
        raise NotAllowed(f"labels outside the taxonomy: {unknown}")
    return out


def hold_out(cases: DataFrame, held: DataFrame, id_: str, reason: str, name: str = "held_out") -> DataFrame:
    """Cases of a list get the reason, unless they have one already."""
    listed = held.select(F.col(id_).alias("_h")).distinct()
    out = cases.join(listed, cases[id_] == F.col("_h"), "left")
    return out.withColumn(reason, F.when((F.col(reason) == "") & F.col("_h").isNotNull(), F.lit(name)).otherwise(F.col(reason))).drop("_h")


def exclude_conflicts(cases: DataFrame, key: list[str], label: str, reason: str, extra: DataFrame | None = None, name: str = "multi_label_solution") -> DataFrame:
    """Cases whose key has several labels get the reason, unless they have one already.  Labels are collected over all
    cases, excluded ones too, and over the extra rows of keys that cases have; keys and labels that are null count
    nowhere.  Adds only_extra: whether the conflict shows through extra rows alone."""
    keyed = lambda d, own: d.select(*key, F.col(label).alias("_l"), F.lit(own).alias("_own"))
    rows = keyed(cases, True) if extra is None else keyed(cases, True).unionByName(keyed(extra, False))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    # two labels are a conflict however many there are, so extremes suffice
    own = F.when(F.col("_own"), F.col("_l"))
    seen = rows.where(whole & F.col("_l").isNotNull()).groupBy(*key).agg(F.min("_l").alias("lo"), F.max("_l").alias("hi"), F.min(own).alias("own_lo"), F.max(own).alias("own_hi"))
    bad = seen.where("own_lo is not null and lo < hi").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], (F.col("own_lo") == F.col("own_hi")).alias("only_extra"))
    same = reduce(lambda a, b: a & b, [cases[k] == F.col(f"_k{i}") for i, k in enumerate(key)])
    out = cases.join(bad, same, "left").drop(*[f"_k{i}" for i in range(len(key))])
    return out.withColumn(reason, F.when((F.col(reason) == "") & F.col("only_extra").isNotNull(), F.lit(name)).otherwise(F.col(reason))).withColumn("only_extra", F.coalesce("only_extra", F.lit(False)))


def length_check(rows: DataFrame, anchor: str, lengths: dict[str, Column], most: int, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows of anchors that no tokenizer finds too long, statistics of each group and tokenizer).  An anchor goes with
    all its rows as soon as one of them is too long for one tokenizer."""
    over = F.greatest(*[F.coalesce(c, F.lit(0)) for c in lengths.values()]) > most if len(lengths) > 1 else F.coalesce(*lengths.values()) > most
    bad = rows.where(over).select(F.col(anchor).alias("_long")).distinct()
    sizes = rows.select(by, F.inline(F.array(*[F.struct(F.lit(n).alias("tokenizer"), c.cast("long").alias("tokens")) for n, c in lengths.items()])))
    t = F.col("tokens")
    p99 = quantile_cont(sizes, [by, "tokenizer"], "tokens", {"p99": 0.99}).select(F.col(by).alias("_by"), F.col("tokenizer").alias("_tok"), "p99")
    stats = sizes.groupBy(by, "tokenizer").agg(F.count(F.lit(1)).alias("n"), F.max(t).alias("longest"), F.count_if(t > most).alias("over"))
    stats = stats.join(p99, F.col(by).eqNullSafe(F.col("_by")) & (F.col("tokenizer") == F.col("_tok")), "left").select(by, "tokenizer", "n", "longest", "p99", "over")
    return rows.join(bad, rows[anchor] == F.col("_long"), "left_anti"), stats


def all_kept(rows: DataFrame, decisions: DataFrame, key: str, decision: str = "decision", keep: str = "KEEP") -> DataFrame:
    """The rows, if a judge decided to keep each of them; a row without a decision or with another one stops the run."""
    known = decisions.select(F.col(key).alias("_k"), F.col(decision).alias("_d"))
    if bad := _some(rows.join(known, rows[key] == F.col("_k"), "left").where(~F.col("_d").eqNullSafe(keep)), key):
        raise NotAllowed(f"rows without the decision {keep}: {bad}")
    return rows


def eligibility(rows: DataFrame, key: str, value: str, extra: DataFrame | None = None) -> DataFrame:
    """(key, eligible, source): what rows say of a key, null where they disagree.  Extra keys are eligible; one that the
    rows have as ineligible becomes unknown."""
    said = rows.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(value).alias("known"))
    agreed = (F.col("lo") == F.col("hi")) & (F.col("n") == F.col("known"))
    said = said.select(key, F.when(agreed, F.col("lo")).alias("eligible"), F.when(agreed, "rows").otherwise("ambiguous").alias("source"))
    if extra is None:
        return said
    listed = extra.select(F.col(key).alias("_k")).distinct()
    both = said.join(listed, said[key] == F.col("_k"), "full_outer")
    mine, theirs = F.col(key).isNotNull(), F.col("_k").isNotNull()
    value_ = F.when(mine & theirs, F.when(F.col("eligible"), F.lit(True))).when(theirs, F.lit(True)).otherwise(F.col("eligible"))
    source = F.when(mine & theirs & ~F.coalesce("eligible", F.lit(False)), "ambiguous").when(~mine, "extra").otherwise(F.col("source"))
    return both.select(F.coalesce(key, "_k").alias(key), value_.alias("eligible"), source.alias("source"))


def with_eligibility(cases: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Cases with what is known of their key; null and `unlinked` where nothing is."""
    dim = known.select(F.col(key).alias("_k"), "eligible", F.col("source").alias("eligibility_source"))
    return cases.join(dim, cases[key] == F.col("_k"), "left").drop("_k").withColumn("eligibility_source", F.coalesce("eligibility_source", F.lit("unlinked")))


def fixed_examples(rows: DataFrame, split: str, name: str, ids: list[str], id_: str, text: str) -> DataFrame:
    """The rows of some ids of a split, with a hash of their text.  Each must be there once, and be a wrong one."""
    own = rows.where((F.col(split) == name) & F.col(id_).isin(ids))
    seen = {r[0]: (r[1], r[2]) for r in own.groupBy(id_).agg(F.count(F.lit(1)), F.count_if("wrong")).collect()}  # a row an id
    if bad := [i for i in ids if seen.get(i) != (1, 1)]:
        raise NotAllowed(f"not exactly one wrong row: {bad}")
    return own.withColumn("text_sha256", F.sha2(text, 256))
