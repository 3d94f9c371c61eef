"""Classification, pair and group metrics.  Ratios are ratios of integer sums; an undefined one is null, but precision,
recall and F1 of a class are 0 then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.textkeys import all_aligned
from sievework.operators.order_stats import at_share, order_values, upper_median

POSITIVE, NEGATIVE, INVALID = "aligned", "not_aligned", "invalid"


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(target: str = "target", prediction: str = "prediction") -> list[Column]:
    """Additive counts; an invalid prediction is wrong everywhere."""
    t, p = F.col(target), F.coalesce(F.col(prediction), F.lit(INVALID))
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    return [
        F.count(F.lit(1)).alias("n"),
        n((t == POSITIVE) & (p == POSITIVE), "tp"),
        n((t == NEGATIVE) & (p == POSITIVE), "fp"),
        n((t == POSITIVE) & (p != POSITIVE), "fn"),
        n((t == NEGATIVE) & (p == NEGATIVE), "tn"),
        n((t == POSITIVE) & (p == NEGATIVE), "neg_fp"),
        n((t == NEGATIVE) & (p != NEGATIVE), "neg_fn"),
        n(p == INVALID, "invalid"),
    ]


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, class and macro scores, acceptance and invalid rates from confusion counts."""
    c = F.col
    f1 = lambda tp, fp, fn: or_zero(ratio(2 * c(tp), 2 * c(tp) + c(fp) + c(fn)))
    return (
        counts.withColumn("accuracy", ratio(c("tp") + c("tn"), c("n")))
        .withColumn("precision_pos", or_zero(ratio(c("tp"), c("tp") + c("fp"))))
        .withColumn("recall_pos", or_zero(ratio(c("tp"), c("tp") + c("fn"))))
        .withColumn("f1_pos", f1("tp", "fp", "fn"))
        .withColumn("f1_neg", f1("tn", "neg_fp", "neg_fn"))
        .withColumn("macro_f1", (c("f1_pos") + c("f1_neg")) / 2)
        .withColumn("negative_acceptance", ratio(c("fp"), c("n") - c("tp") - c("fn")))
        .withColumn("invalid_rate", ratio(c("invalid"), c("n")))
    )


def breakdown(df: DataFrame, facets: list[str], least: int, *aggs: Column) -> DataFrame:
    """Each facet's values and the total, in one pass of grouping sets; groups with fewer rows go."""
    sets = [[]] + [[f] for f in facets]
    name = F.lit("all")
    for f in facets:
        name = F.when(F.grouping(f) == 0, F.lit(f)).otherwise(name)
    value = F.coalesce(*[F.when(F.grouping(f) == 0, F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in facets], F.lit(""))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(f) for f in facets]).agg(name.alias("facet"), value.alias("value"), *aggs)
    return out.where(F.col("n") >= least).drop(*facets)


def pair_accuracy(df: DataFrame, anchor: str, target: str, correct: str) -> DataFrame:
    """Share of anchors with rows of both classes whose rows are all right."""
    per = df.groupBy(anchor).agg(F.count_distinct(target).alias("k"), F.min(F.col(correct).cast("int")).alias("ok")).where("k = 2")
    return per.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("right")).withColumn("pair_accuracy", ratio(F.col("right"), F.col("pairs")))


def last_pair_accuracy(df: DataFrame, anchor: str, target: str, correct: str, order: str) -> DataFrame:
    """The older definition: of several negatives of an anchor only the last row counts."""
    last = df.groupBy(anchor, target).agg(F.max_by(F.col(correct), F.col(order)).alias("c"))
    return pair_accuracy(last, anchor, target, "c")


def length_stats(df: DataFrame, c: str) -> DataFrame:
    """count, min, upper median, p99 by index, max of a column of whole numbers."""
    places = {"min": lambda n: F.lit(0), "upper_median": upper_median, "p99": at_share(0.99), "max": lambda n: n - 1}
    kind = dict(df.dtypes)[c]
    return order_values(df, [], c, places).select("n", *[F.col(p).cast(kind).alias(p) for p in places])


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("both_judged"), F.count_if(F.col(a) != F.col(b)).cast("long").alias("disagree")).withColumn("disagreement", ratio(F.col("disagree"), F.col("both_judged")))


def group_counts(rollouts: DataFrame, group: str, condition: str, primary: str | None = None, secondary: str | None = None) -> DataFrame:
    """Additive counts of each group; zero-success conditions need the conditions' own sums first.

    With primary, a column of a judge's labels (null: not asked), all fields: truncated and total are columns then,
    in_g is success, and secondary is another judge's labels."""
    n = lambda c, name: F.count_if(c).cast("long").alias(name)
    v = F.col("verdict")
    known = [F.count(F.lit(1)).alias("rollouts"), n(v == "correct", "correct"), n(v == "incorrect", "incorrect")]
    if primary is None:
        counts = [*known, n(v.isNull(), "null"), n((v == "incorrect") & F.col("accepted"), "success")]
    else:
        p, s = F.col(primary), F.lit(None).cast("array<string>") if secondary is None else F.col(secondary)
        both, size = p.isNotNull() & s.isNotNull(), lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), F.size(c))), F.lit(0)).cast("long")
        counts = [
            *known,
            n(~F.coalesce(v.isin("correct", "incorrect"), F.lit(False)), "null"),
            n(F.coalesce("in_g", F.lit(False)), "success"),
            n(p.isNotNull() & all_aligned(p), "primary_pass"),
            size(p).alias("verifier_samples"),
            size(F.filter(p, lambda x: x == INVALID)).alias("verifier_invalid"),
            n(both, "both_judged"),
            n(both & all_aligned(s), "secondary_pass"),
            n(both & (all_aligned(p) != all_aligned(s)), "disagree"),
            n(F.coalesce("truncated", F.lit(False)), "truncated"),
            F.coalesce(F.sum("total"), F.lit(0)).cast("double").alias("total_reward"),
        ]
    per = rollouts.groupBy(group, condition).agg(*counts)
    add = [c for c in per.columns if c not in (group, condition)]
    return per.groupBy(group).agg(*[F.sum(c).alias(c) for c in add], F.count(F.lit(1)).alias("conditions"), n(F.col("success") == 0, "zero_success_conditions"))


RATIOS = {
    "wrong_rate": ("incorrect", "rollouts"),
    "correct_rate": ("correct", "rollouts"),
    "null_rate": ("null", "rollouts"),
    "joint_success": ("success", "rollouts"),
    "accept_given_wrong": ("success", "incorrect"),
    "zero_success_condition_rate": ("zero_success_conditions", "conditions"),
}
#: With the counts that a judge's labels give.
JUDGED_RATIOS = RATIOS | {
    "accept_given_wrong": ("primary_pass", "incorrect"),
    "secondary_accept_given_wrong": ("secondary_pass", "both_judged"),
    "disagreement_given_wrong": ("disagree", "both_judged"),
    "verifier_invalid_sample_rate": ("verifier_invalid", "verifier_samples"),
    "truncation_rate": ("truncated", "rollouts"),
    "reward_total_mean": ("total_reward", "rollouts"),
}


def ratio_table(counts: DataFrame, ratios: dict[str, tuple[str, str]] = RATIOS) -> DataFrame:
    sums = sorted({c for ab in ratios.values() for c in ab})
    total = counts.agg(*[F.sum(c).alias(c) for c in sums])
    return total.select(*[ratio(F.col(a), F.col(b)).alias(name) for name, (a, b) in ratios.items()])


def facet_breakdown(df: DataFrame, facets: dict[str, Column], least: int, anchor: str, correct: str, negatives_only: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts and pair accuracy of each value of each facet.  A row counts once for each facet; facets named
    in negatives_only have negatives alone.  Pairs are formed within a facet's value, anchor by anchor.

    Rows of the same facets are counted together before a row is taken for each facet.  For the pairs they are combined by
    anchor, facets and target, so that a frequent anchor is a few rows, and dealt by anchor: the rows for each facet are
    made and combined where they lie, and not shuffled."""
    names = [f"_f{i}" for i in range(len(facets))]
    value = lambda f, c: F.when(F.col("target") == NEGATIVE, F.coalesce(c.cast("string"), F.lit(""))) if f in negatives_only else F.coalesce(c.cast("string"), F.lit(""))
    rows = df.select("target", "prediction", F.col(anchor).alias("_anchor"), F.col(correct).cast("int").alias("_ok"), *[value(f, c).alias(n) for (f, c), n in zip(facets.items(), names, strict=True)])
    entries = [F.when(F.col(n).isNotNull(), F.struct(F.lit(f).alias("facet"), F.col(n).alias("value"))) for f, n in zip(facets, names, strict=True)]
    each = F.inline(F.array_compact(F.array(*entries)))
    counts = rows.groupBy(*names).agg(*confusion())
    add = [c for c in counts.columns if c not in names]
    counts = counts.select(*add, each).groupBy("facet", "value").agg(*[F.sum(c).alias(c) for c in add]).where(F.col("n") >= least)
    target, ok = F.col("target"), F.col("_ok")
    if df.where(~target.isin(POSITIVE, NEGATIVE)).isEmpty():
        # bits: a right partner, a wrong one, a wrong answer, a right one
        bit = lambda c, n: F.when(c, n).otherwise(0)
        bits = bit(target == POSITIVE, 1) + bit(target == NEGATIVE, 2) + bit(ok == 0, 4) + bit(ok == 1, 8)
        some = rows.groupBy("_anchor", *names).agg(F.bit_or(bits).alias("_b")).repartition("_anchor")
        per = some.select("_anchor", "_b", each).groupBy("facet", "value", "_anchor").agg(F.bit_or("_b").alias("_b"))
        per = per.where(F.col("_b").bitwiseAND(3) == 3).withColumn("_ok", F.when(F.col("_b").bitwiseAND(12) == 8, 1))
    else:
        some = rows.groupBy("_anchor", *names, "target").agg(F.min("_ok").alias("_ok")).repartition("_anchor")
        per = some.select("_anchor", "target", "_ok", each).groupBy("facet", "value", "_anchor").agg(F.count_distinct("target").alias("_k"), F.min("_ok").alias("_ok")).where("_k = 2")
    two = per.groupBy(F.col("facet").alias("_facet"), F.col("value").alias("_value")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_ok") == 1).alias("right"))
    out = counts.join(two, (F.col("facet") == F.col("_facet")) & (F.col("value") == F.col("_value")), "left").drop("_facet", "_value")
    return out.fillna(0, ["pairs", "right"]).withColumn("pair_accuracy", ratio(F.col("right"), F.col("pairs")))


def token_weighted_mean(df: DataFrame, loss: str, tokens: str) -> DataFrame:
    """Mean loss a token of rows that have a mean loss and a number of tokens."""
    return df.agg(ratio(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)).alias("loss"), F.sum(tokens).alias("tokens"))


def unique_successes(rollouts: DataFrame, condition: str, answer: str) -> DataFrame:
    """Mean number of distinct successful answers over conditions that have one."""
    per = rollouts.where("accepted").groupBy(condition).agg(F.count_distinct(answer).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("conditions"), F.sum("n").cast("long").alias("answers")).withColumn("mean", ratio(F.col("answers"), F.col("conditions")))
