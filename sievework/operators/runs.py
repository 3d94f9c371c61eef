"""Rates of rollout batches and served judges, usage and sizes of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.textkeys import all_aligned
from sievework.operators.metrics import or_zero, ratio


def _share(part: Column, whole: Column) -> Column:
    """Rows with part among those with whole; null where there are none."""
    return ratio(F.count_if(part & whole), F.count_if(whole))


def step_metrics(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates of a batch, of each group of `by` if given.  Columns: verdict, labels (null or empty: not asked), in_g,
    k, aux, total, truncated, anomaly, cached, attempts, latency_s.  Cached answers count in no call figure."""
    verdict, labels = F.col("verdict"), F.col("labels")
    asked = F.coalesce(F.size(labels) > 0, F.lit(False))
    fresh = ~F.coalesce("cached", F.lit(False))
    active = F.col("in_g") & (F.col("k") >= 2)
    all_ = F.lit(True)
    mean = lambda c, where: or_zero(ratio(F.sum(F.when(where, c)), F.count_if(where)))
    invalid = F.size(F.filter(labels, lambda x: x == "invalid"))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _share(verdict.isNull(), all_).alias("null_rate"),
        _share(verdict.eqNullSafe("correct"), all_).alias("correct_rate"),
        _share(verdict.eqNullSafe("incorrect"), all_).alias("incorrect_rate"),
        or_zero(_share(verdict.eqNullSafe("incorrect"), verdict.isNotNull())).alias("incorrect_rate_judgeable"),
        _share(~fresh, all_).alias("cache_hit_rate"),
        mean(F.col("attempts") - 1, fresh).alias("retry_rate"),
        mean(F.col("latency_s"), fresh).alias("latency_s"),
        or_zero(_share(all_aligned(labels), asked)).alias("accept_rate_incorrect"),
        or_zero(ratio(F.sum(F.when(asked, invalid)), F.sum(F.when(asked, F.size(labels))))).alias("invalid_sample_rate"),
        or_zero(_share(F.size(F.array_distinct(labels)) > 1, asked)).alias("sample_disagreement_rate"),
        _share(F.col("in_g"), all_).alias("success_rate"),
        _share(active, all_).alias("aux_active_rate"),
        mean(F.col("aux"), active).alias("aux_mean_active"),
        _share(F.col("truncated"), all_).alias("truncation_rate"),
        F.count_if("anomaly").alias("anomalies"),
        ratio(F.sum("total"), F.count(F.lit(1))).alias("total_mean"),
    )


def group_sizes(groups: DataFrame, k: str = "k") -> DataFrame:
    """Mean number of accepted rollouts of a group, shares of groups with two and more and with none."""
    return groups.agg(
        ratio(F.sum(k), F.count(F.lit(1))).alias("k_mean"), _share(F.col(k) >= 2, F.lit(True)).alias("k_ge2_rate"), _share(F.col(k) == 0, F.lit(True)).alias("k0_rate")
    )


def case_rates(results: DataFrame, case: str, cases: list[str]) -> DataFrame:
    """One column `<case>_rate` for each case of a reward, whether it occurs or not."""
    return results.agg(F.count(F.lit(1)).alias("n"), *[_share(F.col(case).eqNullSafe(c), F.lit(True)).alias(f"{c}_rate") for c in cases])


def judge_rates(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Check of a served judge on known rows.  Columns: target, labels, negative_kind."""
    accept, labels = all_aligned(F.col("labels")), F.col("labels")
    negative = F.col("target") == "not_aligned"
    return rows.agg(
        or_zero(_share(~accept, F.col("target") == "aligned")).alias("false_rejection"),
        or_zero(_share(accept, negative)).alias("false_acceptance"),
        or_zero(ratio(F.sum(F.size(F.filter(labels, lambda x: x == "invalid"))), F.sum(F.size(labels)))).alias("invalid_sample_rate"),
        or_zero(_share(F.size(F.array_distinct(labels)) > 1, F.lit(True))).alias("sample_disagreement_rate"),
        *[_share(accept, negative & F.col("negative_kind").eqNullSafe(k)).alias(f"false_acceptance_{k}") for k in kinds],
    )


def usage_totals(rows: DataFrame, *fields: str) -> DataFrame:
    """Sums of integer usage fields; what is missing or no integer counts as nothing."""
    return rows.agg(*[F.coalesce(F.sum(F.expr(f"try_cast({f} AS bigint)")), F.lit(0)).alias(f.split(".")[-1]) for f in fields])


def cost_estimate(requests: DataFrame, text: str, price_in: float | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Requests, characters, tokens at four characters each, and their price a million; without a price no cost."""
    tokens = F.floor(F.sum(F.char_length(text)) / 4)
    cost = F.lit(None).cast("double") if price_in is None else tokens * F.lit(price_in) / F.lit(1e6)
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.char_length(text)).alias("chars"), tokens.alias("approx_tokens"), cost.alias("cost"))


def facet_counts(df: DataFrame, facets: str, by: str) -> DataFrame:
    """Rows for each dataset, facet and value of a map of facets."""
    return df.select(by, F.explode(facets).alias("facet", "value")).groupBy(by, "facet", "value").agg(F.count(F.lit(1)).alias("n"))


def donor_reuse(pairs: DataFrame, donor: str = "donor") -> DataFrame:
    """Distinct donors, and the most uses of one."""
    return pairs.groupBy(donor).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("donors"), F.max("n").alias("most_uses"))


def scenario_sizes(questions: DataFrame, split: str, types: str, ks: list[int], per_step: int) -> DataFrame:
    """Conditions of each split with k types a question (each k) or with all of its types; optimizer steps an epoch."""
    n = questions.groupBy(split).agg(F.count(F.lit(1)).alias("questions"), F.sum(types).alias("_all"))
    rows = [F.struct(F.lit(f"balanced k={k}").alias("scenario"), (F.col("questions") * k).alias("conditions")) for k in ks]
    rows.append(F.struct(F.lit("all_types").alias("scenario"), F.col("_all").cast("long").alias("conditions")))
    return n.select(split, "questions", F.inline(F.array(*rows))).withColumn("steps", F.floor(F.col("conditions") / per_step))


def outcome_rates(compared: DataFrame, condition: str, winner: str = "winner", outcomes: tuple[str, ...] = ("x", "y", "tie")) -> DataFrame:
    """Pairs, conditions and the share of each outcome of a pairwise comparison."""
    shares = [_share(F.col(winner).eqNullSafe(o), F.lit(True)).alias(f"{o}_rate") for o in outcomes]
    return compared.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(condition).alias("conditions"), *shares)


def judge_extras(results: DataFrame, primary: str, secondary: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Flagged answers, and a second judge beside the first: both are arrays of labels, null or empty where not asked."""
    p, s = F.col(primary), F.col(secondary)
    both = F.coalesce((F.size(p) > 0) & (F.size(s) > 0), F.lit(False))
    return results.groupBy(*by).agg(
        _share(F.coalesce("flagged", F.lit(False)), F.lit(True)).alias("flagged_rate"),
        F.count_if(both).alias("both_judged"),
        or_zero(_share(all_aligned(s), both)).alias("secondary_accept_rate_incorrect"),
        or_zero(_share(all_aligned(p) != all_aligned(s), both)).alias("disagreement_rate_incorrect"),
    )


def stage_success(results: DataFrame, stage: str) -> DataFrame:
    """Success rate of each stage that occurs."""
    return results.where(F.col(stage).isNotNull()).groupBy(stage).agg(F.count(F.lit(1)).alias("n"), _share(F.col("in_g"), F.lit(True)).alias("success_rate"))


def diversity_rates(similar: DataFrame, highest: str, copy: float = 0.999) -> DataFrame:
    """Mean of the highest similarity of each accepted answer to another one, and the share of copies."""
    return similar.agg(or_zero(ratio(F.sum(highest), F.count(highest))).alias("max_bleu_mean"), or_zero(_share(F.col(highest) >= copy, F.col(highest).isNotNull())).alias("duplicate_rate"))


def likeness_rates(pairs: DataFrame, winner: str = "winner", flagged: str = "flagged") -> DataFrame:
    """Compared pairs, flagged ones, ties and wins of the first place."""
    w = F.col(winner)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(flagged).alias("flagged_pairs"), or_zero(_share(w.eqNullSafe("tie"), F.lit(True))).alias("tie_rate"), or_zero(_share(w.eqNullSafe("A"), F.lit(True))).alias("a_win_rate")
    )
