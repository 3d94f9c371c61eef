"""Rule-based rewards of grouped rollouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.textkeys import all_aligned, hash_rank
from sievework.operators.diversity import bleu_diversity as bleu_diversity


def known_verdict(verdict: Column) -> Column:
    """A verdict is null, correct or incorrect; anything else fails."""
    bad = verdict.isNotNull() & ~verdict.isin("correct", "incorrect")
    return F.when(bad, F.raise_error(F.concat(F.lit("unexpected verdict: "), verdict))).otherwise(verdict)


def main_reward(verdict: Column, labels: Column, correct_penalty: float, null_reward: float = -0.75) -> Column:
    return F.when(verdict.isNull(), F.lit(null_reward)).when(verdict == "correct", F.lit(-correct_penalty)).when(all_aligned(labels), F.lit(1.0)).otherwise(F.lit(0.0))


def distractor_case(verdict: Column, matched: Column, labels: Column) -> Column:
    return F.when(verdict.isNull(), F.lit("null")).when(verdict == "correct", F.lit("correct")).when(F.coalesce(matched, F.lit("")) != "", F.lit("distractor")).when(all_aligned(labels), F.lit("verifier_pass")).otherwise(F.lit("incorrect_rejected"))


def distractor_reward(case: Column, correct_penalty: float, match: float = 1.0, passed: float = 0.5, null_reward: float = -0.75) -> Column:
    return F.when(case == "null", F.lit(null_reward)).when(case == "correct", F.lit(-correct_penalty)).when(case == "distractor", F.lit(match)).when(case == "verifier_pass", F.lit(passed)).otherwise(F.lit(0.0))


def verifiable_case(answer: Column, correct: Column, targets: Column, matched: Column) -> Column:
    """Literal guards first, so that the matcher's word is only asked for the rest."""
    key = lambda c: F.regexp_replace(c, r"(?U)[\s$~]+", "")
    literal = F.coalesce((key(answer) != "") & (key(answer) == key(correct)), F.lit(False))
    target = F.coalesce(F.exists(targets, lambda t: key(t) == key(answer)), F.lit(False))
    return F.when(answer.isNull(), F.lit("null")).when(literal, F.lit("literal_correct")).when(target | (F.coalesce(matched, F.lit("")) != ""), F.lit("distractor")).otherwise(F.lit("no_match"))


def verifiable_reward(case: Column, match: float = 1.0, other: float = -0.75) -> Column:
    return F.when(case == "distractor", F.lit(match)).otherwise(F.lit(other))


def truncation(length: Column, ends: Column, limit: int, penalty: float) -> list[Column]:
    """truncated (no end mark at the limit), anomaly (none below it), and the penalty."""
    cut = ~ends & (length >= limit)
    return [cut.alias("truncated"), (~ends & (length < limit)).alias("anomaly"), F.when(cut, F.lit(-penalty)).otherwise(F.lit(0.0)).alias("trunc")]


def accepted_groups(rollouts: DataFrame, group: str, position: str) -> DataFrame:
    """Accepted positions of each group, and their number K.  Groups are of bounded size."""
    ok = F.when((F.col("verdict") == "incorrect") & F.col("accepted"), F.col(position))
    return rollouts.groupBy(group).agg(F.array_sort(F.collect_list(ok)).alias("accepted_positions"), F.count(ok).alias("k"))


def pair_schedule(members: DataFrame, group: str, item: str, seed: object) -> DataFrame:
    """All unordered pairs of a group's accepted items as (A, B).  In hash order, the earlier item is A if the forward
    way round the ring is the shorter one; half way round, if its place is even.  Everyone is A about half the time."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct(hash_rank(seed, F.col(group), F.col(item)).alias("h"), F.col(item).alias("i")))), lambda x: x["i"])
    g = members.groupBy(group).agg(ring.alias("ring")).withColumn("k", F.size("ring")).where("k >= 2")
    p = g.select(group, "k", "ring", F.posexplode("ring").alias("p", "x")).select(group, "k", "p", "x", F.posexplode("ring").alias("q", "y")).where("p < q")
    d = F.col("q") - F.col("p")
    first = (2 * d < F.col("k")) | ((2 * d == F.col("k")) & (F.col("p") % 2 == 0))
    return p.select(group, F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))


def win_scores(compared: DataFrame, group: str) -> DataFrame:
    """(group, item, score): wins and half the ties over K - 1; a group without its whole round robin fails."""
    side = lambda c, won: compared.select(group, F.col(c).alias("item"), F.when(F.col("winner") == won, 2).when(F.col("winner") == "tie", 1).otherwise(0).alias("half"))
    s = side("a", "A").unionByName(side("b", "B")).groupBy(group, "item").agg(F.sum("half").alias("halves"), F.count(F.lit(1)).alias("n"))
    sizes = s.groupBy(group).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    whole = (F.col("lo") == F.col("k") - 1) & (F.col("hi") == F.col("k") - 1)
    checked = F.when(whole, F.lit(2) * (F.col("k") - 1)).otherwise(F.raise_error(F.lit("incomplete round robin")).cast("int"))
    return s.join(sizes, group).select(group, "item", (F.col("halves").cast("double") / checked).alias("score"))


#: Rewards by name, of the columns that each needs; what a run uses is its setting.
REWARDS = {"main": main_reward, "distractor": distractor_reward, "verifiable": verifiable_reward}


def with_aux(rollouts: DataFrame, group: str, item: str, aux: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds aux, which a strategy gives for accepted members of groups (group, item, aux); null for all others."""
    given = aux(rollouts.where((F.col("verdict") == "incorrect") & F.col("accepted"))).select(F.col(group).alias("_g"), F.col(item).alias("_i"), "aux")
    return rollouts.join(given, (F.col(group) == F.col("_g")) & (F.col(item) == F.col("_i")), "left").drop("_g", "_i")


def total(main: Column, aux: Column, trunc: Column, weight: float) -> Column:
    return main + F.lit(weight) * F.coalesce(aux, F.lit(0.0)) + trunc
