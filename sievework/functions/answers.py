"""Answers of models that must be a JSON object with exactly some keys: columns that say what is wrong, and the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.textkeys import answer_key, strip
from sievework.operators.llmio import with_json

#: Texts that stand for a missing answer, and those that do so where there is no verdict either (fixed values).
NULL_TEXTS = ["null", ""]
PLACEHOLDERS = ["none", "n/a", "na", "null", ""]


def exact_object(df: DataFrame, text: str, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds `fault` (empty: none) and a string column for each key.  The text must be one JSON object that has these
    keys and no others, with values of the kinds allowed (`STRING`, `VOID` for null)."""
    d = with_json(df, text, "_v")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    d = d.withColumn("_have", F.when(F.col("_v").isNotNull() & F.ltrim(text).startswith("{"), F.json_object_keys(text)))
    d = d.withColumns({f"_t_{k}": F.coalesce(kind(k), F.lit("VOID")) for k in kinds} | {k: F.try_variant_get("_v", f"$.{k}", "string") for k in kinds})
    names = F.array(*[F.lit(k) for k in sorted(kinds)])
    fault = F.when(F.col("_v").isNull(), "not JSON").when(F.col("_have").isNull() | (F.array_sort("_have") != names), "other keys")
    for k, allowed in kinds.items():
        fault = fault.when(~F.col(f"_t_{k}").isin(*allowed), f"{k} of another kind")
    return d.withColumn("fault", fault.otherwise(F.lit(""))).drop("_v", "_have", *[f"_t_{k}" for k in kinds])


def _settled(df: DataFrame, own: Column, keys: list[str]) -> DataFrame:
    """fault, else the operator's own fault; values only where there is none."""
    d = df.withColumn("fault", F.when(F.col("fault") != "", F.col("fault")).otherwise(own))
    return d.withColumns({k: F.when(F.col("fault") == "", F.col(k)) for k in keys})


def answer_check(df: DataFrame, text: str) -> DataFrame:
    """extracted_answer, verdict and reason of a graded answer.  A missing answer is a JSON null without a verdict; a
    text that stands for one is a fault, never an incorrect answer."""
    d = exact_object(df, text, {"extracted_answer": ("STRING", "VOID"), "verdict": ("STRING", "VOID"), "reason": ("STRING",)})
    low, verdict = F.lower(strip(F.col("extracted_answer"))), F.col("verdict")
    stands = low.isin(NULL_TEXTS) | (verdict.isNull() & low.isin(PLACEHOLDERS))
    own = F.when(stands, "a text for null").when(~verdict.isin("correct", "incorrect"), "another verdict").when(F.col("extracted_answer").isNull() & verdict.isNotNull(), "a verdict without an answer").otherwise(F.lit(""))
    return _settled(d, own, ["extracted_answer", "verdict", "reason"])


def extraction(df: DataFrame, text: str) -> DataFrame:
    """extracted_answer and reason."""
    d = exact_object(df, text, {"extracted_answer": ("STRING", "VOID"), "reason": ("STRING",)})
    own = F.when(F.lower(strip(F.col("extracted_answer"))).isin(NULL_TEXTS), "a text for null").otherwise(F.lit(""))
    return _settled(d, own, ["extracted_answer", "reason"])


def winner(df: DataFrame, text: str, ties: bool = True) -> DataFrame:
    """winner: A, B, or tie where that is allowed."""
    d = exact_object(df, text, {"winner": ("STRING",)})
    return _settled(d, F.when(~F.col("winner").isin("A", "B", *(["tie"] if ties else [])), "another winner").otherwise(F.lit("")), ["winner"])


def match(df: DataFrame, text: str, letters: Column) -> DataFrame:
    """matched_option and reason; an option that isn't one of the row's letters is null, and dropped tells it."""
    d = exact_object(df, text, {"matched_option": ("STRING", "VOID", "BIGINT", "BOOLEAN"), "reason": ("STRING",)})
    letter = F.upper(strip(F.col("matched_option")))
    d = d.withColumn("dropped", F.when((F.col("fault") == "") & F.col("matched_option").isNotNull() & ~F.array_contains(letters, letter), F.col("matched_option")))
    d = d.withColumn("matched_option", F.when(F.col("dropped").isNull(), letter))
    return _settled(d, F.lit(""), ["matched_option", "reason"])


def options_text(options: Column) -> Column:
    """`A: text` lines of an array of (option, text), in option order."""
    return F.array_join(F.transform(F.array_sort(options), lambda x: F.concat(x["option"], F.lit(": "), x["text"])), "\n")


def matched_class(answer: Column, classes: dict[str, Column]) -> Column:
    """The first class one of whose texts equals the answer after normalisation; none, or unjudgeable without answer."""
    key = answer_key(answer)
    out = F.when(answer.isNull(), "unjudgeable")
    for name, texts in classes.items():
        out = out.when(F.coalesce((key != "") & F.exists(texts, lambda t: answer_key(t) == key), F.lit(False)), name)
    return out.otherwise("none")
