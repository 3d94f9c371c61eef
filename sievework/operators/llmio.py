"""Model calls as data: request keys, resume, pluggable scorers, strict parsing of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.textkeys import blank, strip
from sievework.sources.work import stored

FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"


def request_key(**parts: Column) -> Column:
    """SHA-256 of a canonical JSON object: names sorted, no blanks, nulls written, values of their own type."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def pending(requests: DataFrame, done: DataFrame, key: str = "request_key") -> DataFrame:
    """Distinct requests without a finished answer; failed ones are asked again."""
    finished = done.where(F.col("processing_status") == "ok").select(key).distinct()
    return requests.dropDuplicates([key]).join(finished, key, "left_anti")


def scored(requests: DataFrame, scorer: Callable[[pd.Series], pd.Series], text: str, out: str, callers: int | None = None) -> DataFrame:
    """A batch function over the rows, in as many tasks as callers are allowed.  An exception aborts the job: it is
    never an answer."""
    from pyspark.sql import types as T

    schema = T.StructType([*requests.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: scorer(b[text])})

    return (requests.repartition(callers) if callers else requests).mapInPandas(run, schema)


def mock_scorer(text: pd.Series) -> pd.Series:
    """Deterministic answers for tests."""
    import hashlib

    return text.map(lambda t: ("correct", "incorrect", None)[int(hashlib.sha256((t or "").encode()).hexdigest()[:8], 16) % 3])


def cascade(rollouts: DataFrame, check: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Answer check for all, verifier for incorrect ones only: rows are filtered before they are scored, since a UDF
    inside a CASE would run for each.  Answers are stored, so that each row is asked for once."""
    checked = stored(check(rollouts), "checked")
    labels = verify(checked.where(F.col("verdict") == "incorrect")).select(key, "labels")
    return checked.join(stored(labels, "labels"), key, "left")


def with_fallback(df: DataFrame, column: str, status: str, value: object) -> tuple[DataFrame, DataFrame]:
    """(rows, log): refused requests take the fallback value and keep their status; the log counts them by value."""
    refused = F.coalesce(F.col(status) == "refused", F.lit(False))
    out = df.withColumn(column, F.when(refused, F.lit(value)).otherwise(F.col(column)))
    return out, out.where(refused).groupBy(F.lit(column).alias("column"), F.col(column).cast("string").alias("fallback")).agg(F.count(F.lit(1)).alias("n"))


def with_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text as a variant if all of it is one JSON value, else null.  Spark's parser stops behind the first
    value, so what follows it is tried inside an array and inside an object: no rest suits both.  The steps are
    projections of their own, so that a text is parsed once in each way."""
    tried = df.withColumns({"_array": F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "_object": F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))})
    alone = F.col("_array").isNotNull() & F.col("_object").isNotNull() & F.try_variant_get("_array", "$[1]", "variant").isNull()
    return tried.withColumn(out, F.when(alone, F.try_variant_get("_array", "$[0]", "variant"))).drop("_array", "_object")


def parse_answers(df: DataFrame, text: str, keys: list[str], statuses: list[str]) -> DataFrame:
    """Adds processing_status, repaired, description, evidence_quote, status and extra_keys of a model's JSON answers.
    A fenced block is unwrapped.  JSON is Spark's strict one: duplicate keys and NaN are errors."""
    d = with_json(df, text, "_bare").withColumn("_inner", F.when(F.col("_bare").isNull(), F.nullif(F.regexp_extract(text, FENCE, 1), F.lit(""))))
    d = with_json(d, "_inner", "_fenced")
    d = d.withColumns({"_v": F.coalesce("_bare", "_fenced"), "repaired": F.col("_bare").isNull() & F.col("_fenced").isNotNull(), "_body": F.coalesce("_inner", text)})
    is_object = F.col("_v").isNotNull() & F.ltrim("_body").startswith("{")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    get = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    d = d.withColumns({"_have": F.when(is_object, F.json_object_keys("_body")), **{f"_k_{k}": kind(k) for k in keys}, **{f"_s_{k}": get(k) for k in keys}})
    names = F.array(*[F.lit(k) for k in keys])
    c = F.col
    wrong = (
        (F.size(F.array_except(names, "_have")) > 0)
        | ~F.coalesce(c("_k_description"), F.lit("VOID")).isin("STRING", "VOID")
        | F.coalesce(F.lower(strip(c("_s_description"))).isin("null", "none"), F.lit(False))
        | (F.coalesce(c("_k_evidence_quote"), F.lit("")) != "STRING")
        | (F.coalesce(c("_k_status"), F.lit("")) != "STRING")
        | ~F.coalesce(c("_s_status").isin(statuses), F.lit(False))
    )
    state = F.when(blank(c(text)), F.lit("empty_response")).when(c("_v").isNull(), F.lit("json_parse_error")).when(c("_have").isNull() | wrong, F.lit("schema_invalid")).otherwise(F.lit("ok"))
    d = d.withColumn("processing_status", state)
    made = {k: F.when(c("processing_status") == "ok", c(f"_s_{k}")) for k in keys}
    extra = F.coalesce(F.array_sort(F.array_except("_have", names)), F.array().cast("array<string>"))
    return d.select(*df.columns, "processing_status", "repaired", *[v.alias(k) for k, v in made.items()], extra.alias("extra_keys"))
