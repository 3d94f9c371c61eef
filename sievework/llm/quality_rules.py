"""Quality rules as a bitmask ledger (DataFrame functions only).

`build_ledger` measures every text once and stores one row per document: the measurements and a long whose bit b is
set when rule b failed.  A policy is a named, versioned mask over those bits; applying one, or asking what each rule
removes alone (an ablation), reads the ledger only, by bitwise operations.

Defined cases: a null text counts as no words; an empty text fails `few_words` only; a very long text is one array of
words in one task; rows with equal doc_id are independent; an empty table gives an empty ledger; other columns of the
input are ignored.
Windows of words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.store import stored

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule of each bit, in order, as SQL over the measurements.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of the rules named fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 2, tuple(RULES))


def _covered(starts: Column) -> Column:
    """Positions covered by windows that start at the ascending `starts`; a column name, as it is read once an entry."""
    return F.aggregate(
        F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x.cast("long"),
    )


def build_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored ledger: rules are evaluated once, and filters on it are not pushed into their evaluation."""
    return stored(evaluate_rules(docs, key, text), "ledger")


def evaluate_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger's rows: key, the measurements, failed_bits.  No shuffle: each text is measured where it is read."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, WS, "")
    # each step is a projection of its own, whose columns the next reads several times, so that it isn't inlined there
    a = docs.select(
        F.col(key),
        F.array_remove(F.split(t, WORD_GAP), "").alias("ws"),
        bare.alias("bare"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    a = a.select(key, F.size("ws").cast("long").alias("n_words"), F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"), "bare", "lines")
    b = a.select(
        key,
        "n_words",
        F.char_length("bare").cast("long").alias("word_chars"),
        (F.char_length("bare") - F.char_length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.char_length("bare") - F.char_length(F.translate("bare", CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # a window is the hash of its words' hashes
        F.when(
            F.size("hs") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("hs") - WINDOW), lambda i: F.xxhash64(*[F.get("hs", i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")).alias("keys"),
    )
    measured = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    # (hash, place) sorted: equal windows are neighbours; texts without any skip the sort
    c = b.select(
        key,
        *measured,
        F.when(
            F.size(F.array_distinct("keys")) < F.size("keys"),
            F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("p")))),
        ).alias("by_key"),
    )
    d = c.select(
        key,
        *measured,
        F.sort_array(
            F.transform(
                F.filter("by_key", lambda x, i: F.get("by_key", i - 1)["k"].eqNullSafe(x["k"]) | F.get("by_key", i + 1)["k"].eqNullSafe(x["k"])),
                lambda x: x["p"],
            )
        ).alias("starts"),
    )
    e = d.select(key, *measured, F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"))
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()), F.lit(0).cast("long"))
    return e.withColumn("failed_bits", bits)


def apply_policy(ledger: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    """Adds the policy's verdict; texts are not read again."""
    return ledger.withColumn(column, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it."""
    met = F.col("failed_bits").bitwiseAND(F.lit(policy.mask))
    counts = ledger.groupBy(met.alias("met")).agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** rules rows
    rows = [
        counts.agg(
            F.lit(r).alias("rule"),
            F.lit(policy.version).alias("policy_version"),
            F.coalesce(F.sum(F.when(F.col("met").bitwiseAND(F.lit(BIT[r])) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("met") == BIT[r], F.col("n"))), F.lit(0)).alias("n_failed_alone"),
            F.coalesce(F.sum(F.when(F.col("met").bitwiseAND(F.lit(policy.mask & ~BIT[r])) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
        for r in policy.rules
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = build_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = apply_policy(apply_policy(ledger, BASE, "base_kept"), STRICT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "failed_bits")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, ws[i : i + 7] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (
  SELECT doc_id, sum(least(8, nxt)) AS n FROM (
    SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 25 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END) AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""
