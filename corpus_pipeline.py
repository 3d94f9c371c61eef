"""The corpus pipeline: toxicity, near-duplicates, suffix-array dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its DataFrame is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents.

Defined cases, in all stages: null and empty texts go through (they have no words, spans or hits, get the score of a row
of no words, and are packed as their end mark); very long texts are handled whole; rows with equal doc_id are judged
each by its own text, but near-duplicates that share an id go only if none of them is kept; a null doc_id counts as the
largest; an empty table stays empty; columns other than doc_id, text and n_chars are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from sievework.llm.store import stored

#: Per cent of common shingles that link two documents; op6_near_dedup has 85 in its own contract.
NEAR = 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score of toxicity is 0.3 or more."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each class of near-duplicates, linked at a similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs, NEAR)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes and more that an earlier document has; a document cut away whole goes."""
    return suffix_dedup.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: No stage can be said in SQL: trained scores, sketches, a suffix array's cuts that end at code points, token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
