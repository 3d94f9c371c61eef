"""How unlike the other members of its group a text is, by posting lists of its n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sievework.functions.bleu import token_bleu, token_column
from sievework.functions.textkeys import blank
from sievework.sources.work import stored

ORDER = 4
#: Bounds and scores are doubles that are computed in different orders: a pair this near to the best is scored.
_SLACK = 1e-9


@F.pandas_udf(ArrayType(StructType([StructField("_gram", LongType()), StructField("_c", LongType())])))
def _counted(hashes: pd.Series) -> pd.Series:
    made = (np.unique(h, return_counts=True) for h in hashes)
    return pd.Series([[{"_gram": g, "_c": c} for g, c in zip(x.tolist(), n.tolist(), strict=True)] for x, n in made], dtype=object)


def _grams(texts: DataFrame, n: int, *carry: str) -> DataFrame:
    """(_id, carry..., _gram, _c): hashes of the n-grams, with their group, of texts of at least n tokens.  Grams of one
    hash count as one, which only raises what two texts are taken to share: pairs are chosen by it and scored by their
    tokens, if they are of one group.  A text's grams are counted where it lies."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - (n - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.xxhash64("_g", F.slice("_t", i, n)))
    return texts.where(F.size("_t") >= n).select("_id", *carry, F.inline(_counted(grams)))


def _bound(n: int, length: Column, other: Column, matches: Column | None) -> Column:
    """No pair without a common (n + 1)-gram has a larger BLEU; with no matches given, none without a common n-gram.
    Lower orders may match in full; orders without a match have what smoothing gives them."""
    logs, missed = F.lit(0.0), 0
    for k in range(n, ORDER + 1):
        all_ = (length - (k - 1)).cast("double")
        if k == n and matches is not None:
            term = F.log(matches / all_)
        else:
            missed += 1
            term = -F.log(F.lit(2.0**missed) * all_)
        logs = logs + F.when(length >= k, term).otherwise(0.0)
    short = F.when(length > other, 0.0).otherwise(1 - other / length)
    return F.exp(short + logs / F.least(length, F.lit(ORDER)))


@F.pandas_udf(DoubleType())
def _scores(mine: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([token_bleu(list(a), list(b)) for a, b in zip(mine, other, strict=True)], dtype="float64")


def bleu_diversity(rollouts: DataFrame, group: str, item: str, text: str) -> DataFrame:
    """(group, item, diversity): 1 - the largest sentence BLEU to another member, of groups of two and more.

    Texts of the same tokens are one text, and have 0.  For the rest, postings of 4-grams name the pairs to look at; a
    pair is scored if the bound of its common 4-grams beats the text's best.  Texts whose best a pair without a
    common 4-gram could still beat go on to 3-grams, then to shorter ones.  The result is that of all pairs, as only pairs
    are left out that can't be the largest.  Pairs within a posting list of different texts do meet; groups are the rollouts
    of one prompt.

    A text of blanks or null has 0.  A text without tokens, or one that shares none, has 1.  Repeated items are members of
    their own; null groups and items are like others; other columns may have any name."""
    rows = rollouts.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.coalesce(blank(F.col(text)), F.lit(True)).alias("_blank"), token_column(F.col(text)).alias("_t"))
    rows = stored(rows.withColumn("_h", F.sha2(F.array_join("_t", " "), 256)), "members")
    sizes = rows.groupBy(F.col("_g").alias("_k")).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    rows = rows.join(sizes, F.col("_g").eqNullSafe(F.col("_k"))).drop("_k", "_size")
    known = rows.groupBy("_g", "_h").agg(F.first("_t").alias("_t"), F.count(F.lit(1)).alias("_n"))
    texts = stored(known.withColumn("_len", F.size("_t")).withColumn("_id", F.monotonically_increasing_id()), "texts")
    others = texts.select(F.col("_g").alias("_g2"), F.col("_id").alias("_id2"), F.col("_t").alias("_t2"), F.col("_len").alias("_len2"))
    best = texts.select("_g", "_h", "_id", "_t", "_len", F.when((F.col("_n") > 1) & (F.col("_len") > 0), 1.0).otherwise(0.0).alias("_best"), F.lit(False).alias("_done"))
    for n in range(ORDER, 0, -1):
        best = best.withColumn("_done", F.col("_done") | (F.col("_len") == 0) | (F.col("_best") >= 1))
        open_ = best.where("not _done")
        lists = _grams(texts, n, "_len").select(F.col("_id").alias("_id2"), F.col("_len").alias("_len2"), F.col("_gram").alias("_gram2"), F.col("_c").alias("_c2"))
        met = _grams(open_, n, "_len", "_best").join(lists, (F.col("_gram") == F.col("_gram2")) & (F.col("_id") != F.col("_id2")))
        pairs = met.groupBy("_id", "_id2", "_len", "_len2", "_best").agg(F.sum(F.least("_c", "_c2")).alias("_m"))
        pairs = pairs.where(_bound(n, F.col("_len"), F.col("_len2"), F.col("_m")) > F.col("_best") - _SLACK).select("_id", "_id2")
        sides = pairs.join(texts.select("_g", F.col("_id").alias("_id1"), "_t"), F.col("_id") == F.col("_id1"))
        sides = sides.withColumnRenamed("_id2", "_other")
        sides = sides.join(others, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_other") == F.col("_id2")))
        found = sides.select("_g", "_id", _scores("_t", "_t2").alias("_s")).groupBy(F.col("_g").alias("_g3"), F.col("_id").alias("_id3")).agg(F.max("_s").alias("_s"))
        best = best.join(found, F.col("_g").eqNullSafe(F.col("_g3")) & (F.col("_id") == F.col("_id3")), "left")
        best = best.withColumn("_best", F.greatest("_best", F.coalesce("_s", F.lit(0.0)))).drop("_g3", "_id3", "_s")
        # done where a pair without a common n-gram, of the best length, is worse
        best = best.withColumn("_done", F.col("_done") | ((F.col("_len") >= n) & (F.col("_best") > _bound(n, F.col("_len"), F.col("_len"), None) + _SLACK)))
        best = stored(best, "best")
    best = best.select(F.col("_g").alias("_g4"), F.col("_h").alias("_h4"), "_best")
    both = rows.join(best, F.col("_g").eqNullSafe(F.col("_g4")) & (F.col("_h") == F.col("_h4")))
    value = F.when(F.col("_blank"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("_best"))))
    return both.select(F.col("_g").alias(group), F.col("_i").alias(item), value.alias("diversity"))
