"""Toxicity: gradient-boosted trees over a few dense features, calibrated by isotonic regression.

Words are runs of letters, digits and non-ASCII bytes, in lower case.  A lexicon of words and word beginnings is
learned from labelled texts by smoothed log-odds; the dense features are its densities and weights, how near its hits
stand to second-person words, and the rates of capitals, punctuation and obfuscated words.  The labelled sample is cut
in three by hash: one part gives the lexicon, one the trees, one the calibration.

A score is nine tenths the calibrated chance and one tenth the trees' own, which keeps the order in level stretches.

Defined cases: a null or empty text has features of zero and gets the score of such a row; a very long text is one row
of features in one task; repeated rows get equal scores; labels without a document are ignored; several labels of a
document count as several rows; without labelled rows of both classes every score is the share of label 1 (0.5 without
any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import textops as tx
from sievework.llm.quality_model import SALT, fold, training_texts
from sievework.llm.store import stored

#: At most so many labelled rows, those with the smallest hashes of their ids, are used to fit.
SAMPLE_ROWS = 12000
#: Terms of the lexicon at most, and the lengths in bytes of the word beginnings that can be terms.
LEXICON = 512
BEGINNINGS = (5, 6, 7, 8)
NEAR = 4
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 5.0

#: Second-person words of the corpus' languages (fixed values).
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti eres usted ustedes vosotros vuestro"

FEATURES = ("words", "hit_rate", "begin_rate", "log_hits", "weight_rate", "near_you", "you_rate", "capital_rate", "punct_rate", "outcry_rate", "obfuscated_rate", "densest")


def _terms(t: tx.Texts):
    """Word spans, owners and hashes; hashes of the beginnings of longer words as (word index, hash)."""
    low = tx.LOWER[t.data]
    s, e, first = tx.words(t, tx.NOT_ALNUM)
    h = tx.span_hashes(low, s, e)
    begin_at, begin_h = [], []
    for n in BEGINNINGS:
        at = np.flatnonzero(e - s > n)
        begin_at.append(at)
        begin_h.append(~tx.span_hashes(low, s[at], s[at] + n))  # told apart from whole words
    return s, e, first, h, np.concatenate(begin_at), np.concatenate(begin_h)


def learn_lexicon(texts: DataFrame, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(sorted term hashes, log-odds) from (y, text); the counting is one pre-aggregated groupBy."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                y = np.asarray(part.column("y"))
                _, _, first, h, at, bh = _terms(t)
                doc = tx.owner(first)
                pair = np.unique(np.rec.fromarrays([np.concatenate([h, bh]), np.concatenate([doc, doc[at]])], names="h,d"))
                terms, back = np.unique(pair.h, return_inverse=True)
                bad = np.bincount(back, y[pair.d], len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(bad), pa.array(np.bincount(back, minlength=len(terms)) - bad)], names=["term", "bad", "good"])

    totals = texts.agg(F.sum(F.col("y").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    n_bad = totals["bad"] or 0
    n_good = totals["n"] - n_bad
    if not n_bad or not n_good:
        return np.zeros(0, tx.U64), np.zeros(0)
    odds = F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (n_good - F.col("good") + 0.5))
    counted = texts.mapInArrow(count, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = counted.where(F.col("bad") >= max(3, int(0.02 * n_bad))).withColumn("odds", odds).where(F.col("odds") > 2.5).orderBy(F.desc("odds"), "term").limit(most).collect()
    terms = np.array([r["term"] for r in rows], np.int64).view(tx.U64)
    order = np.argsort(terms)
    return terms[order], np.array([r["odds"] for r in rows])[order]


def dense(t: tx.Texts, terms: np.ndarray, odds: np.ndarray, you: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(t)
    s, e, first, h, at, bh = _terms(t)
    doc = tx.owner(first)
    n_words = np.diff(first)
    per_word = 1 / np.maximum(n_words, 1)

    def known(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(terms):
            return np.zeros(len(x), bool), np.zeros(len(x))
        i = np.minimum(np.searchsorted(terms, x), len(terms) - 1)
        ok = terms[i] == x
        return ok, np.where(ok, odds[i], 0.0)

    whole, weight = known(h)
    begins, begin_weight = known(bh)
    hit_begin = np.zeros(len(h), bool)
    hit_begin[at[begins]] = True
    np.maximum.at(weight, at, begin_weight)
    hit = whole | hit_begin
    is_you = np.isin(h, you)
    reach = np.concatenate(([0], np.cumsum(is_you)))
    i = np.arange(len(h))
    lo, hi = np.maximum(i - NEAR, first[doc]), np.minimum(i + NEAR + 1, first[doc + 1])
    near = hit & (reach[hi] > reach[lo])
    hits = np.concatenate(([0], np.cumsum(hit)))
    crowd = hits[np.minimum(i + 30, first[doc + 1])] - hits[i]
    densest = np.zeros(n)
    np.maximum.at(densest, doc, crowd)
    size = np.maximum(np.diff(t.offsets), 1)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[t.offsets])
    d = t.data
    punct = (d < 0x30) & ~tx.SPACE[d] & (d > 0x20) | (d > 0x39) & (d < 0x41) | (d > 0x5A) & (d < 0x61) | (d > 0x7A) & (d < 0x7F)
    # a word is obfuscated if it has a digit among letters, or one of *@$!. alone between two of its letters
    letter = ~tx.NOT_ALNUM[d] & ~((d >= 0x30) & (d <= 0x39)) | (d >= 65) & (d <= 90)
    odd = np.zeros(256, bool)
    odd[list(b"*@$!.-_0123456789")] = True
    mid = np.zeros(len(d), bool)
    if len(d) > 2:
        mid[1:-1] = letter[:-2] & odd[d[1:-1]] & letter[2:]
    by = lambda x: np.bincount(doc, x, n)
    return np.stack(
        [
            np.log1p(n_words),
            by(whole) * per_word,
            by(hit_begin) * per_word,
            np.log1p(by(hit)),
            by(weight) * per_word,
            by(near) * per_word,
            by(is_you) * per_word,
            total((d >= 65) & (d <= 90)) / size,
            total(punct) / size,
            total((d == 33) | (d == 63)) / size,
            total(mid) * per_word,
            densest,
        ],
        1,
    )


class Boosted:
    """Histogram gradient boosting for the logistic loss; complete trees of DEPTH levels in arrays."""

    def __init__(self) -> None:
        self.bias, self.feature, self.cut, self.value = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], 1)  # bin <= b: x <= edges[b]
        f = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, w = p - y, p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
            node = np.zeros(len(y), int)
            for level in range(DEPTH):
                base = 2**level - 1
                for k in range(base, 2 * base + 1):
                    rows = np.flatnonzero(node == k)
                    best = 1e-6
                    if len(rows) >= 2 * LEAF:
                        gt, wt = g[rows].sum(), w[rows].sum()
                        for j in range(x.shape[1]):
                            m = len(edges[j])
                            if not m:
                                continue
                            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], m + 1))[:-1]
                            wl = np.cumsum(np.bincount(binned[rows, j], w[rows], m + 1))[:-1]
                            cl = np.cumsum(np.bincount(binned[rows, j], minlength=m + 1))[:-1]
                            gain = gl**2 / (wl + 1) + (gt - gl) ** 2 / (wt - wl + 1) - gt**2 / (wt + 1)
                            gain[(cl < LEAF) | (len(rows) - cl < LEAF)] = 0
                            if gain.max() > best:
                                best, feature[k], cut[k] = gain.max(), j, edges[j][gain.argmax()]
                    node[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
            leaf = node - (2**DEPTH - 1)
            value = -np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, w, 2**DEPTH) + 1) * RATE
            f += value[leaf]
            self.feature.append(feature), self.cut.append(cut), self.value.append(value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            f += value[node - (2**DEPTH - 1)]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, smoothed share of label 1) of the pool-adjacent-violators fit."""
    order = np.argsort(f, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(f[order], y[order], strict=True):
        blocks.append([float(a), float(b), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            c = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][2] + c[0] * c[2]) / (blocks[-1][2] + c[2]), blocks[-1][1] + c[1], blocks[-1][2] + c[2]]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Lexicon, trees and calibration: a few tens of kilobytes whatever the corpus."""

    def __init__(self, terms: np.ndarray, odds: np.ndarray, prior: float):
        self.terms, self.odds, self.prior, self.trees, self.knots = terms, odds, prior, None, None
        listed = tx.Texts.of([w.encode() for w in SECOND_PERSON.split()])
        s, e, _ = tx.words(listed, tx.NOT_ALNUM)
        self.you = tx.span_hashes(listed.data, s, e)

    def dense(self, t: tx.Texts) -> np.ndarray:
        return dense(t, self.terms, self.odds, self.you)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a small share of the raw probability keeps the order inside level stretches."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        f = self.trees.raw(x)
        return 0.9 * np.interp(f, *self.knots) + 0.1 / (1 + np.exp(-np.clip(f, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held_out: int = 2, most: int = SAMPLE_ROWS) -> Model:
    texts = stored(training_texts(docs, labels, label, parts, held_out, most), "toxicity-sample").withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit(SALT + 1)), F.lit(100)))
    model = Model(*learn_lexicon(texts.where("third < 45")), 0.5)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                x = model.dense(t)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("third"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "third", "y", "x"])

    got = sorted((r["doc_id"], r["third"], r["y"], r["x"]) for r in texts.mapInArrow(rows, "doc_id long, third long, y int, x array<double>").toLocalIterator())
    y = np.array([r[2] for r in got], float)
    if not len(y) or y.min() == y.max():
        model.prior = float(y.mean()) if len(y) else 0.5
        return model
    third, x = np.array([r[1] for r in got]), np.array([r[3] for r in got])
    grow, level = (third >= 45) & (third < 80), third >= 80
    if len(set(y[grow])) < 2:
        grow = np.ones(len(y), bool)
    if len(set(y[level])) < 2:
        level = np.ones(len(y), bool)
    model.trees = Boosted().fit(x[grow], y[grow])
    model.knots = isotonic(model.trees.raw(x[level]), y[level])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every text, in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(sent.value.dense(t)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, all columns; each text is judged in the pass that reads it.
    Rows with equal doc_id are judged each by its own text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                kept = part.filter(pa.array(model.value.score(model.value.dense(t)) < threshold))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)
