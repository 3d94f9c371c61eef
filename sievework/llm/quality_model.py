"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are folded to lower case (A-Z), hashed, and counted as 1-grams and 2-grams in BUCKETS bins, as log(1 + count)
over the text's norm; a few dense columns of shape (length, capitals, symbols, repetition) join them.  Training is
FTRL-proximal with L1 and L2, one update a text, on a bounded sample of labelled rows; scoring is a sparse dot product
with one array of weights whose size is fixed by BUCKETS.

Defined cases: a null or empty text has no words and gets the score of its bias and shape columns; a very long text is
scored whole in one task; repeated rows get equal scores; labels without a document are ignored; different labels of
a document count as several rows, equal ones as one; of documents with equal ids one text is learned from; without any labelled row, or with labels of one class only, the score is the share of
label 1 among them (0.5 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import textops as tx

BUCKETS = 1 << 18
SHAPE = 6
#: At most so many labelled rows, those with the smallest hashes of their ids, are used to fit.
SAMPLE_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0005, 0.0005
SALT = 17


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(parts))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y, text) of at most `most` labelled documents outside the held-out fold, by a hash order: the same at
    every size.  Labels count once, and only those that have a document; of several texts of an id one is taken, by a
    hash order too, so the bound holds for rows."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & (fold(F.col("doc_id"), parts) != held_out)).distinct()
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(SALT)), "doc_id", "y").limit(most)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def features(t: tx.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, values, first): non-zero bins of document i are first[i]:first[i + 1]."""
    low = tx.LOWER[t.data]
    s, e, first = tx.words(t)
    h = tx.span_hashes(low, s, e)
    doc = tx.owner(first)
    two = tx.grams(h, 2)
    inside = doc[1:] == doc[:-1]
    key = np.concatenate([h, two[inside]]) & tx.U64(BUCKETS - 1)
    own = np.concatenate([doc, doc[:-1][inside]])
    flat, counts = np.unique(own.astype(np.int64) * BUCKETS + key.astype(np.int64), return_counts=True)
    own, bins, value = flat >> 18, flat & (BUCKETS - 1), np.log1p(counts)
    n = len(t)
    norm = np.sqrt(np.bincount(own, value * value, n))
    value = value / norm[own]
    # shape columns take the bins beyond BUCKETS
    size = np.maximum(np.diff(t.offsets), 1)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[t.offsets])
    n_words = np.maximum(np.diff(first), 1)
    distinct = np.bincount(np.unique(doc * (1 << 20) + (h & tx.U64((1 << 20) - 1)).astype(np.int64)) >> 20, minlength=n)[:n] if len(h) else np.zeros(n)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    shape = np.stack(
        [
            np.ones(n),
            np.log1p(np.diff(first)) / 8,
            total((t.data >= 65) & (t.data <= 90)) / size,
            total(symbol[t.data]) / size * 4,
            total(t.data == 33) / size * 4,
            1 - distinct / n_words,
        ],
        1,
    )
    own = np.concatenate([own, np.repeat(np.arange(n), SHAPE)])
    order = np.argsort(own, kind="stable")
    bins = np.concatenate([bins, BUCKETS + np.tile(np.arange(SHAPE), n)])[order]
    value = np.concatenate([value, shape.ravel()])[order]
    return bins.astype(np.int32), value.astype(np.float32), np.searchsorted(own[order], np.arange(n + 1))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights from (label, bins, values) of each training text."""
    w = np.zeros(BUCKETS + SHAPE)
    ys = np.array([y for y, _, _ in rows])
    if not len(ys) or ys.min() == ys.max():
        share = ys.mean() if len(ys) else 0.5
        w[BUCKETS] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return w
    z, n = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            y, at, x = rows[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wi @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - sigma * wi, ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held_out: int = 0, most: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights.  Executors turn the sample into sparse rows; the driver gets those, `most` at the utmost."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                bins, values, first = features(t)
                keep = [slice(first[i], first[i + 1]) for i in range(len(t))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array([bins[k].tobytes() for k in keep], pa.binary()), pa.array([values[k].astype(np.float16).tobytes() for k in keep], pa.binary())],
                    names=["doc_id", "y", "bins", "vals"],
                )

    texts = training_texts(docs, labels, label, parts, held_out, most)
    got = texts.mapInArrow(sparse, "doc_id long, y int, bins binary, vals binary").toLocalIterator()
    rows = sorted(((r["doc_id"], r["y"], bytes(r["bins"]), bytes(r["vals"])) for r in got))
    return fit([(y, np.frombuffer(b, np.int32), np.frombuffer(v, np.float16).astype(np.float64)) for _, y, b, v in rows])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every text, in one pass without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                bins, values, first = features(t)
                z = np.add.reduceat(w[bins].astype(np.float64) * values, first[:-1])  # each text has its shape columns
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
