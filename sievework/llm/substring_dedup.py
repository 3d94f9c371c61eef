"""Substring dedup by relative Lempel-Ziv parsing: removes words of 50-word windows that start in an earlier document.

Distinct segments of a group are taken in the order of their documents and factored greedily against those of smaller
documents, which form the indexed reference block: at each place the longest reference string is sought and the parse
goes on behind it.  Factors of 50 words and more are duplicate spans.  A window across a factor's end may still lie
whole in another reference string, so the parse resumes at the last word from which a window would cross that end, and
seeks again from there.

Defined cases: a null or empty text has no words; texts below 50 words lose nothing; rows with equal doc_id do not
remove each other's words; of repeated rows the smallest doc_id keeps its words; a null doc_id counts as the largest; a
very long text is a block of its own; an empty table gives an empty result; other columns are ignored by the query and
kept by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import spans

WINDOW = 50
GRAM = 8


class Reference:
    """Reference strings of one group, with the places of each WINDOW-word string in them.  A string is known by its
    hash, and its words are compared wherever the hash is met, so that a place takes two numbers."""

    def __init__(self) -> None:
        self.texts: list[list[bytes]] = []
        self.places: dict[int, list[tuple[int, int]]] = {}

    def at(self, words: list[bytes], p: int) -> list[tuple[list[bytes], int]]:
        """Places of the string that begins at p."""
        string = words[p : p + WINDOW]
        held = ((self.texts[k], q) for k, q in self.places.get(hash(tuple(string)), ()))
        return [(other, q) for other, q in held if other[q : q + WINDOW] == string]

    def add(self, words: list[bytes]) -> None:
        self.texts.append(words)
        for p in range(len(words) - WINDOW + 1):
            if len(self.at(words, p)) < 4:  # any one proves the window; more only let a factor be longer
                self.places.setdefault(hash(tuple(words[p : p + WINDOW])), []).append((len(self.texts) - 1, p))

    def longest(self, words: list[bytes], p: int) -> int:
        """Words of the longest factor at p among the indexed places, 0 if it is shorter than a window."""
        best = 0
        for other, q in self.at(words, p):
            n, most = WINDOW, min(len(words) - p, len(other) - q)
            while n < most and words[p + n] == other[q + n]:
                n += 1
            best = max(best, n)
        return best


def factors(words: list[bytes], reference: Reference) -> list[tuple[int, int]]:
    """(start, length) of the duplicate spans, ascending; spans may overlap at checked boundaries."""
    out, p = [], 0
    while p + WINDOW <= len(words):
        n = reference.longest(words, p)
        if n:
            out.append((p, n))
            p += n - WINDOW + 1  # the first window that is not in the factor
        else:
            p += 1
    return out


def match(segments: list[bytes], least: np.ndarray, group: np.ndarray) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    order = np.lexsort((least, group))
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and group[order[j]] == group[order[i]]:
            j += 1
        reference, waiting, at = Reference(), [], None
        for k in order[i:j].tolist():
            if least[k] != at:  # segments of one document do not refer to each other
                for w in waiting:
                    reference.add(w)
                waiting, at = [], least[k]
            words = segments[k].split(b" ")
            out[k] = factors(words, reference)
            waiting.append(words)
        i = j
    return out


KIND = spans.Kind(words=True, window=WINDOW, gram=GRAM, match=match)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in spans.rows(batch):
            u, gone, _ = spans.removed_units(row, KIND)
            start, end, raw, out = u.start.tolist(), u.end.tolist(), u.raw, []
            for i, a, b in zip(row["ids"], u.first[:-1].tolist(), u.first[1:].tolist(), strict=True):
                left = (np.flatnonzero(~gone[a:b]) + a).tolist()
                kept = b" ".join([raw[start[w] : end[w]] for w in left])
                out.append((i, b - a, b - a - len(left), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(),) * 3 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def removals(docs: DataFrame) -> DataFrame:
    """What each document loses."""
    return spans.repeated(docs, KIND).mapInArrow(_rows, RESULT)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without the removed words; changed texts are their kept words joined by one space."""
    return spans.cleaned(docs, KIND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
low AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (
           SELECT w.doc_id, unnest(range(w.i, w.i + 50)) AS p FROM win w JOIN low USING (k) WHERE w.doc_id > low.first)),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
