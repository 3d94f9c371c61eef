"""Benchmark decontamination by winnowing.

Texts are words of letters, digits and non-ASCII characters, A-Z folded.  Of every window of 10 words the smallest of
its 5-word hashes is a fingerprint, on both sides, so that any 10 words that a document shares with an item give both
the same fingerprint.  Matching fingerprints are extended to whole windows, whose words are then compared.  Items
shorter than a window are looked up whole.

A benchmark of up to BROADCAST_BYTES of text, which is measured, is indexed on the driver and broadcast; documents are
only mapped then.  Beyond that nothing is broadcast: fingerprints of both sides are joined by shuffle, documents that
share one give their windows there, windows are joined by digest, and hits come back to their documents.  Documents
are read once either way.

Defined cases: a null or empty text or item has no words and no hits; items without an id hit words too, count as one
item together and have no part in items_sha256; items with equal ids count once; repeated documents, also of one id,
each get a row; a very long text is handled whole in one task; empty tables give no rows or no hits; other columns are
ignored.  Words are told apart by 64-bit hashes in the broadcast index, windows by 128-bit digests in the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import textops as tx
from sievework.llm.store import stored

SPAN = 10
GRAM = 5
BROADCAST_BYTES = 4 << 20


def fingerprints(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Ascending places of the GRAM-word hashes that are the smallest of some SPAN-word window of one document.
    Equal smallest hashes are all taken."""
    w = SPAN - GRAM + 1
    g = tx.grams(h, GRAM)
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = tx.sliding_min(g, w)
    inside = doc[: len(low)] == doc[SPAN - 1 :]
    chosen = np.zeros(len(g), bool)
    start = np.flatnonzero(inside)
    for k in range(w):
        at = start + k
        chosen[at[g[at] == low[start]]] = True
    return np.flatnonzero(chosen)


class Index:
    """Windows of some items by hash, each with its words and the items that have it."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        texts = tx.Texts.of([x for _, x in items])
        low = tx.LOWER[texts.data]
        s, e, first = tx.words(tx.Texts(low, texts.offsets), tx.NOT_ALNUM)
        self.words = tx.span_hashes(low, s, e)
        self.names = sorted({n for n, _ in items}, key=lambda n: (n is None, n))
        number = {n: i for i, n in enumerate(self.names)}
        count, own = np.diff(first), np.array([number[n] for n, _ in items], np.int64)
        doc = tx.owner(first)
        self.fingerprints = np.unique(tx.grams(self.words, GRAM)[fingerprints(self.words, doc)]) if len(self.words) else np.zeros(0, tx.U64)
        self.tables: dict[int, tuple] = {}
        for n in sorted({min(int(c), SPAN) for c in count if c}):
            mine = np.flatnonzero(count >= SPAN if n == SPAN else count == n)
            start = tx.ranges(first[mine], count[mine] - n + 1)
            holder = np.repeat(own[mine], count[mine] - n + 1)
            g = tx.grams(self.words, n)[start]
            keys, at, back = np.unique(g, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([back, holder], 1), axis=0)
            self.tables[n] = (keys, start[at], np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)), pairs[:, 1])

    def windows(self, n: int, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places `at` where a window of n words begins, and its number in the table."""
        keys, example, _, _ = self.tables[n]
        g = tx.grams(h, n)[at]
        i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        ok = keys[i] == g
        at, i = at[ok], i[ok]
        step = np.arange(n)
        same = (h[at[:, None] + step] == self.words[example[i][:, None] + step]).all(1)
        return at[same], i[same]


def hits(t: tx.Texts, index: Index) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each text, and (start, length, item) triples of the windows found in it; starts count its words."""
    low = tx.LOWER[t.data]
    s, e, first = tx.words(tx.Texts(low, t.offsets), tx.NOT_ALNUM)
    h, doc = tx.span_hashes(low, s, e), tx.owner(first)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, (_, _, begin, holders) in index.tables.items():
        if len(h) < n:
            continue
        inside = doc[: len(h) - n + 1] == doc[n - 1 :]
        if n == SPAN:
            f = fingerprints(h, doc)
            f = f[np.isin(tx.grams(h, GRAM)[f], index.fingerprints)]
            at = np.unique((f[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
            at = at[(at >= 0) & (at < len(inside))]
            at = at[inside[at]]
        else:
            at = np.flatnonzero(inside)
        at, which = index.windows(n, h, at)
        many = begin[which + 1] - begin[which]
        found.append((np.repeat(at, many), np.full(int(many.sum()), n), holders[tx.ranges(begin[which], many)]))
    if not found:
        found = [(np.zeros(0, np.int64),) * 3]
    at, size, item = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
    order = np.argsort(at, kind="stable")
    at, size, item = at[order], size[order], item[order]
    cuts = np.searchsorted(at, first)
    return np.diff(first), [(at[a:b] - f, size[a:b], item[a:b]) for a, b, f in zip(cuts[:-1], cuts[1:], first[:-1], strict=True)]


def covered(start: np.ndarray, size: np.ndarray) -> int:
    """Words in the union of ranges with ascending starts."""
    if not len(start):
        return 0
    end = np.maximum.accumulate(start + size)
    return int((end - np.maximum(start, np.concatenate(([start[0]], end[:-1])))).clip(0).sum())


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def verdict(doc: int | None, n_words: int, start: np.ndarray, size: np.ndarray, items: set[str | None]) -> tuple:
    """A result row, from the windows found and the items that have them."""
    order = np.argsort(start, kind="stable")
    n = covered(start[order], size[order])
    return doc, n_words, n, len(items), hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest(), n > 0


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))


def _index(benchmark: DataFrame, most: int):
    """The broadcast index, or None for a benchmark of more than `most` bytes."""
    items = _items(benchmark)
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most:
        return None
    rows = [(r["item"], r["text"].encode()) for r in items.collect()]
    return benchmark.sparkSession.sparkContext.broadcast(Index(sorted(rows, key=lambda r: (r[0] is None, r))))


# ---- by shuffle: rows are numbered, so that documents of one id stay apart


def _numbers(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes that also tell how long their window is."""
    return tx.mix(h ^ tx.U64(n * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)


def _parts(t: tx.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = tx.LOWER[t.data]
    s, e, first = tx.words(tx.Texts(low, t.offsets), tx.NOT_ALNUM)
    return low, s, e, first, tx.span_hashes(low, s, e), tx.owner(first)


def _digests(low: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, n: int) -> list[bytes]:
    raw, s, e = low.tobytes(), s.tolist(), e.tolist()
    return [hashlib.blake2b(b" ".join(raw[s[w] : e[w]] for w in range(i, i + n)), digest_size=16).digest() for i in at.tolist()]


def _keys(lengths: list[int], short_only: bool):
    """(row, n, h): fingerprints (n is SPAN) and windows of the shorter lengths of each row, each once.  Of an item
    (short_only) the shorter windows are the item itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                _, _, _, first, h, doc = _parts(t)
                count, found = np.diff(first), []
                f = fingerprints(h, doc) if len(h) else np.zeros(0, np.int64)
                found.append((doc[f], np.full(len(f), SPAN), _numbers(tx.grams(h, GRAM)[f], SPAN)))
                for n in lengths:
                    if len(h) < n:
                        continue
                    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
                    at = at[count[doc[at]] == n] if short_only else at
                    found.append((doc[at], np.full(len(at), n), _numbers(tx.grams(h, n)[at], n)))
                d, n, k = (np.concatenate([x[i] for x in found]) for i in range(3))
                once = np.unique(np.stack([d, n, k]).astype(np.int64), axis=1) if len(d) else np.zeros((3, 0), np.int64)
                row = np.asarray(part.column("row"))
                yield pa.RecordBatch.from_arrays([pa.array(row[once[0]]), pa.array(once[1].astype(np.int32)), pa.array(once[2])], names=["row", "n", "h"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, digest) of every window of an item."""
    for batch in batches:
        for part, t in tx.chunks(batch, "text"):
            low, s, e, first, _, _ = _parts(t)
            for i in range(len(t)):
                count = int(first[i + 1] - first[i])
                if count:
                    n = min(count, SPAN)
                    found = sorted(set(_digests(low, s, e, np.arange(first[i], first[i + 1] - n + 1), n)))
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("item")[i].as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "digest"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, n, digest) of the windows of a document that hold a shared fingerprint, or are a shared short one."""
    for batch in batches:
        for row, text, live in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), batch.column("live").to_pylist(), strict=True):
            low, s, e, _, h, doc = _parts(tx.Texts.of([text.encode()]))
            wanted: dict[int, list[int]] = {}
            for x in live:
                wanted.setdefault(x["n"], []).append(x["h"])
            for n, keys in sorted(wanted.items()):
                if n == SPAN:
                    f = fingerprints(h, doc)
                    f = f[np.isin(_numbers(tx.grams(h, GRAM)[f], n), np.array(keys))]
                    at = np.unique((f[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
                    at = at[(at >= 0) & (at <= len(h) - n)]
                else:
                    at = np.flatnonzero(np.isin(_numbers(tx.grams(h, n), n), np.array(keys)))
                if len(at):
                    columns = [np.full(len(at), row), at.astype(np.int64), np.full(len(at), n, np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(_digests(low, s, e, at, n), pa.binary())], names=["row", "at", "n", "digest"])


def _met(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, spans, items) of the rows of docs that hold a window; docs are numbered and stored."""
    items = stored(_items(benchmark).withColumn("row", F.monotonically_increasing_id()), "items")
    size = F.size(F.filter(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())
    known = items.select("row", "text").mapInArrow(_keys(lengths, True), "row long, n int, h long").select("n", "h").distinct()
    sent = docs.select("row", "text").mapInArrow(_keys(lengths, False), "row long, n int, h long")
    live = stored(sent.join(known, ["n", "h"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("n", "h")).alias("live")), "live")
    found = stored(docs.select("row", "text").join(live, "row").mapInArrow(_candidates, "row long, at long, n int, digest binary"), "candidates")
    windows = stored(items.select("item", "text").mapInArrow(_windows, "item string, digest binary").distinct(), "windows")
    confirmed = stored(found.join(windows.select("digest").distinct(), "digest", "left_semi"), "hits")
    spans = confirmed.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    # a structure, as sets leave nulls out
    named = confirmed.select("row", "digest").distinct().join(windows, "digest").groupBy("row").agg(F.collect_set(F.struct("item")).alias("items"))
    return stored(spans.join(named, "row"), "met")


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    # the number is fixed by the write
    return stored(docs.select(*columns).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row", F.monotonically_increasing_id()), "numbered")


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, t in tx.chunks(batch, "text"):
            count, rows = np.diff(_parts(t)[3]).tolist(), []
            for doc, n, spans, items in zip(part.column("doc_id").to_pylist(), count, part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
                at = np.array([x["at"] for x in spans or []], np.int64)
                rows.append(verdict(doc, n, at, np.array([x["n"] for x in spans or []], np.int64), {x["item"] for x in items or []}))
            yield _result(rows)


def find(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One verdict for each document."""
    index = _index(benchmark, broadcast_bytes)
    if index is None:
        rows = _numbered(docs, "doc_id", "text")
        met = _met(rows, benchmark).withColumnRenamed("row", "_row")
        return rows.join(met, F.col("row") == F.col("_row"), "left").select("doc_id", "text", "spans", "items").mapInArrow(_verdicts, RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                n, found = hits(t, known)
                ids = part.column("doc_id").to_pylist()
                yield _result([verdict(i, k, a, s, {known.names[x] for x in np.unique(o).tolist()}) for i, k, (a, s, o) in zip(ids, n.tolist(), found, strict=True)])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a hit, all columns."""
    index = _index(benchmark, broadcast_bytes)
    if index is None:
        columns = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names of their own, whatever docs' are
        rows = stored(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()], F.monotonically_increasing_id().alias("row")), "numbered")
        met = _met(rows.select("row", F.coalesce(columns["text"], F.lit("")).alias("text")), benchmark).select("row")
        return rows.join(met, "row", "left_anti").select(*[F.col(n).alias(c) for c, n in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                kept = part.filter(pa.array([not len(at) for at, _, _ in hits(t, index.value)[1]], pa.bool_()))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT *, least(len(ws), 10) AS m FROM item WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS k
        FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT m FROM win),
dwin AS (SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS k
         FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM fold, lens WHERE len(ws) >= m)),
met AS (SELECT d.doc_id, d.i, d.m, w.item_id FROM dwin d JOIN win w ON d.m = w.m AND d.k = w.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM fold f LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
