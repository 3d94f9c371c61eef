"""Packing by concatenate and cut.

Pass one tokenises every text once and stores bundles of ids with their place in their partition; the partitions'
token totals are summed up to global offsets (one row a partition).  Pass two reads the bundles where they lie and
cuts the stream of all ids at multiples of the sequence length; a document that crosses a cut gives one boundary
record on either side.  Only the last sequence of all is padded.

Defined cases: a null or empty text is its end mark alone; rows with equal doc_id are packed one by one, and so are
rows without an id, whose pieces have none; an empty table gives no piece; other columns are ignored.  Words between ASCII white space, A-Z folded as the vocabulary does,
are tokenised once per worker and looked up by a 64-bit hash after that: its splitter never joins across white space.
Texts that hold an added token of the vocabulary (matched in the raw text, not folded) are tokenised whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm import textops as tx
from sievework.llm.store import stored

LENGTH = 4096
END = 2
#: Distinct words that a worker remembers; it starts anew beyond, which changes speed only.
REMEMBERED = 600_000
#: A seldom word of one id in the vocabulary; it only stands between words that are tokenised together.
MARK = "philanthropy"
#: Up to so many partitions their offsets are broadcast (16 bytes each), beyond that they are joined by shuffle.
BROADCAST_PARTITIONS = 1_000_000
BUNDLES = "part int, before long, n long, docs binary, nulls binary, counts binary, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of words, by hash; texts are put together from them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [a.content.encode().translate(tx.LOWER.tobytes()) for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, tx.U64), np.zeros(0, np.int32)  # by key
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids, size = self.encode(texts)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.concatenate(([0], np.cumsum(size)))[:-1]
        at = np.searchsorted(self.keys, keys)
        self.slots = np.insert(self.slots, at, np.arange(len(self.start), len(self.start) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number in each).  They go as one text with a word of one id between them; where that id
        shows up within a text too, they go one by one."""
        parts = [f" {MARK} ".join(texts[i : i + 256]) for i in range(0, len(texts), 256)]
        ids = np.concatenate([np.array(x.ids + [self.mark], np.uint32) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) == len(texts):
            return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1
        each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])

    def __call__(self, t: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end marks, number of them in each text)."""
        low, raw = tx.LOWER[t.data], t.data.tobytes()
        s, e, first = pieces(t)
        whole = self.with_added(low.tobytes(), t.offsets)
        if len(whole):
            stay = ~np.isin(np.repeat(np.arange(len(first) - 1), np.diff(first)), whole)
            first = np.concatenate(([0], np.cumsum(stay)))[first]
            s, e = s[stay], e[stay]
        keys, at, back = np.unique(tx.span_hashes(low, s, e), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.append(self.keys, tx.U64(0))[place] == keys
        known[place == len(self.keys)] = False
        slot = np.where(known, np.append(self.slots, np.int32(0))[place], -1)
        new = np.flatnonzero(slot < 0)
        if len(new):
            n = len(self.start)
            self.learn(keys[new], [raw[a:b].decode() for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)])
            slot[new] = n + np.arange(len(new))
        which = slot[back]
        size = self.size[which]
        ids = self.pool[tx.ranges(self.start[which], size)]
        ends = np.concatenate(([0], np.cumsum(size)))[first]
        n = np.diff(ends)
        if len(whole):
            each = [x.ids for x in self.tokenizer.encode_batch_fast([raw[t.offsets[i] : t.offsets[i + 1]].decode() for i in whole.tolist()], add_special_tokens=False)]
            n[whole] = [len(x) for x in each]
            ids = np.insert(ids, np.repeat(ends[whole], n[whole]), [i for x in each for i in x])
            ends = np.concatenate(([0], np.cumsum(n)))
        return np.insert(ids, ends[1:], END), n + 1

    def with_added(self, low: bytes, offsets: np.ndarray) -> np.ndarray:
        """Texts with the content of an added token, in any case (more than have the token, which changes speed only)."""
        at = []
        for content in self.added:
            k = low.find(content)
            while k >= 0:
                at.append(k)
                k = low.find(content, k + 1)
        i = np.unique(np.searchsorted(offsets, np.array(at, np.int64), side="right") - 1)
        return i[(i >= 0) & (i < len(offsets) - 1)]


def pieces(t: tx.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, with ASCII punctuation at their ends as pieces of its own where a letter or digit stands before it: there
    the vocabulary's splitter always divides.  Letters are told for ASCII and for U+00C0 to U+00FF."""
    s, e, _ = tx.words(t)
    d = t.data
    punct = tx.NOT_ALNUM[tx.LOWER[d]]
    last = np.maximum.accumulate(np.where(punct, -1, np.arange(len(d))))[e - 1] if len(s) else s  # last other byte
    inside = (last >= s) & (last < e - 1)
    at = last[inside]
    before = d[np.maximum(at - 1, 0)]
    letter = (d[at] < 0x80) | (before == 0xC3) & (at > s[inside]) & (d[at] != 0x97) & (d[at] != 0xB7)
    cut = at[letter] + 1
    start = np.sort(np.concatenate([s, cut]))
    return start, np.sort(np.concatenate([e, cut])), np.searchsorted(start, t.offsets)


def tokenized(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bundles of documents: their ids, and the tokens that come before them in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        words = WordTokens(vocabulary)
        kind = np.uint32 if words.wide else np.uint16
        for batch in batches:
            for rows, t in tx.chunks(batch, text, tx.CHUNK_BYTES // 2):
                ids, counts = words(t)
                key_of = rows.column(key).cast(pa.int64())
                doc, nulls = np.asarray(key_of.fill_null(0)), np.packbits(np.asarray(key_of.is_null())).tobytes() if key_of.null_count else None
                yield pa.RecordBatch.from_pylist(
                    [{"part": part, "before": before, "n": len(ids), "docs": doc.tobytes(), "nulls": nulls, "counts": counts.astype(np.int64).tobytes(), "ids": ids.astype(kind).tobytes()}],
                    schema=pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("nulls", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())]),
                )
                before += len(ids)

    return docs.select(key, text).mapInArrow(run, BUNDLES)


def cut(bundles: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of the bundles' documents, in sequences of `length` ids."""
    totals = bundles.groupBy("part").agg(F.sum("n").alias("tokens"))
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))
    bases = stored(bases, "packing-offsets")
    if bases.count() <= BROADCAST_PARTITIONS:
        bases = F.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc, n = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.int64)
                ids = np.frombuffer(r["ids"], np.uint16 if len(r["ids"]) == 2 * r["n"] else np.uint32).astype("<u4")
                inner = np.concatenate(([0], np.cumsum(n)))[:-1]
                at = inner + (r["base"] + r["before"])
                pieces = (at + n - 1) // length - at // length + 1
                own = np.repeat(np.arange(len(n)), pieces)
                sequence = tx.ranges(at // length, pieces)
                a, b = np.maximum(at[own], sequence * length), np.minimum((at + n)[own], (sequence + 1) * length)
                shift = r["base"] + r["before"]
                crc = [zlib.crc32(ids[i:j]) for i, j in zip((a - shift).tolist(), (b - shift).tolist(), strict=True)]
                no_id = np.unpackbits(np.frombuffer(r["nulls"], np.uint8))[own].astype(bool) if r["nulls"] else None
                columns = [a - at[own], b - a, np.array(crc, np.int64), n[own], sequence, a - sequence * length]
                yield pa.RecordBatch.from_arrays([pa.array(doc[own], mask=no_id), *[pa.array(c.astype(np.int64)) for c in columns]], names=[c.split()[0] for c in PIECES.split(", ")])

    return bundles.join(bases, "part").select("base", "before", "n", "docs", "nulls", "counts", "ids").mapInArrow(run, PIECES)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    return cut(stored(tokenized(docs, str(vocabulary or default_vocabulary())), "packing-ids"), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
