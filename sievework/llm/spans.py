"""Repeated windows across documents: what substring dedup over words and suffix-array dedup over bytes share.

A unit is a byte or a word, a window WINDOW consecutive units of one document.  Texts lie in stored blocks.

1. Copies: documents equal to one with a smaller id are known by their digests and take no further part.
2. Anchors: a window's key is the smallest hash of its GRAM-unit pieces, so equal windows have equal keys.  Each block
   sends its distinct keys, packed, to the buckets of the key space; a bucket answers each block with those that
   another document has too.  Keys that very many blocks hold, or fewer blocks very often, are marked hot.  Of more
   than TREE_BLOCKS blocks, some thousand count their keys together first, so that a bucket has a key once for each
   of these groups and not for each block.
3. Segments: a block cuts out each run of windows whose key has come back and sends it to the shard of its key.
4. A shard keeps each distinct segment once, with its smallest document; later ones are removed whole.  Where a key has
   several distinct segments, `match` (an operator's own method) tells which of their windows lie in a segment of a
   smaller document.
5. Hot keys' windows, a common passage with all its surroundings, meet in no shard.  Blocks list their distinct ones by
   a 128-bit hash, with their places, and these lists only pass through the shards' tasks; the smallest document of a
   window is an aggregate, combined before the shuffle, and a join, whose hot side can be split, brings it back.
6. Spans and hot windows go back to their blocks, which write what is left.

Buckets and shards are numbered in proportion to the corpus, so their size is bounded; nothing reaches the driver but
sums.  Anchors only choose candidates; segments are compared as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sievework.llm import textops as tx
from sievework.llm.store import stored

BLOCK_BYTES = 1 << 20
#: Text bytes whose anchors, or cut-out segments, make one bucket or shard.
BUCKET_BYTES, SHARD_BYTES = 16 << 20, 2 << 20
KEY_BITS = 45  # three more bits say how a block has the key: whether in several documents, and how often about
RUNS = (1, 32, 512, 8192)
#: Windows in a segment at most.
MOST_RUN = 4096
#: Segments of a key, about, that a shard has room for.
HOT_RUNS = SHARD_BYTES // 64
#: Beyond so many blocks their keys are counted by groups of GROUP_BLOCKS first.
TREE_BLOCKS, GROUP_BLOCKS = 1 << 20, 4096
NO_ID = np.iinfo(np.int64).max  # a null id counts as the largest

#: From (segments as bytes, smallest document of each, group of each), for each segment its removed units as (start, length).
Match = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class Kind:
    words: bool
    window: int
    gram: int
    match: Match
    hot_blocks: int = 1000


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(keys: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each may hold a block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Rows sorted by key, one key's at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = np.asarray(batch.column(key))
        cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if j == i:
                continue
            if held and held[0].column(key)[0].as_py() != at[i]:
                yield held[0].column(key)[0].as_py(), held
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held[0].column(key)[0].as_py(), held


# ---- blocks

BLOCK = "block long, ids array<long>, digests array<binary>, bytes long, sizes binary, data binary, rest binary"
_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("bytes", pa.int64()), ("sizes", pa.binary()), ("data", pa.binary()), ("rest", pa.binary())])


def blocks(docs: DataFrame, carry: bool, most: int = BLOCK_BYTES) -> DataFrame:
    """Texts in blocks of about `most` bytes; with carry, the other columns go along as one Arrow message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part, t in tx.chunks(batch, "text", most):
                data = t.data.tobytes()
                sizes = np.diff(t.offsets)
                rest = b""
                if carry:
                    other = part.select([c for c in part.schema.names if c not in ("doc_id", "text", "n_chars")])
                    rest = squeeze(other.serialize().to_pybytes())
                row = {
                    "block": base + n,
                    "ids": part.column("doc_id").cast(pa.int64()).to_pylist(),
                    "digests": [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)],
                    "bytes": len(data),
                    "sizes": squeeze(sizes.tobytes()),
                    "data": squeeze(data),
                    "rest": rest,
                }
                n += 1
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    return stored((docs if carry else docs.select("doc_id", "text")).mapInArrow(run, BLOCK), "blocks", "uncompressed")


def load(row: dict) -> tuple[tx.Texts, np.ndarray]:
    """The texts of a block, and their ids with the largest number for none."""
    sizes = np.frombuffer(expand(row["sizes"]), np.int64)
    return tx.Texts(np.frombuffer(expand(row["data"]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))), np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)


class Units:
    """Units of a block: hashes, and the byte span of each."""

    def __init__(self, t: tx.Texts, kind: Kind):
        self.text, self.kind = t, kind
        if kind.words:
            self.start, self.end, self.first = tx.words(t)
            self.hash = tx.span_hashes(t.data, self.start, self.end)
        else:
            self.first, self.hash = t.offsets, t.data.astype(tx.U64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, document, first window, windows) of each run of neighbouring windows of one document and key; long runs,
        which periodic texts have, come in pieces of MOST_RUN windows."""
        w, k = self.kind.window, self.kind.gram
        if len(self.hash) < w:
            return np.zeros(0, tx.U64), *(np.zeros(0, np.int64),) * 3
        low = tx.sliding_min(tx.grams(self.hash, k), w - k + 1)
        doc = tx.owner(self.first)
        inside = doc[: len(low)] == doc[w - 1 :]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
        # windows that cross a document's end are not inside, so no run joins two documents
        at = np.flatnonzero(begin)
        past = np.flatnonzero(~inside)
        stop = np.minimum(np.append(at[1:], len(low)), np.append(past, len(low))[np.searchsorted(past, at)])
        pieces = (stop - at - 1) // MOST_RUN + 1
        begin = tx.ranges(np.zeros(len(at), np.int64), pieces) * MOST_RUN + np.repeat(at, pieces)
        size = np.minimum(np.repeat(stop, pieces) - begin, MOST_RUN)
        # smallest hashes lie near 0; mixed, the keys are even again
        return tx.mix(low[begin]) >> tx.U64(64 - KEY_BITS), doc[begin], begin, size

    def content(self, first: int, count: int) -> bytes:
        """The bytes of `count` units; words are joined by one space."""
        if self.kind.words:
            return b" ".join(self.raw[a:b] for a, b in zip(self.start[first : first + count].tolist(), self.end[first : first + count].tolist(), strict=True))
        return self.raw[first : first + count]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the windows that begin at some places, in two halves."""
        out = []
        for salt, base in ((0xA0761D6478BD642F, 0x9FB21C651E98DF25), (0xE7037ED1A0B428DB, 0xD6E8FEB86659FD93)):
            power, total = 1, np.zeros(len(at), tx.U64)
            for k in range(self.kind.window):  # hot windows are few, so their units are mixed where they stand
                total += tx.mix(self.hash[at + k] ^ tx.U64(salt)) * tx.U64(power)
                power = power * base % (1 << 64)
            out.append(tx.mix(total).view(np.int64))
        return tuple(out)

    @property
    def raw(self) -> bytes:
        if not hasattr(self, "_raw"):
            self._raw = self.text.data.tobytes()
        return self._raw


# ---- anchors

ANCHORS = "bucket long, block long, keys binary"


def _anchors(kind: Kind, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                t, _ = load(row)
                key, doc, _, _ = Units(t, kind).runs()
                if not len(key):
                    continue
                keys, back, runs = np.unique(key, return_inverse=True, return_counts=True)
                lo, hi = np.full(len(keys), len(t)), np.zeros(len(keys), np.int64)
                np.minimum.at(lo, back, doc)
                np.maximum.at(hi, back, doc)
                often = (np.searchsorted(RUNS, runs, "right") - 1).astype(tx.U64)
                sent = keys << tx.U64(3) | often << tx.U64(1) | (lo != hi).astype(tx.U64)
                yield _dealt(keys, buckets, row["block"], sent)

    return run


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal slices of the key space each key lies in."""
    return ((keys >> tx.U64(KEY_BITS - 32)) * tx.U64(parts) >> tx.U64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, parts: int, block: int, sent: np.ndarray) -> pa.RecordBatch:
    part = _place(keys, parts)
    cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, block)), pa.array([pack(sent[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "block", "keys"]
    )


def _tallied(sent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, place of each sent one among them, blocks, runs at least, more than one document) of what blocks sent."""
    keys, back, counts = np.unique(sent >> tx.U64(3), return_inverse=True, return_counts=True)
    runs = np.bincount(back, np.array(RUNS)[(sent >> tx.U64(1) & tx.U64(3)).astype(np.int64)], len(keys)).astype(np.int64)
    many = counts > 1
    many[back[(sent & tx.U64(1)) > 0]] = True
    return keys, back, counts, runs, many


def _replies(owners: list[int], sizes: np.ndarray, back: np.ndarray, keys: np.ndarray, many: np.ndarray, hot: np.ndarray) -> pa.RecordBatch | None:
    """For each block those of its keys that another document has, with a bit for hot ones."""
    ends = np.cumsum(sizes)
    out: list[tuple[int, bytes]] = []
    for block, i, j in zip(owners, (ends - sizes).tolist(), ends.tolist(), strict=True):
        k = back[i:j][many[back[i:j]]]
        if len(k):
            out.append((block, pack(keys[k] << tx.U64(1) | hot[k].astype(tx.U64))))
    if not out:
        return None
    block, packed = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(packed, pa.binary())], names=["block", "keys"])


ANSWERS = "block long, keys binary"


def _answers(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "bucket"):
            raw = [x for b in held for x in b.column("keys").to_pylist()]
            owners = [x for b in held for x in b.column("block").to_pylist()]
            keys, back, counts, runs, many = _tallied(unpack(b"".join(raw)))
            out = _replies(owners, np.array([len(x) // 6 for x in raw]), back, keys, many, (counts >= kind.hot_blocks) | (runs >= HOT_RUNS))
            if out is not None:
                yield out

    return run


# the same for very many blocks: a group of blocks tallies its keys, a bucket sums the groups' tallies, and the group
# answers its blocks.  "cell" names a group's part of a bucket.

TALLIES = "bucket long, cell long, keys binary, blocks binary, runs binary"
VERDICTS = "cell long, block long, keys binary"


def _cell_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell, held in groups(batches, "cell"):
        keys, _, counts, runs, many = _tallied(unpack(b"".join(x for b in held for x in b.column("keys").to_pylist())))
        row = [held[0].column("bucket")[0].as_py(), int(cell), pack(keys << tx.U64(1) | many.astype(tx.U64)), counts.astype(np.int64).tobytes(), runs.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["bucket", "cell", "keys", "blocks", "runs"])


def _sums(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "bucket"):
            raw = [unpack(x) for b in held for x in b.column("keys").to_pylist()]
            blocks, runs = (np.concatenate([np.frombuffer(x, np.int64) for b in held for x in b.column(c).to_pylist()]) for c in ("blocks", "runs"))
            cells = [x for b in held for x in b.column("cell").to_pylist()]
            sent = np.concatenate(raw)
            keys, back, counts = np.unique(sent >> tx.U64(1), return_inverse=True, return_counts=True)
            many = counts > 1
            many[back[(sent & tx.U64(1)) > 0]] = True
            hot = (np.bincount(back, blocks, len(keys)) >= kind.hot_blocks) | (np.bincount(back, runs, len(keys)) >= HOT_RUNS)
            out = _replies(cells, np.array([len(x) for x in raw]), back, keys, many, hot)
            if out is not None:
                # a verdict comes before the cell's blocks
                yield pa.RecordBatch.from_arrays([out.column("block"), pa.array(np.full(out.num_rows, -1)), out.column("keys")], names=["cell", "block", "keys"])

    return run


def _cell_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, held in groups(batches, "cell"):
        rows = [(x, y) for b in held for x, y in zip(b.column("block").to_pylist(), b.column("keys").to_pylist(), strict=True)]
        if rows[0][0] >= 0:  # no key of the cell has come back
            continue
        known = np.sort(unpack(rows[0][1]))
        for i in range(1, len(rows), 256):
            part = rows[i : i + 256]
            sent = [unpack(x) >> tx.U64(3) for _, x in part]
            keys = np.concatenate(sent)
            at = np.minimum(np.searchsorted(known >> tx.U64(1), keys), len(known) - 1)
            many, hot = known[at] >> tx.U64(1) == keys, (known[at] & tx.U64(1)) > 0
            out = _replies([b for b, _ in part], np.array([len(x) for x in sent]), np.arange(len(keys)), keys, many, hot)
            if out is not None:
                yield out


def answered(sent: DataFrame, kind: Kind, n_blocks: int) -> DataFrame:
    """ANSWERS to what the blocks sent."""
    if n_blocks <= TREE_BLOCKS:
        return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers(kind), ANSWERS)
    cells = -(-n_blocks // GROUP_BLOCKS)
    sent = stored(sent.withColumn("cell", F.col("bucket") * cells + F.pmod(F.xxhash64("block"), F.lit(cells))), "sent")
    tallies = sent.select("cell", "bucket", "keys").repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_tallies, TALLIES)
    verdicts = tallies.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sums(kind), VERDICTS)
    both = sent.select("cell", "block", "keys").unionByName(verdicts)
    return both.repartition("cell").sortWithinPartitions("cell", "block").mapInArrow(_cell_answers, ANSWERS)


# ---- segments

SEGMENTS = "shard long, block long, meta binary, data binary, hot binary"
#: A segment: shard, key, document number in its block, its id, first unit, units, bytes.
_META = 7


def _hot_windows(u: Units, ids: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """The distinct windows of some runs: h1, h2, smallest and largest document, number of places; then the places."""
    first, own = tx.ranges(at, n), ids[np.repeat(doc, n)]
    h1, h2 = u.windows(first)
    order = np.lexsort((first, h2, h1))
    h1, h2, own, first = h1[order], h2[order], own[order], first[order]
    cut = np.flatnonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))
    table = np.stack([h1[cut], h2[cut], np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut), np.diff(np.append(cut, len(own)))])
    return squeeze(np.concatenate([[len(cut)], table.ravel(), first]).astype(np.int64).tobytes())


def _hot_rows(block: int, raw: bytes) -> pa.RecordBatch:
    x = np.frombuffer(expand(raw), np.int64)
    h1, h2, lo, hi, size = x[1 : 1 + 5 * x[0]].reshape(5, -1)
    ends, places = np.cumsum(size).tolist(), x[1 + 5 * x[0] :].astype(np.int32)
    at = [places[i:j].tobytes() for i, j in zip([0, *ends[:-1]], ends, strict=True)]
    columns = [pa.array(np.full(len(h1), block)), pa.nulls(len(h1), pa.binary()), *map(pa.array, (h1, h2, lo, hi)), pa.array(at, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "spans", "h1", "h2", "lo", "hi", "at"])


def _segments(kind: Kind, shards: int):
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                if not row["keys"]:
                    continue
                t, ids = load(row)
                wanted = np.sort(np.concatenate([unpack(x) for x in row["keys"]]))
                copy = np.zeros(len(t), bool)
                copy[row["copies"] or []] = True
                u = Units(t, kind)
                key, doc, at, n = u.runs()
                i = np.minimum(np.searchsorted(wanted >> tx.U64(1), key), len(wanted) - 1)
                ok = (wanted[i] >> tx.U64(1) == key) & ~copy[doc]
                hot = ok & (wanted[i] & tx.U64(1)).astype(bool)
                if hot.any():
                    listed = _hot_windows(u, ids, doc[hot], at[hot], n[hot])
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"] % shards]), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in (None, None, listed))], names=names)
                ok &= ~hot
                key, doc, at, n = key[ok], doc[ok], at[ok], n[ok]
                seg = np.stack([_place(key, shards), key.astype(np.int64), doc, ids[doc], at, n + kind.window - 1, np.zeros(len(key), np.int64)])
                seg = seg[:, np.argsort(seg[0], kind="stable")]
                cuts = np.concatenate(([0], np.flatnonzero(seg[0, 1:] != seg[0, :-1]) + 1, [seg.shape[1]]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    content = [u.content(f, c) for f, c in zip(*seg[4:6, a:b].tolist(), strict=True)]
                    meta = np.concatenate([seg[:6, a:b], np.array([list(map(len, content))], np.int64)])
                    meta[4] -= u.first[meta[2]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(seg[0, a])]), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in (squeeze(np.diff(meta, axis=1, prepend=0).tobytes()), squeeze(b"".join(content)), None))],
                        names=names,
                    )

    return run


#: Spans of a block, or one of its hot windows with the places of it there.
SPANS = "block long, spans binary, h1 long, h2 long, lo long, hi long, at binary"


def _matched(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "shard"):
            number: dict[bytes, int] = {}
            which, metas, owners = [], [], []
            for batch in held:
                for block, meta, data, hot in zip(*(batch.column(c).to_pylist() for c in ("block", "meta", "data", "hot")), strict=True):
                    if hot is not None:
                        yield _hot_rows(block, hot)
                        continue
                    m = np.cumsum(np.frombuffer(expand(meta), np.int64).reshape(_META, -1), axis=1)
                    raw, ends = expand(data), np.cumsum(m[6]).tolist()
                    which += [number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    metas.append(m)
                    owners.append(np.full(m.shape[1], block))
            if not metas:
                continue
            m, block, which_of = np.concatenate(metas, axis=1), np.concatenate(owners), np.array(which)
            least, key = np.full(len(number), NO_ID), np.zeros(len(number), np.int64)
            np.minimum.at(least, which_of, m[3])
            key[which_of] = m[1]
            later = m[3] > least[which_of]
            out = [np.stack([block[later], m[2, later], m[4, later], m[5, later]])]
            keys, back, counts = np.unique(key, return_inverse=True, return_counts=True)
            chosen = np.flatnonzero(counts[back] > 1)
            if len(chosen):
                listed = list(number)
                parts = kind.match([listed[i] for i in chosen], least[chosen], back[chosen])
                first_rows = np.flatnonzero(~later)
                order = first_rows[np.argsort(which_of[first_rows], kind="stable")]
                lo = np.searchsorted(which_of[order], chosen)
                hi = np.searchsorted(which_of[order], chosen, "right")
                found = [(block[r], m[2, r], m[4, r] + s, c) for i, j, spans in zip(lo, hi, parts, strict=True) if spans for r in order[i:j] for s, c in spans]
                if found:
                    out.append(np.array(found, np.int64).T)
            spans = np.concatenate(out, axis=1)
            spans = spans[:, np.lexsort((spans[2], spans[1], spans[0]))]
            cuts = np.concatenate(([0], np.flatnonzero(spans[0, 1:] != spans[0, :-1]) + 1, [spans.shape[1]]))
            if spans.shape[1]:
                packed = [squeeze(np.diff(spans[1:, a:b], axis=1, prepend=0).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                none = [pa.nulls(len(packed), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array(spans[0, cuts[:-1]]), pa.array(packed, pa.binary()), *none, pa.nulls(len(packed), pa.binary())], names=["block", "spans", "h1", "h2", "lo", "hi", "at"])

    return run


# ---- results


def removed_units(row: dict, kind: Kind) -> tuple[Units, np.ndarray, np.ndarray]:
    """Units of a block, a flag for each that is removed, and the ids."""
    t, ids = load(row)
    u = Units(t, kind)
    n = len(u.hash)
    step = np.zeros(n + 1, np.int64)
    for raw in row["spans"] or []:
        s = np.cumsum(np.frombuffer(expand(raw), np.int64).reshape(3, -1), axis=1)
        at = u.first[s[0]] + s[1]
        np.add.at(step, at, 1)
        np.add.at(step, at + s[2], -1)
    size = np.diff(u.first)
    for x in row["hot"] or []:
        at = np.frombuffer(x["at"], np.int32)
        gone = at[ids[np.searchsorted(u.first, at, "right") - 1] > x["least"]]
        np.add.at(step, gone, 1)
        np.add.at(step, gone + kind.window, -1)
    for i in row["copies"] or []:
        if size[i] >= kind.window:
            step[u.first[i]] += 1
            step[u.first[i + 1]] -= 1
    return u, np.cumsum(step)[:n] > 0, ids


def repeated(docs: DataFrame, kind: Kind, carry: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored blocks, each with the spans of it that are removed and the numbers of its copies."""
    spark = docs.sparkSession
    base = blocks(docs, carry, block_bytes)
    total, n_blocks = base.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    buckets, shards = max(1, total // BUCKET_BYTES), max(1, total // SHARD_BYTES)
    rows = base.select("block", F.posexplode(F.arrays_zip("ids", "digests"))).select("block", F.col("pos").alias("at"), F.coalesce("col.ids", F.lit(NO_ID)).alias("id"), F.col("col.digests").alias("digest"))
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    least = stored(least, "copied")  # read back, the join below can split the rows of a frequent digest
    copies = stored(rows.join(least, "digest").where("id > least").groupBy("block").agg(F.collect_list("at").alias("copies")), "copies")

    sent = base.select("block", "ids", "sizes", "data").mapInArrow(_anchors(kind, buckets), ANCHORS)
    back = answered(sent, kind, n_blocks).groupBy("block").agg(F.collect_list("keys").alias("keys"))
    # blocks are joined by shuffle at every size, so that what is measured on small tables holds for large ones
    cut = base.select("block", "ids", "sizes", "data").join(stored(back, "anchors").hint("merge"), "block").join(copies.hint("merge"), "block", "left").select("block", "ids", "sizes", "data", "keys", "copies")
    segments = cut.mapInArrow(_segments(kind, shards), SEGMENTS).repartition("shard").sortWithinPartitions("shard")
    found = stored(segments.mapInArrow(_matched(kind), SPANS), "spans")
    spans = found.where("spans is not null").groupBy("block").agg(F.collect_list("spans").alias("spans"))
    hot = found.where("h1 is not null")
    first = hot.groupBy("h1", "h2").agg(F.min("lo").alias("least"))
    later = hot.join(first, ["h1", "h2"]).where("hi > least").groupBy("block").agg(F.collect_list(F.struct("least", "at")).alias("hot"))
    later = stored(later, "hot")
    return base.drop("digests").join(spans.hint("merge"), "block", "left").join(copies.hint("merge"), "block", "left").join(later.hint("merge"), "block", "left").select("block", "ids", "sizes", "data", "rest", "spans", "copies", "hot")


def without_points(data: np.ndarray, gone: np.ndarray) -> bytes:
    """UTF-8 text without the code points that have a byte in gone."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cut = np.logical_or.reduceat(gone, lead)
    return data[~np.repeat(cut, np.diff(np.append(lead, len(data))))].tobytes()


def cleaned(docs: DataFrame, kind: Kind) -> DataFrame:
    """docs with the removed units cut out of their texts; n_chars, if there is one, follows the text.  Documents of
    which nothing is left go.  A code point that a cut falls into goes whole."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows(batch):
                u, gone, ids = removed_units(row, kind)
                other = pa.ipc.read_record_batch(expand(row["rest"]), rest_schema) if rest else None
                texts, keep = [], []
                for i in range(len(ids)):
                    a, b = int(u.first[i]), int(u.first[i + 1])
                    left = np.flatnonzero(~gone[a:b]) + a
                    if len(left) == b - a:
                        texts.append(u.text.doc(i).tobytes().decode())
                    elif kind.words:
                        texts.append(b" ".join(u.raw[x:y] for x, y in zip(u.start[left].tolist(), u.end[left].tolist(), strict=True)).decode())
                    else:
                        texts.append(without_points(u.text.doc(i), gone[a:b]).decode())
                    keep.append(bool(texts[-1]) or a == b)
                made = {"doc_id": pa.array(row["ids"], pa.int64()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
                columns = [made[c].cast(whole_schema.field(c).type) if c in made else other.column(c) for c in names]
                out = pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))
                if out.num_rows:
                    yield out

    rest = [f for f in docs.schema.names if f not in ("doc_id", "text", "n_chars")]
    whole_schema, rest_schema = to_arrow_schema(docs.schema), to_arrow_schema(docs.select(*rest).schema)
    return repeated(docs, kind, carry=True).mapInArrow(run, schema)
