"""MinHash near-duplicates by fast similarity sketching.

Texts are sets of 5-word shingles, A-Z folded.  A sketch has BINS coordinates, filled in rounds: in each of the first
BINS rounds every shingle is hashed into one bin with a value that starts with the round, in the following ones all
shingles go to one bin each; a bin keeps its smallest value and the rounds end once all bins are filled, so every
coordinate is filled and agrees between two sets with their Jaccard similarity, with concentration.  BANDS bands of
ROWS coordinates find candidates: a pair shares no band with probability below 1e-10 at similarity 0.85, and below
1e-7 at 0.8.

Equal sets are one node, numbered once, which the text of its smallest id represents.  In a band's bucket the smallest representative is paired
with all others; confirmed pairs make components.  Links across components remain to be found among the candidates:
all that met another one in a bucket.  Two sets that are similar enough share one of their rarest shingles (as many of
each as it may lack and one more), so only members of different components that do are looked at, in blocks, their
sketches first: documents of one template, which share much but not enough, don't meet.  All links are confirmed on
full sets.

Defined cases: a null or empty text has no shingle and is linked with nothing; fewer than 5 words are one shingle;
repeated rows fall into one class; rows with equal doc_id and different texts are judged each by its own text, and all
their links count; a row without an id is always kept and has the smallest id of its class, if any, as component; a
very long text is one set in one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import textops as tx
from sievework.llm.graph import components, only
from sievework.llm.spans import groups
from sievework.llm.store import stored

SHINGLE = 5
THRESHOLD = 85  # per cent, of the query; classes can be given another
BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: Sketches of sets at the threshold agree in fewer coordinates than agreeing() with probability below this.
MISSED = 1e-10
#: Up to so many nodes (their number, id and set's name) are broadcast, beyond that they are joined by shuffle.
BROADCAST_NODES = 400_000
#: Members of a cluster in a block, about.
BLOCK = 512
_EMPTY = tx.U64(0xFFFFFFFFFFFFFFFF)


def agreeing(threshold: int) -> int:
    """Coordinates in which sketches must agree before their full sets are compared."""
    p, below = threshold / 100, 0.0
    for a in range(BINS):
        below += comb(BINS, a) * p**a * (1 - p) ** (BINS - a)
        if below >= MISSED:
            return a
    return BINS


def shingle_sets(t: tx.Texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = tx.LOWER[t.data]
    s, e, first = tx.words(t)
    h = tx.span_hashes(low, s, e)
    g = tx.grams(h, SHINGLE)
    return [np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else tx.grams(h[a:b], b - a) if b > a else np.zeros(0, tx.U64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of coordinates a set; rows of empty sets stay unfilled."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full(len(sets) * bins, _EMPTY)
    h, doc = np.concatenate(sets) if sets else np.zeros(0, tx.U64), np.repeat(np.arange(len(sets)), size)
    for i in range(2 * bins):
        if not len(h):
            break
        x = tx.mix(h ^ tx.U64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = (x & tx.U64(bins - 1)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, doc * bins + at, tx.U64(i << 55) | (x >> tx.U64(9)))
        open_ = (out.reshape(-1, bins) == _EMPTY).any(1)
        stay = open_[doc]
        h, doc = h[stay], doc[stay]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys of each sketch; a key names its band."""
    v = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=tx.U64), v.shape[:2]).copy()
    for r in range(ROWS):
        key = tx.mix(key * tx.U64(0xD6E8FEB86659FD93) + v[:, :, r])
    return key.view(np.int64)


def signature(x: np.ndarray) -> bytes | None:
    """Name of a set: its size and two sums of mixed hashes, in which the order does not matter; none if empty."""
    return len(x).to_bytes(4, "little") + tx.mix(x).sum(dtype=tx.U64).tobytes() + tx.mix(x ^ tx.U64(0x5851F42D4C957F2D)).sum(dtype=tx.U64).tobytes() if len(x) else None


SKETCHED = "doc_id long, n_shingles long, sig binary, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, t in tx.chunks(batch, "text"):
            sets = shingle_sets(t)
            sk = sketches(sets)
            sig = [signature(x) for x in sets]
            keys = band_keys(sk)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            small = tx.mix(sk).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sig, pa.binary()), bands, pa.array([r.tobytes() for r in small], pa.binary())],
                names=["doc_id", "n_shingles", "sig", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, members) of texts that have the set named by sig; another text of the same doc_id has not."""
    for batch in batches:
        for part, t in tx.chunks(batch, "text"):
            sets = shingle_sets(t)
            own = [signature(x) == want for x, want in zip(sets, part.column("sig").to_pylist(), strict=True)]
            members = pa.array([x.tobytes() for x, is_own in zip(sets, own, strict=True) if is_own], pa.binary())
            if len(members):
                yield pa.RecordBatch.from_arrays([part.column("node").filter(pa.array(own)), members], names=["id", "members"])


def _confirm(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), tx.U64), np.frombuffer(y.as_py(), tx.U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    return run


def full_sets(docs: DataFrame, heads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, members): the whole shingle sets of the nodes that occur in pairs."""
    nodes = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    wanted = stored(heads.join(nodes, F.col("node") == F.col("a")).select("node", "head", "sig"), "near-nodes")
    small = wanted.count() <= BROADCAST_NODES
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("head"))
    return stored(texts.select("node", "sig", "text").mapInArrow(_sets, "id long, members binary"), "near-sets")


def confirmed(sets: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    right = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    return stored(pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(_confirm(threshold), "a long, b long"), "near-links")


def _across(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two blocks of a cluster (side 0 and 1) at a time: confirmed links between different components.  A link makes
    one component of two, so a block gives fewer links than it has members."""
    least = agreeing(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "block"):
            part = pa.Table.from_batches(held).combine_chunks()
            side, member, main = (np.asarray(part.column(c)) for c in ("side", "member", "main"))
            root = np.unique(np.asarray(part.column("component")), return_inverse=True)[1]
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            sets = [np.frombuffer(x, tx.U64) for x in part.column("members").to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            other, links = np.flatnonzero(side == 1), []
            for i in np.flatnonzero(side == 0).tolist():
                # of two members outside the main component, the smaller one looks at the larger one
                near = other[(root[other] != root[i]) & (main[other] | (member[other] > member[i]))]
                near = near[(100 * size[near] >= threshold * size[i]) & (100 * size[i] >= threshold * size[near])]
                agree = (sketch[near] == sketch[i]).sum(1)
                for j in near[np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]].tolist():
                    if root[i] == root[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= threshold * (size[i] + size[j] - both):
                        links.append((min(member[i], member[j]), max(member[i], member[j])))
                        root[root == root[j]] = root[i]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, component, token) of every shingle of a member."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("members").to_pylist()]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        ends = np.cumsum(size)
        i = 0
        while i < len(sets):  # some thousand sets at a time, a longer one alone
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + (1 << 18))))
            columns = [np.repeat(np.asarray(batch.column(c))[i:j], size[i:j]) for c in ("member", "component")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(sets[i:j]))], names=["member", "component", "token"])
            i = j


def meeting(rows: DataFrame, threshold: int) -> DataFrame:
    """(member, cluster) of members that share a rare shingle with a member of another component; such shingles connect
    the members of a cluster.  rows: member, component, members.

    Shingles are taken in the order of how many members have them.  A set of n shingles that is linked with another
    lacks at most n - ceil(n * threshold / 100) of it, so one of its first n - ceil(...) + 1 is shared, and so it is
    for the other: the rarest shingle that they share is among the first of both."""
    tokens = stored(rows.mapInArrow(_tokens, "member long, component long, token long"), "near-tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 1")
    shared = tokens.join(counts.select("token", "n", (F.col("lo") < F.col("hi")).alias("mixed")), "token")
    size = rows.select("member", (F.octet_length("members") / 8).cast("long").alias("size"))
    # shingles that no other member has come first; only their number matters
    lists = shared.groupBy("member", "component").agg(F.array_sort(F.collect_list(F.struct("n", "token", "mixed"))).alias("t"))
    lists = lists.join(size, "member")
    few = F.col("size") - F.ceil(F.col("size") * threshold / 100) + 1 - (F.col("size") - F.size("t"))
    first = lists.where(few > 0).select("member", "component", F.explode(F.slice("t", F.lit(1), few.cast("int"))).alias("t")).where("t.mixed")
    first = stored(first.select("member", "component", F.col("t.token").alias("token")), "near-rare")
    heads = first.groupBy("token").agg(F.min("member").alias("head"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    met = components(first.join(heads.select("token", "head"), "token").select(F.col("member").alias("a"), F.col("head").alias("b")))
    return stored(met.select(F.col("node").alias("member"), F.col("component").alias("cluster")), "near-meeting")


def across(comps: DataFrame, sketched: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links between components of the candidates in sets.  Members that may have one are clustered; a cluster's members
    outside its largest component are dealt to blocks, and so are all its members; each block of the former meets each
    of the latter in a group of bounded size."""
    rows = sets.join(comps, sets["id"] == comps["node"], "left").select(F.col("id").alias("member"), F.coalesce("component", "id").alias("component"), "members")
    known = meeting(rows, threshold).join(rows.select("member", "component"), "member")
    sizes = known.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    few = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = mixed.select("cluster", F.col("top.component").alias("largest"), few(F.col("all") - F.col("top.n")).alias("outer"), few(F.col("all")).alias("every"))
    rows = known.join(mixed, "cluster").withColumn("main", F.col("component") == F.col("largest"))
    rows = rows.join(sketched.select("member", "sketch"), "member").join(sets.withColumnRenamed("id", "member"), "member")
    dealt = lambda n, salt: F.pmod(F.xxhash64("member", F.lit(salt)), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = ["side", "member", "main", "component", "sketch", "members"]
    left = rows.where("not main").withColumn("side", F.lit(0)).withColumn("k", dealt("outer", 1)).withColumn("r", numbers("every"))
    right = rows.withColumn("side", F.lit(1)).withColumn("r", dealt("every", 2)).withColumn("k", numbers("outer"))
    block = F.xxhash64("cluster", "k", "r").alias("block")
    met = left.select(block, *out).unionByName(right.select(block, *out))
    return met.repartition("block").sortWithinPartitions("block", "member").mapInArrow(_across(threshold), "a long, b long")


def classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; sets are linked from threshold per cent on."""
    sketched = stored(docs.select("doc_id", "text").mapInArrow(_sketch, SKETCHED), "near-sketches")
    heads = sketched.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("head"))
    heads = stored(heads.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    named = heads.select(F.col("sig").alias("_sig"), "head", F.col("node").alias("member"))
    reps = sketched.join(named, (F.col("doc_id") == F.col("head")) & (F.col("sig") == F.col("_sig"))).dropDuplicates(["member"])
    reps = stored(reps.select("member", "bands", "sketch"), "near-representatives")
    flat = reps.select(F.explode("bands").alias("bucket"), "member")
    shared = flat.groupBy("bucket").agg(F.min("member").alias("first"), F.max("member").alias("last")).where("first < last")
    buckets = stored(flat.join(shared.select("bucket", "first"), "bucket").select("bucket", "first", "member"), "near-buckets")
    pairs = stored(buckets.where("first < member").select(F.col("first").alias("a"), F.col("member").alias("b")).distinct(), "near-pairs")
    sets = full_sets(docs, heads, pairs)
    links = confirmed(sets, pairs, threshold)
    comps = stored(components(links), "near-components")
    more = stored(across(comps, reps, sets, threshold), "near-links")
    if not more.isEmpty():
        comps = stored(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "near-components")
    linked = heads.join(comps.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    smallest = linked.groupBy("component").agg(F.min("head").alias("smallest"))
    named = linked.join(smallest, "component").select(F.col("sig").alias("_sig"), F.col("smallest").alias("component"))
    alone = heads.join(comps.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left_anti").select(F.col("sig").alias("_sig"), F.col("head").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "sig").join(named.unionByName(alone), F.col("sig") == F.col("_sig"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS whole, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM j WHERE 100 * c >= 85 * whole UNION ALL SELECT b, a FROM j WHERE 100 * c >= 85 * whole),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.x = l.a),
m AS (SELECT doc_id, min(x) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents that are the smallest of their class, all columns.  Rows that share an id stay together: they go
    only if none of them is kept."""
    judged = classes(docs, threshold)
    gone = stored(judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "near-removed")
    return only(docs, gone, "left_anti")
