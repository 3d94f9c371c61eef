"""Sharding over fixed virtual slots (DataFrame functions only).

A record's slot is a hash of its columns `by` modulo SLOTS and never changes.  Bytes are summed per slot, and a
slot-to-shard map, SLOTS rows long whatever the corpus, says where each slot lives.  The map is a table with a folder
for each version.  Rebalancing reads the newest version, edits it and writes the next one: only the slots that it
names move, and a record of any slot, empty before or not, has a shard in every version.

Places in a shard are prefix sums over counts.  A slot of many rows (a key that very many rows have) is counted and
numbered in parts of about PART rows, so no slot is sorted in one task.

Defined cases: a null text has no bytes (its size is 1, as each record ends with one byte more); a very long text is
hashed where it is read; null and repeated keys hash like any other value; rows equal in all columns of `by` share a
slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.store import shared_dir, stored

SLOTS = 8192
PART = 1_000_000
#: Up to so many parts of slots (a few dozen bytes each) their offsets are broadcast, beyond that they are joined by shuffle.
BROADCAST_PARTS = 1_000_000
MAP_SCHEMA = "version int, vslot int, shard int"
Map = list[tuple[int, int, int]]


def with_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, vslot of every record, and a number that deals the rows of a slot to its parts."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(*by), F.lit(slots)).cast("int").alias("vslot"),
        F.xxhash64(F.monotonically_increasing_id()).alias("deal"),
    )


def slot_sizes(slotted: DataFrame) -> list[tuple[int, int]]:
    """(slot, bytes), at most SLOTS of them."""
    return [(r["vslot"], r["bytes"]) for r in slotted.groupBy("vslot").agg(F.sum("size").alias("bytes")).orderBy("vslot").collect()]


def first_map(sizes: list[tuple[int, int]], shards: int, slots: int = SLOTS) -> Map:
    """Version 1: the largest slot left goes to the shard with the fewest bytes so far, and of those with equally many
    to the one with the fewest slots, which deals the empty slots in turn."""
    load = [(0, 0, s) for s in range(shards)]
    size = dict(sizes)
    rows = []
    for slot in sorted(range(slots), key=lambda x: (-size.get(x, 0), x)):
        have, held, shard = heapq.heappop(load)
        rows.append((1, slot, shard))
        heapq.heappush(load, (have + size.get(slot, 0), held + 1, shard))
    return sorted(rows)


def grown_map(old: Map, sizes: list[tuple[int, int]], shards: int) -> Map:
    """The next version for shards + 1 shards: slots leave the fullest shard for the new one until it has its share."""
    size = dict(sizes)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for _, slot, shard in old:
        held[shard].append((size.get(slot, 0), slot))
    load = {s: sum(b for b, _ in held[s]) for s in held}
    target, moved, gained = sum(load.values()) / (shards + 1), {}, 0
    for s in held:
        held[s].sort(key=lambda x: (-x[0], -x[1]))
    while gained < target and any(held.values()):
        s = max((s for s in held if held[s]), key=lambda x: (load[x], -x))
        b, slot = held[s].pop()
        if gained + b > target and gained:
            break
        moved[slot], load[s], gained = shards, load[s] - b, gained + b
    return [(v + 1, slot, moved.get(slot, shard)) for v, slot, shard in old]


def write_map(spark: SparkSession, mapping: Map, path: str) -> None:
    """Adds a version to the table; one that is there already is left as it is, and that is an error."""
    versions = {v for v, _, _ in mapping}
    if len(versions) != 1 or len({s for _, s, _ in mapping}) != len(mapping):
        raise ValueError("a map is one version with each slot once")
    spark.createDataFrame(mapping, MAP_SCHEMA).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={versions.pop()}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> Map:
    """A version of the map, the newest if none is named."""
    table = spark.read.parquet(path).select("version", "vslot", "shard")
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted(map(tuple, table.where(F.col("version") == version).collect()))  # SLOTS rows
    if not rows:
        raise ValueError(f"no version {version} of the map in {path}")
    return rows


def rebalance(spark: SparkSession, path: str, sizes: list[tuple[int, int]], shards: int) -> Map:
    """Reads the newest map, moves slots into one more shard, and writes that as the next version."""
    grown = grown_map(read_map(spark, path), sizes, shards)
    write_map(spark, grown, path)
    return grown


def place(slotted: DataFrame, mapping: Map, key: str = "doc_id", part: int = PART) -> DataFrame:
    """shard of every record and its place there, gapless from 0: the rows of the shard's earlier parts of slots, by
    prefix sums over their counts, plus the row's number in its part.  slotted is stored, as it is read twice.  A
    record of a slot that the map doesn't name fails."""
    spark = slotted.sparkSession
    m = spark.createDataFrame(mapping, MAP_SCHEMA)  # SLOTS rows
    parts = slotted.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).select("vslot", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    known = parts.join(F.broadcast(m), "vslot", "left")
    shard = F.coalesce("shard", F.raise_error(F.concat(F.lit("the map has no shard for slot "), F.col("vslot").cast("string"))).cast("int"))
    known = known.select("vslot", "parts", "version", shard.alias("shard"))
    rows = slotted.join(F.broadcast(known), "vslot").withColumn("part", F.pmod("deal", "parts").cast("int"))
    counts = rows.groupBy("shard", "vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "slot-offsets")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    nth = F.row_number().over(Window.partitionBy("vslot", "part").orderBy(key, "size", "text_crc32", "deal"))
    numbered = rows.withColumn("nth", nth).join(bases, ["vslot", "part"])
    return numbered.select(key, "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), "vslot", F.col("version").alias("map_version"))


def query(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """Shards by law `bytes`; slots go by id and text, so that an id that very many rows have doesn't fill a shard."""
    slotted = stored(with_slots(spark.read.parquet(f"{sf_dir}/documents.parquet"), by=("doc_id", "text")), "slots")
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    write_map(spark, first_map(slot_sizes(slotted), shards), path)
    return place(slotted, read_map(spark, path)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version"
    )
