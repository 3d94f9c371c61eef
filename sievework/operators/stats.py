"""Clustered and paired bootstrap, checkpoint ranking, run comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.textkeys import hash_rank
from sievework.operators.metrics import ratio
from sievework.operators.ranks import free, hash_ranked
from sievework.sources.work import stored


#: Entries, at most, of a range's table of multiplicities, and draws that a chunk makes.
DRAWN = 1 << 21


def _draws(spark: SparkSession, n: int, replicates: int, seed: object, leaf: int) -> DataFrame:
    """(leaf, drawn): n draws from n places in each replicate; draw i takes the place that the hash of (seed, replicate, i)
    names.  A row holds the draws of a chunk that fall into a range of `leaf` places, as replicate * leaf + place in it."""
    size = max(1, DRAWN // replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                of = range(chunk * size, min(n, (chunk + 1) * size))
                at = np.empty((replicates, len(of)), np.int64)
                for r in range(replicates):
                    head = f"{seed}|{r}|".encode()
                    hashes = b"".join([hashlib.sha256(head + b"%d" % i).digest() for i in of])
                    at[r] = np.frombuffer(hashes, ">u4")[::8].astype(np.int64) % n
                code = (np.arange(replicates)[:, None] * leaf + at % leaf).astype(np.uint32).ravel()
                to = (at // leaf).ravel()
                order = np.argsort(to, kind="stable")
                code, to = code[order], to[order]
                runs = _runs(to)
                yield pa.RecordBatch.from_arrays([pa.array([int(to[i]) for i, _ in runs], pa.int64()), pa.array([code[i:j].tobytes() for i, j in runs], pa.binary())], names=["leaf", "drawn"])

    return spark.range(-(-n // size)).mapInArrow(run, "leaf long, drawn binary")


def drawn_sums(counts: DataFrame, groups: DataFrame, group: str, over: list[str], columns: list[str], replicates: int, seed: object) -> DataFrame:
    """(over, replicate, columns): sums of whole numbers over the rows of the groups drawn, each as often as it is drawn;
    a null is no addend.  All of `groups` are drawn from, numbered in hash order, and each replicate has as many draws; one
    that hits no row of some `over` has no row for it.

    Draws go packed to the range of places that they hit, and meet its groups' rows there; a task adds up one vector for each
    of `over` and column, so neither a row for each group and replicate nor a join with them is shuffled."""
    spark = counts.sparkSession
    g, place = free(counts, "_group", "_place")
    numbered = hash_ranked(groups.select(F.col(group).alias(g)).distinct(), [], hash_rank(seed, F.col(g)), g)
    places = stored(numbered.select(g, (F.col("_r") - 1).alias(place)), "places")
    n, leaf = places.count(), max(1, DRAWN // replicates)
    names = [*[f"c{i}" for i in range(len(columns))], "hits"]
    values = [*[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in columns], F.lit(1).cast("long")]
    key = F.to_json(F.struct(*over), {"ignoreNullFields": "false"})
    at = F.col(place)
    rows = counts.join(places, F.col(group) == F.col(g)).select(
        F.floor(at / leaf).alias("leaf"), F.lit(None).cast("binary").alias("drawn"), (at % leaf).cast("int").alias("place"), key.alias("key"), *[v.alias(c) for v, c in zip(values, names, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        now, drawn, times = None, [], None
        for batch in batches:
            for i, j in _runs(np.asarray(batch.column("leaf"))):
                part = batch.slice(i, j - i)
                if part.column("leaf")[0].as_py() != now:
                    now, drawn, times = part.column("leaf")[0].as_py(), [], None
                packed = part.column("drawn")
                first = len(packed) - packed.null_count  # a range's draws come before its rows
                drawn += [np.frombuffer(x, np.uint32) for x in packed.slice(0, first).to_pylist()]
                if first == len(packed):
                    continue
                if times is None:
                    code = np.concatenate(drawn) if drawn else np.zeros(0, np.uint32)
                    drawn, times = [], np.bincount(code, minlength=replicates * leaf).reshape(replicates, leaf).T.astype(np.float64)
                part = part.slice(first)
                places_, keys = np.asarray(part.column("place")), part.column("key").dictionary_encode()
                held = np.stack([np.asarray(part.column(c)) for c in names])
                for k, text in enumerate(keys.dictionary.to_pylist()):
                    own = np.flatnonzero(np.asarray(keys.indices) == k)
                    made = _product(held[:, own], times[places_[own]])
                    total[text] = total[text] + made if text in total else made
        if total:
            flat = [pa.array([list(v[c]) for v in total.values()], pa.list_(pa.int64())) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *flat], names=["key", *names])

    both = _draws(spark, n, replicates, seed, leaf).unionByName(rows, allowMissingColumns=True)
    made = both.repartition("leaf").sortWithinPartitions("leaf", F.col("drawn").isNull()).mapInArrow(run, "key string, " + ", ".join(f"{c} array<bigint>" for c in names))
    return _summed(made, counts, over, columns, names).where("hits > 0").drop("hits")


def _product(values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """values @ times in whole numbers; doubles are faster, and exact below 2 ** 53."""
    if np.abs(values).sum(axis=1, dtype=np.float64).max(initial=0) * times.max(initial=0) < 1 << 53:
        return (values.astype(np.float64) @ times).astype(np.int64)
    return values @ times.astype(np.int64)


def _summed(made: DataFrame, counts: DataFrame, over: list[str], columns: list[str], names: list[str]) -> DataFrame:
    """The tasks' vectors added up: a row for each of `over` and replicate."""
    each = made.select("key", F.posexplode(F.arrays_zip(*names)).alias("replicate", "v")).groupBy("key", "replicate").agg(*[F.sum(f"v.{c}").alias(c) for c in names])
    wide = T.StructType([counts.schema[c] for c in over])
    out = each.withColumn("k", F.from_json("key", wide)) if over else each
    rest = names[len(columns) :]
    return out.select(*[F.col(f"k.{c}").alias(c) for c in over], "replicate", *[F.col(n).alias(c) for n, c in zip(names, columns, strict=False)], *rest)


def replicate_ratios(counts: DataFrame, group: str, over: list[str], num: str, den: str, replicates: int, seed: object) -> DataFrame:
    """The ratio in each replicate of drawing the groups with replacement, from their additive counts."""
    s = drawn_sums(counts, counts, group, over, [num, den], replicates, seed)
    return s.select(*over, "replicate", ratio(F.col(num), F.col(den)).alias("value"))


#: Groups whose multiplicities are drawn together, at the tree's leaves.
LEAF = 1024


def _node_rng(seed: object, lo: int, hi: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(f"{seed}|{lo}|{hi}".encode()).digest()[:16], "little")))


def leaf_multiplicities(n: int, leaf: int, replicates: int, seed: object, size: int = LEAF) -> np.ndarray:
    """How often each group of a leaf is drawn in each replicate: (groups, replicates).

    n draws from n groups are split down a tree of ranges of places: of a range's draws, a binomial part falls into its
    lower half.  Each range has random numbers of its own, so a leaf's counts need its own path only, wherever they
    are computed, and all leaves together have n draws in each replicate."""
    lo, hi = 0, n
    drawn = np.full((1, replicates), n, np.int64)
    first, last = leaf * size, min(n, (leaf + 1) * size)
    while hi - lo > last - first:
        # halves end where a leaf does
        mid = lo + -(-(hi - lo) // size) // 2 * size
        low = _node_rng(seed, lo, hi).binomial(drawn, (mid - lo) / (hi - lo))
        lo, hi, drawn = (lo, mid, low) if first < mid else (mid, hi, drawn - low)
    rng = _node_rng(seed, lo, -hi)
    # within the leaf each place in turn takes its part of the draws that are left
    out = np.zeros((hi - lo, replicates), np.int64)
    left = drawn[0]
    for i in range(hi - lo - 1):
        out[i] = rng.binomial(left, 1 / (hi - lo - i))
        left = left - out[i]
    out[-1] = left
    return out


def replicate_sums(counts: DataFrame, group: str, over: list[str], columns: list[str], replicates: int, seed: object, leaf: int = LEAF) -> DataFrame:
    """(over, replicate, columns): sums of additive whole numbers of groups in replicates of resampling the groups with
    replacement; a null is no addend.  The same groups are drawn for all of `over`.

    Rows meet by leaves of the groups' places in hash order; a task draws the multiplicities of its leaves and adds up
    one vector for each of `over` and column, so what is shuffled doesn't grow with groups times replicates."""
    g, place, all_ = free(counts, "_group", "_place", "_all")
    places = hash_ranked(counts.select(F.col(group).alias(g)).distinct(), [], hash_rank(seed, F.col(g)), g).select(g, (F.col("_r") - 1).alias(place), F.col("_n").alias(all_))
    keyed = counts.join(places, F.col(group).eqNullSafe(F.col(g)))
    key = F.to_json(F.struct(*over), {"ignoreNullFields": "false"})
    rows = keyed.select(F.floor(F.col(place) / leaf).alias("leaf"), (F.col(place) % leaf).cast("int").alias("place"), F.col(all_).alias("n"), key.alias("key"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        now, times = None, None
        for batch in batches:
            at, key, place, n = (np.asarray(batch.column(c)) if c != "key" else batch.column(c).to_pylist() for c in ("leaf", "key", "place", "n"))
            key = np.array(key, object)
            values = np.stack([np.asarray(batch.column(c)) for c in names])
            for i, j in _runs(at):
                if at[i] != now:
                    now, times = at[i], leaf_multiplicities(int(n[i]), int(at[i]), replicates, seed, leaf)
                for k in set(key[i:j].tolist()):
                    own = np.flatnonzero(key[i:j] == k) + i
                    made = values[:, own] @ times[place[own]]
                    total[k] = total[k] + made if k in total else made
        if total:
            flat = [pa.array([list(v[c]) for v in total.values()], pa.list_(pa.int64())) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *flat], names=["key", *names])

    made = rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "key string, " + ", ".join(f"{c} array<bigint>" for c in names))
    return _summed(made, counts, over, columns, names)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j]


def tree_ratios(counts: DataFrame, group: str, over: list[str], num: str, den: str, replicates: int = 1000, seed: object = 0) -> DataFrame:
    """replicate_ratios by the tree of multiplicities."""
    s = replicate_sums(counts, group, over, [num, den], replicates, seed)
    return s.select(*over, "replicate", ratio(F.col(num), F.col(den)).alias("value"))


def tree_paired_difference(counts: DataFrame, group: str, model: str, reference: str, num: str, den: str, replicates: int = 1000, seed: object = 0) -> DataFrame:
    """paired_difference by the tree of multiplicities: in a replicate model and reference have the same groups."""
    base = counts.where(F.col(model) == reference).select(F.col(group).alias("_g"), F.col(num).alias("_a"), F.col(den).alias("_b"))
    both = counts.where(F.col(model) != reference).join(base, F.col(group) == F.col("_g"))
    sums = replicate_sums(both, group, [model], [num, den, "_a", "_b"], replicates, seed)
    values = sums.select(model, "replicate", (ratio(F.col(num), F.col(den)) - ratio(F.col("_a"), F.col("_b"))).alias("value"))
    return point_differences(counts, group, model, reference, num, den).join(interval(values, [model]), model, "left")


def interval(values: DataFrame, over: list[str], level: float = 0.95) -> DataFrame:
    """Interpolated percentile interval; replicates where the ratio is undefined are left out."""
    e = (1 - level) / 2
    return values.where("value is not null").groupBy(*over).agg(F.percentile("value", F.lit(e)).alias("low"), F.percentile("value", F.lit(1 - e)).alias("high"), F.count(F.lit(1)).alias("replicates"))


def index_interval(values: DataFrame, over: list[str], level: float = 0.95) -> DataFrame:
    """The other definition: entries int(q * n) of the sorted replicates, whose number is a parameter of the draw."""
    e = (1 - level) / 2
    s = F.sort_array(F.collect_list("value"))
    at = lambda q: F.get(s, F.floor(F.lit(q) * F.size(s)).cast("int"))
    return values.where("value is not null").groupBy(*over).agg(at(e).alias("low"), at(1 - e).alias("high"))


def paired(values: DataFrame, model: str, reference: str) -> DataFrame:
    """Differences to the reference model in the replicates that both share."""
    r = values.where(F.col(model) == reference).select("replicate", F.col("value").alias("base"))
    return values.where(F.col(model) != reference).join(r, "replicate").select(model, "replicate", (F.col("value") - F.col("base")).alias("value"))


def point_differences(counts: DataFrame, group: str, model: str, reference: str, num: str, den: str) -> DataFrame:
    """(model, point): each model's ratio minus the reference's, over the groups that both have."""
    base = counts.where(F.col(model) == reference).select(F.col(group).alias("_g"), F.col(num).alias("_a"), F.col(den).alias("_b"))
    both = counts.where(F.col(model) != reference).join(base, F.col(group) == F.col("_g"))
    sums = both.groupBy(model).agg(*[F.sum(c).alias(n) for c, n in ((num, "a"), (den, "b"), ("_a", "ra"), ("_b", "rb"))])
    return sums.select(model, (ratio(F.col("a"), F.col("b")) - ratio(F.col("ra"), F.col("rb"))).alias("point"))


def paired_difference(counts: DataFrame, group: str, model: str, reference: str, num: str, den: str, replicates: int, seed: object) -> DataFrame:
    """(model, point, low, high): the difference to the reference with a paired bootstrap's interval.  In a replicate
    model and reference have the same groups, those that both have."""
    base = counts.where(F.col(model) == reference).select(group, F.col(num).alias("_a"), F.col(den).alias("_b"))
    both = counts.where(F.col(model) != reference).join(base, group)
    sums = drawn_sums(both, counts, group, [model], [num, den, "_a", "_b"], replicates, seed)
    values = sums.select(model, "replicate", (ratio(F.col(num), F.col(den)) - ratio(F.col("_a"), F.col("_b"))).alias("value"))
    return point_differences(counts, group, model, reference, num, den).join(interval(values, [model]), model, "left")


def checkpoint_order(keys: list[tuple[str, str]], tie: str) -> list[Column]:
    """Order of `metric:max` and `metric:min` keys; a null is the worst, ties go by the tie column."""
    return [F.desc_nulls_last(c) if d == "max" else F.asc_nulls_last(c) for c, d in keys] + [F.asc(tie)]


def aligned_runs(runs: DataFrame, run: str, id_: str, value: str, names: list[str]) -> DataFrame:
    """Ids that every run has, a column for each run: one aggregate instead of a chain of joins."""
    wide = runs.groupBy(id_).agg(F.count_distinct(run).alias("_k"), *[F.max(F.when(F.col(run) == n, F.col(value))).alias(n) for n in names])
    return wide.where(F.col("_k") == len(names)).drop("_k")


def rank_zip(a: DataFrame, b: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows of two models paired by rank within a condition."""
    r = lambda d, n: d.select(by, F.row_number().over(Window.partitionBy(by).orderBy(order)).alias("rank"), F.col(value).alias(n))
    return r(a, "a").join(r(b, "b"), [by, "rank"])


def index_zip(a: DataFrame, b: DataFrame, by: str, index: str, value: str) -> DataFrame:
    """Rows of two models paired by their index within a condition."""
    side = lambda d, n: d.select(by, index, F.col(value).alias(n))
    return side(a, "a").join(side(b, "b"), [by, index])


def offset_rates(rows: DataFrame, other: DataFrame, key: str, position: str, test: Column, offsets: range) -> DataFrame:
    """Hit rate at each offset of a positional join; the configured one should be the peak."""
    shifted = rows.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_at", F.col(position) + F.col("offset"))
    j = shifted.join(other.withColumnRenamed(position, "_at"), [key, "_at"])
    return j.groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.count_if(test).cast("long").alias("hits")).withColumn("rate", ratio(F.col("hits"), F.col("n")))
