"""Positive and negative pairs, without listing a bucket's square of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.textkeys import hash_long, hash_rank
from sievework.operators.ranks import hash_ranked, order_ranked
from sievework.sources.work import stored

#: Rows of a bucket that a window runs over, besides the few that follow.
STRETCH = 100_000
MOST_TYPES = 10_000


def donors(df: DataFrame, bucket: list[str], id_: str, label: str, group: str, seed: object, look: int = 8) -> DataFrame:
    """For each anchor the next row of its bucket, in hash order and round the ring, with another label and group.

    A window of `look` rows ahead decides nearly all; anchors that find none there (long stretches of one label) are
    joined with the first row of each other label of their bucket, which is exact: (bucket, anchor, donor).  Rows are
    numbered and looked at in stretches, each with the first rows of the next, so that no bucket is sorted in one task."""
    rows = hash_ranked(df.withColumn("_h", hash_rank(seed, F.col(id_))).withColumn("_g", F.col(group)), bucket, F.col("_h"), id_)
    at = F.col("_r") - 1
    own, into = F.floor(at / STRETCH), F.when((at >= STRETCH) & (at % STRETCH < look), F.floor(at / STRETCH) - 1)
    dealt = rows.select("*", F.explode(F.array_compact(F.array(own, into))).alias("_s")).withColumn("_own", F.col("_s") == own)
    ring = Window.partitionBy(*bucket, "_s").orderBy("_r")
    ahead = F.collect_list(F.struct(F.col(id_).alias("i"), F.col(label).alias("l"), F.col("_g").alias("g"))).over(ring.rowsBetween(1, look))
    tried = dealt.withColumn("_a", ahead).where("_own").withColumn("_ok", F.filter("_a", lambda x: (x["l"] != F.col(label)) & (x["g"] != F.col("_g")))).withColumn("donor", F.get("_ok", F.lit(0))["i"])
    found = tried.where(F.col("donor").isNotNull()).select(*bucket, F.col(id_).alias("anchor"), "donor")
    rest = tried.where(F.col("donor").isNull()).select(*bucket, id_, label, F.col("_g").alias("a_group"))
    # the first two groups of each label suffice: one of them is not the anchor's
    per = stored(rows.groupBy(*bucket, label, "_g").agg(F.min(F.struct("_h", id_)).alias("f")), "firsts")
    keys = [*bucket, label]
    one = per.groupBy(*keys).agg(F.min(F.struct("f", "_g")).alias("x")).select(*keys, F.col("x._g").alias("_g1"), F.col("x.f").alias("f"))
    two = per.join(one.select(*keys, "_g1"), keys).where(F.col("_g") != F.col("_g1")).groupBy(*keys).agg(F.min(F.struct("f", "_g")).alias("x"))
    both = one.select(*bucket, F.col(label).alias("d_label"), F.col("_g1").alias("d_group"), "f").unionByName(two.select(*bucket, F.col(label).alias("d_label"), F.col("x._g").alias("d_group"), F.col("x.f").alias("f")))
    late = rest.join(both, bucket).where((F.col("d_label") != F.col(label)) & (F.col("d_group") != F.col("a_group")))
    late = late.groupBy(*bucket, id_).agg(F.min("f").alias("f")).select(*bucket, F.col(id_).alias("anchor"), F.col(f"f.{id_}").alias("donor"))
    return found.unionByName(late)


def uniform_donors(df: DataFrame, bucket: list[str], id_: str, label: str, group: str, seed: object) -> DataFrame:
    """(bucket, anchor, donor): for each anchor a uniform draw from the rows of its bucket that have another label and
    another group.  A null label or group is a value like others; an anchor without such rows has no donor.

    A bucket's rows are numbered in the order of label, group and hash, by ranges.  What an anchor may not take are a
    few ranges of numbers then: its label's, and its group's in each other label.  Their sizes tell how many rows are
    allowed, a hash picks the r-th of them, and stepping over the ranges that come before gives its number, so no
    candidates are listed."""
    keys = [f"b{i}" for i in range(len(bucket))]
    d = df.select(*[F.col(c).alias(k) for c, k in zip(bucket, keys, strict=True)], F.col(id_).alias("i"), F.col(label).alias("l"), F.col(group).alias("g"))
    rows = stored(order_ranked(d.withColumn("h", hash_rank(seed, F.col("i"))), keys, ["l", "g", "h", "i"]).drop("h"), "donors")
    span = F.struct(F.min("_r").alias("s"), F.count(F.lit(1)).alias("n"))
    labels = rows.groupBy(*keys, "l").agg(span.alias("own"))
    cells = rows.groupBy(*keys, "g", "l").agg(span.alias("x"))
    groups = cells.groupBy(*keys, "g").agg(F.collect_list(F.struct("x.s", "x.n", "l")).alias("others"))  # a range a label
    side = lambda t, names: t.select(*[F.col(c).alias(f"_{c}") for c in names], *[c for c in t.columns if c not in names])
    same = lambda names: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    a = rows.join(side(labels, [*keys, "l"]), same([*keys, "l"])).select(*keys, "i", "l", "g", "_n", "own")
    a = a.join(side(groups, [*keys, "g"]), same([*keys, "g"])).select(*keys, "i", "l", "_n", "own", "others")
    apart = F.transform(F.filter("others", lambda x: ~x["l"].eqNullSafe(F.col("l"))), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n")))
    a = a.withColumn("barred", F.array_sort(F.concat(F.array("own"), apart)))
    a = a.withColumn("allowed", F.col("_n") - F.aggregate("barred", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])).where("allowed > 0")
    drawn = hash_long(F.concat_ws("|", F.lit(str(seed)), F.lit("donor"), F.col("i"))) % F.greatest("allowed", F.lit(1)) + 1
    a = a.select(*keys, "i", F.aggregate("barred", drawn, lambda acc, x: F.when(acc >= x["s"], acc + x["n"]).otherwise(acc)).alias("at"))
    donors_ = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], "_r", F.col("i").alias("donor"))
    found = a.join(donors_, same(keys) & (F.col("at") == F.col("_r")) if keys else F.col("at") == F.col("_r"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(bucket, keys, strict=True)], F.col("i").alias("anchor"), "donor")


def candidates(anchors: DataFrame, types: DataFrame, own: str, unit: str, eligible: str) -> DataFrame:
    """Anchors with the types other than their own; unit types only where eligibility is true (a null isn't).  Types
    are a dimension of at most MOST_TYPES rows, which is checked and then broadcast."""
    if types.limit(MOST_TYPES + 1).count() > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types")
    return anchors.join(F.broadcast(types), (F.col(own) != F.col("type")) & (~F.col(unit) | F.col(eligible).eqNullSafe(F.lit(True))))


def draw(cands: DataFrame, anchor: str, seed: object, unit: str, priority: str | None = None) -> DataFrame:
    """One type an anchor by hash; where the column `priority` holds, of its unit types if it has any.  A second draw
    that doesn't depend on this one is a call with another seed."""
    first = F.lit(False) if priority is None else F.col(priority) & F.col(unit)
    best = F.min(F.struct((~F.coalesce(first, F.lit(False))).alias("later"), hash_rank(seed, F.col(anchor), F.col("type")).alias("h"), F.col("type").alias("type")))
    return cands.groupBy(anchor).agg(best.alias("b")).select(anchor, F.col("b.type").alias("type"), F.when(F.col("b.later"), "uniform").otherwise("unit_priority").alias("draw"))


def audit(pairs: DataFrame, region: str, type_: str, target: str) -> DataFrame:
    """Positives and negatives of each region and type."""
    count = lambda v: F.count_if(F.col(target) == v)
    return pairs.groupBy(region, type_).agg(count("aligned").alias("positives"), count("not_aligned").alias("negatives"))


def full_audit(pairs: DataFrame, manifest: DataFrame, region: str, types: DataFrame) -> DataFrame:
    """(region, type, positives, negatives, removed, no_negatives) of every type in every region.  pairs: region, type,
    target; manifest: region, removed (an array of the types that eligibility took from an anchor's candidates).
    no_negatives marks types that the name alone gives away: positives and not one negative."""
    counts = audit(pairs, region, "type", "target").withColumn("removed", F.lit(0).cast("long"))
    gone = manifest.select(region, F.explode("removed").alias("type")).groupBy(region, "type").agg(F.count(F.lit(1)).alias("removed"))
    gone = gone.select(region, "type", F.lit(0).cast("long").alias("positives"), F.lit(0).cast("long").alias("negatives"), "removed")
    # regions and types are fixed dimensions of a few rows
    grid = pairs.select(region).unionByName(manifest.select(region)).distinct().join(types.select("type").distinct()).select(region, "type", *[F.lit(0).cast("long").alias(c) for c in ("positives", "negatives", "removed")])
    every = counts.unionByName(gone).unionByName(grid).groupBy(region, "type").agg(*[F.sum(c).alias(c) for c in ("positives", "negatives", "removed")])
    return every.withColumn("no_negatives", (F.col("positives") > 0) & (F.col("negatives") == 0))
