"""Allocation, sampling and splitting.  Draws are hash orders: they equal the distribution of seeded shuffles, not
their members, and a row's place never depends on rows of other strata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.textkeys import half_up, hash_rank
from sievework.operators.ranks import free, hash_ranked, order_ranked
from sievework.sources.work import stored


def vote(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """A group's most frequent stratum, ties to the smallest."""
    n = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(stratum))).alias("v")).select(group, F.col(f"v.{stratum}").alias(stratum))


def allocate(strata: DataFrame, total: int, stratum: str = "stratum", available: str = "available", rows: str | None = None) -> DataFrame:
    """Even shares, the remainder to the largest strata (by the column rows, or by what is available); capped where a stratum is too small, what is over goes round
    robin to those with room.  The rounds are not played: strata in order of their room tell how many whole rounds all
    have room for or are full, and the last round goes by size.  Windows are over strata, however many rows those have."""
    all_ = Window.partitionBy()
    by_size = Window.partitionBy(F.lit(0)).orderBy(F.desc(available), stratum)
    by_room = Window.partitionBy(F.lit(0)).orderBy("room", stratum)
    k = F.count(F.lit(1)).over(all_)
    s = strata.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(rows or available), stratum)))
    s = s.withColumn("want", (F.floor(F.lit(total) / k) + (F.col("rank") <= F.lit(total) % k).cast("int")).cast("long"))
    s = s.withColumn("got", F.least("want", available)).withColumn("room", F.col(available) - F.col("got")).withColumn("deficit", F.sum(F.col("want") - F.col("got")).over(all_))
    below = F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # strata with less room are full after `rounds` rounds, the others share what is left evenly
    s = s.withColumn("others", k - F.row_number().over(by_room) + 1).withColumn("rounds", F.floor((F.col("deficit") - below) / F.col("others")))
    s = s.withColumn("rounds", F.max(F.when(F.col("rounds") < F.col("room"), F.col("rounds"))).over(all_))
    s = s.withColumn("given", F.least("room", F.coalesce("rounds", "room")))
    s = s.withColumn("last", F.col("deficit") - F.sum("given").over(all_)).withColumn("open", F.col("room") > F.col("given"))
    turn = F.sum(F.col("open").cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    extra = F.col("given") + (F.col("open") & (turn <= F.col("last"))).cast("int")
    return s.select(stratum, *([rows] if rows else []), available, "want", (F.col("got") + extra).cast("long").alias("allocated"))


def interleave(df: DataFrame, stratum: str, diversity: Column | str, id_: str, seed: object) -> DataFrame:
    """Place of each row of a stratum: hash order within its diversity key, the keys in turn.  No stratum or key is
    sorted in one task.  Adds turn and place, in the stead of columns of these names."""
    rows = df.drop("turn", "place")
    (d,) = free(rows, "_d")
    key = F.col(diversity) if isinstance(diversity, str) else diversity
    turns = hash_ranked(rows.withColumn(d, key), [stratum, d], hash_rank(seed, F.col(id_)), id_).withColumnRenamed("_r", "turn").drop("_n")
    return order_ranked(turns, [stratum], ["turn", d, id_]).withColumnRenamed("_r", "place").drop("_n", d)


def split_strata(df: DataFrame, stratum: str, group: str, seed: object, cuts: list[tuple[str, float]], rest: str, forced: DataFrame | None = None) -> DataFrame:
    """Groups of each stratum to the cuts in hash order, floor(n * share + 0.5) of them each; the others, and forced
    groups, to `rest`."""
    g = df.select(group, stratum).distinct()
    if forced is not None:
        g = g.join(forced.select(F.col(group).alias("_f")).distinct(), F.col(group) == F.col("_f"), "left").withColumn("_forced", F.col("_f").isNotNull()).drop("_f")
    else:
        g = g.withColumn("_forced", F.lit(False))
    # forced groups come last and are never cut, so the others are ranked by themselves
    unforced = hash_ranked(g.where("not _forced"), [stratum], hash_rank(seed, F.col(stratum), F.col(group)), group).drop("_n")
    g = unforced.unionByName(g.where("_forced").withColumn("_r", F.lit(None).cast("long")))
    sizes = df.select(group, stratum).distinct().groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    g = g.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
    name, low = F.lit(rest), F.lit(0).cast("long")
    tests = []
    for label, share in cuts:
        high = low + half_up(F.col("_n") * F.lit(share))
        tests.append((label, low, high))
        low = high
    for label, a, b in reversed(tests):
        name = F.when((F.col("_r") > a) & (F.col("_r") <= b) & ~F.col("_forced"), F.lit(label)).otherwise(name)
    return g.select(group, stratum, name.alias("split"))


def halves(df: DataFrame, stratum: str, group: str, seed: object) -> DataFrame:
    """A or B in turn along the hash order; strata of odd size give their extra group to A and B alternately."""
    g = hash_ranked(df.select(group, stratum).distinct(), [stratum], hash_rank(seed, F.col(stratum), F.col(group)), group)
    odd = g.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    odd = odd.select(stratum, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(stratum)) % 2).alias("_flip"))
    return g.join(odd, stratum, "left").select(group, stratum, F.when((F.col("_r") + F.coalesce("_flip", F.lit(1))) % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("half"))


def carve(groups: DataFrame, pool: str, stratum: str, group: str, target: int, seed: object) -> DataFrame:
    """Validation groups from a restricted pool, at the rate that gives `target` of all of it."""
    p = groups.where(F.col(pool))
    ranked = hash_ranked(p, [stratum], hash_rank(seed, F.col(stratum), F.col(group)), group)
    rate = p.agg((F.lit(float(target)) / F.count(F.lit(1))).alias("_rate"))
    q = ranked.join(F.broadcast(rate)).withColumn("_cut", half_up(F.col("_n") * F.col("_rate")))
    return q.where(F.col("_r") <= F.col("_cut")).select(group, stratum)


def subset(df: DataFrame, id_: str, seed: object, n: int) -> DataFrame:
    """n rows, the first in hash order."""
    return df.orderBy(hash_rank(seed, F.col(id_)), id_).limit(n)


def sample_once(df: DataFrame, quotas: list[tuple[str, int]], stratum: str, group: str, id_: str, seed: object) -> DataFrame:
    """Strata in the order of the quotas; a group that an earlier stratum took is blocked in later ones, and what a
    stratum lacks then is not made up for.  One scan of the table a stratum: what the earlier ones took is stored."""
    taken: DataFrame | None = None
    for name, n in quotas:
        one = df.where(F.col(stratum) == name)
        one = one.groupBy(group).agg(F.min(F.struct(hash_rank(seed, F.col(id_)).alias("h"), *df.columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in df.columns], F.col("r.h").alias("h"))
        if taken is not None:
            one = one.join(taken.select(F.col(group).alias("_taken")), F.col(group).eqNullSafe(F.col("_taken")), "left_anti")
        one = one.orderBy("h", id_).limit(n).select(*df.columns)
        taken = stored(one if taken is None else taken.unionByName(one), "sample")
    return taken


def accepted(edges: DataFrame, quotas: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(stratum, group) pairs of giving the strata, in their order, their quota of groups each: a stratum takes the first
    groups of its own order that no earlier stratum took.  edges: stratum, group, order (a hash, distinct in a stratum);
    quotas: stratum, quota; used: groups that nobody may take.

    The strata don't wait for each other.  In a round each proposes to the first groups that are left to it, and a group
    keeps its earliest proposer for good unless a still earlier one comes, so all later strata lose it at once.  Rounds
    end when no proposal was turned down.  That gives the pairs of going from stratum to stratum, since the first
    stratum is settled after one round, and each further one a round after all before it at the latest; the plan of a
    round doesn't depend on the number of strata."""
    left = edges.select("stratum", "group", "order")
    if used is not None:
        left = left.join(used.select(F.col(used.columns[0]).alias("_u")), F.col("group").eqNullSafe(F.col("_u")), "left_anti")
    left = stored(left.groupBy("stratum", "group").agg(F.min("order").alias("order")), "edges")
    limits = quotas.select(F.col("stratum").alias("_s"), F.col("quota").alias("_q"))
    while True:
        ranked = hash_ranked(left, ["stratum"], F.col("order"), "group")
        asked = ranked.join(limits, F.col("stratum").eqNullSafe(F.col("_s"))).where("_r <= _q").select("stratum", "group")
        asked = stored(asked, "proposals")
        # a stratum without a name comes first
        holder = asked.groupBy("group").agg(F.min(F.struct(F.col("stratum").isNotNull().alias("named"), "stratum")).alias("by"), F.count(F.lit(1)).alias("n"))
        holder = stored(holder.select(F.col("group").alias("_g"), "by", "n"), "holders")
        if holder.where("n > 1").isEmpty():
            return asked
        order = F.struct(F.col("stratum").isNotNull().alias("named"), F.col("stratum"))
        left = stored(left.join(holder, F.col("group").eqNullSafe(F.col("_g")), "left").where(F.col("by").isNull() | (order <= F.col("by"))).select("stratum", "group", "order"), "edges")


def sample_groups(df: DataFrame, total: int, stratum: str, group: str, id_: str, seed: object, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): about `total` rows with one of each group, shared out over strata: even shares, remainders to the
    strata of most rows, what small ones lack to those that have more groups; a group goes to the first stratum that
    reaches it, by the strata's order.  used: groups that were taken before.  plan: stratum, rows, available (groups),
    want, allocated and taken."""
    known = df if used is None else df.join(used.select(F.col(used.columns[0]).alias("_u")), F.col(group).eqNullSafe(F.col("_u")), "left_anti")
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
    have = known.groupBy(F.col(stratum).alias("_s")).agg(F.count_distinct(F.struct(group)).alias("_n"))
    sizes = sizes.join(have, F.col("stratum").eqNullSafe(F.col("_s")), "left").select("stratum", "rows", F.coalesce("_n", F.lit(0)).alias("available"))
    plan = stored(allocate(sizes, total, "stratum", "available", "rows"), "plan")
    edges = known.select(F.col(stratum).alias("stratum"), F.col(group).alias("group"), hash_rank(seed, F.col(id_)).alias("order"))
    pairs = accepted(edges, plan.select("stratum", F.col("allocated").alias("quota")))
    inner = free(known, "_st", "_gr", "_h")
    taken = known.join(pairs.toDF(*inner[:2]), F.col(stratum).eqNullSafe(F.col(inner[0])) & F.col(group).eqNullSafe(F.col(inner[1])))
    taken = taken.withColumn(inner[2], hash_rank(seed, F.col(id_)))
    first = taken.groupBy(*inner[:2]).agg(F.min(F.struct(inner[2], id_, F.struct(*known.columns).alias("r"))).alias("x"))
    rows = first.select(*[F.col(f"x.r.{c}").alias(c) for c in known.columns])
    got = pairs.groupBy(F.col("stratum").alias("_s")).agg(F.count(F.lit(1)).alias("_t"))
    return rows, plan.join(got, F.col("stratum").eqNullSafe(F.col("_s")), "left").select(*plan.columns, F.coalesce("_t", F.lit(0)).alias("taken"))


def sample_strata(df: DataFrame, total: int, stratum: str, group: str, id_: str, seed: object) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): `total` rows with one of each group, shared out evenly over strata of bounded number.  What small
    strata lack goes to those with room, by the groups that each has; groups met twice still lack in the end, and the
    plan says how many of each stratum were taken."""
    have = df.groupBy(stratum).agg(F.count_distinct(group).alias("available"))
    plan = stored(allocate(have, total, stratum).orderBy(stratum), "plan")
    quotas = [(r[stratum], r["allocated"]) for r in plan.orderBy(stratum).collect()]  # a row a stratum
    rows = sample_once(df, quotas, stratum, group, id_, seed)
    took = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_t"))
    return rows, plan.join(took, plan[stratum].eqNullSafe(took["_s"]), "left").select(plan["*"], F.coalesce("_t", F.lit(0)).alias("taken"))


def ceil_split(df: DataFrame, key: str, share: float, seed: object, labels: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Distinct keys in two: the first ceil(n * share) in hash order get the first label."""
    ranked = hash_ranked(df.select(key).distinct(), [], hash_rank(seed, F.col(key)), key)
    return ranked.select(key, F.when(F.col("_r") <= F.ceil(F.col("_n") * F.lit(share)), labels[0]).otherwise(labels[1]).alias("split"))


def global_groups(a: DataFrame, b: DataFrame, group: str, stratum: str) -> DataFrame:
    """Groups of two sources together: the stratum that most of a group's rows have, its rows, and which sources have
    it, so that a split puts both sources' rows on one side."""
    both = a.select(group, stratum, F.lit(1).alias("_from")).unionByName(b.select(group, stratum, F.lit(2).alias("_from")))
    seen = both.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct("_from") == 2).alias("in_both"))
    return seen.join(vote(both, group, stratum).withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def balanced(df: DataFrame, id_: str, options: list[str], seed: object, split: str) -> DataFrame:
    """One option a row with even counts in each split: options in turn along the hash order (an approximation of
    assigning each row to the option with the fewest so far, which is one ordered task)."""
    r = hash_ranked(df, [split], hash_rank(seed, F.col(id_)), id_)
    return r.withColumn("option", F.get(F.array(*[F.lit(o) for o in options]), ((F.col("_r") - 1) % len(options)).cast("int"))).drop("_r", "_n")


def balanced_exact(df: DataFrame, id_: str, options: str, seed: object, split: str) -> DataFrame:
    """Greedy: in hash order each row takes, of its own options, the least used so far, ties by hash.  Each split is
    one ordered task, as each choice depends on all before it; its rows are sorted by Spark and stream through, and only
    how often each option was used is held."""
    import hashlib

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = lambda *x: hashlib.sha256("|".join(map(str, (seed, *x))).encode()).hexdigest()
        used: dict[str, int] = {}
        now: object = assign  # no split yet
        for batch in batches:
            ids = batch.column(0)
            chosen = []
            for text, of, own in zip(*(batch.column(c).to_pylist() for c in ("_text", split, options)), strict=True):
                if of != now:
                    now, used = of, {}
                best = min(own, key=lambda o: (used.get(o, 0), h(text, o))) if own else None
                used[best] = used.get(best, 0) + 1
                chosen.append(best)
            yield pa.RecordBatch.from_arrays([ids, batch.column(split), pa.array(chosen, pa.string())], names=[id_, split, "option"])

    types = dict(df.dtypes)
    rows = df.select(id_, split, options, F.col(id_).cast("string").alias("_text"), hash_rank(seed, F.col(id_)).alias("_h"))
    dealt = rows.repartition(split).sortWithinPartitions(split, "_h", id_).drop("_h")
    return dealt.mapInArrow(assign, f"{id_} {types[id_]}, {split} {types[split]}, option string")


def spread_pick(df: DataFrame, category: str, quotas: dict[str, int], stage: str, id_: str, seed: object) -> DataFrame:
    """The quota of each category, its stages in turn along their hash orders; categories without a quota give none."""
    most = F.create_map(*[F.lit(x) for item in quotas.items() for x in item])
    ranked = hash_ranked(df.where(F.col(category).isin(*quotas)), [category, stage], hash_rank(seed, F.col(id_)), id_)
    # no stage can give more than the quota, so at most quota times stages rows of a category are ordered
    few = ranked.where(F.col("_r") <= most[F.col(category)])
    turn = F.row_number().over(Window.partitionBy(category).orderBy("_r", stage, id_))
    return few.withColumn("place", turn).where(F.col("place") <= most[F.col(category)]).select(*df.columns, "place")


def stage_order(id_: str, seed: object, stage: object) -> Column:
    """Order key of a training stage: every stage has a permutation of its own."""
    return hash_rank(seed, F.lit(str(stage)), F.col(id_))


def broken_blocks(df: DataFrame, condition: str, position: str, size: int) -> DataFrame:
    """Conditions whose rollouts aren't exactly the positions 0 to size - 1, each once."""
    n, p = F.count(F.lit(1)), F.col(position)
    seen = df.groupBy(condition).agg(n.alias("n"), F.count_distinct(F.when((p >= 0) & (p < size), p)).alias("inside"))
    return seen.where(f"n <> {size} or inside <> {size}")
