"""Order statistics of groups: exact ones by radix selection, and a mergeable sketch with a stated error."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.work import stored

#: Bits of a value that one step selects by: four steps, and at most 65,536 counts a group and step.
DIGIT = 16
_WHOLE = ("tinyint", "smallint", "int", "bigint")

#: A place from 0 in a group's sorted values, from the number of its values.
Place = Callable[[Column], Column]


def at_share(q: float) -> Place:
    """The place floor(q * (n - 1))."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))


def order_values(df: DataFrame, by: list[str], value: str, places: dict[str, Place]) -> DataFrame:
    """(by..., n, a column for each place): exact values at places of each group's sorted values.

    Equal values are counted first.  Each of four steps counts by 16 more bits, running sums over the counts below one
    prefix find the one that holds a place, and the next step counts only there: no window holds more than 65,536
    counts and no group's values meet in one task.

    The value is a whole number of up to 64 bits, else a TypeError.  Nulls are left out; a group of nulls alone gives no
    row, but without `by` an empty table gives one row with n 0 and nulls, as aggregates do.  Null groups are groups; a
    place outside a group is null; ties are values like others; other columns may have any name."""
    if (kind := dict(df.dtypes)[value]) not in _WHOLE:
        raise TypeError(f"{value} is {kind}, not a whole number")
    keys = [f"_g{i}" for i in range(len(by))]
    v = F.col("_v")
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("long").alias("_v")).where("_v is not null")
    counted = stored(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "values")
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), place(F.col("_n")).cast("long").alias("_left")) for name, place in places.items()])
    open_ = sizes.select(*keys, "_n", F.inline(wanted)).where("_left between 0 and _n - 1").withColumn("_p", F.lit(0).cast("long"))
    for step in range(64 // DIGIT):
        shift = 64 - DIGIT * (step + 1)
        mine = [f"_m{i}" for i in range(len(keys))]
        # counted before they meet the open places, so that a prefix brings at most 65,536 rows
        above = F.shiftright("_to", DIGIT) if step else F.lit(0).cast("long")
        held = open_.select(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], F.col("_p").alias("_above")).distinct()
        level = counted.groupBy(*keys, F.shiftright(v, shift).alias("_to")).agg(F.sum("_c").alias("_c")).withColumn("_from", above)
        level = level.join(held, _same(keys, mine) & (F.col("_from") == F.col("_above")), "left_semi")
        within = Window.partitionBy(*keys, "_from").orderBy("_to")
        level = level.withColumn("_end", F.sum("_c").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        level = level.select(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], "_from", "_to", "_end", (F.col("_end") - F.col("_c")).alias("_begin"))
        inside = (F.col("_p") == F.col("_from")) & (F.col("_left") >= F.col("_begin")) & (F.col("_left") < F.col("_end"))
        open_ = open_.join(level, _same(keys, mine) & inside).select(*keys, "_n", "_name", (F.col("_left") - F.col("_begin")).alias("_left"), F.col("_to").alias("_p"))
    names = [f"_x{i}" for i in range(len(places))]
    found = open_.select(*keys, F.lit(None).cast("long").alias("_n"), "_name", "_p").unionByName(sizes.select(*keys, "_n", F.lit(None).cast("string").alias("_name"), F.lit(None).cast("long").alias("_p")))
    whole = found.groupBy(*keys).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_n"), *[F.max(F.when(F.col("_name") == p, F.col("_p"))).alias(x) for p, x in zip(places, names, strict=True)])
    return whole.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("_n").alias("n"), *[F.col(x).alias(p) for x, p in zip(names, places, strict=True)])


def quantile_cont(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., n, a column for each share): quantiles between the two nearest values, exact; else as order_values."""
    places: dict[str, Place] = {}
    for i, q in enumerate(shares.values()):
        places[f"_lo{i}"] = at_share(q)
        places[f"_hi{i}"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    got = order_values(df, by, value, places)

    def between(i: int, q: float) -> Column:
        at = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(F.floor(at) == F.ceil(at), lo.cast("double")).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return got.select(*by, "n", *[between(i, q).alias(name) for i, (name, q) in enumerate(shares.items())])


def sketch(df: DataFrame, by: list[str], value: str, error: float = 0.01) -> DataFrame:
    """(by..., bucket, n): counts of logarithmic buckets.  A value estimated from them is within `error` of the true one,
    relative to it.  Tables of the same error are merged by `merged`, in any order.

    At most 1,488 / error buckets a group, for doubles of any size and sign.  Zeros have bucket 0; nulls, NaN and
    infinities are left out.  Null groups are groups."""
    grow = math.log((1 + error) / (1 - error))
    x = F.col(value).cast("double")
    # the bucket of |x| counts from the smallest double, so that it is never 0; the sign is put before it
    size = F.ceil(F.log(F.abs(x)) / grow) + math.ceil(750 / grow)
    bucket = F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("long")
    real = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(real).groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(*tables: DataFrame) -> DataFrame:
    """One sketch of the rows of all."""
    whole = reduce(DataFrame.unionByName, tables)
    return whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n"))


def sketched_values(sketched: DataFrame, by: list[str], places: dict[str, Place], error: float = 0.01) -> DataFrame:
    """As order_values, from a sketch made with this error."""
    grow = math.log((1 + error) / (1 - error))
    b = F.col("bucket")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    t = sketched.withColumn("_end", F.sum("n").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(whole))
    middle = F.lit(2.0) * F.exp((F.abs(b) - math.ceil(750 / grow)) * grow) / (1 + math.exp(grow))
    t = t.withColumn("_x", F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * middle))
    at = lambda p: F.max(F.when((F.col("_end") > p) & (F.col("_end") - F.col("n") <= p), F.col("_x")))
    return t.groupBy(*by).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n"), *[at(place(F.col("_n"))).alias(name) for name, place in places.items()])
