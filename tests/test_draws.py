"""Uniform donors, sampling in the strata's order, the bootstrap's tree: against sequential and plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.textkeys import hash_rank
from sievework.operators import pairs, splits, stats


def test_donors_are_uniform(spark):
    """Every allowed candidate is as likely as any other: chi-square over many anchors of the same choices."""
    rows = [(i, "b", "x", f"g{i}") for i in range(6000)] + [(10_000 + k, "b", "yz"[k % 2], f"h{k // 3}") for k in range(40)]
    got = pairs.uniform_donors(spark.createDataFrame(rows, "i int, b string, l string, g string"), ["b"], "i", "l", "g", 5)
    donors = got.where("anchor < 10000").groupBy("donor").count().collect()
    n = np.array([r["count"] for r in donors])
    assert len(n) == 40 and n.sum() == 6000
    assert ((n - 150) ** 2 / 150).sum() < 75  # 39 degrees of freedom: 0.999 at 73


@pytest.mark.parametrize("seed", range(3))
def test_donors_are_allowed(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, None])) for i in range(150)] + [(900, "alone", "x", 1), (901, "alone", "x", 2), (902, "alone", "y", 1)]
    df = spark.createDataFrame(rows, "i int, b string, l string, g int")
    got = {r["anchor"]: r["donor"] for r in pairs.uniform_donors(df, ["b"], "i", "l", "g", seed).collect()}
    by = {r[0]: r for r in rows}
    for i, b, l, g in rows:
        allowed = {r[0] for r in rows if r[1] == b and r[2] != l and r[3] != g}
        assert got[i] in allowed if allowed else i not in got
    assert all(by[a][1] == by[d][1] for a, d in got.items())
    assert pairs.uniform_donors(df.where("false"), ["b"], "i", "l", "g", 1).count() == 0


def in_order(edges, quotas, used=()):
    """One stratum after the other."""
    taken, out = set(used), set()
    for s in sorted(quotas):
        n = 0
        for _, g in sorted((o, g) for (t, g), o in edges.items() if t == s):
            if n < quotas[s] and g not in taken:
                taken.add(g)
                out.add((s, g))
                n += 1
    return out


def test_a_thousand_tables_in_order(spark):
    """Tables that share no groups are one table of many strata."""
    rng = random.Random(3)
    edges, quotas, want = {}, {}, set()
    for t in range(1000):
        strata, groups = rng.randrange(1, 6), rng.randrange(1, 9)
        own = {(f"{t:04}.{s}", f"{t}:{g}"): rng.random() for s in range(strata) for g in range(groups) if rng.random() < 0.6}
        q = {f"{t:04}.{s}": rng.randrange(0, 5) for s in range(strata)}
        edges |= own
        quotas |= q
        want |= in_order(own, q)
    e = spark.createDataFrame([(s, g, f"{o:.17f}"[2:]) for (s, g), o in edges.items()], "stratum string, group string, order string")
    got = splits.accepted(e, spark.createDataFrame(list(quotas.items()), "stratum string, quota int"))
    assert {(r["stratum"], r["group"]) for r in got.collect()} == want


def test_sampling_hands_shortfalls_on(spark):
    rows = [(i, "a" if i < 300 else "b" if i < 310 else "c", f"g{i % 90 if i < 300 else i}") for i in range(400)] + [(1000, "b", "g1"), (1001, None, "g7"), (1002, "c", None)]
    df = spark.createDataFrame(rows, "i int, s string, g string").withColumn("_h", F.lit("own"))
    got, plan = splits.sample_groups(df, 120, "s", "g", "i", 11, used=spark.createDataFrame([("g2",), ("g395",)], "g string"))
    taken = got.collect()
    assert got.columns == df.columns and len({r["g"] for r in taken}) == len(taken) and not {r["g"] for r in taken} & {"g2", "g395"}
    p = {r["stratum"]: r for r in plan.collect()}
    assert (p["a"]["rows"], p["a"]["available"], p["b"]["available"], p["c"]["available"]) == (300, 89, 11, 90)
    assert sum(r["allocated"] for r in p.values()) == 120 and p[None]["allocated"] == 1
    assert Counter(r["s"] for r in taken) == {k: r["taken"] for k, r in p.items()}
    assert len({tuple(sorted(r["i"] for r in splits.sample_groups(df, 120, "s", "g", "i", 11)[0].collect())) for _ in range(2)}) == 1


def whole_tree(n, replicates, seed, size):
    """All multiplicities by splitting all ranges from the top."""
    out = np.zeros((n, replicates), np.int64)

    def split(lo, hi, drawn):
        if hi - lo <= size:
            rng, left = stats._node_rng(seed, lo, -hi), drawn
            for i in range(lo, hi - 1):
                out[i] = rng.binomial(left, 1 / (hi - i))
                left = left - out[i]
            out[hi - 1] = left
            return
        leaves = -(-(hi - lo) // size)
        mid = lo + (leaves // 2) * size
        low = stats._node_rng(seed, lo, hi).binomial(drawn[None], (mid - lo) / (hi - lo))[0]
        split(lo, mid, low)
        split(mid, hi, drawn - low)

    split(0, n, np.full(replicates, n, np.int64))
    return out


@pytest.mark.parametrize("n", [1, 7, 64, 65, 1000])
def test_leaves_of_the_tree(n):
    want = whole_tree(n, 50, "s", 16)
    got = np.concatenate([stats.leaf_multiplicities(n, k, 50, "s", 16) for k in range(-(-n // 16))])
    assert (got == want).all() and (got.sum(0) == n).all()


def test_multiplicities_are_multinomial():
    m = np.concatenate([stats.leaf_multiplicities(200, k, 4000, 3, 16) for k in range(13)]).astype(float)
    assert np.abs(m.mean(1) - 1).max() < 0.08 and np.abs(m.var(1) - (1 - 1 / 200)).max() < 0.13
    c = np.cov(m)
    assert abs(c[np.triu_indices(200, 1)].mean() + 1 / 200) < 0.002


def test_tree_bootstrap(spark):
    rng = random.Random(1)
    rows = [(g, m, rng.randrange(5), rng.randrange(5, 9), "x") for g in range(500) for m in ("base", "new", None) if rng.random() < 0.8]
    counts = spark.createDataFrame(rows, "g int, model string, a int, b int, key string")
    places = {r["g"]: r["p"] for r in stats.hash_ranked(counts.select("g").distinct(), [], hash_rank(4, F.col("g")), "g").select("g", (F.col("_r") - 1).alias("p")).collect()}
    times = whole_tree(len(places), 30, 4, 64)
    got = {(r["model"], r["replicate"]): (r["a"], r["b"]) for r in stats.replicate_sums(counts, "g", ["model"], ["a", "b"], 30, 4, 64).collect()}
    for m in ("base", "new", None):
        for k in range(30):
            assert got[m, k] == tuple(sum(r[c] * int(times[places[r[0]], k]) for r in rows if r[1] == m) for c in (2, 3))
    r = stats.tree_paired_difference(counts.where("model is not null"), "g", "model", "base", "a", "b", 200, 4).collect()
    assert len(r) == 1 and r[0]["low"] < r[0]["point"] < r[0]["high"] and r[0]["replicates"] == 200
    assert stats.replicate_sums(counts.where("false"), "g", ["model"], ["a"], 5, 1).count() == 0


def test_drawn_sums(spark, monkeypatch):
    """Hashed draws against a plain version, in ranges of 8 places; draws are rows by chunk and range, not each one."""
    import hashlib

    rows = [(f"g{i}", m, i % 5, i % 7 + 1) for i in range(37) for m in ("x", "y") if m == "x" or i % 3] + [("g0", "z", None, 2)]
    counts = spark.createDataFrame(rows, "g string, m string, a long, b long")
    sha = lambda *x: hashlib.sha256("|".join(map(str, (9, *x))).encode()).hexdigest()
    groups = sorted({r[0] for r in rows}, key=lambda g: (sha(g), g))
    plain = {}
    for rep in range(30):
        times = Counter(groups[int(sha(rep, i)[:8], 16) % len(groups)] for i in range(len(groups)))
        for g, m, a, b in rows:
            if times[g]:
                s = plain.setdefault((m, rep), [0, 0])
                s[0] += (a or 0) * times[g]
                s[1] += b * times[g]
    for size in (240, 1 << 21):
        monkeypatch.setattr(stats, "DRAWN", size)
        got = stats.drawn_sums(counts, counts, "g", ["m"], ["a", "b"], 30, 9).collect()
        assert len(got) == len(plain) and {(r["m"], r["replicate"]): [r["a"], r["b"]] for r in got} == plain
    assert stats._draws(spark, 20_000, 200, 7, 10_485).count() == 4  # 4,000,000 draws
    assert stats.drawn_sums(counts.where("false"), counts.where("false"), "g", ["m"], ["a"], 30, 9).count() == 0


def test_balanced_exact_streams(spark):
    """Equal to a plain greedy pass; a split's rows come in batches, so none is held whole."""
    import hashlib

    rows = [(i, "ab"[i % 2] if i % 9 else None, ["x", "y", "z"][i % 3 :] or None) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, s string, o array<string>")
    sha = lambda *x: hashlib.sha256("|".join(map(str, (4, *x))).encode()).hexdigest()
    want, used = {}, {}
    for i, s, o in sorted(rows, key=lambda r: (sha(r[0]), r[0])):
        best = min(o, key=lambda c: (used.get((s, c), 0), sha(i, c)))
        used[s, best] = used.get((s, best), 0) + 1
        want[i] = (s, best)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = splits.balanced_exact(df, "i", "o", 4, "s")
        assert {r["i"]: (r["s"], r["option"]) for r in got.collect()} == want
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
