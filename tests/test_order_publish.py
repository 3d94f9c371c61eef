"""Order statistics, options, published tables and diversity: against plain versions and at their edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions.bleu import sentence_bleu, token_column, tokens
from sievework.operators import checks, diversity, options, order_stats
from sievework.sources import publish

PLACES = {"first": lambda n: F.lit(0), "mid": order_stats.upper_median, "p9": order_stats.at_share(0.9), "out": lambda n: n}


def test_order_values(spark):
    rng = random.Random(3)
    edge = [-(2**63), 2**63 - 1, 0, -1, 65535, 65536, 2**32]
    rows = [(rng.choice(["a", "b", None]), rng.choice(edge) if rng.random() < 0.3 else rng.randint(-(10**rng.randint(1, 18)), 10**6)) for _ in range(800)] + [("nulls", None), ("b", None)]
    got = {r["n_"]: r for r in order_stats.order_values(spark.createDataFrame(rows, "n_ string, _v long"), ["n_"], "_v", PLACES).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        n = len(v)
        assert (r["n"], r["first"], r["mid"], r["p9"], r["out"]) == (n, v[0], v[n // 2], v[math.floor(0.9 * (n - 1))], None)
    empty = order_stats.order_values(spark.createDataFrame([], "v int"), [], "v", PLACES).collect()
    assert [tuple(r) for r in empty] == [(0, None, None, None, None)]
    assert order_stats.order_values(spark.createDataFrame([], "g int, v int"), ["g"], "v", PLACES).count() == 0
    with pytest.raises(TypeError):
        order_stats.order_values(spark.createDataFrame([(1.5,)], "v double"), [], "v", PLACES)


def test_sketch_keeps_its_error(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, 1.0, -1.0]) * 10 ** rng.uniform(-12, 12),) for _ in range(1500)] + [(None,), (float("nan"),), (float("inf"),)]
    df = spark.createDataFrame(rows, "x double")
    for error in (0.01, 0.1):
        parts = [order_stats.sketch(df.where(c), [], "x", error) for c in ("x < 0", "x >= 0 or x is null")]
        at = {f"q{q}": order_stats.at_share(q / 10) for q in range(11)}
        r = order_stats.sketched_values(order_stats.merged(*parts), [], at, error).first()
        v = sorted(x for (x,) in rows if x is not None and math.isfinite(x))
        assert r["n"] == len(v)
        for q in range(11):
            true = v[math.floor(q / 10 * (len(v) - 1))]
            assert abs(r[f"q{q}"] - true) <= error * abs(true) * (1 + 1e-9)


def test_label_lists(spark):
    rows = [("1", "w", "x", None, "7", " 8 ", "", "A ", 8), ("2", None, "", "z", "7", None, "7", None, 7), ("3", "a", "b", "c", "1", "2", "3", "B", None)]
    df = spark.createDataFrame(rows, "id string, TxA string, TxB string, TxC string, LbA string, LbB string, LbC string, target string, other int").withColumnsRenamed({"target": "ok", "other": "want"})
    df = df.withColumn("target", F.lit("clash"))
    got = {r["id"]: [[tuple(o) for o in r[k]] for k in ("target", "other", "unlabelled")] for r in options.label_lists(df, "Tx(.)", "Lb(.)", F.col("ok"), F.col("want")).collect()}
    assert got["1"] == [[("B", "x", "8")], [], [("C", "", None)]]
    assert got["2"] == [[("A", "", "7"), ("C", "z", "7")], [], [("B", "", None)]]
    assert got["3"] == [[], [("A", "a", "1"), ("C", "c", "3")], []]
    assert options.option_rows(df, ["id"], "Tx(.)", "Lb(.)").count() == 9
    with pytest.raises(ValueError):
        options.options_of(df, "none(.)")


def test_publish(spark, tmp_path):
    at = f"file://{tmp_path}/table"
    rules = {"_rows": F.col("x") > 0, "y": F.col("y").isNotNull()}
    table = lambda rows: spark.createDataFrame(rows, "x int, y string")
    with pytest.raises(FileNotFoundError):
        publish.current(spark, at)
    assert publish.publish(table([(1, "a")]), at, rules) == 1
    unique = lambda t: checks.violations("unique", checks.not_unique(t, "x"))
    for bad, why in (([(0, "a"), (None, "b")], "_rows: 2 violations"), ([(1, None)], "y: 1 violations"), ([(1, "a"), (1, "b")], "unique: 1 violations"), ([], "rows: 0 of at least 1")):
        with pytest.raises(checks.CheckFailed, match=why):
            publish.publish(table(bad), at, rules, unique, least=1)
        assert publish.versions(spark, at) == [1] and [tuple(r) for r in publish.current(spark, at).collect()] == [(1, "a")]
    assert publish.publish(table([]), at, rules) == 2
    assert publish.current(spark, at).count() == 0
    assert not [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("_staged")]


def test_a_version_is_not_overwritten(spark, tmp_path):
    (tmp_path / "t" / "v1").mkdir(parents=True)
    (tmp_path / "t" / "_a").mkdir()
    with pytest.raises(Exception, match="exists|Exist"):
        publish._rename(spark, f"file://{tmp_path}/t/_a", f"file://{tmp_path}/t/v1")


TEXTS = ["", " ", None, "<skipped>", "the cat sat on the mat", "the cat sat on the mat.", "the cat sat", "mat the on sat cat the", "cat", "cat", "a b c d e", "a b c x d e", "d e a b", "2.5 is 3-4, &lt;b&gt; &amp;", "x-\ny z\nw", "e d c b a", " the cat\x1c sat "]


def test_tokens_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", token_column(F.col("t")).alias("k")).collect():
        assert r["k"] == tokens(r["t"] or "")
    assert tokens("say &quot;no&quot;, x-\ny") == ["say", '"', "no", '"', ",", "xy"]


@pytest.mark.parametrize("seed", range(2))
def test_diversity_is_that_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["p", "q", None]), rng.randint(0, 5), t) for t in TEXTS for _ in range(2)]
    rows += [(rng.choice(["r", "s"]), i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))) for i in range(60)] + [("lone", 1, "x y")]
    want = []
    for i, (g, k, t) in enumerate(rows):
        other = [u or "" for j, (h, _, u) in enumerate(rows) if h == g and j != i]
        if other:
            want.append((g, k, 0.0 if not (t or "").strip() else min(1.0, max(0.0, 1 - max(sentence_bleu(t, u) for u in other)))))
    df = spark.createDataFrame(rows, "_g string, _h int, _t string")
    got = [tuple(r) for r in diversity.bleu_diversity(df, "_g", "_h", "_t").collect()]
    key = lambda r: (str(r[0]), r[1], round(r[2], 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert diversity.bleu_diversity(df.where("false"), "_g", "_h", "_t").count() == 0


def test_grams_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b", "a", "b"]), (None, 2, ["a"])], "_g string, _id long, _t array<string>")
    got = diversity._grams(df, 2)
    assert sorted((r["_id"], r["_c"]) for r in got.collect()) == [(1, 1), (1, 2)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
