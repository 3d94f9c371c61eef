import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions.textkeys import hash_rank
from sievework.operators import checks, curation, exports, runs, splits
from sievework.operators.ranks import hash_ranked


def test_hash_ranked_is_the_window_order(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 2 == 0, "cold")).alias("g"))
    w = Window.partitionBy("g")
    want = df.withColumn("_r", F.row_number().over(w.orderBy(hash_rank(1, F.col("id")), "id"))).withColumn("_n", F.count(F.lit(1)).over(w))
    got = hash_ranked(df, ["g"], hash_rank(1, F.col("id")), "id")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == 5000  # null groups too
    assert hash_ranked(df.where("false"), ["g"], hash_rank(1, F.col("id")), "id").count() == 0
    assert sorted(r["_r"] for r in hash_ranked(df, [], hash_rank(1, F.col("id")), "id").collect()) == list(range(1, 5001))


def test_forced_groups_are_never_cut(spark):
    df = spark.range(200).select("id", F.lit("s").alias("s"))
    out = splits.split_strata(df, "s", "id", 3, [("test", 0.1), ("val", 0.1)], "train", forced=df.where("id < 50"))
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"test": 20, "val": 20, "train": 160}
    assert out.where("id < 50 and split <> 'train'").isEmpty()


def test_attach(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "row int, text string")
    label = lambda *pairs: spark.createDataFrame(list(pairs), "row int, label string")
    got = exports.attach(rows, label((1, "y"), (0, None)), ["row"], "label").collect()
    assert sorted((r["row"], r["text"], r["label"]) for r in got) == [(0, "a", None), (1, "b", "y")]
    for bad in (label((0, "x")), label((0, "x"), (1, "y"), (2, "z")), label((0, "x"), (1, "y"), (1, "z"))):
        with pytest.raises(Exception, match="one to one"):
            exports.attach(rows, bad, ["row"], "label").collect()
    with pytest.raises(ValueError):
        exports.attach(rows, label(), ["row"], "text")


def test_attach_by_identity(spark):
    known = spark.createDataFrame([("q", None, "x"), ("q", 1, "y")], "b string, a int, label string")
    rows = spark.createDataFrame([(None, "q"), (1, "q"), (1, "q")], "a int, b string")
    assert sorted(r["label"] for r in exports.attach_by_identity(rows, known, "label").collect()) == ["x", "y", "y"]
    with pytest.raises(Exception, match="no identical row"):
        exports.attach_by_identity(spark.createDataFrame([(2, "q")], "a int, b string"), known, "label").collect()


def test_verdicts_are_counted(spark):
    r = spark.createDataFrame([(1, 0)], "c int, k int")
    v = lambda n: spark.createDataFrame([(1, 0, "x")] * n, "c int, k int, verdict string")
    assert exports.with_verdicts(r, v(3), ["c", "k"], "verdict", 3).first()["verdicts"] == ["x"] * 3
    for n in (1, 4):
        with pytest.raises(Exception, match="exactly 3"):
            exports.with_verdicts(r, v(n), ["c", "k"], "verdict", 3).collect()


def test_step_metrics_of_nothing(spark):
    schema = "verdict string, labels array<string>, in_g boolean, k int, aux double, total double, truncated boolean, anomaly boolean, cached boolean, attempts int, latency_s double"
    r = runs.step_metrics(spark.createDataFrame([], schema)).first()
    assert (r["n"], r["null_rate"], r["accept_rate_incorrect"], r["retry_rate"]) == (0, None, 0.0, 0.0)
    rows = [("incorrect", ["aligned", "aligned"], True, 2, 1.0, 2.0, False, False, False, 2, 1.0), (None, None, False, 0, 0.0, 0.0, True, True, True, 9, 9.0), ("incorrect", [], False, 2, 0.0, 0.0, False, False, None, 1, 3.0)]
    r = runs.step_metrics(spark.createDataFrame(rows, schema)).first()
    assert (r["accept_rate_incorrect"], r["aux_mean_active"], r["retry_rate"], r["latency_s"], r["incorrect_rate_judgeable"]) == (1.0, 1.0, 0.5, 2.0, 1.0)


def test_quota_pick_and_blocks(spark):
    d = spark.createDataFrame([(i, "a" if i < 20 else "b", i % 2) for i in range(22)], "id int, cat string, stage int")
    got = splits.spread_pick(d, "cat", {"a": 5, "b": 9}, "stage", "id", 1).collect()
    assert sum(r["cat"] == "a" for r in got) == 5 and sum(r["cat"] == "b" for r in got) == 2
    assert sorted(r["stage"] for r in got if r["cat"] == "a") in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])
    blocks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 0), (3, 2), (4, 0)], "c int, k int")
    assert sorted(r["c"] for r in splits.broken_blocks(blocks, "c", "k", 2).collect()) == [2, 3, 4]


def test_pair_checks_find_each_fault(spark):
    cases = spark.createDataFrame([(1, "d", "g1", "train", "ok", False, ""), (2, "d", "g2", "train", "ok", False, ""), (3, "e", "g1", "test", "ambiguous", True, "")], "sample_id int, dataset string, question_group_id string, split string, description_status string, prompt_dev_group boolean, exclusion_reason string")
    names = "target string, split string, dataset string, anchor_sample_id int, donor_sample_id int, question_group_id string, donor_question_group_id string, anchor_source_error_label string, donor_source_error_label string, question string, solution string, error_description string, n_tokens int"
    good = [("aligned", "train", "d", 1, 1, "g1", "g1", "x", "x", "q", "s", "e", 5), ("not_aligned", "train", "d", 1, 2, "g1", "g2", "x", "y", "q", "s", "e", 5)]
    assert checks.pair_checks(cases.where("sample_id < 3"), spark.createDataFrame(good, names), 10).where("not passed").isEmpty()
    bad = [("aligned", "train", "d", 1, 2, "g1", "g2", "x", "x", "q", " ", "e", 11), ("not_aligned", "train", "d", 1, 3, "g1", "g1", "Some_x", "some X", "q", "s", "e", 5), ("not_aligned", "train", "d", 1, 9, "g1", "g1", "x", "y", "q", "s", None, 5)]
    assert checks.pair_checks(cases, spark.createDataFrame(bad, names), 10).where("passed").isEmpty()


def test_half_checks(spark):
    whole = spark.createDataFrame([(1, "g", "A"), (2, "h", "B"), (3, "i", "B")], "id int, g string, dh string")
    a, b = whole.where("id = 1"), whole.where("id > 1")
    assert checks.half_checks(whole, a, b, "id", "g", "dh").where("not passed").isEmpty()
    assert checks.half_checks(whole, whole, b, "id", "g", "dh").where("passed").isEmpty()


def test_columns_may_have_inner_names(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("_h"), F.lit("b").alias("_b"), F.lit(1).alias("_k0"), F.lit(2).alias("_C"), F.lit("s").alias("s"), F.lit(0).alias("_r"))
    got = hash_ranked(df, ["s"], hash_rank(1, F.col("id")), "id")
    assert got.columns == ["id", "_h", "_b", "_k0", "_C", "s", "_r", "_n"]
    assert sorted((r["id"], r["_h"], r["_b"]) for r in got.collect()) == [(i, i % 3, "b") for i in range(50)]
    assert sorted(r["_r"] for r in got.collect()) == list(range(1, 51))
    mixed = splits.interleave(df.withColumn("place", F.lit("x")).withColumn("_o1", F.lit(1)).withColumn("_d", F.lit(1)), "s", "_h", "id", 3)
    assert sorted(r["place"] for r in mixed.collect()) == list(range(1, 51)) and {"_o1", "_d", "turn"} <= set(mixed.columns)
    rows = spark.createDataFrame([(1, "k", "", 5), (2, "k", "", 6), (3, None, "", 7)], "i int, key string, reason string, _least int")
    assert sorted((r["i"], r["reason"], r["_least"]) for r in curation.duplicate_reason(rows, ["key"], "i").collect()) == [(1, "", 5), (2, "duplicate_record_of:1", 6), (3, "", 7)]
