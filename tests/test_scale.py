"""What must hold at sizes that the tables of the tests don't have."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators import curation, llmio, pairs, ranks, splits
from sievework.plans import report
from sievework.streaming import rollouts


def plain_allocation(available, total):
    """The rounds played one by one."""
    order = sorted(available, key=lambda s: (-available[s], s))
    want = {s: total // len(order) + (i < total % len(order)) for i, s in enumerate(order)}
    got = {s: min(want[s], available[s]) for s in order}
    left = sum(want.values()) - sum(got.values())
    while left and any(got[s] < available[s] for s in order):
        for s in order:
            if left and got[s] < available[s]:
                got[s] += 1
                left -= 1
    return got


def test_allocation_is_the_round_robin(spark):
    rng = random.Random(3)
    for _ in range(12):
        have = {f"s{i}": rng.choice([0, 1, 3, rng.randrange(40)]) for i in range(rng.randrange(1, 9))}
        total = rng.randrange(0, 90)
        got = splits.allocate(spark.createDataFrame(list(have.items()), "stratum string, available long"), total).collect()
        assert {r["stratum"]: r["allocated"] for r in got} == plain_allocation(have, total)


def test_allocation_of_huge_strata(spark):
    s = spark.createDataFrame([("a", 3 * 10**9), ("b", 5), ("c", 4 * 10**9)], "stratum string, available long")
    assert {r["stratum"]: r["allocated"] for r in splits.allocate(s, 6 * 10**9).collect()} == {"a": 2_999_999_997, "b": 5, "c": 2_999_999_998}


def test_sampling_scans_once_a_stratum(spark, tmp_path):
    spark.range(200).select(F.col("id"), (F.col("id") % 8).cast("string").alias("s"), (F.col("id") % 50).alias("g")).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    out = splits.sample_once(d, [(str(i), 4) for i in range(8)], "s", "g", "id", 1)
    # what was taken is stored at each step, so the last plan reads that alone
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert out.count() == 32 and out.select("g").distinct().count() == 32


def test_sample_strata_fills_up(spark):
    d = spark.createDataFrame([(i, "a" if i < 3 else "b", i) for i in range(60)], "id long, s string, g long")
    rows, plan = splits.sample_strata(d, 20, "s", "g", "id", 1)
    assert {r["s"]: r["taken"] for r in plan.collect()} == {"a": 3, "b": 17} and rows.count() == 20


def test_each_row_is_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(text):
        calls.add(len(text))
        return llmio.mock_scorer(text)

    rolls = spark.range(30).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = llmio.cascade(rolls, lambda d: llmio.scored(d, scorer, "text", "verdict"), lambda d: d.withColumn("labels", F.array(F.lit("aligned"))), "id")
    assert out.count() == 30 and out.where("verdict = 'incorrect'").count() > 0 and calls.value == 30


def test_null_keys_are_duplicates(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, k string").withColumn("reason", F.lit(""))
    assert {r["id"]: r["reason"] for r in curation.duplicate_reason(d, ["k"], "id").collect()} == {1: "", 2: "duplicate_record_of:1", 3: ""}


def test_request_key_keeps_types_and_nulls(spark):
    d = spark.createDataFrame([(1, "1", None)], "n long, s string, z string")
    r = d.select(llmio.request_key(v=F.col("n")).alias("a"), llmio.request_key(v=F.col("s")).alias("b"), llmio.request_key(v=F.col("s"), z=F.col("z")).alias("c")).first()
    assert len({r["a"], r["b"], r["c"]}) == 3


def test_order_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, v long, id long")
    got = {r["id"]: (r["_r"], r["_n"]) for r in ranks.order_ranked(d, ["g"], ["v", "id"]).collect()}
    for g in ("a", "b", None):
        mine = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in mine] == [(k + 1, len(mine)) for k in range(len(mine))]


def test_donors_across_stretches(spark, monkeypatch):
    d = spark.range(300).select("id", (F.col("id") % 2).alias("k"), (F.col("id") % 7 % 3).alias("l"), (F.col("id") % 50).alias("g"))
    want = sorted(map(tuple, pairs.donors(d, ["k"], "id", "l", "g", 5).collect()))
    monkeypatch.setattr(pairs, "STRETCH", 10)
    assert sorted(map(tuple, pairs.donors(d, ["k"], "id", "l", "g", 5).collect())) == want


def test_types_are_few(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MOST_TYPES", 1)
    types = spark.createDataFrame([("A", False), ("B", False)], "type string, unit boolean")
    with pytest.raises(ValueError, match="types"):
        pairs.candidates(spark.range(1), types, "id", "unit", "id")


def test_reports_count_what_they_leave_out(spark):
    d = spark.range(7).orderBy("id")
    assert report.markdown(d, 5).endswith("2 more rows not shown") and "more rows" not in report.markdown(d, 7)
    page = report.sheet(d, "t", 5, {"odd": lambda r: r["id"] % 2})
    assert "2 more rows not shown" in page and page.count("odd") == 2
    review, key = report.review_and_key(d.withColumn("verdict", F.lit("x")), "id", ["verdict"], 3)
    assert review.columns == ["number"] and key.select("id").distinct().count() == 7


SCHEMA = T.StructType([T.StructField("step", T.LongType()), T.StructField("try", T.LongType()), T.StructField("v", T.LongType())])


def test_stream_adds_up_batches_of_an_attempt(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run(**kind):
        rollouts.replace_steps(rollouts.read_rollouts(spark, str(src), SCHEMA, 1), str(out), str(tmp_path / "cp"), "step", **kind).awaitTermination()
        return sorted((r["step"], r["v"]) for r in rollouts.newest_steps(spark, str(out)).collect())

    for i in range(3):
        (src / f"{i}.json").write_text(f'{{"step": 1, "try": 1, "v": {i}}}\n{{"step": {i + 2}, "try": 1, "v": {i}}}\n')
    assert run(attempt="try") == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 1), (4, 2)]
    # step 1 is done again in two files; a late file of the first try changes nothing
    for i, (t, v) in enumerate([(2, 10), (1, 3), (2, 11)]):
        (src / f"x{i}.json").write_text(f'{{"step": 1, "try": {t}, "v": {v}}}\n')
    assert run(attempt="try") == [(1, 10), (1, 11), (2, 0), (3, 1), (4, 2)]


def test_stream_keeps_rows_without_a_step(spark, tmp_path):
    schema = "step string, try long, v long"
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        stream = spark.readStream.schema(schema).json(str(src))
        rollouts.replace_steps(stream, str(out), str(tmp_path / "cp"), "step", attempt="try").awaitTermination()
        return sorted(((r["step"], r["v"]) for r in rollouts.newest_steps(spark, str(out)).collect()), key=str)

    (src / "0.json").write_text('{"v": 1, "try": 1}\n{"step": "", "try": 1, "v": 2}\n{"step": "a/b=c", "try": 1, "v": 3}\n{"step": "s", "v": 4}\n')
    assert run() == sorted([(None, 1), (None, 2), ("a/b=c", 3), ("s", 4)], key=str)
    (src / "1.json").write_text('{"v": 5, "try": 2}\n{"step": "a/b=c", "try": 2, "v": 6}\n{"step": "s", "try": 0, "v": 7}\n')
    assert run() == sorted([(None, 5), ("a/b=c", 6), ("s", 7)], key=str)
