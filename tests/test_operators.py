import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import textkeys as tk
from sievework.functions.bleu import sentence_bleu
from sievework.operators import checks, llmio, metrics, pairs, rewards, splits
from sievework.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_keys(spark):
    assert one(spark, tk.squash(F.lit(" A b\n C "))) == "a b c"
    assert one(spark, tk.question_key(F.lit("What, is 2?"))) == one(spark, tk.question_key(F.lit("what is_2")))
    assert one(spark, tk.text_key(F.lit("1 + 2"))) == "1+2"
    assert one(spark, tk.answer_key(F.lit(r"$\mathrm{cm}~ 5\,$"))) == "cm5"
    assert one(spark, tk.nfkc(F.lit("ﬁ"))) == "fi"
    assert one(spark, tk.evidence_found(F.lit(" "), F.lit("x"))) is False
    assert one(spark, tk.strict_label(F.lit(" aligned "), ["aligned"])) == "aligned"
    assert one(spark, tk.lenient_label(F.lit("so: not_aligned."), ["aligned", "not_aligned"])) == "not_aligned"


def test_template_is_one_pass(spark):
    assert one(spark, tk.render("{a} {b}", {"a": F.lit("{b}"), "b": F.lit("x")})) == "{b} x"
    assert one(spark, tk.render_lines("q: {a}\nr: {b}", {"a": F.lit("x"), "b": F.lit(None).cast("string")})) == "q: x"


def test_aligned_needs_labels(spark):
    none = F.array().cast("array<string>")
    assert one(spark, tk.all_aligned(none)) is False
    assert one(spark, tk.all_aligned(F.lit(None).cast("array<string>"))) is False
    assert one(spark, tk.all_aligned(F.array(F.lit("aligned"), F.lit("aligned")))) is True


@pytest.mark.parametrize("verdict,labels,want", [(None, ["aligned"], -0.75), ("correct", ["aligned"], -0.5), ("incorrect", ["aligned", "aligned"], 1.0), ("incorrect", ["aligned", "not_aligned"], 0.0), ("incorrect", [], 0.0)])
def test_main_reward(spark, verdict, labels, want):
    c = rewards.main_reward(F.lit(verdict).cast("string"), F.array(*[F.lit(x) for x in labels]).cast("array<string>"), 0.5)
    assert one(spark, c) == want


def test_unknown_verdict_fails(spark):
    with pytest.raises(Exception, match="unexpected verdict"):
        one(spark, rewards.known_verdict(F.lit("maybe")))


def test_win_scores(spark):
    cycle = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "A"), (1, 2, 0, "A")], "g int, a int, b int, winner string")
    assert {r["score"] for r in rewards.win_scores(cycle, "g").collect()} == {0.5}
    with pytest.raises(Exception, match="incomplete round robin"):
        rewards.win_scores(cycle.limit(2), "g").collect()


@pytest.mark.parametrize("k", [2, 3, 4, 5, 8])
def test_schedule_is_balanced(spark, k):
    s = rewards.pair_schedule(spark.range(k).select(F.lit(1).alias("g"), F.col("id")), "g", "id", 3).collect()
    assert len({frozenset((r["a"], r["b"])) for r in s}) == k * (k - 1) // 2
    first = [sum(r["a"] == i for r in s) for i in range(k)]
    assert set(first) <= {(k - 1) // 2, k // 2}


def test_bleu():
    assert sentence_bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1)
    assert sentence_bleu("a b", "c d") == 0
    assert 0 < sentence_bleu("the cat sat", "the cat stood there") < 1


def test_two_pair_accuracies(spark):
    rows = spark.createDataFrame([("a", "aligned", True, 1), ("a", "not_aligned", False, 2), ("a", "not_aligned", True, 3), ("b", "aligned", True, 1)], "anchor string, target string, correct boolean, o int")
    assert metrics.pair_accuracy(rows, "anchor", "target", "correct").first()["pair_accuracy"] == 0.0
    assert metrics.last_pair_accuracy(rows, "anchor", "target", "correct", "o").first()["pair_accuracy"] == 1.0


def test_invalid_is_wrong(spark):
    rows = spark.createDataFrame([("aligned", "aligned"), ("not_aligned", None)], "target string, prediction string")
    r = metrics.rates(rows.agg(*metrics.confusion())).first()
    assert (r["accuracy"], r["invalid_rate"], r["negative_acceptance"]) == (0.5, 0.5, 0.0)


def test_allocation_redistributes(spark):
    s = spark.createDataFrame([("a", 1), ("b", 5), ("c", 50)], "stratum string, available long")
    assert {r["stratum"]: r["allocated"] for r in splits.allocate(s, 30).collect()} == {"a": 1, "b": 5, "c": 24}


def test_split_ignores_other_strata(spark):
    a = spark.range(100).select(F.lit("x").alias("s"), F.col("id"))
    b = a.unionByName(spark.range(100, 150).select(F.lit("y").alias("s"), F.col("id")))
    f = lambda d: {r["id"]: r["split"] for r in splits.split_strata(d, "s", "id", 1, [("test", 0.1)], "train").where("s = 'x'").collect()}
    assert f(a) == f(b)
    assert sum(v == "test" for v in f(a).values()) == 10


def test_donors_cover_long_stretches(spark):
    rows = [(i, "l0" if i else "l1", i) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, l string, g long").withColumn("k", F.lit(1))
    got = {r["anchor"]: r["donor"] for r in pairs.donors(d, ["k"], "id", "l", "g", 5).collect()}
    assert len(got) == 60 and all(got[i] == 0 for i in range(1, 60))


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "g int, s string")
    t = checks.table(checks.violations("one split", checks.in_one(df, "g", "s")))
    with pytest.raises(checks.CheckFailed, match="one split"):
        checks.require(t)
    assert checks.partition_gap(df, df.where("s = 'a'"), df.where("s = 'b'")).isEmpty()


@pytest.mark.parametrize(
    "text,want",
    [
        ("", "empty_response"),
        ('{"description": null, "evidence_quote": "x", "status": "ok"}', "ok"),
        ('```json\n{"description": "d", "evidence_quote": "x", "status": "ok"}\n```', "ok"),
        ('{"description": "null", "evidence_quote": "x", "status": "ok"}', "schema_invalid"),
        ('{"description": "d", "evidence_quote": "x", "status": "ok"} trailing', "json_parse_error"),
        ('{"description": "d", "evidence_quote": "x", "status": "ok"}}', "json_parse_error"),
        ('{"description": "d", "evidence_quote": 3, "status": "ok"}', "schema_invalid"),
        ("[1]", "schema_invalid"),
    ],
)
def test_parse_answer(spark, text, want):
    df = llmio.parse_answers(spark.createDataFrame([(text,)], "t string"), "t", ["description", "evidence_quote", "status"], ["ok"])
    assert df.first()["processing_status"] == want


def test_cascade_asks_the_verifier_for_incorrect_only(spark):
    rolls = spark.range(90).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    check = lambda d: llmio.scored(d, llmio.mock_scorer, "text", "verdict", 2)
    seen = []

    def verify(d):
        seen.append(d)
        return d.withColumn("labels", F.array(F.lit("aligned")))

    out = llmio.cascade(rolls, check, verify, "id")
    assert out.where("verdict = 'incorrect' and labels is null").isEmpty() and out.where("verdict <> 'incorrect' and labels is not null").isEmpty()
    assert seen[0].where("verdict <> 'incorrect'").isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    schema = T.StructType([T.StructField("x", T.LongType())])
    assert sorted(r["x"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\nnope\n')
    with pytest.raises(Exception, match="not a JSON record"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), schema).collect()
    (tmp_path / "c.json").write_text('{"records": [{"x": 5}, {"x": 6}]}')
    assert [(r["row"], r["record"]["x"]) for r in files.read_json_array(spark, str(tmp_path / "c.json"), "struct<x:long>").orderBy("row").collect()] == [(0, 5), (1, 6)]
    raw = '[\n  {\n    "a": "é"\n  }\n]\n'
    (tmp_path / "d.json").write_text(raw, encoding="utf-8")
    files.rewrite_json(str(tmp_path / "d.json"), str(tmp_path / "e.json"), lambda rows: rows)
    assert (tmp_path / "e.json").read_text(encoding="utf-8") == raw


def test_csv_key_is_unique(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n1,a\n1,b\n")
    with pytest.raises(files.BadInput):
        files.read_csv(spark, str(tmp_path / "x.csv"), T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())]), ["id"])


def test_stream_replaces_steps(spark, tmp_path):
    from sievework.streaming import rollouts

    schema = T.StructType([T.StructField("step", T.LongType()), T.StructField("v", T.LongType())])
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for name, v in (("1", 1), ("2", 2)):
        (src / f"{name}.json").write_text(f'{{"step": 7, "v": {v}}}\n')
        rollouts.replace_steps(rollouts.read_rollouts(spark, str(src), schema), str(out), str(tmp_path / "cp"), "step").awaitTermination()
    assert [(r["step"], r["v"]) for r in spark.read.parquet(str(out)).collect()] == [(7, 2)]


def test_facet_rows_are_not_shuffled(spark):
    """What is shuffled for facets doesn't grow with their number; null anchors and frequent ones are as in a plain count."""
    from collections import defaultdict

    data = [(i % 7 if i % 11 else None, "aligned" if i % 2 else "not_aligned", ("aligned", "not_aligned", "invalid")[i % 3], i % 5, None if i % 4 == 0 else "u") for i in range(300)]
    df = spark.createDataFrame(data, "g int, target string, prediction string, x int, y string").withColumn("correct", F.expr("target = prediction"))
    facets = {"x": F.col("x"), "y": F.col("y"), "neg": F.col("x") % 2}
    got = metrics.facet_breakdown(df, facets, 1, "g", "correct", ("neg",))
    plain = defaultdict(list)
    for g, t, p, x, y in data:
        for f, v in (("x", str(x)), ("y", y or ""), *((("neg", str(x % 2)),) if t == "not_aligned" else ())):
            plain[f, v].append((g, t, p))
    want = {}
    for k, rows in plain.items():
        by = defaultdict(list)
        for g, t, p in rows:
            by[g].append((t, p))
        two = [r for r in by.values() if len({t for t, _ in r}) == 2]
        right = sum(all(t == p for t, p in r) for r in two)
        want[k] = (len(rows), sum(t == p == "aligned" for _, t, p in rows), len(two), right)
    assert {(r["facet"], r["value"]): (r["n"], r["tp"], r["pairs"], r["right"]) for r in got.collect()} == want
    exchanges = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("facet" in line and "_anchor" in line for line in exchanges)
    other = df.withColumn("target", F.expr("case when g = 1 and target = 'aligned' then 'third' else target end"))
    pairs_of = {(r["facet"], r["value"]): r["pairs"] for r in metrics.facet_breakdown(other, facets, 1, "g", "correct", ("neg",)).collect()}
    assert pairs_of == {k: v[2] for k, v in want.items()}  # two kinds, whichever


def test_pair_checks_join_no_texts(spark):
    """Whether a text is blank is told before the joins."""
    cases = spark.createDataFrame([(1, "d", 1, "train", "ok", False, "")], "sample_id int, dataset string, question_group_id int, split string, description_status string, prompt_dev_group boolean, exclusion_reason string")
    data = [("aligned", "train", "d", 1, 1, 1, 1, "a", "a", q, "s", "e", 5) for q in ("text", " \n", None)]
    kinds = "target string, split string, dataset string, anchor_sample_id int, donor_sample_id int, question_group_id int, donor_question_group_id int, anchor_source_error_label string, donor_source_error_label string, question string, solution string, error_description string, n_tokens int"
    out = checks.pair_checks(cases, spark.createDataFrame(data, kinds), 10)
    assert {r["name"]: r["detail"] for r in out.collect()}["text.present"] == "2 violations"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter") :]
    assert "_texts" in below
    first = plan[: plan.index("Join LeftOuter")]
    assert "question#" not in first and "solution#" not in first
