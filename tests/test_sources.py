"""Corpora, eligibility, answers and settings, on small cases written out."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import answers, settings
from sievework.operators import checks, eligibility, exports, llmio, rewards, splits, stats
from sievework.sources import corpora, files


def rows_of(spark, tmp_path, name, records, corpus):
    (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / name).write_text(json.dumps(records))
    return files.read_json_array(spark, str(tmp_path / name), corpus.record)


def reasons(df):
    return [r["exclusion_reason"] for r in sorted(df.collect(), key=lambda r: int(r["source_id"].split("#")[1]))]


def test_stepwise(spark, tmp_path):
    records = [
        {"problem": "2+2?", "student_incorrect_solution": ["2+2", "=5"], "error_category": "Calculation"},
        {"problem": "2+2?", "student_incorrect_solution": "[plain] = 5", "error_category": " None of the above "},
        {"problem": " ", "student_incorrect_solution": None, "error_category": "none"},
    ]
    got = corpora.canonical(rows_of(spark, tmp_path, "dataset.json", records, corpora.STEPWISE), corpora.STEPWISE, "r1")
    assert reasons(got) == ["", "non_error_label", "missing_field:question,incorrect_solution"]
    r = got.where("eligible").first()
    assert r["incorrect_solution"] == "2+2\n=5" and r["source_revision"] == "r1" and json.loads(r["annotations"])["steps"] == '["2+2","=5"]'
    assert got.where("incorrect_solution = '[plain] = 5'").count() == 1 and r["sample_id"].startswith("stepwise:") and r["question_group_id"].startswith("qg:")


def test_mathclean(spark, tmp_path):
    records = [{"question": "q", "answer": "a", "type": "Logic Error", "extent": "x"}, {"question": "q", "answer": "a", "type": "correct"}, {"question": "q", "answer": "a"}]
    got = corpora.canonical(rows_of(spark, tmp_path, "check_type_answer/simple.json", records, corpora.MATHCLEAN), corpora.MATHCLEAN)
    assert reasons(got) == ["", "label_outside_error_types:correct", "missing_field:source_error_label"]
    assert json.loads(got.where("eligible").first()["annotations"]) == {"extent": "x", "difficulty_file": "simple", "subset": "check_type_answer"}


def test_eic(spark, tmp_path):
    record = {"question": "q", "transformed_solution": "s", "wrong_type": "missing_step", "is_single_error": True}
    tree = {"missing_step": [record, {**record, "is_single_error": None}, {**record, "wrong_type": "other"}], "wrong_step_x": [record]}
    for folder, records in tree.items():
        at = tmp_path / "generated_cases_GSM8K" / folder
        at.mkdir(parents=True)
        (at / "clean.jsonl").write_text("\n\n".join(map(json.dumps, records)) + "\n")
    raw = corpora.read_json_lines(spark, str(tmp_path), corpora.EIC.record)
    got = corpora.canonical(corpora.eic_rows(raw, ["GSM8K"]), corpora.EIC)
    assert reasons(got.where("source_file like '%/missing_step/%'")) == ["", "is_single_error_not_true", "label_outside_canonical_set:other"]
    assert reasons(got.where("source_file like '%wrong_step_x%'")) == ["non_error_type_directory:wrong_step_x"]
    assert corpora.eic_rows(raw, ["MathQA"]).isEmpty()
    with pytest.raises(files.BadInput, match="unknown benchmarks"):
        corpora.eic_rows(raw, ["GSM9K"])
    (tmp_path / "generated_cases_GSM8K" / "missing_step" / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        corpora.read_json_lines(spark, str(tmp_path), corpora.EIC.record).collect()


def test_mathedu_with_questions_by_position(spark, tmp_path):
    parts = [spark.createDataFrame(rows, "row int, Problem string") for rows in ([(0, "first"), (1, "second")], [(0, "third")])]
    questions = files.concat_positions(parts)
    error = {"error_type": " Wrong Formula ", "error_equation": "e", "teacher_advice_en": "a", "teacher_advice_ch": "b"}
    wrong = lambda i, *errors: {"id": i, "student_process": "p", "correct_or_not": "Wrong", "teacher_review": {"error_counts": len(errors), "error": list(errors)}}
    records = [wrong(2, error), wrong(0, error, error), wrong(1), wrong(9, error), wrong(-1, error), {"id": 0, "correct_or_not": "right"}, {**wrong(0, error), "student_process": " "}]
    raw = rows_of(spark, tmp_path, "train.json", records, corpora.MATHEDU)
    got = corpora.canonical(corpora.with_questions(raw, questions, F.col("record.id"), "Problem"), corpora.MATHEDU)
    assert reasons(got) == ["", "multiple_annotated_errors:2", "no_teacher_annotated_error", "mathqa_question_not_found", "mathqa_question_not_found", "not_an_incorrect_answer:right", "missing_field:incorrect_solution"]
    assert [(r["question"], r["source_error_label"], r["stratum"]) for r in got.where("eligible").collect()] == [("third", "Wrong Formula", "Wrong Formula")]


def test_own_files_and_dispatch(spark, tmp_path):
    raw = rows_of(spark, tmp_path, "own.json", [{"q": "x", "s": "y", "l": "z"}, {"q": None, "s": "y", "l": "z"}], corpora.Corpus("own", "struct<q:string,s:string,l:string>", None, None, None))
    got = corpora.from_map(raw, {"question": "q", "incorrect_solution": "s", "source_error_label": "l"}, "own")
    assert reasons(got) == ["", "missing_field:question"]
    with pytest.raises(files.BadInput, match="question"):
        corpora.from_map(raw, {"incorrect_solution": "s", "source_error_label": "l"}, "own")
    step = rows_of(spark, tmp_path, "a.json", [{"problem": "p", "student_incorrect_solution": "s", "error_category": "c"}], corpora.STEPWISE)
    clean = rows_of(spark, tmp_path, "b.json", [{"question": "p", "answer": "s", "type": "logic error"}], corpora.MATHCLEAN)
    assert sorted(r["dataset"] for r in corpora.pool_of({"stepwise": step, "mathclean": clean}).where("eligible").collect()) == ["mathclean", "stepwise"]
    with pytest.raises(files.BadInput, match="unknown corpora"):
        corpora.pool_of({"steps": step})


def test_pinned_and_strings(spark, tmp_path):
    spark.createDataFrame([("q", "work #### 4 "), ("r", "a #### b #### 5")], "question string, answer string").write.parquet(str(tmp_path / "p"))
    assert sorted(r["reference"] for r in files.read_pinned(spark, str(tmp_path / "p"), 2, "answer").collect()) == ["4", "5"]
    with pytest.raises(files.BadInput, match="2 rows"):
        files.read_pinned(spark, str(tmp_path / "p"), 3)
    with pytest.raises(files.BadInput, match="without"):
        files.read_pinned(spark, str(tmp_path / "p"), 2, "question")
    digests = {r["sha256"] for r in files.provenance(spark, str(tmp_path / "p")).where("file like '%.parquet'").collect()}
    assert digests == {settings.file_digest(str(f)) for f in (tmp_path / "p").glob("*.parquet")}
    assert files.read_pinned(spark, str(tmp_path / "p"), 2, sha256=digests).count() == 2
    with pytest.raises(files.BadInput, match="digests"):
        files.read_pinned(spark, str(tmp_path / "p"), 2, sha256={"0"})
    d = spark.createDataFrame([('["a", "b"]',), ("nope",)], "x string").select(files.string_list(F.col("x")).alias("l"))
    assert [r["l"] for r in d.collect()] == [["a", "b"], None]


def test_json_lines_sink(spark, tmp_path):
    d = spark.createDataFrame([(1, "é")], "n long, t string")
    assert files.write_jsonl(d, str(tmp_path / "o")) == 1
    assert files.write_jsonl(d.unionByName(d), str(tmp_path / "o"), append=True) == 2
    back = files.read_jsonl(spark, str(tmp_path / "o"), T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType())]))
    assert [tuple(r) for r in back.collect()] == [(1, "é")] * 3
    files.write_review_csv(d, str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*.csv")
    assert part.read_text(encoding="utf-8-sig").splitlines() == ["n,t", "1,é"] and part.read_bytes().startswith(b"\xef\xbb\xbf")


def test_select_run(spark):
    d = spark.createDataFrame([("b", "x2"), ("a", "x3"), ("a", "x1")], "dataset string, id string")
    ids = spark.createDataFrame([("x1",), ("x2",)], "id string")
    assert [r["id"] for r in eligibility.select_run(d, "id", "dataset", ids=ids).collect()] == ["x1", "x2"]
    assert [r["id"] for r in eligibility.select_run(d, "id", "dataset", ["a"], limit=1).collect()] == ["x1"]
    with pytest.raises(eligibility.NotAllowed, match="x2"):
        eligibility.select_run(d, "id", "dataset", ["a"], ids)


def test_taxonomy(spark):
    tax = spark.createDataFrame([("d", "calc", "T1", "adopted"), ("d", "misc", "T9", "excluded")], "dataset string, alias string, type_id string, status string")
    cases = spark.createDataFrame([("d", "calc"), ("d", "misc")], "dataset string, label string")
    assert sorted((r["label"], r["type_id"], r["type_status"]) for r in eligibility.resolve_types(cases, tax, "dataset", "label").collect()) == [("calc", "T1", "adopted"), ("misc", "T9", "excluded")]
    with pytest.raises(eligibility.NotAllowed, match="outside"):
        eligibility.resolve_types(cases.withColumn("label", F.lit("new")), tax, "dataset", "label")
    with pytest.raises(eligibility.NotAllowed, match="several"):
        eligibility.resolve_types(cases, tax.unionByName(tax), "dataset", "label")


def test_exclusions_keep_the_first_reason(spark):
    cases = spark.createDataFrame([(1, "k1", "a", ""), (2, "k1", "b", "short"), (3, "k2", "a", ""), (4, "k3", "a", ""), (5, None, "a", ""), (6, None, "b", "")], "id long, k string, l string, reason string")
    extra = spark.createDataFrame([("k2", "z"), ("k9", "z"), ("k3", None)], "k string, l string")
    got = {r["id"]: (r["reason"], r["only_extra"]) for r in eligibility.exclude_conflicts(cases, ["k"], "l", "reason", extra).collect()}
    assert got == {1: ("multi_label_solution", False), 2: ("short", False), 3: ("multi_label_solution", True), 4: ("", False), 5: ("", False), 6: ("", False)}
    held = eligibility.hold_out(cases, spark.createDataFrame([(2,), (4,)], "id long"), "id", "reason")
    assert {r["id"]: r["reason"] for r in held.collect()} == {1: "", 2: "short", 3: "", 4: "held_out", 5: "", 6: ""}


def test_length_check(spark):
    d = spark.createDataFrame([("a", "r", 5, 9), ("a", "r", 50, 2), ("b", "r", 5, 5), ("c", "s", 1, 60)], "anchor string, region string, x int, y int")
    kept, stats = eligibility.length_check(d, "anchor", {"x": F.col("x"), "y": F.col("y")}, 40, "region")
    assert [r["anchor"] for r in kept.collect()] == ["b"]
    assert {(r["region"], r["tokenizer"]): (r["n"], r["longest"], r["over"]) for r in stats.collect()} == {("r", "x"): (3, 50, 1), ("r", "y"): (3, 9, 0), ("s", "x"): (1, 1, 0), ("s", "y"): (1, 60, 1)}


def test_decisions(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert eligibility.all_kept(rows, spark.createDataFrame([(1, "KEEP"), (2, "KEEP"), (3, "DROP")], "id long, decision string"), "id").count() == 2
    for other in ([(1, "KEEP")], [(1, "KEEP"), (2, "DROP")]):
        with pytest.raises(eligibility.NotAllowed):
            eligibility.all_kept(rows, spark.createDataFrame(other, "id long, decision string"), "id")


def test_eligibility_conflicts_are_unknown(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("b", False), ("c", False), ("d", None)], "k string, v boolean")
    extra = spark.createDataFrame([("a",), ("c",), ("e",)], "k string")
    known = eligibility.eligibility(rows, "k", "v", extra)
    got = {r["k"]: (r["eligible"], r["source"]) for r in known.collect()}
    assert got == {"a": (True, "rows"), "b": (None, "ambiguous"), "c": (None, "ambiguous"), "d": (None, "ambiguous"), "e": (True, "extra")}
    cases = eligibility.with_eligibility(spark.createDataFrame([("a",), ("x",)], "k string"), known, "k")
    assert {r["k"]: (r["eligible"], r["eligibility_source"]) for r in cases.collect()} == {"a": (True, "rows"), "x": (None, "unlinked")}


def test_fixed_examples(spark):
    d = spark.createDataFrame([("train", "1", True, "t"), ("train", "2", False, "u"), ("test", "1", True, "v")], "split string, id string, wrong boolean, text string")
    assert eligibility.fixed_examples(d, "split", "train", ["1"], "id", "text").count() == 1
    with pytest.raises(eligibility.NotAllowed, match="2"):
        eligibility.fixed_examples(d, "split", "train", ["1", "2"], "id", "text")


@pytest.mark.parametrize(
    "text,fault",
    [
        ('{"extracted_answer": "4", "verdict": "correct", "reason": "r"}', ""),
        ('{"extracted_answer": null, "verdict": null, "reason": ""}', ""),
        ('{"extracted_answer": "none", "verdict": "incorrect", "reason": "no mode"}', ""),
        ('{"extracted_answer": "none", "verdict": null, "reason": "r"}', "a text for null"),
        ('{"extracted_answer": " NULL ", "verdict": "incorrect", "reason": "r"}', "a text for null"),
        ('{"extracted_answer": null, "verdict": "correct", "reason": "r"}', "a verdict without an answer"),
        ('{"extracted_answer": "4", "verdict": "right", "reason": "r"}', "another verdict"),
        ('{"extracted_answer": 4, "verdict": null, "reason": "r"}', "extracted_answer of another kind"),
        ('{"extracted_answer": "4", "verdict": null}', "other keys"),
        ('{"extracted_answer": "4", "verdict": null, "reason": "r", "more": 1}', "other keys"),
        ("[1]", "other keys"),
        ("nope", "not JSON"),
        (None, "not JSON"),
    ],
)
def test_answer_check(spark, text, fault):
    r = answers.answer_check(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r["fault"] == fault and (r["reason"] is None) == (fault != "")


def test_other_answers(spark):
    one = lambda f, text, *more: f(spark.createDataFrame([(text,)], "t string"), "t", *more).first()
    assert one(answers.winner, '{"winner": "tie"}')["winner"] == "tie" and one(answers.winner, '{"winner": "tie"}', False)["fault"] == "another winner"
    assert one(answers.extraction, '{"extracted_answer": "n/a", "reason": "r"}')["extracted_answer"] == "n/a" and one(answers.extraction, '{"extracted_answer": "", "reason": "r"}')["fault"] == "a text for null"
    letters = F.array(F.lit("A"), F.lit("B"))
    r = one(answers.match, '{"matched_option": " b ", "reason": "r"}', letters)
    assert (r["matched_option"], r["dropped"], r["fault"]) == ("B", None, "")
    r = one(answers.match, '{"matched_option": "C", "reason": "r"}', letters)
    assert (r["matched_option"], r["dropped"], r["fault"]) == (None, "C", "")
    assert one(answers.match, '{"matched_option": null, "reason": 3}', letters)["fault"] == "reason of another kind"


def test_options_and_classes(spark):
    d = spark.createDataFrame([([("B", "two"), ("A", "one")], "$ 1,0 $"), ([], None)], "o array<struct<option:string,text:string>>, a string")
    got = d.select(answers.options_text(F.col("o")).alias("o"), answers.matched_class(F.col("a"), {"target": F.array(F.lit("7")), "other": F.array(F.lit("1,0"), F.lit("7"))}).alias("c")).collect()
    assert [tuple(r) for r in got] == [("A: one\nB: two", "other"), ("", "unjudgeable")]


def test_stamp(spark):
    d = spark.sql("SELECT timestamp'2026-01-01 15:30:00' AS t").select(settings.stamp(F.col("t")).alias("s"))
    assert d.first()["s"] == "20260102_003000"


def test_key_checks(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert sorted(r["k"] for r in checks.key_mismatch(a, b, "k").collect()) == [1, 3]
    assert [r["k"] for r in checks.exactly(a.unionByName(b), "k", 2).where("count = 1").orderBy("k").collect()] == [1, 3]
    assert exports.row_identity(a) is not None and splits.ceil_split(a, "k", 0.5, 1).groupBy("split").count().count() == 2


def failed(table):
    return sorted(r["name"] for r in table.where("not passed").collect())


def test_half_expectations(spark):
    names = "anchor_sample_id long, donor_sample_id long, target string, split string, dataset string, question_group_id string, donor_question_group_id string, anchor_source_error_label string, donor_source_error_label string, question string, n_tokens int, half string"
    row = lambda a, b, half, t="aligned", **kw: tuple({"a": a, "b": b, "t": t, "split": "train", "d": "d", "g": f"g{a}", "dg": f"g{b}", "al": f"l{a}", "dl": f"l{b}", "q": f"q{a}", "n": 5, "h": half, **kw}.values())
    cases = spark.createDataFrame([(i, f"g{i}", "d", "A" if i < 3 else "B") for i in range(1, 5)], "sample_id long, question_group_id string, dataset string, half string")
    good = [row(i, i, "A" if i < 3 else "B") for i in range(1, 5)] + [row(1, 2, "A", "not_aligned"), row(2, 1, "A", "not_aligned"), row(3, 4, "B", "not_aligned"), row(4, 3, "B", "not_aligned")]
    pairs = spark.createDataFrame(good, names)
    out = checks.half_expectations(pairs, cases, pairs, 10)
    assert out.count() == 19 and failed(out) == []
    bad = spark.createDataFrame([row(1, 1, "A", q="changed"), *good[1:4], row(1, 3, "A", "not_aligned", dl="L1", dg="g1", split="dev", n=11), row(2, 1, "A", "not_aligned", d="other"), *good[6:7]], names)
    moved = cases.unionByName(spark.createDataFrame([(1, "g1", "d", "B"), (9, "g9", "d", "B")], cases.schema))
    got = failed(checks.half_expectations(pairs, moved, bad, 10))
    assert set(got) >= {"cut.whole", "cut.anchors", "cut.groups", "A.self.unchanged", "A.pair.train", "A.donor.half", "A.donor.group", "A.donor.dataset", "A.donor.label", "A.text.length", "B.anchor.targets"}


def test_typed_expectations(spark):
    types = spark.createDataFrame([("T1", "s1", False), ("T2", "s2", False), ("U", "s2", True)], "type_id string, stage string, unit_related boolean")
    groups = spark.createDataFrame([("g1", "train", "A", True, True, True), ("g2", "test", None, True, False, False)], "group_id string, split string, half string, has_sft boolean, forced_train boolean, forced_a boolean")
    cases = spark.createDataFrame([(1, "q", "s")], "sample_id long, question string, solution string")
    names = "pair_id string, region string, question_group_id string, target string, anchor_sample_id long, anchor_error_id string, target_error_id string, target_stage string, unit_conversion_eligible boolean, negative_dataset_relation string, negative_kind string, question string, solution string, n_tokens map<string,int>"
    pos = ("1::pos", "A", "g1", "aligned", 1, "T1", "T1", "s1", None, None, None, "q", "s", {"t": 3})
    neg = ("1::neg", "A", "g1", "not_aligned", 1, "T1", "U", "s2", True, "same_dataset", "different_stage", "q", "s", {"t": 3, "u": 9})
    cross = ("1::neg_cross", "A", "g1", "not_aligned", 1, "T1", "T2", "s2", None, "other_dataset", "different_stage", "q", "s", {"t": 3})
    run = lambda rows, g=groups, **kw: checks.typed_expectations(g, cases, spark.createDataFrame(rows, names), types, **kw)
    assert run([pos, neg]).count() == 13 and failed(run([pos, neg])) == []
    assert run([pos, neg, cross], second=True, longest=9).count() == 15 and failed(run([pos, neg, cross], second=True, longest=9)) == []
    wrong = [("1::pos", "A", "g1", "aligned", 1, "T1", "T2", "s1", None, None, None, "q", "other", {"t": 30}), ("1::neg", "B", "g1", "not_aligned", 1, "X", "X", "s9", None, "other_dataset", "same_stage", "q", "s", {}), ("1::neg", "B", "g1", "not_aligned", 1, "T1", "U", "s2", None, "same_dataset", "x", "q", "s", {})]
    assert failed(run(wrong, longest=9)) == sorted(["type.own", "type.other", "type.adopted", "type.stage", "type.unit", "text.own", "text.length", "draw.first", "anchor.targets", "group.region"])
    bad = spark.createDataFrame([("g1", "train", None, True, False, True), ("g2", "test", None, True, True, False), ("g3", "dev", None, False, False, False)], groups.schema)
    assert failed(run([pos, neg], bad)) == ["group.forced_a", "group.forced_train", "group.half", "group.split"]


def test_condition_expectations(spark):
    types = spark.createDataFrame([("T1", "s1", False), ("U", "s2", True)], "type_id string, stage string, unit_related boolean")
    groups = spark.createDataFrame([("g1", "A", True), ("g2", None, False), ("g3", None, False)], "group_id string, half string, has_sft boolean")
    names = "split string, question_group_id string, source_error_id string, stage string, unit_conversion_eligible boolean, listed string"
    good = [("train", "g1", "T1", "s1", None, "train"), ("test", "g2", "U", "s2", True, "test"), ("validation", "g3", "T1", "s1", None, "validation")]
    out = checks.condition_expectations(spark.createDataFrame(good, names), groups, types)
    assert out.count() == 6 and failed(out) == []
    bad = [("train", "g1", "T1", "s2", None, "test"), ("test", "g2", "U", "s2", None, "test"), ("validation", "g1", "T1", "s1", None, "validation")]
    assert len(failed(checks.condition_expectations(spark.createDataFrame(bad, names), groups, types))) == 6


def test_same_rows_and_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, m string")
    assert failed(checks.same_rows(a, a, "id", ["m"])) == [] and failed(checks.same_rows(a, a.where("id = 1"), "id", ["m"])) == ["same.content", "same.ids"]
    assert failed(checks.same_rows(a, a.withColumn("m", F.lit("x")), "id", ["m"])) == ["same.content"]
    b = spark.createDataFrame([(1, "z"), (3, "y")], "id long, m string")
    assert sorted(map(tuple, checks.table_difference(a, b, "id", ["m"]).collect()), key=str) == [(1, "m", "x", "z"), (2, "m", "y", None), (3, "m", None, "y")]


def test_fallback_is_logged(spark):
    d = spark.createDataFrame([(1, "ok", "A"), (2, "refused", None), (3, None, "B")], "id long, status string, winner string")
    out, log = llmio.with_fallback(d, "winner", "status", "tie")
    assert {r["id"]: r["winner"] for r in out.collect()} == {1: "A", 2: "tie", 3: "B"} and [tuple(r) for r in log.collect()] == [("winner", "tie", 1)]


def test_index_zip_and_aux(spark):
    a = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y")], "c string, k int, v string")
    assert [tuple(r) for r in stats.index_zip(a, a.where("k = 1"), "c", "k", "v").collect()] == [("c", 1, "y", "y")]
    rolls = spark.createDataFrame([("g", 0, "incorrect", True, "same text here"), ("g", 1, "incorrect", True, "same text here"), ("g", 2, "correct", True, "z")], "g string, k int, verdict string, accepted boolean, t string")
    out = rewards.with_aux(rolls, "g", "k", lambda d: rewards.bleu_diversity(d, "g", "k", "t").withColumnRenamed("diversity", "aux"))
    assert {r["k"]: r["aux"] for r in out.collect()} == {0: pytest.approx(0), 1: pytest.approx(0), 2: None} and set(rewards.REWARDS) == {"main", "distractor", "verifiable"}


def test_lines_of_a_file_in_splits(spark, tmp_path):
    """Rows are numbered alike in one split and in several, blank lines and carriage returns included."""
    rows = [{"x": i, "t": "é" * (i % 37)} for i in range(900)]
    text = "\n".join(("  \n" if i % 50 == 0 else "") + json.dumps(r, ensure_ascii=i % 2 == 0) + ("\r" if i % 3 == 0 else "") for i, r in enumerate(rows))
    (tmp_path / "d").mkdir()
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "d" / "b.jsonl").write_text('{"x": 5}\n')
    (tmp_path / "d" / "c.jsonl").write_text("\n \n")
    read = lambda: corpora.read_json_lines(spark, str(tmp_path), "struct<x:int,t:string>")
    known = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["record"]["x"], r["record"]["t"]) for r in read().collect())
    assert known == [("a.jsonl", i, r["x"], r["t"]) for i, r in enumerate(rows)] + [("b.jsonl", 0, 5, None)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text.encode()) // 3 + 1))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = files.numbered_lines(spark, str(tmp_path))
        blocks = spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
        assert blocks >= 3
        got = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["record"]["x"], r["record"]["t"]) for r in read().collect())
        assert got == known
        placed = files.positions(lines, ["c.jsonl", "b.jsonl", "a.jsonl"])
        assert sorted(r["position"] for r in placed.collect()) == list(range(901)) and placed.where("file like '%b.jsonl'").first()["position"] == 0
        with pytest.raises(Exception, match="no place for"):
            files.positions(lines, ["a.jsonl"]).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    with pytest.raises(Exception, match="not counted before"):  # dealt in other splits than those that were counted
        lines.collect()
