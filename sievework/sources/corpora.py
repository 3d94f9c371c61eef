"""Corpora as canonical records.

A corpus is declared by where its question, solution and label stand, and by the rules that make a row ineligible.  No
row is dropped: an ineligible one keeps its reason.  Raw rows come as (file, row, record), which files.read_json_array
and read_json_lines give, so a record is named by its file and place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import textkeys as tk
from sievework.operators.curation import first_reason, missing_reason
from sievework.sources.files import BadInput, from_fields, numbered_lines

#: Labels that name no error, and those that two corpora know (fixed values).
NO_ERROR = ["none of the above", "none", "no error"]
MATHCLEAN_LABELS = ["logic error", "computing error", "expression error"]
EIC_TYPES = [
    "adding_irrelevant_information",
    "calculation_error",
    "confusing_formula_error",
    "counting_error",
    "missing_step",
    "operator_error",
    "referencing_context_value_error",
    "referencing_previous_step_value_error",
    "unit_conversion_error",
]
EIC_BENCHMARKS = ["GSM8K", "MathQA"]


def steps_text(c: Column) -> Column:
    """A JSON array of steps as lines; a text that isn't one as it is."""
    steps = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(F.array_join(steps, "\n"), c)


Rules = list[tuple[Column, Column | str]]


@dataclass(frozen=True)
class Corpus:
    """Expressions over raw rows.  rules come after missing fields, before is what comes first."""

    name: str
    record: str  # the record's type
    question: Callable[[], Column]
    solution: Callable[[], Column]
    label: Callable[[], Column]
    rules: Callable[[], Rules] = lambda: []
    before: Callable[[], Rules] = lambda: []
    annotations: Callable[[], dict[str, Column]] = field(default=dict)


def _r(name: str) -> Column:
    return F.col(f"record.{name}")


def _folder(at: int) -> Column:
    """A part of the file's path, counted from its end."""
    return F.element_at(F.split("file", "/"), -at)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _key(c: Column) -> Column:
    return F.lower(tk.strip(_text(c)))


def _errors() -> Column:
    return F.coalesce(_r("teacher_review.error"), F.array().cast("array<struct<error_type:string,error_equation:string,teacher_advice_en:string,teacher_advice_ch:string>>"))


STEPWISE = Corpus(
    "stepwise",
    "struct<problem:string,student_incorrect_solution:string,error_category:string,incorrect_index:int,incorrect_step:string,topic:string>",
    lambda: _r("problem"),
    lambda: steps_text(_r("student_incorrect_solution")),
    lambda: _r("error_category"),
    lambda: [(_key(_r("error_category")).isin(NO_ERROR), "non_error_label")],
    annotations=lambda: {"incorrect_index": _r("incorrect_index"), "incorrect_step": _r("incorrect_step"), "steps": _r("student_incorrect_solution"), "topic": _r("topic")},
)
MATHCLEAN = Corpus(
    "mathclean",
    "struct<question:string,answer:string,type:string,extent:string>",
    lambda: _r("question"),
    lambda: _r("answer"),  # the answer under evaluation
    lambda: _r("type"),
    lambda: [(~_key(_r("type")).isin(MATHCLEAN_LABELS), F.concat(F.lit("label_outside_error_types:"), _text(_r("type"))))],
    annotations=lambda: {"extent": _r("extent"), "difficulty_file": F.regexp_replace(_folder(1), r"\.[^.]*$", ""), "subset": _folder(2)},
)
EIC = Corpus(
    "eic",
    "struct<question:string,transformed_solution:string,wrong_type:string,is_single_error:boolean,wrong_step:string,explanation:string>",
    lambda: _r("question"),
    lambda: _r("transformed_solution"),
    lambda: _r("wrong_type"),
    lambda: [
        (~F.col("type_dir").isin(EIC_TYPES), F.concat(F.lit("non_error_type_directory:"), F.col("type_dir"))),
        (~tk.strip(_text(_r("wrong_type"))).isin(EIC_TYPES), F.concat(F.lit("label_outside_canonical_set:"), _text(_r("wrong_type")))),
        (~F.coalesce(_r("is_single_error"), F.lit(False)), "is_single_error_not_true"),
    ],
    annotations=lambda: {"type_dir": F.col("type_dir"), "source_benchmark": F.col("benchmark"), "wrong_step": _r("wrong_step"), "explanation": _r("explanation"), "is_single_error": _r("is_single_error")},
)
#: Its question stands in another corpus, at the position that `id` names: see with_questions.
MATHEDU = Corpus(
    "mathedu",
    "struct<id:bigint,student_id:string,student_process:string,correct_or_not:string,teacher_review:struct<error_counts:int,error:array<struct<error_type:string,error_equation:string,teacher_advice_en:string,teacher_advice_ch:string>>>>",
    lambda: F.col("asked"),
    lambda: _r("student_process"),
    lambda: F.when(F.size(_errors()) == 1, tk.strip(_text(F.get(_errors(), F.lit(0))["error_type"]))),
    before=lambda: [
        (_key(_r("correct_or_not")) != "wrong", F.concat(F.lit("not_an_incorrect_answer:"), F.coalesce(_r("correct_or_not"), F.lit("None")))),
        (F.size(_errors()) == 0, "no_teacher_annotated_error"),
        (F.size(_errors()) > 1, F.concat(F.lit("multiple_annotated_errors:"), F.size(_errors()).cast("string"))),
        (tk.blank(F.col("asked")), "mathqa_question_not_found"),
    ],
    annotations=lambda: {"mathedu_id": _r("id"), "student_id": _r("student_id"), "error_counts": _r("teacher_review.error_counts"), "teacher_review_errors": _r("teacher_review.error")},
)


def canonical(rows: DataFrame, corpus: Corpus, revision: str = "") -> DataFrame:
    """Canonical records, one a row: an empty text is a missing field, and the first reason that holds is kept."""
    question, solution, label = (_text(f()) for f in (corpus.question, corpus.solution, corpus.label))
    named = rows.select("*", question.alias("question"), solution.alias("incorrect_solution"), label.alias("source_error_label"))
    missing = missing_reason({c: F.col(c) for c in ("question", "incorrect_solution", "source_error_label")})
    reason = first_reason([*corpus.before(), (missing != "", missing), *corpus.rules()])
    notes = corpus.annotations()
    return named.select(
        tk.sample_id(F.lit(corpus.name), F.col("question"), F.col("incorrect_solution"), F.col("source_error_label")).alias("sample_id"),
        F.lit(corpus.name).alias("dataset"),
        F.concat("file", F.lit("#"), F.col("row").cast("string")).alias("source_id"),
        F.col("file").alias("source_file"),
        F.lit(revision).alias("source_revision"),
        "question",
        "incorrect_solution",
        "source_error_label",
        (F.to_json(F.struct(*[c.alias(n) for n, c in notes.items()])) if notes else F.lit("{}")).alias("annotations"),
        F.when(tk.blank(F.col("question")), F.lit("")).otherwise(tk.question_key(tk.nfkc("question"))).alias("question_group_id"),
        tk.strip(F.col("source_error_label")).alias("stratum"),
        (reason == "").alias("eligible"),
        reason.alias("exclusion_reason"),
    )


def eic_rows(rows: DataFrame, benchmarks: list[str]) -> DataFrame:
    """Rows of the benchmarks' folders, with the folder of the error type."""
    if wrong := sorted(set(benchmarks) - set(EIC_BENCHMARKS)):
        raise BadInput(f"unknown benchmarks {wrong}")
    found = F.regexp_extract("file", r"generated_cases_([^/]+)/([^/]+)/", 1)
    typed = rows.withColumns({"benchmark": found, "type_dir": F.regexp_extract("file", r"generated_cases_([^/]+)/([^/]+)/", 2)})
    return typed.where(F.col("benchmark").isin(benchmarks))


def with_questions(rows: DataFrame, questions: DataFrame, at: Column, text: str, position: str = "position") -> DataFrame:
    """Adds `asked`, the question at a position of another corpus (files.concat_positions); null where there is none."""
    known = questions.select(F.col(position).alias("_at"), F.col(text).alias("asked"))
    return rows.join(known, at == F.col("_at"), "left").drop("_at")


def from_map(rows: DataFrame, fields: Mapping[str, str], name: str, revision: str = "") -> DataFrame:
    """Records of a user's own files: fields says which key of a record is question, incorrect_solution and
    source_error_label."""
    flat = rows.select("file", "row", "record.*")
    picked = from_fields(flat, {**fields, "file": "file", "row": "row"}, ("question", "incorrect_solution", "source_error_label"))
    corpus = Corpus(name, "", lambda: F.col("_q"), lambda: F.col("_s"), lambda: F.col("_l"))
    return canonical(picked.select("file", "row", *[F.col(c).cast("string").alias(a) for c, a in (("question", "_q"), ("incorrect_solution", "_s"), ("source_error_label", "_l"))]), corpus, revision)


CORPORA = {c.name: c for c in (STEPWISE, MATHCLEAN, EIC, MATHEDU)}


def pool_of(parts: Mapping[str, DataFrame], revision: str = "") -> DataFrame:
    """All corpora's records; parts are raw rows by corpus.  An unknown corpus is an error."""
    if unknown := sorted(set(parts) - set(CORPORA)):
        raise BadInput(f"unknown corpora {unknown}")
    out = None
    for name, rows in parts.items():
        records = canonical(rows, CORPORA[name], revision)
        out = records if out is None else out.unionByName(records)
    if out is None:
        raise BadInput("no corpus")
    return out


def read_json_lines(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(file, row, record) of JSON Lines files, below path too, read in splits.  Row numbers count a file's lines that
    aren't blank.  A line that isn't JSON fails the scan."""
    record = F.from_json("line", T.StructType.fromDDL(f"r {element}")["r"].dataType, {"mode": "FAILFAST"})
    return numbered_lines(spark, path).select("file", "row", record.alias("record"))
