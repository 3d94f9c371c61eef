"""Scans and sinks: JSON Lines, wrapped JSON arrays, CSV, pinned Parquet, positional union, byte-true JSON files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.textkeys import strip
from sievework.sources.work import stored


class BadInput(ValueError):
    """A source breaks its contract."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a line that isn't JSON of this schema fails the scan, with its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    checked = F.when(F.col("r._bad").isNotNull(), F.raise_error(F.concat(F.lit("not a JSON record: "), F.substring("value", 1, 200))).cast("boolean")).otherwise(F.lit(True))
    return parsed.where(checked).select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Writes JSON Lines; the number of rows written, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["n"]


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_json_array(spark: SparkSession, path: str, element: str, wrappers: tuple[str, ...] = ("data", "records", "items", "examples")) -> DataFrame:
    """Rows of files that are a JSON array, bare or under one of the wrapper keys: file, row (from 0), record.  Each
    file is one text, so rows keep their places."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.from_json("value", f"array<{element}>")
    wrapped = F.from_json("value", "struct<" + ",".join(f"{w}:array<{element}>" for w in wrappers) + ">")
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(*[wrapped[w] for w in wrappers]))
    return text.select("file", F.posexplode(rows).alias("row", "record"))


#: Up to so many splits their line counts are broadcast (a path and a few numbers each).
BROADCAST_SPLITS = 100_000
_SPLIT = ("file", "start", "length")


def _place_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split, which come one after the other in a task."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in _SPLIT:
            x = batch.column(c)
            new[1:] |= np.asarray(pc.not_equal(x[1:], x[:-1]))
        now = tuple(batch.column(c)[0].as_py() for c in _SPLIT)
        n = n if now == last else 0
        first = np.flatnonzero(np.concatenate(([True], new[1:])))
        size = np.diff(np.append(first, batch.num_rows))
        place = np.arange(batch.num_rows) - np.repeat(first, size)
        place[: size[0]] += n
        n, last = int(place[-1]) + 1, tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in _SPLIT)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _SPLIT], pa.array(place), batch.column("line")], names=[*_SPLIT, "place", "line"])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, row, line) of the lines that aren't blank of text files, below path too; row is a line's number in its
    file, from 0.

    Files are read in splits, however long they are.  A first pass counts the lines of each split, running sums of the
    counts are the splits' offsets, and a second pass numbers the lines within a split as they come.  Splits are named
    by place and length, so a second pass that was dealt other splits than the first fails instead of misnumbering."""
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")]
    lines = text.select(*at, F.regexp_replace("value", "\r$", "").alias("line")).where(F.trim("line") != "")
    counts = stored(lines.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n")), "splits")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*_SPLIT, F.coalesce(before, F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    placed = lines.mapInArrow(_place_in_split, "file string, start bigint, length bigint, place bigint, line string")
    known = F.when(F.col("before").isNull(), F.raise_error(F.concat(F.lit("not counted before: a split of "), "file")).cast("bigint")).otherwise(F.col("before"))
    return placed.join(offsets, list(_SPLIT), "left").select("file", (known + F.col("place")).alias("row"), "line")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `position` to (file, row, ...): files follow each other by their names (ends of paths) in the order given.
    All files are counted in one pass."""
    nth = F.coalesce(*[F.when(F.col("file").endswith(name), i) for i, name in enumerate(order)], F.raise_error(F.concat(F.lit("no place for "), "file")).cast("int"))
    sizes = rows.groupBy("file").agg((F.max("row") + 1).alias("_n"), F.min(nth).alias("_nth"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    bases = sizes.select(F.col("file").alias("_file"), F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(bases, F.col("file") == F.col("_file")).withColumn("position", F.col("row") + F.col("_base")).drop("_file", "_base")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """Header CSV whose key is unique, or the scan fails."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    if again := df.groupBy(*key).count().where("count > 1").limit(1).collect():
        raise BadInput(f"key occurs more than once: {again[0].asDict()}")
    return df


def write_review_csv(df: DataFrame, path: str) -> None:
    """For people: header, and a byte order mark before it; the review sheet is small and written as one file."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    named.coalesce(1).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def read_pinned(spark: SparkSession, path: str, rows: int, answer: str | None = None, mark: str = "####", sha256: set[str] | None = None) -> DataFrame:
    """Parquet with a known number of rows, and with sha256 the digests that its files must have; with answer, adds
    `reference`, what stands behind the last mark."""
    df = spark.read.parquet(path)
    if sha256 is not None and (got := {r["sha256"] for r in provenance(spark, path).where("file like '%.parquet'").collect()}) != sha256:
        raise BadInput(f"{path}: files with the digests {sorted(got)}")
    if (n := df.count()) != rows:
        raise BadInput(f"{path}: {n} rows, {rows} expected")
    if answer is None:
        return df
    if df.where(F.col(answer).isNull() | ~F.contains(F.col(answer), F.lit(mark))).limit(1).count():
        raise BadInput(f"{path}: an answer without {mark}")
    return df.withColumn("reference", strip(F.element_at(F.split(answer, mark), -1)))


def concat_positions(parts: list[DataFrame], row: str = "row") -> DataFrame:
    """Union of sources addressed by position: each part's rows follow the ones of the parts before it."""
    marked = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # all parts are counted in one job
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base")))  # a row a part
    return marked.join(bases, "_part").withColumn("position", F.col(row).cast("long") + F.col("_base")).drop("_part", "_base")


def from_fields(df: DataFrame, fields: Mapping[str, str], required: tuple[str, ...]) -> DataFrame:
    """Columns renamed by a user's map; what it lacks is reported with what there is."""
    missing = [k for k in required if k not in fields or fields[k] not in df.columns]
    if missing:
        raise BadInput(f"no source for {missing}; found {df.columns}")
    return df.select(*[F.col(src).alias(dst) for dst, src in fields.items()])


def string_list(c: Column) -> Column:
    """A JSON array of strings held in a string column; null if it isn't one."""
    return F.from_json(c, "array<string>")


def rewrite_json(path_in: str, path_out: str, change) -> None:
    """Change a JSON file on the driver and keep its indent, escapes and final newline."""
    raw = open(path_in, encoding="utf-8", newline="").read()  # noqa: SIM115
    body = raw.rstrip("\r\n")
    second = body.split("\n", 1)[1] if "\n" in body else ""
    indent = len(second) - len(second.lstrip(" ")) or None
    text = json.dumps(change(json.loads(body)), ensure_ascii=body.isascii(), indent=indent)
    with open(path_out, "w", encoding="utf-8", newline="") as f:
        f.write(text + raw[len(body) :])
