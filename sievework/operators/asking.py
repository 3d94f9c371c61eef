"""Calls to a model within limits: calls in flight over the cluster, time, attempts; answers are logged as they come."""

from __future__ import annotations

import asyncio
import json
import uuid
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ask = Callable[[str | None], Awaitable[str | None]]
_LOG = "key string, ok boolean, answer string, error string, tries int, at double"


async def _call(ask: Ask, key: str, text: str | None, timeout: float, attempts: int, pause: float) -> dict:
    """One answer; the pause doubles from attempt to attempt.  What fails each time is an error, never an answer."""
    import time

    error = ""
    for tried in range(attempts):
        try:
            answer = await asyncio.wait_for(ask(text), timeout)
            return {"key": key, "ok": True, "answer": answer, "error": None, "tries": tried + 1, "at": time.time()}
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if tried + 1 < attempts:
            await asyncio.sleep(pause * 2**tried)
    return {"key": key, "ok": False, "answer": None, "error": error, "tries": attempts, "at": time.time()}


def answer_rows(rows: Iterator[tuple[str, str | None]], folder: str, ask: Ask, in_flight: int, timeout: float, attempts: int, pause: float) -> int:
    """A task's work: asks for its rows, in_flight at once, and logs these before it asks for the next.  What its folder
    holds from an attempt that died is not asked again.  Returns the number of rows asked."""
    from pyarrow import fs as arrow_fs

    fs, base = arrow_fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    logged = [f.path for f in fs.get_file_info(arrow_fs.FileSelector(base)) if f.path.endswith(".jsonl")]
    seen: set[str] = set()
    for path in logged:
        with fs.open_input_stream(path) as f:
            seen |= {json.loads(line)["key"] for line in f.read().decode().splitlines()}
    asked = 0

    def ask_all(some: list[tuple[str, str | None]]) -> None:
        async def gather():
            return await asyncio.gather(*[_call(ask, k, t, timeout, attempts, pause) for k, t in some])

        name = f"{base}/{uuid.uuid4().hex}"
        with fs.open_output_stream(name + ".tmp") as f:
            f.write("".join(json.dumps(a) + "\n" for a in asyncio.run(gather())).encode())
        fs.move(name + ".tmp", name + ".jsonl")

    some: list[tuple[str, str | None]] = []
    for key, text in rows:
        if key in seen:
            continue
        some.append((key, text))
        if len(some) == in_flight:
            ask_all(some)
            asked, some = asked + len(some), []
    if some:
        ask_all(some)
    return asked + len(some)


def answers_of(log: DataFrame) -> DataFrame:
    """(key, ok, answer, error, tries): what stands for each key, an answer before an error, then the newest."""
    newest = F.max(F.struct("ok", "at", "answer", "error", "tries")).alias("_a")
    return log.groupBy("key").agg(newest).select("key", "_a.ok", "_a.answer", "_a.error", "_a.tries")


def asked_within(requests: DataFrame, key: str, text: str, ask: Ask, log: str, callers: int, in_flight: int, timeout: float, attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """(key, ok, answer, error, tries) of each request, asked for now or in an earlier run with this log.

    `callers` tasks have at most `in_flight` calls each, so callers * in_flight is the bound over the cluster, if tasks are
    not speculated.  A call has `timeout` seconds and `attempts` tries.  Each task logs what was in flight before it goes on,
    below `log`, a folder that all executors reach: a task that dies, or a run that is begun again, asks for no logged
    answer again and for at most in_flight rows of a task twice.  Errors are logged but asked for again in the next run.
    Small files are the price: one for in_flight answers.

    Keys are texts; rows of one key are one request, with the least of their texts; rows without a key are an error.  A
    text of null is asked for as None.  An empty table asks for nothing.  Other columns don't matter."""
    spark = requests.sparkSession
    k = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit("a request without a key")).cast("string"))
    wanted = requests.select(k.alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.min("text").alias("text"))
    logged = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").schema(_LOG)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(log)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    open_ = wanted.join(logged.json(log).where("ok").select("key").distinct(), "key", "left_anti")
    run = f"{log.rstrip('/')}/run-{uuid.uuid4().hex}"

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = ((r.key, None if pd.isna(r.text) else r.text) for b in batches for r in b.itertuples(index=False))
        n = answer_rows(rows, f"{run}/{TaskContext.get().partitionId():05d}", ask, in_flight, timeout, attempts, pause)
        yield pd.DataFrame({"n": [n]})

    # rows are dealt by key, so that a task that runs again has the rows of its folder
    open_.repartition(callers, "key").mapInPandas(task, "n long").write.format("noop").mode("overwrite").save()
    return answers_of(logged.json(log).join(wanted.select("key"), "key", "left_semi"))
