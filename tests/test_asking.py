"""Calls within limits: counted calls, time, attempts, and what a run that died has to ask again."""

import asyncio
import os
import time

import pytest

from sievework.operators import asking


def _caller(folder, kill=False):
    """An ask function that notes its calls in files, as its tasks are other processes."""

    async def ask(text):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{text}\t{time.time()}\t")
            f.write("\n")
        if kill and text == "t7" and not os.path.exists(f"{folder}/dead"):
            open(f"{folder}/dead", "w").close()
            await asyncio.sleep(0.2)
            os._exit(3)
        if text == "slow":
            await asyncio.sleep(5)
        if text == "bad":
            raise ValueError("no")
        await asyncio.sleep(0.01)
        return None if text is None else text.upper()

    return ask


def _calls(folder):
    with open(f"{folder}/calls") as f:
        return [line.split("\t")[0] for line in f]


def test_limits(spark, tmp_path):
    rows = [(str(i), f"t{i}", 1) for i in range(20)] * 2 + [("s", "slow", 1), ("b", "bad", 1), ("n", None, 1)]
    df = spark.createDataFrame(rows, "k string, t string, key int").withColumnRenamed("key", "answer")
    log = f"file://{tmp_path}/log"
    run = lambda d: {r["key"]: tuple(r)[1:] for r in asking.asked_within(d, "k", "t", _caller(tmp_path), log, 2, 4, 0.5, 2, 0.01).collect()}
    got = run(df)
    assert len(got) == 23 and got["3"] == (True, "T3", None, 1) and got["n"] == (True, None, None, 1)
    assert not got["s"][0] and got["s"][2].startswith("TimeoutError") and got["s"][3] == 2
    assert got["b"] == (False, None, "ValueError: no", 2)
    assert len(_calls(tmp_path)) == 21 + 2 + 2
    assert run(df) == got  # only what failed is asked again
    assert len(_calls(tmp_path)) == 25 + 4
    assert run(df.where("false")) == {}
    with pytest.raises(Exception, match="without a key"):
        asking.asked_within(spark.createDataFrame([(None, "x")], "k string, t string"), "k", "t", _caller(tmp_path), log, 2, 4, 1)


def test_a_run_that_died_goes_on(spark, tmp_path):
    df = spark.range(40).selectExpr("cast(id as string) k", "concat('t', id) t")
    log = f"file://{tmp_path}/log"
    with pytest.raises(Exception):  # noqa: B017
        asking.asked_within(df, "k", "t", _caller(tmp_path, kill=True), log, 2, 4, 5).count()
    first = _calls(tmp_path)
    kept = {r["key"] for r in spark.read.option("recursiveFileLookup", True).json(log).collect()} if any((tmp_path / "log").rglob("*.jsonl")) else set()
    assert asking.asked_within(df, "k", "t", _caller(tmp_path), log, 2, 4, 5).where("ok").count() == 40
    again = _calls(tmp_path)[len(first) :]
    assert not {t[1:] for t in again} & kept and len(again) == 40 - len(kept)


def test_a_task_that_runs_again(tmp_path):
    rows = [(str(i), f"t{i}") for i in range(10)]
    args = (f"file://{tmp_path}/part", _caller(tmp_path), 3, 5, 1, 0.0)
    assert asking.answer_rows(iter(rows[:6]), *args) == 6
    assert asking.answer_rows(iter(rows), *args) == 4
    assert len(_calls(tmp_path)) == 10
