"""A stream's cache of answers, over restarts."""

import pandas as pd
from pyspark.sql import functions as F

from sievework.operators import llmio
from sievework.streaming import cache


def test_requests_are_asked_once(spark, tmp_path):
    src, log, out, cp, calls = (str(tmp_path / n) for n in ("in", "log", "out", "cp", "calls"))
    for folder in (src, log, out, calls):
        (tmp_path / folder.rsplit("/", 1)[1]).mkdir()

    def scorer(texts: pd.Series) -> pd.Series:
        import os
        import uuid

        for t in texts:
            open(os.path.join(calls, f"{t}.{uuid.uuid4().hex}"), "w").close()
        bad = lambda t: t == "always bad" or t == "bad once" and len([x for x in os.listdir(calls) if x.startswith(t)]) < 2
        return texts.map(lambda t: None if bad(t) else t.upper())

    def asked(text):
        return len([x for x in (tmp_path / "calls").iterdir() if x.name.startswith(text)])

    def put(*rows):
        df = spark.createDataFrame([(i, t, temp) for i, t, temp in rows], "request_id string, text string, temperature double")
        key = llmio.request_key(text=F.col("text"), temperature=F.col("temperature"))
        df.select(key.alias("request_key"), "request_id", "text").coalesce(1).write.mode("append").parquet(src)

    def run(times=1):
        for _ in range(times):
            cache.serve(spark, src, log, out, cp, scorer, attempts=3).awaitTermination()
        rows = spark.read.schema(cache.OUT).option("recursiveFileLookup", True).parquet(out).collect()
        return sorted((r["request_id"], r["event"], r["answer"]) for r in rows)

    put(("1", "one", 0.0), ("2", "one", 0.0), ("3", "one", 0.5), ("4", "bad once", 0.0), ("5", "always bad", 0.0))
    assert run() == [] and (asked("one"), asked("bad once"), asked("always bad")) == (2, 1, 1)  # two settings, one call each
    put(("6", "one", 0.0))
    got = run()  # the late one waits or hits, as the answer comes in the same batch
    assert [(i, a) for i, _, a in got] == [("1", "ONE"), ("2", "ONE"), ("3", "ONE"), ("6", "ONE")] and asked("one") == 2
    got = run(2)  # further starts of the query go on from its state
    assert ("4", "answered", "BAD ONCE") in got and ("5", "failed", None) in got and asked("bad once") == 2 and asked("always bad") == 3
    put(("7", "one", 0.0), ("8", "bad once", 0.0), ("9", "always bad", 0.0))
    got = run()
    assert ("7", "hit", "ONE") in got and ("8", "hit", "BAD ONCE") in got and asked("one") == 2 and asked("bad once") == 2
    assert asked("always bad") == 4 and len(got) == 8  # a failure is not kept
