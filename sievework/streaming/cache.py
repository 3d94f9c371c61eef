"""Answers of a model as keyed state of a stream: asked once, kept, and asked again where the model failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "kind string, request_key string, request_id string, text string, answer string, ok boolean"
OUT = "request_key string, request_id string, event string, text string, answer string"


class Responses(StatefulProcessor):
    """One key is one request: its text with all settings.

    A request whose answer is known is a `hit`.  The first one of an unknown answer is an `ask`, for whoever calls the
    model; while that is in flight further ones only wait.  An answer is kept and given to all that wait (`answered`).
    A failed call, and one without an answer for `patience_ms`, is an `ask` again, up to `attempts` times; then those that
    wait have `failed`, and nothing is kept, so a later request starts anew."""

    def __init__(self, attempts: int = 3, patience_ms: int = 600_000):
        self.attempts, self.patience_ms = attempts, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", "answer string")
        self.flight = handle.getValueState("flight", "text string, attempt int, until bigint")
        self.waiting = handle.getListState("waiting", "request_id string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in rows:
            if r.kind == "answer":
                yield from self._answered(key[0], r, now)
            elif self.answer.exists():
                yield Row(request_key=key[0], request_id=r.request_id, event="hit", text=None, answer=self.answer.get()[0])
            else:
                self.waiting.appendValue((r.request_id,))
                if not self.flight.exists():
                    yield self._ask(key[0], r.text, 1, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.flight.exists() and self.flight.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._again(key[0], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    def _ask(self, key: str, text: str, attempt: int, now: int) -> Row:
        self.flight.update((text, attempt, now + self.patience_ms))
        self.handle.registerTimer(now + self.patience_ms)
        return Row(request_key=key, request_id=None, event="ask", text=text, answer=None)

    def _answered(self, key: str, r: Row, now: int) -> Iterator[Row]:
        if r.ok:
            if not self.answer.exists():  # the first answer stands
                self.answer.update((r.answer,))
            yield from self._to_all(key, "answered", self.answer.get()[0])
        elif self.flight.exists():
            yield from self._again(key, now)

    def _again(self, key: str, now: int) -> Iterator[Row]:
        text, attempt, _ = self.flight.get()
        if attempt < self.attempts:
            yield self._ask(key, text, attempt + 1, now)
        else:
            yield from self._to_all(key, "failed", None)

    def _to_all(self, key: str, event: str, answer: str | None) -> Iterator[Row]:
        for (request_id,) in self.waiting.get() if self.waiting.exists() else ():
            yield Row(request_key=key, request_id=request_id, event=event, text=None, answer=answer)
        self.waiting.clear()
        self.flight.clear()


def responses(events: DataFrame, attempts: int = 3, patience_ms: int = 600_000) -> DataFrame:
    """What becomes of a stream of EVENTS: requests (kind `request`, with the text) and what the model said to them
    (kind `answer`, by key).  The session's state store must be RocksDB."""
    return events.groupBy("request_key").transformWithState(Responses(attempts, patience_ms), OUT, "Append", "ProcessingTime")


def serve(spark: SparkSession, requests: str, log: str, out: str, checkpoint: str, scorer: Callable[[pd.Series], pd.Series], attempts: int = 3, patience_ms: int = 600_000):
    """Starts one batch over the requests that lie as Parquet below a path (request_key, request_id, text; the key from
    llmio.request_key, so that other settings are another key) and over what the model said since the last one.  One
    batch a start, since a query with timers never runs out of batches.

    scorer gives an answer for each text, null where the call failed.  Answers go to a log before they are used, in a
    folder for each batch of calls; a batch that is run again finds its folder and doesn't ask a second time.  The log is
    part of the input of the next batches; the results lie below out, a folder for each batch too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    lit = lambda v, kind: F.lit(v).cast(kind)
    asked = spark.readStream.schema("request_key string, request_id string, text string").parquet(requests)
    said = spark.readStream.schema("request_key string, answer string").option("recursiveFileLookup", True).parquet(log)
    events = asked.select(F.lit("request").alias("kind"), "request_key", "request_id", "text", lit(None, "string").alias("answer"), lit(None, "boolean").alias("ok")).unionByName(
        said.select(F.lit("answer").alias("kind"), "request_key", lit(None, "string").alias("request_id"), lit(None, "string").alias("text"), "answer", F.col("answer").isNotNull().alias("ok"))
    )

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"request_key": b["request_key"], "answer": scorer(b["text"]).astype(object).where(lambda x: x.notna(), None)})

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.persist()
        batch.where("event <> 'ask'").drop("text").write.mode("overwrite").parquet(f"{out}/batch={number}")
        done = session._jvm.org.apache.hadoop.fs.Path(f"{log}/batch={number}/_SUCCESS")
        if not done.getFileSystem(session._jsc.hadoopConfiguration()).exists(done):
            calls = batch.where("event = 'ask'").select("request_key", "text")
            calls.mapInPandas(call, "request_key string, answer string").write.mode("overwrite").parquet(f"{log}/batch={number}")
        batch.unpersist()

    stream = responses(events, attempts, patience_ms)
    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(once=True).start()
