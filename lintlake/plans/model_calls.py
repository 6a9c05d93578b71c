"""Calls of a language model inside a plan: injected, off by default, cached, retried and bounded."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import response_key


class Limited(Exception):
    """The model asks to wait."""

    def __init__(self, seconds: float | None = None):
        super().__init__("limited")
        self.seconds = seconds


def with_retries(call: Callable[[str], str], *, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """A waiting time the model names is kept, other failures wait 1, 2, 4 ... seconds."""

    def run(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt)
            except Limited as wait:
                if attempt == retries:
                    raise
                sleep(2.0**attempt if wait.seconds is None else wait.seconds)
            except Exception:
                if attempt == retries:
                    raise
                sleep(2.0**attempt)
        raise AssertionError

    return run


class Window60:
    """At most so many requests and tokens in 60 seconds; a request beyond the whole budget goes alone instead of waiting forever."""

    def __init__(self, requests: int = 60, tokens: int = 100_000, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.requests, self.tokens, self.clock, self.sleep = requests, tokens, clock, sleep
        self.log: list[tuple[float, int]] = []
        self.lock = threading.Lock()

    def acquire(self, tokens: int) -> None:
        with self.lock:
            while True:
                now = self.clock()
                self.log = [(t, n) for t, n in self.log if now - t < 60]
                if not self.log or (len(self.log) < self.requests and sum(n for _, n in self.log) + tokens <= self.tokens):
                    self.log.append((now, tokens))
                    return
                self.sleep(max(0.01, 60 - (now - self.log[0][0])))


def answered(prompts: DataFrame, model: str, call: Callable[[str], str] | None, cache: DataFrame | None = None, *, retries: int = 3, requests: int = 60, tokens: int = 100_000, at_once: int = 3) -> DataFrame:
    """prompts (with a column prompt) with answer and error. Answers in the cache (key, answer) are taken from
    there; without a model the others stay null. With one, only they are brought into at_once tasks, each of which
    asks one by one within its share of the rate, so that the whole job stays within it. Errors are
    rows, and are not for the cache. `cached` tells which answers were known."""
    keyed = prompts.withColumn("key", response_key(F.lit(model), F.col("prompt")))
    if cache is not None:
        keyed = keyed.join(cache.select("key", F.col("answer").alias("known")), "key", "left")
    else:
        keyed = keyed.withColumn("known", F.lit(None).cast("string"))
    if call is None:
        return keyed.withColumn("answer", F.col("known")).withColumn("error", F.lit(None).cast("string")).withColumn("cached", F.col("known").isNotNull()).drop("known")
    asked = keyed.columns
    at_once = max(1, min(at_once, requests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, window = with_retries(call, retries=retries), Window60(max(1, requests // at_once), max(1, tokens // at_once))
        for batch in batches:
            answers, errors = [], []
            for prompt, known in zip(batch.column(asked.index("prompt")).to_pylist(), batch.column(asked.index("known")).to_pylist()):
                answer, error = known, None
                if known is None:
                    try:
                        window.acquire(max(1, len(prompt or "") // 4))
                        answer = ask(prompt)
                    except Exception as wrong:
                        error = f"{type(wrong).__name__}: {wrong}"[:500]
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*asked, "answer", "error"])

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*keyed.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    fresh = keyed.where("known is null").repartition(at_once).mapInArrow(run, schema).withColumn("cached", F.lit(False))
    known = keyed.where("known is not null").withColumns({"answer": F.col("known"), "error": F.lit(None).cast("string"), "cached": F.lit(True)})
    return known.unionByName(fresh).drop("known")
