"""Streams of editor events, model calls, cache entries and score entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def debounced(changes: DataFrame, *, key: str = "uri", ts: str = "ts", quiet: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """One row for each burst of changes of a key: a run starts when nothing more came for the quiet time.

    The same expression serves a batch; a stream emits a burst when the watermark has passed it."""
    events = changes.withWatermark(ts, late) if changes.isStreaming else changes
    return events.groupBy(F.col(key), F.session_window(ts, quiet).alias("burst")).agg(F.count(F.lit(1)).alias("changes"), F.max(ts).alias("last_change")).select(key, F.col("burst.start").alias("started"), F.col("burst.end").alias("runs_at"), "changes", "last_change")


def rate_windows(calls: DataFrame, *, ts: str = "ts", tokens: str = "tokens", length: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Requests and tokens in sliding windows. A batch is summed to bins of one slide first, so that not every row
    is copied into each of its windows; a stream has one aggregation, by its windows."""
    if not calls.isStreaming:
        bins = calls.groupBy(F.window(ts, slide).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("s"))
        return bins.groupBy(F.window("b.start", length, slide).alias("w")).agg(F.sum("n").alias("requests"), F.sum("s").alias("tokens")).select(F.col("w.start").alias("from"), F.col("w.end").alias("until"), "requests", "tokens")
    events = calls.withWatermark(ts, late)
    return events.groupBy(F.window(ts, length, slide).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")).select(F.col("w.start").alias("from"), F.col("w.end").alias("until"), "requests", "tokens")


def unexpired(entries: DataFrame, *, ts: str = "ts", ttl_seconds: int = 86_400, now=None) -> DataFrame:
    """Entries that are not older than their time to live."""
    return entries.where(F.unix_seconds(now if now is not None else F.current_timestamp()) - F.unix_seconds(ts) <= ttl_seconds)


def latest_per_key(results: DataFrame, *, key: str = "uri", ts: str = "ts") -> DataFrame:
    """The latest result of each key; a stream in update mode keeps it current."""
    return results.groupBy(key).agg(F.max_by(F.struct(*[c for c in results.columns if c != key]), ts).alias("r")).select(key, "r.*")


def live_leaderboard(entries: DataFrame) -> DataFrame:
    """Totals and score of each author as entries arrive; for update or complete mode."""
    from lintlake.operators.scoreboard import leaderboard

    return leaderboard(entries)


def arrivals(spark: SparkSession, folder: str, schema: StructType, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Analyse files of rows as they arrive in a folder; each batch is written once, under its number, so that
    a batch repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiring(entries: DataFrame, *, key: str = "key", ts: str = "ts", ttl_seconds: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Entries as a stream of (key, ts, state): `set` when one comes, `expired` when nothing newer came within its time to live.

    The state is one timestamp a key; it is dropped on expiry, so it follows the live keys only."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def follow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [name[0]], "ts": [pd.Timestamp(last, unit="ms")], "state": ["expired"]})
            return
        newest = max(int(b["ts"].max().timestamp() * 1000) for b in batches if len(b))
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        until = newest + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [name[0]], "ts": [pd.Timestamp(newest, unit="ms")], "state": ["set"]})

    events = entries.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", late)
    return events.groupBy("key").applyInPandasWithState(follow, "key string, ts timestamp, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(results: DataFrame, *, key: str = "uri", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once within the time for late data."""
    return results.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if results.isStreaming else results.dropDuplicates([key])
