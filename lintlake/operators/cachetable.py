"""An analysis cache as a table: hits, work lists, statistics, merging and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 7 * 86_400


def valid(version: str, now: Column, ttl_seconds: int = TTL_SECONDS) -> Column:
    return (F.col("version") == version) & (F.unix_seconds(now) - F.unix_seconds("ts") <= ttl_seconds)


def hits(files: DataFrame, cache: DataFrame, *, version: str, now: Column, config_hash: str | None = None, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Files (analyzer, filepath, file_hash) whose cached result is for the same content, version and config and not too old."""
    live = cache.where(valid(version, now, ttl_seconds))
    if config_hash is not None:
        live = live.where(F.col("config_hash") == config_hash)
    return files.join(live.drop("version", "config_hash"), ["analyzer", "filepath", "file_hash"])


def work_list(files: DataFrame, cache: DataFrame, **how) -> DataFrame:
    """Files without a hit: what has to be analysed."""
    return files.join(hits(files, cache, **how).select("analyzer", "filepath", "file_hash"), ["analyzer", "filepath", "file_hash"], "left_anti")


def stats(cache: DataFrame, *, version: str, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Entries of each analyzer: all, valid, expired, bytes."""
    return cache.groupBy("analyzer").agg(F.count(F.lit(1)).alias("entries"), F.count_if(valid(version, now, ttl_seconds)).alias("valid"), F.count_if(~valid(version, now, ttl_seconds)).alias("expired"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"))


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new results in place of old ones of the same analyzer and file."""
    return cache.join(fresh.select("analyzer", "filepath"), ["analyzer", "filepath"], "left_anti").unionByName(fresh)
