"""Leaderboards, trends and activity from score entries (ts, author, metrics, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.functions.grades import developer_score, half_even_1
from lintlake.sources.tables import materialize


def once(entries: DataFrame, key: str = "seq") -> DataFrame:
    """Each entry once; a re-sent one has the same values."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.first(F.struct(*rest)).alias("e")).select(key, "e.*")


def author_totals(entries: DataFrame) -> DataFrame:
    """Totals of each author: a missing reviews counts 1, other missing keys 0; the average is over entries that have the key.

    Null and NaN values of a present key are ignored. Partial sums before the one shuffle on author."""
    value = lambda k: F.nanvl(F.try_element_at("metrics", F.lit(k)), F.lit(None))
    held = lambda k: F.map_contains_key("metrics", k)
    return entries.groupBy("author").agg(
        F.sum(F.when(held("reviews"), F.coalesce(value("reviews"), F.lit(0.0))).otherwise(1.0)).alias("reviews"),
        F.coalesce(F.avg(value("complexity_avg")), F.lit(0.0)).alias("avg_complexity"),
        *[F.coalesce(F.sum(value(k)), F.lit(0.0)).alias(k) for k in ("security_issues", "rule_violations", "fix_count")],
        F.count(F.lit(1)).alias("entries"),
        F.min("seq").alias("first_seq"),
    )


def leaderboard(entries: DataFrame) -> DataFrame:
    """Authors by composite score, ties in order of first appearance. Average and score are rounded to one decimal by
    their exact binary values; the score uses the rounded average."""
    totals = author_totals(entries).withColumn("avg_complexity", half_even_1(F.col("avg_complexity")))
    score = developer_score(F.col("reviews"), F.col("fix_count"), F.col("security_issues"), F.col("rule_violations"), F.col("avg_complexity"))
    return totals.withColumn("score", half_even_1(score))


def ranked(board: DataFrame, top: int | None = None) -> DataFrame:
    """Places on a board. A limited board is cut by a distributed top-k first, so the one-task window sees few rows;
    a whole board is sorted in ranges, which are numbered on their own and moved on by the sizes of those before."""
    order = [F.desc("score"), F.asc("first_seq")]
    if top is not None:
        return board.orderBy(*order).limit(top).withColumn("place", F.row_number().over(W.orderBy(*order)))
    parts = materialize(board.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "board")
    sizes = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))  # one row for each range
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = F.row_number().over(W.partitionBy("part_").orderBy(*order))
    return parts.withColumn("own_", own).join(before, "part_").withColumn("place", (F.col("own_") + F.col("before_")).cast("int")).drop("part_", "own_", "before_")


def trend(entries: DataFrame, metric: str, author: str | None = None) -> DataFrame:
    """Points of one metric in order of time, for one author or all; entries without the metric or with a null have none."""
    kept = entries if author is None else entries.where(F.col("author") == author)
    return kept.select("seq", "ts", "author", F.try_element_at("metrics", F.lit(metric)).alias("value")).where("value is not null").orderBy("ts", "seq")


def latest(entries: DataFrame) -> DataFrame:
    """The entry appended last."""
    return entries.agg(F.max_by(F.struct(*entries.columns), "seq").alias("e")).select("e.*")


def activity(entries: DataFrame) -> DataFrame:
    return entries.groupBy("author").agg(F.count(F.lit(1)).alias("entries"))


def last_entries(entries: DataFrame, n: int = 20) -> DataFrame:
    return entries.orderBy(F.desc("seq")).limit(n)
