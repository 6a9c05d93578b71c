"""Queries of the two general problems: top N within groups, rolling totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.rolling import parse_instant, rolling_totals, utc_day
from lintlake.operators.topn import clean_path, top_n_per_group
from lintlake.sources.tables import table

METRICS = ("reviews", "complexity_avg", "security_issues", "rule_violations", "docs_issues", "deps_vulns", "fix_count")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "fn_metrics").select("fn_id", "name", "file", "cyclomatic")
    best = top_n_per_group(functions, clean_path(F.col("file")), F.col("cyclomatic"), [F.col("name")], F.col("fn_id"), 3, group_name="path")
    return best.select(F.col("path").alias("file"), "fn_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same functions with all that was measured of them."""
    functions = table(spark, sf_dir, "fn_metrics").drop("scanned_at", "received_at")
    best = top_n_per_group(functions, clean_path(F.col("file")), F.col("cyclomatic"), [F.col("name")], F.col("fn_id"), 3, group_name="path")
    return best.drop("file").withColumnRenamed("path", "file")


def score_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the score table that have an author and a readable time, each seq once: author, day, seq, metrics."""
    author = F.lower(F.regexp_replace("author", r"(?U)^\s+|\s+$", ""))
    return table(spark, sf_dir, "score").select("seq", author.alias("author"), utc_day(parse_instant(F.col("ts"))).alias("day"), "metrics").where("author != '' and author != 'unknown' and day is not null")


def _rolled(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    entries = score_entries(spark, sf_dir)
    once = entries.select("author", "day", "seq", *[F.col("metrics")[k].alias(k) for k in keys]).groupBy("author", "day", "seq").agg(*[F.first(k).alias(k) for k in keys])
    return rolling_totals(once, "author", "day", keys)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = _rolled(spark, sf_dir, ("reviews",))
    return rolled.where("day_number >= 30 and reviews_total_7d * 2 > reviews_total_30d").select("author", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of every metric, to six decimals."""
    rolled = _rolled(spark, sf_dir, METRICS)
    return rolled.select("author", F.date_format("day", "yyyy-MM-dd").alias("day"), "day_number", "entries", *[F.round(c, 6).alias(c) for c, kind in rolled.dtypes if kind == "double"])


QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked, "p2_found": p2_found, "p2_rolling": p2_rolling}

_PATH = r"regexp_replace(replace(file, '\', '/'), '^(\./+)+', '')"

_P1 = f"""
WITH once AS (
  SELECT DISTINCT fn_id, {_PATH} AS file, name, line, end_line, length, cyclomatic, max_nesting, cognitive, params
  FROM fn_metrics WHERE file IS NOT NULL AND cyclomatic IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY cyclomatic DESC, encode(coalesce(name, '')), fn_id) AS rank FROM once)
"""

_P2 = r"""
WITH said AS (
  SELECT seq, metrics, lower(regexp_replace(author, '^\s+|\s+$', '', 'g')) AS author,
         regexp_replace(trim(ts), '^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)', '\1-\2-\3T\4:\5:\6') AS t
  FROM score WHERE regexp_matches(trim(ts), '^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d{8}T\d{6}|\d{4}-\d\d-\d\d$)')),
timed AS (
  SELECT seq, metrics, author,
         try_cast(CASE WHEN regexp_matches(t, ':.*(Z|[+-]\d\d:?\d\d)$') THEN t WHEN length(t) = 10 THEN t || 'T00:00:00Z' ELSE t || 'Z' END AS TIMESTAMPTZ) AS moment
  FROM said WHERE author NOT IN ('', 'unknown')),
entry AS (
  SELECT seq, any_value(author) AS author, any_value(CAST(floor(epoch_us(moment) / 86400000000) AS INTEGER)) AS d, any_value(metrics) AS metrics
  FROM timed WHERE moment IS NOT NULL GROUP BY seq),
daily AS (SELECT author, d, count(*) AS entries, {sums} FROM entry GROUP BY author, d),
span AS (SELECT author, min(d) AS first, max(d) AS last FROM daily GROUP BY author),
calendar AS (SELECT author, first, unnest(generate_series(first, last)) AS d FROM span),
filled AS (
  SELECT c.author, c.d, CAST(c.d - c.first + 1 AS INTEGER) AS day_number, CAST(coalesce(y.entries, 0) AS BIGINT) AS entries, {fills}
  FROM calendar c LEFT JOIN daily y ON y.author = c.author AND y.d = c.d),
rolled AS (
  SELECT author, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, day_number, entries, {windows} FROM filled
  WINDOW w7 AS (PARTITION BY author ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY author ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""


def _p2(keys: tuple[str, ...]) -> str:
    return (
        _P2.replace("{sums}", ", ".join(f"sum(coalesce(CASE WHEN isnan(metrics['{k}']) THEN 0 ELSE metrics['{k}'] END, 0)) AS {k}" for k in keys))
        .replace("{fills}", ", ".join(f"coalesce(y.{k}, 0.0) AS {k}" for k in keys))
        .replace("{windows}", ", ".join(f"sum({k}) OVER w{p} AS {k}_total_{p}d, sum({k}) OVER w{p} / {p} AS {k}_avg_{p}d" for k in keys for p in (7, 30)))
    )


SQL = {
    "p1_found": _P1 + "SELECT file, fn_id FROM ranked WHERE rank <= 3",
    "p1_ranked": _P1 + "SELECT file, rank, fn_id, name, line, end_line, length, cyclomatic, max_nesting, cognitive, params FROM ranked WHERE rank <= 3",
    "p2_rolling": _p2(METRICS) + "SELECT author, day, day_number, entries, " + ", ".join(f"round({k}_{what}_{p}d, 6) AS {k}_{what}_{p}d" for k in METRICS for p in (7, 30) for what in ("total", "avg")) + " FROM rolled",
    "p2_found": _p2(("reviews",)) + "SELECT author, day FROM rolled WHERE day_number >= 30 AND reviews_total_7d * 2 > reviews_total_30d",
}
