"""Scanning of source lines, added diff lines and file names by rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.arrays import sums_before
from lintlake.functions.grades import SEVERITIES, security_grade, security_score, severity_rank
from lintlake.functions.rules import FILE_RULES, SECRET_RULES, VULNERABILITY_RULES, Rule, any_of, hits, ignored, matches
from lintlake.functions.text import lines, strip

MAX_BYTES = 500_000


def code_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row a line: the other columns, line (from 1), text."""
    rest = [c for c in files.columns if c != content]
    return files.select(*rest, F.posexplode(lines(F.col(content))).alias("at", "text")).select(*rest, (F.col("at") + 1).alias("line"), "text")


def added_lines(patches: DataFrame, keys: Sequence[str], patch: str = "patch") -> DataFrame:
    """Added lines of unified diffs with their numbers in the new file.

    A hunk header that names a new start sets the counter before it; added lines and everything else
    but removed lines count (file headers and the no-newline mark too). A patch is cut before each such header, and
    lines are counted inside the row: nothing is shuffled, and only added lines become rows."""
    raw = F.split("hunk", "\n")
    is_added = lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))
    counts = F.transform(raw, lambda x: F.when(F.startswith(x, F.lit("@@")) | F.startswith(x, F.lit("-")), 0).otherwise(1))
    first = F.get(raw, F.lit(0))
    base = F.coalesce(F.when(F.startswith(first, F.lit("@@")), F.nullif(F.regexp_extract(first, r"\+(\d+)", 1), F.lit("")).cast("long")) - 1, F.lit(0))
    hunks = patches.where(f"{patch} is not null and {patch} != ''").select(*keys, F.explode(F.split(patch, r"\n(?=@@[^\n]*\+\d)")).alias("hunk"))
    told = hunks.select(*keys, base.alias("base"), F.zip_with(raw, sums_before(counts), lambda x, n: F.when(is_added(x), F.struct(n.alias("n"), F.substring(x, F.lit(2), F.length(x)).alias("text")))).alias("lines"))
    rows = told.select(*keys, "base", F.explode(F.filter("lines", lambda x: x.isNotNull())).alias("x"))
    return rows.select(*keys, (F.col("base") + F.col("x.n") + 1).cast("int").alias("line"), "x.text")


def rule_findings(rows: DataFrame, rules: Sequence[Rule] = (*SECRET_RULES, *VULNERABILITY_RULES)) -> DataFrame:
    """One finding for each line and rule; match is the whole line without its margins. Lines in which no rule is
    found drop out by one expression before the rules are tried one by one."""
    rest = [c for c in rows.columns if c != "text"]
    return rows.where(F.col("text").rlike(any_of(rules))).select(*rest, strip(F.col("text")).alias("match"), F.explode(hits(F.col("text"), rules)).alias("hit")).select(*rest, "hit.rule_id", "hit.severity", "match")


def pattern_findings(rows: DataFrame, rules: Sequence[Rule], path: str = "file") -> DataFrame:
    """One finding for each match of the custom pattern rules in scope of a line's file."""
    rest = [c for c in rows.columns if c != "text"]
    return rows.select(*rest, F.explode(matches(F.col("text"), rules, F.col(path))).alias("hit")).select(*rest, "hit.*")


def name_findings(files: DataFrame, path: str = "file", rules: Sequence[Rule] = FILE_RULES) -> DataFrame:
    """Findings on file names alone; they have no line and no match."""
    return files.select(*files.columns, F.explode(hits(F.col(path), rules)).alias("hit")).select(*files.columns, F.lit(None).cast("int").alias("line"), "hit.rule_id", "hit.severity", F.lit(None).cast("string").alias("match"))


def scan_files(files: DataFrame, keys: Sequence[str], *, ignore: Sequence[str] | None = None, rules: Sequence[Rule] = (*SECRET_RULES, *VULNERABILITY_RULES)) -> DataFrame:
    """Findings of whole files (keys, file, content): by name, and by line up to MAX_BYTES bytes."""
    seen = files.where(~ignored(F.col("file"), ignore))
    by_name = name_findings(seen.select(*keys, "file"))
    small = seen.where((F.octet_length("content") <= MAX_BYTES) & F.col("content").rlike(any_of(rules))).select(*keys, "file", "content")
    return by_name.unionByName(rule_findings(code_lines(small), rules))


def scan_patches(patches: DataFrame, keys: Sequence[str], *, ignore: Sequence[str] | None = None, rules: Sequence[Rule] = (*SECRET_RULES, *VULNERABILITY_RULES)) -> DataFrame:
    """Findings of diffs (keys, file, patch): by name, and by added line."""
    seen = patches.where(~ignored(F.col("file"), ignore))
    return name_findings(seen.select(*keys, "file")).unionByName(rule_findings(added_lines(seen, [*keys, "file"]), rules))


def severity_counts(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(*[F.count_if(F.lower("severity") == s).cast("int").alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("findings"))


def scan_scores(heads: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, score and grade for every head, those without findings (100, A) too."""
    counted = heads.join(severity_counts(findings, keys), list(keys), "left").fillna(0, [*SEVERITIES, "findings"])
    score = security_score({s: F.col(s) for s in SEVERITIES})
    return counted.withColumn("score", score).withColumn("grade", security_grade(F.col("score")))


def ordered(findings: DataFrame, *then: str) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), *then)
