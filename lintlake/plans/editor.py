"""Projections for editors, verdicts and first guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes an editor analyses, levels of severities, words that give a tag, file names that start a
# project, steps by manifest in their order, words of a verdict.
ANALYSED = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".rb")
LEVELS = {"critical": 1, "high": 2, "medium": 3, "low": 4, "info": 4}
TAGS = {"deprecated": "deprecated", "unused": "unnecessary"}
ENTRY_POINTS = ("main.py", "app.py", "server.py", "index.ts", "index.js", "main.go", "main.rs")
STEPS = (("requirements.txt", "pip install -r requirements.txt"), ("pyproject.toml", "pip install -e ."), ("package.json", "npm install"), ("go.mod", "go mod download"))
NO_ENTRY_POINT = "See README for entry points"


def analysed(uri: Column) -> Column:
    """Whether an editor's server analyses an address: a local file with one of the suffixes, as they are written."""
    return F.startswith(uri, F.lit("file://")) & uri.rlike("(?:" + "|".join("\\" + s for s in ANALYSED) + ")$")


def diagnostics(findings: DataFrame, category: str) -> DataFrame:
    """Findings as an editor shows them: places from 0, severities 1 (error) to 4 (hint; unknown ones 3), a code, tags
    by words of the message or the rule. first_column, end_line and end_column are optional columns of the findings."""
    given = lambda c, usual: F.coalesce(F.col(c), usual) if c in findings.columns else usual
    line = F.greatest(F.coalesce(F.col("line"), F.lit(1)) - 1, F.lit(0)).cast("int")
    first = F.greatest(given("first_column", F.lit(0)), F.lit(0)).cast("int")
    level = F.lit(3)
    for name, n in LEVELS.items():
        level = F.when(F.lower("severity") == name, n).otherwise(level)
    message, rule = given("message", F.lit("Issue detected")), F.coalesce("rule_id", F.lit(f"{category}-issue"))
    tagged = [F.when(F.contains(F.lower(message), F.lit(word)) | F.contains(F.lower(rule), F.lit(word)), tag) for word, tag in TAGS.items()]
    rest = [c for c in findings.columns if c not in ("line", "severity", "message", "first_column", "end_line", "end_column")]
    return findings.select(
        *rest,
        line.alias("line"),
        F.greatest(line, given("end_line", line + 1) - 1).cast("int").alias("end_line"),
        first.alias("first_column"),
        given("end_column", first + 1).cast("int").alias("end_column"),
        level.alias("level"),
        F.concat(F.lit(f"lintlake/{category}/"), rule).alias("code"),
        message.alias("message"),
        F.filter(F.array(*tagged), lambda x: x.isNotNull()).alias("tags"),
    )


def verdict_mark(verdict: Column) -> Column:
    """pass, warn or other, by what a review's verdict says."""
    said = lambda *words: F.lower(verdict).rlike("|".join(words))
    return F.when(said("ready", "merge"), "pass").when(said("needs changes", "needs discussion"), "warn").otherwise("other")


def score_colour(score: Column) -> Column:
    return F.when(score >= 90, "green").when(score >= 60, "yellow").otherwise("red")


def guide(snapshots: DataFrame) -> DataFrame:
    """Entry points (of the root folder), the first six files, the setup step of the first manifest and the first two
    languages of each snapshot (files, manifests and languages are arrays); file names are in alphabetical order."""
    none = F.array().cast("array<string>")
    files, manifests = F.array_sort(F.coalesce("files", none)), F.coalesce("manifests", none)
    starts = F.filter(files, lambda f: f.isin(*ENTRY_POINTS))
    step = F
    for manifest, command in STEPS:
        step = step.when(F.array_contains(manifests, manifest), command)
    rest = [c for c in snapshots.columns if c not in ("files", "manifests", "languages")]
    return snapshots.select(
        *rest,
        F.when(F.size(starts) > 0, starts).otherwise(F.array(F.lit(NO_ENTRY_POINT))).alias("entry_points"),
        F.slice(files, 1, 6).alias("key_files"),
        step.alias("setup"),
        F.coalesce(F.nullif(F.array_join(F.slice(F.coalesce("languages", none), 1, 2), ", "), F.lit("")), F.lit("unknown")).alias("stack"),
    )
