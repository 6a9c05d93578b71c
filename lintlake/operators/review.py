"""Pull requests: triage of files, summaries, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import suffix

# Parts of names by which files are sorted, in their order.
SAFE = (".md", ".txt", ".rst", "readme", "changelog", "license", "docs/", ".lock", "package-lock", ".gitignore", ".editorconfig")
RISKY = {
    "security": ("auth", "login", "password", "token", "secret", "crypt", "jwt", "oauth", "session"),
    "config": ("config", "env", ".yml", ".yaml", ".toml", "settings", "dockerfile", "docker-compose"),
    "database": ("migration", "schema", "model", "sql", "db"),
    "api": ("route", "endpoint", "controller", "handler", "middleware", "api"),
}
MANIFEST_NAMES = ("pyproject.toml", "package.json", "requirements.txt", "go.mod")


def _any_part(name: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(name, F.lit(p))
    return found


def pr_files(prs: DataFrame, *keys: str) -> DataFrame:
    """One row for each file of each row of pull requests, in its order; keys are further columns to keep."""
    return prs.select("pr_id", "repo", "number", *keys, F.posexplode("files").alias("ordinal", "f")).select("pr_id", "repo", "number", *keys, "ordinal", F.col("f.filename").alias("file"), "f.status", F.coalesce("f.additions", F.lit(0)).alias("additions"), F.coalesce("f.deletions", F.lit(0)).alias("deletions"), "f.patch")


def triage(files: DataFrame) -> DataFrame:
    """Whether a file is safe to skim or what it touches: safe names first, then the first risky category, then size."""
    name, size = F.lower("file"), F.col("additions") + F.col("deletions")
    category = F.when(_any_part(name, SAFE), "safe")
    for kind, parts in RISKY.items():
        category = category.when(_any_part(name, parts), kind)
    sorted_ = files.withColumn("category", category.when(size > 200, "large").otherwise("standard"))
    risky = F.col("category").isin(*RISKY)
    return sorted_.withColumn("severity", F.when(risky & (size > 100), "high").when(risky | (F.col("category") == "large"), "medium"))


def summary(files: DataFrame, keys: Sequence[str] = ("pr_id",)) -> DataFrame:
    """Totals, extensions, top folders, categories, impact and the five largest changes of each pull request."""
    ext = F.nullif(F.when(F.contains("file", F.lit(".")), F.element_at(F.split("file", r"\."), -1)), F.lit(""))
    folder = F.when(F.contains("file", F.lit("/")), F.substring_index("file", "/", 1))
    size = F.col("additions") + F.col("deletions")
    told = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.array_sort(F.collect_set(ext)).alias("extensions"),
        F.array_sort(F.collect_set(folder)).alias("folders"),
        F.max(F.contains(F.lower("file"), F.lit("test"))).alias("tests"),
        F.max(F.col("file").isin(*MANIFEST_NAMES)).alias("deps"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-size).alias("s"), F.col("ordinal").alias("o"), F.col("file").alias("f")))), lambda x: x["f"]), 1, 5).alias("key_changes"),
    )
    change = F.col("additions") + F.col("deletions")
    named = F.filter(F.array(F.when(F.arrays_overlap("extensions", F.array(*map(F.lit, ("md", "rst", "txt")))), "docs"), F.when(F.col("tests") | F.arrays_overlap("extensions", F.array(F.lit("test"), F.lit("spec"))), "test"), F.when(F.col("deps"), "deps")), lambda x: x.isNotNull())
    return told.withColumn("impact", F.when(change < 100, "low").when(change < 500, "medium").otherwise("high")).withColumn("categories", F.when(F.size(named) == 0, F.array(F.lit("feature"))).otherwise(named)).drop("tests", "deps")


def python_additions(added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added lines of Python files as one text for each file: (keys, file, content)."""
    kept = added.where(suffix(F.col("file")) == ".py")
    rows = kept.groupBy(*keys, "file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    return rows.select(*keys, "file", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("content"))
