"""Prompts of the model operators, what their replies say, and what the calls cost. The model itself is injected (model_calls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import json_object, lines, token_estimate

# Lines of a patch by detail, and sizes in characters at which texts are cut.
PATCH_LINES = {"low": 30, "medium": 80, "high": 200}
BODY, SECURITY_DIFF, SUMMARY_DIFF, SUMMARY_FILES, COMMIT_DIFF, CODE, REVIEWED = 2_000, 30_000, 15_000, 30, 10_000, 10_000, 50_000
CUT = "\n\n... (truncated)"
LISTS = ("issues", "review", "comments", "findings")


def _cut(text: Column, most: int, mark: str = CUT) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def _body(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "(no description)").otherwise(F.left(text, F.lit(BODY)))


def _diff(files: Column) -> Column:
    """The patches of a pull request, each under its file's name; files without a patch are left out."""
    kept = F.filter(files, lambda f: F.coalesce(f["patch"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda f: F.concat(F.lit("--- "), f["filename"], F.lit(" ---\n"), f["patch"])), "\n\n")


def _counts(f: Column) -> Column:
    n = lambda c: F.coalesce(f[c], F.lit(0)).cast("string")
    return F.concat(F.lit("+"), n("additions"), F.lit(" -"), n("deletions"))


def review_prompt(prs: DataFrame, detail: str = "medium") -> DataFrame:
    """pr_id and prompt of a review: header, description, and the first lines of every patch; an unknown detail is medium."""
    most = PATCH_LINES.get(detail, PATCH_LINES["medium"])
    part = F.transform("files", lambda f: F.concat(F.lit("### "), f["filename"], F.lit(" ("), F.coalesce(f["status"], F.lit("")), F.lit(", "), _counts(f), F.lit(")\n"), F.array_join(F.slice(lines(F.coalesce(f["patch"], F.lit(""))), 1, most), "\n")))
    text = lambda c, usual="": F.coalesce(F.col(c).cast("string"), F.lit(usual))
    head = F.concat(
        F.lit("Pull request "), text("number"), F.lit(": "), text("title"), F.lit("\nAuthor: "), text("author"), F.lit("\nBranches: "), text("head_branch"), F.lit(" into "), text("base_branch"),
        F.lit("\nChanges: +"), text("additions", "0"), F.lit(" -"), text("deletions", "0"), F.lit(" in "), text("changed_files", "0"), F.lit(" files\nLabels: "), F.coalesce(F.nullif(F.array_join("labels", ", "), F.lit("")), F.lit("none")),
    )
    return prs.select("pr_id", F.concat(head, F.lit("\n\nDescription:\n"), text("body", "(no description)"), F.lit("\n\nFiles:\n"), F.array_join(part, "\n\n")).alias("prompt"))


def security_prompt(prs: DataFrame, findings: DataFrame) -> DataFrame:
    """pr_id and prompt of a deeper security review; findings: pr_id, severity, title, file of the scanner."""
    known = findings.groupBy("pr_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit(" in "), F.coalesce("file", F.lit("?"))))), "\n").alias("known"))
    told = prs.join(known, "pr_id", "left")
    return told.select("pr_id", F.concat(F.lit("Look for security faults that patterns miss. Already found:\n"), F.coalesce("known", F.lit("None")), F.lit("\n\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nDescription: "), _body(F.col("body")), F.lit("\n\nDiff:\n"), _cut(_diff(F.col("files")), SECURITY_DIFF)).alias("prompt"))


def summary_prompt(prs: DataFrame) -> DataFrame:
    """pr_id and prompt of a summary: 30 file names with their sizes, and 15,000 characters of the diff."""
    listed = F.array_join(F.transform(F.slice("files", 1, SUMMARY_FILES), lambda f: F.concat(F.lit("  "), f["filename"], F.lit(" ("), _counts(f), F.lit(")"))), "\n")
    return prs.select("pr_id", F.concat(F.lit("Summarise this change.\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nDescription: "), _body(F.col("body")), F.lit("\nFiles ("), F.size("files").cast("string"), F.lit("):\n"), listed, F.lit("\n\nDiff:\n"), _cut(_diff(F.col("files")), SUMMARY_DIFF)).alias("prompt"))


TASKS = {
    "review": "Review this code and list its issues as JSON with the key issues.",
    "bugs": "List the bugs of this code as JSON with the key bugs.",
    "refactor": "Suggest refactorings of this code as JSON with the key suggestions.",
    "explain": "Explain this code as JSON with the keys summary, components, patterns and notes.",
    "docs": "List what is wrong in the code blocks of this document as JSON with the key issues.",
    "onboard": "Describe this project to a newcomer as JSON with the keys overview, architecture, key_files, entry_points and getting_started.",
    "commit": "Write a commit message for this diff as JSON with the keys subject and body.",
    "fixes": "Suggest a fix for each of these issues as a JSON list with the keys issue_index, replacement and explanation.",
}


def task_prompt(rows: DataFrame, task: str, text: str, *keys: str, language: str | None = None) -> DataFrame:
    """The keys and the prompt of a task over a text; code to review is cut at 50,000 characters, other texts at 10,000."""
    most = REVIEWED if task in ("review", "fixes") else COMMIT_DIFF if task == "commit" else CODE
    lead = F.concat(F.lit(TASKS[task]), F.lit("\nLanguage: ") if language else F.lit(""), F.coalesce(language, F.lit("unknown")) if language else F.lit(""), F.lit("\n\n"))
    return rows.select(*keys, F.concat(lead, F.left(F.coalesce(text, F.lit("")), F.lit(most))).alias("prompt"))


def parsed(answers: DataFrame, schema: str, *, fallback: Column | None = None) -> DataFrame:
    """answers with `said`: the JSON object of the reply, in a code fence or not; what cannot be read is the fallback.
    With fields of structs only, so that a reply of another shape gives nulls and ends no job."""
    read = F.from_json(json_object(F.col("answer")), schema)
    return answers.withColumn("said", F.coalesce(read, fallback) if fallback is not None else read)


def listed(answers: DataFrame, item: str) -> DataFrame:
    """One row for each element of the first list that a reply holds, bare or under one of the known names, with its position."""
    reply = F.trim(F.regexp_replace("answer", r"^\s*```\w*\n|\n?```\s*$", ""))
    found = F.coalesce(F.from_json(F.when(F.startswith(reply, F.lit("[")), reply), f"array<{item}>"), *[F.from_json(json_object(F.col("answer")), f"{name} array<{item}>")[name] for name in LISTS])
    return answers.select(*[c for c in answers.columns if c != "answer"], F.posexplode(found).alias("position", "item"))


def fixed_issues(issues: DataFrame, fixes: DataFrame, *keys: str) -> DataFrame:
    """Issues with the fix that a model gave for them: an equi-join on the keys and the issue's index; other fixes drop out."""
    return issues.join(fixes.withColumnRenamed("issue_index", "index"), [*keys, "index"])


def usage(answers: DataFrame, *keys: str) -> DataFrame:
    """Prompt and completion tokens (estimated), requests and cached requests of answered prompts (prompt, answer, cached)."""
    prompt, answer = token_estimate(F.coalesce("prompt", F.lit(""))), F.when(F.col("answer").isNull(), 0).otherwise(token_estimate(F.col("answer")))
    asked = F.when(F.col("cached"), 0)
    return answers.groupBy(*keys).agg(
        F.sum(asked.otherwise(prompt)).cast("long").alias("prompt_tokens"), F.sum(asked.otherwise(answer)).cast("long").alias("completion_tokens"), F.sum(asked.otherwise(prompt + answer)).cast("long").alias("total_tokens"), F.count(F.lit(1)).alias("requests"), F.count_if("cached").alias("cached_requests")
    )
