"""Suggested fixes and the context of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.grades import severity_rank
from lintlake.functions.rules import SECRET_RULES, VULNERABILITY_RULES, any_of, hits, ignored
from lintlake.functions.text import lines
from lintlake.operators.scan import MAX_BYTES

# Which rules have a fix. The identifiers SEC005, SEC007, SEC010, VLN007 and VLN010 mean other
# rules here than in the scanner's catalogue (fixed values; `drifted` marks them).
FIXES = {
    "SEC001": ("read the key from the environment", False),
    "SEC002": ("read the secret from the environment", False),
    "SEC003": ("read the token from the environment", False),
    "SEC005": ("read the payment key from the environment", True),
    "SEC007": ("move the private key to a vault", True),
    "SEC009": ("read the password from the environment", False),
    "SEC010": ("read the database address from the environment", True),
    "VLN001": ("bind parameters instead of formatting SQL", False),
    "VLN002": ("pass a list of arguments instead of a shell text", False),
    "VLN003": ("load data with a safe loader", False),
    "VLN004": ("evaluate literals only", False),
    "VLN005": ("leave the certificate check on", False),
    "VLN007": ("resolve the path and check its folder", True),
    "VLN010": ("take the debug mode from the environment", True),
}


def fix_diff(file: Column, line: Column, match: Column, fix: Column) -> Column:
    at = F.coalesce(line, F.lit(1)).cast("string")
    return F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -"), at, F.lit(",1 +"), at, F.lit(",1 @@\n-"), F.coalesce(match, F.lit("")), F.lit("\n+# TODO: "), fix)


def suggested(findings: DataFrame, most: int | None = None, *order: str) -> DataFrame:
    """Findings with their fix; those of other rules drop out. A limit applies to the findings before the
    lookup, in the order given (severity first). The table of fixes is a map literal of fixed size."""
    if most is not None:
        findings = findings.orderBy(severity_rank(F.col("severity")), *order).limit(most)
    entries = [x for rule, (fix, drifted) in FIXES.items() for x in (F.lit(rule), F.struct(F.lit(fix).alias("fix"), F.lit(drifted).alias("drifted")))]
    known = findings.withColumn("known", F.try_element_at(F.create_map(*entries), F.col("rule_id"))).where("known is not null")
    told = known.select(*findings.columns, "known.fix", "known.drifted")
    return told.withColumn("diff", fix_diff(F.col("file"), F.col("line"), F.col("match"), F.col("fix")))


def contexts(findings: DataFrame, files: DataFrame, keys: Sequence[str], window: int = 5) -> DataFrame:
    """The lines around each finding with a mark at its own: an equi-join on the file, then a slice of its lines."""
    told = findings.where("line is not null").join(files.select(*keys, "content"), list(keys))
    all_ = lines(F.col("content"))
    first = F.greatest(F.lit(1), F.col("line") - window)
    part = F.slice(all_, first, F.col("line") + window - first + 1)
    shown = F.transform(part, lambda x, i: F.concat(F.when(i + first == F.col("line"), ">>> ").otherwise("    "), F.format_string("%4d", i + first), F.lit(" | "), x))
    return told.where(F.size(all_) > 0).select(*findings.columns, F.array_join(shown, "\n").alias("context"))


def at_cursor(findings: DataFrame, line: Column) -> DataFrame:
    """Findings whose lines contain a place (0-based, as editors count)."""
    return findings.where(line.between(F.greatest(F.col("line") - 1, F.lit(0)), F.greatest(F.coalesce(F.col("end_line"), F.col("line")) - 1, F.lit(0)) if "end_line" in findings.columns else F.greatest(F.col("line") - 1, F.lit(0))))


def blocking(findings: DataFrame, fail_on: str, *order: str, most: int = 10) -> DataFrame:
    """The first findings at or above a severity; an unknown threshold means high, an unknown severity counts as info."""
    ranks = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}  # fixed values
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.lower("severity")), F.lit(0))
    return findings.where(rank >= ranks.get(fail_on, 3)).orderBy(*order).limit(most)


def found_in_context(files: DataFrame, keys: Sequence[str], window: int = 5) -> DataFrame:
    """Findings by line of (keys, file, content), each with the lines around it, cut out of the lines of the scanned row:
    contents are neither joined nor shuffled."""
    rules = (*SECRET_RULES, *VULNERABILITY_RULES)
    kept = files.where(~ignored(F.col("file")) & (F.octet_length("content") <= MAX_BYTES) & F.col("content").rlike(any_of(rules)))
    told = kept.select(*keys, "file", lines(F.col("content")).alias("all"))
    around = lambda i: F.transform(F.sequence(F.greatest(F.lit(1), i + 1 - window), F.least(F.size("all"), i + 1 + window)), lambda n: F.concat(F.when(n == i + 1, ">>> ").otherwise("    "), F.format_string("%4d", n), F.lit(" | "), F.get("all", n - 1)))
    hit = F.filter(F.transform("all", lambda x, i: F.when(x.rlike(any_of(rules)), F.struct((i + 1).alias("line"), x.alias("text"), F.array_join(around(i), "\n").alias("context")))), lambda x: x.isNotNull())
    rows = told.select(*keys, "file", F.explode(hit).alias("h")).select(*keys, "file", "h.line", "h.text", "h.context")
    return rows.select(*keys, "file", "line", "context", F.explode(hits(F.col("text"), rules)).alias("r")).select(*keys, "file", "line", "r.rule_id", "r.severity", "context")
