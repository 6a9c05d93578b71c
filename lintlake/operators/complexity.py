"""Complexity of functions, files and whole reports, and the rules on it."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.functions import bracemetrics, pymetrics
from lintlake.functions.grades import complexity_grade, complexity_score, function_risk
from lintlake.functions.rules import AST_RULES, Rule, in_scope
from lintlake.functions.text import SPACE, lines, suffix

SKIP_FOLDERS = ("node_modules", "__pycache__", ".git", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache")
_METRICS = [T.StructField(n, T.StringType() if n == "name" else T.IntegerType()) for n in ("name", "line", "end_line", "length", "cyclomatic", "max_nesting", "cognitive", "params")]


def _per_file(files: DataFrame, keys: Sequence[str], fields: list[T.StructField], rows) -> DataFrame:
    """Rows of a Python function over (file, content), whole Arrow batches at a time; a failing file gives none."""
    schema = T.StructType([*[files.schema[k] for k in keys], files.schema["file"], T.StructField("position", T.IntegerType()), *fields])
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int32() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            owner, ordinal, out = [], [], [[] for _ in fields]
            for i in range(batch.num_rows):  # one text at a time becomes a Python string
                for k, row in enumerate(rows(batch.column(n)[i].as_py(), batch.column(n + 1)[i].as_py())):
                    owner.append(i)
                    ordinal.append(k)
                    for column, v in zip(out, row):
                        column.append(v)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(n + 1)], pa.array(ordinal, pa.int32()), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=schema.names)

    return files.select(*keys, "file", "content").where("file is not null and content is not null").mapInArrow(run, schema)


def _measure(path: str, content: str) -> list[tuple]:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".py":
        return pymetrics.functions(content)
    language = bracemetrics.EXTENSIONS.get(kind)
    return bracemetrics.functions(content, language) if language else []


def measured_functions(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics and risk of every function of (keys, file, content); other suffixes have no functions."""
    found = _per_file(files, keys, _METRICS, _measure)
    return found.withColumn("risk", function_risk(F.col("cyclomatic"), F.col("length"), F.col("max_nesting")))


def ast_violations(files: DataFrame, keys: Sequence[str] = (), wanted: Sequence[str] = tuple(AST_RULES)) -> DataFrame:
    """Findings of the syntax-tree rules in Python files."""
    names = frozenset(wanted)
    fields = [T.StructField("rule_id", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("detail", T.StringType())]
    found = _per_file(files.where(F.endswith("file", F.lit(".py"))), keys, fields, lambda path, content: pymetrics.checks(content, names))
    severity = F
    for rule, s in AST_RULES.items():
        severity = severity.when(F.col("rule_id") == rule, s)
    return found.withColumn("severity", severity)


def is_code(line: Column, language: Column) -> Column:
    """Neither blank nor a whole-line comment; one regular expression a line."""
    no_code = lambda marks: line.rlike(rf"^{SPACE}*(?:$|{marks})")
    return ~F.when(language == "python", no_code(r"//|/?\*|#")).otherwise(no_code(r"//|/?\*"))


def language_of(path: Column) -> Column:
    """The language of a file by its suffix; python for .py, null if unknown."""
    kind = F.lower(suffix(path))
    out = F.when(kind == ".py", "python")
    for ext, name in bracemetrics.EXTENSIONS.items():
        out = out.when(kind == ext, name)
    return out


def line_counts(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total and code lines (neither blank nor a whole-line comment) of each file, inside the row, without a shuffle."""
    told = files.select(*keys, "file", lines(F.col("content")).alias("all"), F.coalesce(language_of(F.col("file")), F.lit("")).alias("language"))
    code = F.filter("all", lambda x: is_code(x, F.col("language")))
    return told.select(*keys, "file", "language", F.size("all").alias("total_lines"), F.size(code).alias("code_lines"))


def file_complexity(heads: DataFrame | None, functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For every head (a file) its functions' count, average and greatest cyclomatic complexity; 0 without functions.
    Without heads those files come out that have functions, from one aggregation."""
    per = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("functions"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"))
    told = per if heads is None else heads.join(per, list(keys), "left")
    return told.fillna(0, ["functions", "max_cyclomatic"]).fillna(0.0, ["avg_cyclomatic"])


def report(functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average over all functions (not of the files' averages), counts by risk, score and grade of each key."""
    out = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("functions"), F.avg("cyclomatic").alias("avg_cyclomatic"), *[F.count_if(F.col("risk") == r).cast("int").alias(f"{r}_risk") for r in ("high", "medium", "low")])
    return out.withColumn("score", complexity_score(F.col("avg_cyclomatic"), F.col("high_risk"))).withColumn("grade", complexity_grade(F.col("avg_cyclomatic"), F.col("high_risk")))


def threshold_violations(functions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row for each function and threshold rule in scope whose metric is strictly greater than the bound.

    The rules become one array of candidates a row; the metric `nesting` is accepted but no function
    has it, so such a rule never fires."""
    names = [r for r in rules if r.enabled and r.type == "threshold" and r.metric in functions.columns and r.max_value is not None]
    columns = functions.columns
    if not names:
        return functions.select(*columns, F.lit("").alias("rule_id"), F.lit("").alias("severity"), F.lit("").alias("metric"), F.lit(0).alias("value"), F.lit(0).alias("max_value")).where(F.lit(False))
    made = [F.when((F.col(r.metric) > r.max_value) & in_scope(F.col("file"), r), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.metric).alias("metric"), F.col(r.metric).cast("int").alias("value"), F.lit(r.max_value).alias("max_value"))) for r in names]
    return functions.select(*columns, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("v")).select(*columns, "v.*")
