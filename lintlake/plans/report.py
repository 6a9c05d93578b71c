"""Reports: JSON rows by the engine, Markdown and HTML from small results."""

from __future__ import annotations

import html
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.grades import severity_rank
from lintlake.functions.text import shortened

MOST_ROWS = 1_000


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def finding_rows(findings: DataFrame, most: int = 80, chars: int = 60) -> DataFrame:
    """The most severe findings with shortened matches, for a report."""
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line", "rule_id").limit(most).withColumn("match", shortened(F.col("match"), chars))


def function_rows(functions: DataFrame, medium: int = 15) -> DataFrame:
    """All functions of high risk, and the first of medium risk, by falling complexity."""
    high = functions.where("risk = 'high'")
    some = functions.where("risk = 'medium'").orderBy(F.desc("cyclomatic"), "file", "line", "name").limit(medium)
    return high.unionByName(some)


def _cells(df: DataFrame, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most).collect()
    return df.columns, [["" if v is None else str(v) for v in r] for r in rows]


def markdown_table(df: DataFrame, title: str, most: int = MOST_ROWS) -> str:
    """A result of at most `most` rows as Markdown."""
    names, rows = _cells(df, most)
    safe = lambda v: v.replace("|", "\\|").replace("\n", " ")
    body = ["| " + " | ".join(map(safe, r)) + " |" for r in rows]
    return "\n".join([f"## {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *body, ""])


def html_page(title: str, sections: Sequence[tuple[str, DataFrame]], cards: Sequence[tuple[str, object]] = (), most: int = MOST_ROWS) -> str:
    """A page of figures and tables; everything is escaped."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    out += [f"<p class='card'><b>{html.escape(str(value))}</b> {html.escape(name)}</p>" for name, value in cards]
    for name, df in sections:
        names, rows = _cells(df, most)
        head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(v)}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def save(path: str, title: str, sections: Sequence[tuple[str, DataFrame]]) -> None:
    """HTML for .html and .htm, Markdown otherwise."""
    text = html_page(title, sections) if Path(path).suffix.lower() in (".html", ".htm") else "\n".join(markdown_table(df, name) for name, df in sections)
    Path(path).write_text(text, encoding="utf-8")
