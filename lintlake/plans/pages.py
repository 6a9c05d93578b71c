"""Pages and texts for people: a dashboard, a scoreboard, bodies of comments, tables for a terminal.

Everything here renders results that are limited by the engine first; all values are escaped."""

from __future__ import annotations

import html
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.grades import severity_rank
from lintlake.operators.scoreboard import activity, leaderboard, ranked, trend
from lintlake.plans.report import MOST_ROWS

# Rows of a section, bars of its chart, Markdown files and history entries that are shown.
SECTION_ROWS = {"complexity": 50, "security": 80, "dependencies": MOST_ROWS, "docs": 50, "rules": 80}
CHART_BARS, MARKDOWN_FILES, HISTORY_ROWS = 15, 20, 20


@dataclass
class Section:
    """A part of a page: a table and perhaps a chart (kind, labels, values)."""

    name: str
    title: str
    columns: Sequence[str]
    rows: Sequence[Sequence[object]]
    summary: str = ""
    chart: Mapping[str, object] = field(default_factory=dict)


def section(name: str, title: str, df: DataFrame, *, order: Sequence[object] = (), bars: tuple[str, str] | None = None, histogram: str | None = None) -> Section:
    """A section of the first rows of a result. bars: columns of labels and values of a bar chart over the first rows;
    histogram: a column whose values are counted over all rows by the engine."""
    rows = (df.orderBy(*order) if order else df).limit(SECTION_ROWS.get(name, MOST_ROWS)).collect()
    chart: dict[str, object] = {}
    if bars:
        chart = {"type": "bar", "labels": [str(r[bars[0]])[:30] for r in rows[:CHART_BARS]], "values": [r[bars[1]] for r in rows[:CHART_BARS]]}
    elif histogram:
        counts = df.groupBy(F.coalesce(F.lower(histogram), F.lit("none")).alias("k")).count().orderBy("k").limit(MOST_ROWS).collect()
        chart = {"type": "doughnut", "labels": [r["k"] for r in counts] or ["none"], "values": [r["count"] for r in counts] or [0]}
    return Section(name, title, df.columns, [tuple(r) for r in rows], f"{len(rows)} rows shown", chart)


def dashboard_sections(functions: DataFrame | None = None, findings: DataFrame | None = None, dependencies: DataFrame | None = None, issues: DataFrame | None = None, violations: DataFrame | None = None) -> list[Section]:
    """The sections of a dashboard, of what is given: the most complex functions, the first findings by severity,
    dependencies, the issues of the first 20 Markdown files, and violations of rules."""
    out = []
    if functions is not None:
        out.append(section("complexity", "Complexity", functions, order=[F.desc("cyclomatic"), "file", "name"], bars=("name", "cyclomatic")))
    if findings is not None:
        out.append(section("security", "Security", findings, order=[severity_rank(F.col("severity")), "file", "line"], histogram="severity"))
    if dependencies is not None:
        out.append(section("dependencies", "Dependencies", dependencies, order=["name"]))
    if issues is not None:
        first = issues.select("file").distinct().orderBy("file").limit(MARKDOWN_FILES)
        out.append(section("docs", "Documents", issues.join(F.broadcast(first), "file", "left_semi"), order=["file", "block_index"]))  # 20 names
    if violations is not None:
        out.append(section("rules", "Rules", violations, order=[severity_rank(F.col("severity")), "file", "line"], histogram="severity"))
    return out


_STYLE = "body{font-family:sans-serif;margin:2rem}table{border-collapse:collapse}td,th{padding:.3rem .6rem;border-bottom:1px solid #ddd;text-align:left}.card{display:inline-block;margin:.5rem;padding:1rem;border:1px solid #ddd}.bar{background:#68c;height:.8rem}"


def _table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    cell = lambda v: html.escape("" if v is None else str(v))
    head = "".join(f"<th>{cell(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def _chart(chart: Mapping[str, object]) -> str:
    """The configuration as data for a chart library, and the values as bars of plain markup."""
    if not chart:
        return ""
    values = [v or 0 for v in chart["values"]]
    most = max([*values, 1])
    bars = "".join(f"<div>{html.escape(str(n))} ({v})<div class='bar' style='width:{100 * v / most:.0f}%'></div></div>" for n, v in zip(chart["labels"], values))
    return f"<div class='chart' data-chart='{html.escape(json.dumps(dict(chart)), quote=True)}'>{bars}</div>"


def page(title: str, sections: Sequence[Section], cards: Mapping[str, object] | None = None) -> str:
    """A page without outside parts: cards of figures, then each section with its chart and table."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style><h1>{html.escape(title)}</h1>"]
    out += [f"<div class='card'><b>{html.escape(str(v))}</b><br>{html.escape(k)}</div>" for k, v in (cards or {}).items()]
    for s in sections:
        out.append(f"<section id='{html.escape(s.name)}'><h2>{html.escape(s.title)}</h2><p>{html.escape(s.summary)}</p>{_chart(s.chart)}{_table(s.columns, s.rows)}</section>")
    return "\n".join(out)


def scoreboard_page(entries: DataFrame, title: str = "Scoreboard", metric: str = "complexity_avg") -> str:
    """Podium, board, trend of a metric, entries of each author and the last entries, each limited by the engine."""
    board = ranked(leaderboard(entries), MOST_ROWS).drop("first_seq").orderBy("place")
    rows = [tuple(r) for r in board.collect()]
    names = board.columns
    place, author, score = (names.index(c) for c in ("place", "author", "score"))
    podium = Section("podium", "Podium", ("place", "author", "score"), [(r[place], r[author], r[score]) for r in rows[:3]])
    points = trend(entries, metric).limit(MOST_ROWS).collect()
    line = Section("trend", f"Trend of {metric}", ("ts", "author", "value"), [(r["ts"], r["author"], r["value"]) for r in points], chart={"type": "line", "labels": [str(r["ts"])[:10] for r in points], "values": [r["value"] for r in points]})
    busy = activity(entries).orderBy(F.desc("entries"), "author").limit(MOST_ROWS).collect()
    active = Section("activity", "Activity", ("author", "entries"), [tuple(r) for r in busy], chart={"type": "bar", "labels": [str(r["author"]) for r in busy[:CHART_BARS]], "values": [r["entries"] for r in busy[:CHART_BARS]]})
    last = entries.orderBy(F.desc("seq")).limit(HISTORY_ROWS).select(F.to_json(F.struct(*entries.columns)).alias("entry")).collect()
    return page(title, [podium, Section("board", "Board", names, rows), line, active, Section("raw", "Last entries", ("entry",), [tuple(r) for r in last])], {"authors": len(rows)})


_DOTS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🔵"}


def _shown(value: object, most: int = 60) -> str:
    text = "" if value is None else str(value)
    return text[:most] + "..." if len(text) > most else text


def security_comment(scan: Mapping[str, object], findings: DataFrame, most: int = MOST_ROWS) -> str:
    """The body of a comment on a scan (pr_number, score, grade, files_scanned, total_files) of one pull request."""
    score = int(scan["score"])
    rows = findings.orderBy(severity_rank(F.col("severity")), "file", "line").limit(most).collect()
    counts = {r["s"]: r["count"] for r in findings.groupBy(F.lower("severity").alias("s")).count().limit(MOST_ROWS).collect()}
    mark = "🟢" if score >= 90 else "🟡" if score >= 60 else "🔴"
    out = [f"## Security scan of pull request {scan['pr_number']}", "", f"{mark} score {score}/100, grade {scan['grade']}; {scan['files_scanned']} of {scan['total_files']} files scanned", "", "| Severity | Count |", "| --- | --- |"]
    out += [f"| {s.title()} | {counts.get(s, 0)} |" for s in _DOTS]
    out.append("")
    for r in rows:
        d, s = r.asDict(), str(r["severity"] or "").lower()
        out.append(f"#### {_DOTS.get(s, '⚪')} [{s.upper()}] {d.get('title') or d['rule_id']}")
        out.append(f"- `{d['file']}`" + (f", line {d['line']}" if d.get("line") else "") + f" ({d['rule_id']})")
        out += [f"- `{_shown(d['match'])}`"] if d.get("match") else []
        out += [f"- {d[k]}" for k in ("description", "suggestion") if d.get(k)]
    return "\n".join(out if rows else [*out, "No security issues found."])


def review_comment(number: int, verdict: str, summary: str, risks: Sequence[Mapping[str, str]], safe: Sequence[Mapping[str, str]]) -> str:
    """The body of a comment on a review; the mark follows what the verdict says."""
    said = verdict.lower()
    mark = "✅" if "ready" in said or "merge" in said else "⚠️" if "needs changes" in said or "needs discussion" in said else "📋"
    table = ["| Severity | File | Reason |", "| --- | --- | --- |", *[f"| {r.get('severity', 'medium').upper()} | `{r['file']}` | {r['reason']} |" for r in risks]] if risks else ["No risky files."]
    easy = [f"- `{r['file']}`: {r['reason']}" for r in safe] or ["No files that are safe to skim."]
    return "\n".join([f"## Review of pull request {number}", "", f"{mark} **{verdict}**", "", summary, "", f"### Risky files ({len(risks)})", *table, "", f"### Safe to skim ({len(safe)})", *easy])


def terminal_table(df: DataFrame, most: int = 50, width: int = 60) -> str:
    """The first rows of a result as aligned text."""
    rows = [df.columns, *[["" if v is None else _shown(v, width).replace("\n", " ") for v in r] for r in df.limit(most).collect()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip()
    return "\n".join([line(rows[0]), "  ".join("-" * w for w in wide), *map(line, rows[1:])])
