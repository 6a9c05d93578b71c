"""Queries of the scanning, complexity, dependency, docs, score, cache and review operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.globs import ignore_predicate
from lintlake.functions.grades import SEVERITIES, at_least, editor_grade, security_grade, severity_rank
from lintlake.functions.rules import AST_RULES, DEFAULT_IGNORE, FILE_RULES, SECRET_RULES, VULNERABILITY_RULES, Rule, ignored, validate
from lintlake.functions.text import basename, human_size, shortened, suffix, token_estimate
from lintlake.operators import cachetable, complexity, deps, docs, fixes, review, scan, scoreboard
from lintlake.operators.topn import clean_path, top_n_per_group
from lintlake.plans.editor import ENTRY_POINTS, analysed, diagnostics, guide, score_colour, verdict_mark
from lintlake.plans.prompts import review_prompt
from lintlake.plans.report import function_rows, json_rows
from lintlake.sources.tables import first_sent, table
from lintlake.sources.tree import IGNORED_FOLDERS, LANGUAGES, TEXT_SUFFIXES, language_counts, snapshot_sources, tree_text
from lintlake.streaming.streams import debounced, latest_per_key, rate_windows, unexpired

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- inputs


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.once(table(spark, sf_dir, "score").select("seq", "ts", "author", "metrics"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.once(table(spark, sf_dir, "finding").select("finding_id", "pr_id", "rule_id", "severity", "file", "line", "match"), "finding_id")


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all snapshots. A re-sent snapshot is there twice: queries drop its rows from their small
    results, so that no content is shuffled."""
    return table(spark, sf_dir, "repo_snapshot").select("snapshot_id", F.explode("file_contents").alias("file", "content")).where("content is not null")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all pull requests without their patches, each once."""
    return review.pr_files(table(spark, sf_dir, "pr")).drop("patch").distinct()


def sent_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches by pull request, arrival and place: results of re-sent ones are dropped afterwards."""
    return review.pr_files(table(spark, sf_dir, "pr"), "fetched_at").select("pr_id", "fetched_at", "ordinal", "file", "patch")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function metrics; a re-sent row is there twice: queries drop repeats by fn_id from what they keep."""
    rows = table(spark, sf_dir, "fn_metrics").drop("received_at", "scanned_at")
    return rows.withColumn("file", clean_path(F.col("file")))


_ENTRIES = "e AS (SELECT DISTINCT ON (seq) seq, ts, author, metrics FROM score)"
_FINDINGS = "f AS (SELECT DISTINCT ON (finding_id) finding_id, pr_id, rule_id, severity, file, line, match FROM finding)"
_FILES = "files AS (SELECT DISTINCT ON (snapshot_id, file) snapshot_id, file, content FROM (SELECT snapshot_id, e.key AS file, e.value AS content FROM (SELECT snapshot_id, unnest(map_entries(file_contents)) AS e FROM repo_snapshot)) WHERE content IS NOT NULL)"
_PATCHES = "p1 AS (SELECT DISTINCT ON (pr_id) pr_id, repo, number, files FROM pr), p2 AS (SELECT pr_id, repo, number, unnest(files) AS f, unnest(generate_series(0, len(files) - 1)) AS ordinal FROM p1 WHERE len(files) > 0), patches AS (SELECT pr_id, repo, number, CAST(ordinal AS INTEGER) AS ordinal, f.filename AS file, f.status AS status, coalesce(f.additions, 0) AS additions, coalesce(f.deletions, 0) AS deletions, f.patch AS patch FROM p2)"
_METRICS = r"m AS (SELECT DISTINCT fn_id, name, regexp_replace(replace(file, '\', '/'), '^(\./+)+', '') AS file, line, end_line, length, cyclomatic, max_nesting, cognitive, params FROM fn_metrics)"
_LINES = r"(CASE WHEN {c} = '' THEN [] WHEN regexp_matches({c}, '(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])\z') THEN regexp_split_to_array({c}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')[:-2] ELSE regexp_split_to_array({c}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') END)"
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lines_sql(column: str) -> str:
    return _LINES.replace("{c}", column)


def _strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _rank_sql(column: str = "severity") -> str:
    return f"CASE lower({column}) " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " ELSE 5 END"


def _re2(pattern: str) -> str:
    """The pattern without lookaround, which finds the same lines."""
    return pattern.replace(r"(?<!\w)", r"(?:^|\W)").replace("(?!Loader)", "")


def _hits_sql(column: str, rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, {_q(_re2(r.pattern))}) THEN {{'rule_id': '{r.id}', 'severity': '{r.severity}'}} END" for r in rules) + "], lambda x: x IS NOT NULL)"


def _ignored_sql(column: str) -> str:
    return f"regexp_matches({column}, {_q('|'.join(f'(?:{p})' for p in DEFAULT_IGNORE))})"


# ---------------------------------------------------------------- scores

_TOTALS = f"""WITH {_ENTRIES}, t AS (
  SELECT author, sum(CASE WHEN list_contains(map_keys(metrics), 'reviews') THEN coalesce(CASE WHEN NOT isnan(metrics['reviews']) THEN metrics['reviews'] END, 0.0) ELSE 1.0 END) AS reviews,
    coalesce(avg(CASE WHEN NOT isnan(metrics['complexity_avg']) THEN metrics['complexity_avg'] END), 0.0) AS avg_complexity,
    coalesce(sum(CASE WHEN NOT isnan(metrics['security_issues']) THEN metrics['security_issues'] END), 0.0) AS security_issues, coalesce(sum(CASE WHEN NOT isnan(metrics['rule_violations']) THEN metrics['rule_violations'] END), 0.0) AS rule_violations,
    coalesce(sum(CASE WHEN NOT isnan(metrics['fix_count']) THEN metrics['fix_count'] END), 0.0) AS fix_count, count(*) AS entries, min(seq) AS first_seq FROM e GROUP BY author),
r AS (SELECT * REPLACE (CAST(printf('%.1f', avg_complexity) AS DOUBLE) AS avg_complexity) FROM t),
b AS (SELECT *, CAST(printf('%.1f', reviews * 10 + fix_count * 5 - security_issues * 8 - rule_violations * 3 - greatest(0.0, avg_complexity - 10) * 4) AS DOUBLE) AS score FROM r) """


@query(_TOTALS + "SELECT * FROM b")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.leaderboard(entries(spark, sf_dir))


@query(_TOTALS + "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, first_seq) AS INTEGER) AS place FROM b")
def leaderboard_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole board with places."""
    return scoreboard.ranked(scoreboard.leaderboard(entries(spark, sf_dir)))


@query(_TOTALS + "SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, first_seq) AS INTEGER) AS place FROM b) WHERE place <= 3")
def podium_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.ranked(scoreboard.leaderboard(entries(spark, sf_dir)), 3)


@query(f"WITH {_ENTRIES} SELECT author, count(*) AS entries FROM e GROUP BY author")
def activity_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.activity(entries(spark, sf_dir))


@query("SELECT DISTINCT author FROM score WHERE author IS NOT NULL")
def distinct_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "score").select("author").where("author is not null").distinct()


@query("SELECT seq, ts, author FROM score ORDER BY seq DESC LIMIT 1")
def latest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.latest(table(spark, sf_dir, "score").select("seq", "ts", "author"))


@query(f"WITH {_ENTRIES} SELECT seq, ts, author, metrics['complexity_avg'] AS value FROM e WHERE metrics['complexity_avg'] IS NOT NULL")
def metric_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.trend(entries(spark, sf_dir), "complexity_avg")


@query(f"WITH {_ENTRIES} SELECT seq, ts, author FROM e ORDER BY seq DESC LIMIT 20")
def history_last20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoreboard.last_entries(entries(spark, sf_dir).drop("metrics"))


# ---------------------------------------------------------------- findings


@query(f"WITH {_FINDINGS} SELECT lower(severity) AS severity, count(*) AS findings FROM f GROUP BY 1")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("findings"))


@query(
    f"""WITH {_FINDINGS}, h AS (SELECT DISTINCT pr_id FROM pr), c AS (SELECT pr_id, {", ".join(f"CAST(count(*) FILTER (lower(severity) = '{s}') AS INTEGER) AS {s}" for s in SEVERITIES)}, count(*) AS findings FROM f GROUP BY pr_id),
    s AS (SELECT h.pr_id, {", ".join(f"coalesce({s}, 0) AS {s}" for s in SEVERITIES)}, coalesce(findings, 0) AS findings FROM h LEFT JOIN c ON c.pr_id = h.pr_id),
    g AS (SELECT *, CAST(greatest(0, 100 - 25 * critical - 15 * high - 5 * medium - low) AS INTEGER) AS score FROM s)
    SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM g"""
)
def scan_score_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and grade of every pull request, those without findings too."""
    return scan.scan_scores(table(spark, sf_dir, "pr").select("pr_id").distinct(), findings(spark, sf_dir).where("pr_id is not null"), ["pr_id"])


@query("WITH s AS (SELECT unnest(generate_series(0, 100)) AS score) SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS security, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS editor FROM s")
def grade_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scales of grades."""
    s = F.col("score")
    return spark.range(101).select(F.col("id").cast("int").alias("score")).select("score", security_grade(s).alias("security"), editor_grade(s).alias("editor"))


@query(f"WITH {_FINDINGS} SELECT finding_id, lower(severity) AS severity FROM f WHERE lower(severity) IN ('high', 'critical')")
def gate_fail_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that fail a gate at `high`."""
    return findings(spark, sf_dir).where(at_least(F.col("severity"), "high")).select("finding_id", F.lower("severity").alias("severity"))


@query(f"WITH {_FINDINGS}, r AS (SELECT finding_id, rule_id, file, left(rule_id, 3) AS category, CAST(row_number() OVER (PARTITION BY left(rule_id, 3) ORDER BY {_rank_sql()}, coalesce(file, ''), finding_id) AS INTEGER) AS rank FROM f WHERE rule_id IS NOT NULL) SELECT * FROM r WHERE rank <= 5")
def top_findings_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n_per_group(findings(spark, sf_dir), F.left("rule_id", F.lit(3)), -severity_rank(F.col("severity")), [F.col("file")], F.col("finding_id"), 5, group_name="category")
    return best.select("category", "rank", "finding_id", "rule_id", "file")


@query(f"WITH {_FINDINGS} SELECT finding_id, CASE WHEN length(match) > 80 THEN left(match, 80) || '...' ELSE match END AS shown FROM f ORDER BY {_rank_sql()}, finding_id LIMIT 80")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 most severe findings as a report shows them."""
    return scan.ordered(findings(spark, sf_dir), "finding_id").limit(80).select("finding_id", shortened(F.col("match")).alias("shown"))


@query(f"WITH {_FINDINGS}, {_PATCHES} SELECT finding_id, f.file FROM f WHERE EXISTS (SELECT 1 FROM patches WHERE patches.file = f.file AND patches.pr_id = f.pr_id)")
def staged_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on files that their pull request changes."""
    return findings(spark, sf_dir).select("finding_id", "pr_id", "file").join(patches(spark, sf_dir).select("pr_id", "file"), ["pr_id", "file"], "left_semi").select("finding_id", "file")


@query(f"WITH {_FINDINGS} SELECT finding_id, rule_id, file, CASE rule_id " + " ".join(f"WHEN '{k}' THEN {_q(v[0])}" for k, v in fixes.FIXES.items()) + " END AS fix FROM f WHERE rule_id IN (" + ", ".join(_q(k) for k in fixes.FIXES) + ")")
def fixes_for_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a fix of their rule."""
    return fixes.suggested(findings(spark, sf_dir)).select("finding_id", "rule_id", "file", "fix")


@query(
    f"WITH {_FINDINGS}, l AS (SELECT * FROM f ORDER BY {_rank_sql()}, finding_id LIMIT 20) SELECT finding_id, '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -' || coalesce(line, 1) || ',1 +' || coalesce(line, 1) || ',1 @@' || chr(10) || '-' || coalesce(match, '') || chr(10) || '+# TODO: ' || CASE rule_id "
    + " ".join(f"WHEN '{k}' THEN {_q(v[0])}" for k, v in fixes.FIXES.items())
    + " END AS diff FROM l WHERE rule_id IN ("
    + ", ".join(_q(k) for k in fixes.FIXES)
    + ")"
)
def fixes_of_first20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit applies to the findings, before the lookup."""
    return fixes.suggested(findings(spark, sf_dir), 20, "finding_id").select("finding_id", "diff")


@query(f"WITH {_FINDINGS} SELECT CAST(to_json({{'finding_id': finding_id, 'pr_id': pr_id, 'rule_id': rule_id, 'severity': severity, 'file': file, 'line': line, 'match': match}}) AS VARCHAR) AS json FROM f")
def findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(findings(spark, sf_dir).select("finding_id", "pr_id", "rule_id", "severity", "file", "line", "match"))


@query(
    """WITH f AS (SELECT DISTINCT ON (finding_id) * FROM finding), l AS (SELECT *, CAST(greatest(coalesce(line, 1) - 1, 0) AS INTEGER) AS place, coalesce(description, 'Issue detected') AS message, coalesce(rule_id, 'security-issue') AS rule FROM f)
    SELECT finding_id, place AS line, place AS end_line, 0 AS first_column, 1 AS end_column, CASE lower(coalesce(severity, 'medium')) WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'low' THEN 4 WHEN 'info' THEN 4 ELSE 3 END AS level, 'lintlake/security/' || rule AS code, message,
      concat_ws(',', CASE WHEN contains(lower(message), 'deprecated') OR contains(lower(rule), 'deprecated') THEN 'deprecated' END, CASE WHEN contains(lower(message), 'unused') OR contains(lower(rule), 'unused') THEN 'unnecessary' END) AS tags FROM l"""
)
def editor_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoreboard.once(table(spark, sf_dir, "finding").select("finding_id", "rule_id", "severity", "file", "line", F.col("description").alias("message")), "finding_id")
    return diagnostics(rows, "security").select("finding_id", "line", "end_line", "first_column", "end_column", "level", "code", "message", F.concat_ws(",", "tags").alias("tags"))


URIS = ("file:///a/b.py", "file:///a/b.PY", "http://x/b.py", "/a/b.py", "file:///a/b.rb", "file:///a/b.md", "file:///a.tsx/b")


@query("SELECT * FROM (VALUES ('file:///a/b.py', true), ('file:///a/b.PY', false), ('http://x/b.py', false), ('/a/b.py', false), ('file:///a/b.rb', true), ('file:///a/b.md', false), ('file:///a.tsx/b', false)) t(uri, analysed)")
def analysed_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses an editor's server analyses."""
    return spark.createDataFrame([(u,) for u in URIS], "uri string").withColumn("analysed", analysed(F.col("uri")))


@query(f"WITH {_FINDINGS} SELECT finding_id, CASE WHEN length(match) > 60 THEN left(match, 60) ELSE match END AS shown FROM f WHERE lower(severity) IN ('critical', 'high') ORDER BY finding_id LIMIT 10")
def hook_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten findings that block a commit at `high`."""
    return fixes.blocking(findings(spark, sf_dir), "high", "finding_id").select("finding_id", F.left("match", F.lit(60)).alias("shown"))


VERDICTS = ("Ready to merge", "MERGE after a rebase", "Needs changes", "needs discussion first", "Not sure", "")


@query("SELECT * FROM (VALUES ('Ready to merge', 'pass'), ('MERGE after a rebase', 'pass'), ('Needs changes', 'warn'), ('needs discussion first', 'warn'), ('Not sure', 'other'), ('', 'other')) t(verdict, mark)")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark of a review's verdict, by what it says."""
    return spark.createDataFrame([(v,) for v in VERDICTS], "verdict string").withColumn("mark", verdict_mark(F.col("verdict")))


@query("WITH s AS (SELECT unnest(generate_series(0, 100)) AS score) SELECT CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'green' WHEN score >= 60 THEN 'yellow' ELSE 'red' END AS colour FROM s")
def score_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(101).select(F.col("id").cast("int").alias("score")).withColumn("colour", score_colour(F.col("score")))


# ---------------------------------------------------------------- scanning

_SCANNED = f"""code AS (SELECT snapshot_id, file, unnest({_lines_sql("content")}) AS text, unnest(generate_series(1, len({_lines_sql("content")}))) AS line FROM files WHERE NOT {_ignored_sql("file")} AND octet_length(encode(content)) <= 500000 AND content != '')"""


def _scan_sql(rules) -> str:
    return f"WITH {_FILES}, {_SCANNED} SELECT snapshot_id, file, CAST(line AS INTEGER) AS line, h.rule_id AS rule_id, h.severity AS severity, match FROM (SELECT snapshot_id, file, line, {_strip_sql('text')} AS match, unnest({_hits_sql('text', rules)}) AS h FROM code)"


def _scanned(spark: SparkSession, sf_dir: str, rules) -> DataFrame:
    return scan.scan_files(repo_files(spark, sf_dir), ["snapshot_id"], rules=rules).where("line is not null").select("snapshot_id", "file", "line", "rule_id", "severity", "match").distinct()


@query(_scan_sql(SECRET_RULES))
def builtin_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, SECRET_RULES)


@query(_scan_sql(VULNERABILITY_RULES))
def builtin_vuln_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, VULNERABILITY_RULES)


@query(f"WITH {_FINDINGS} SELECT finding_id, h.rule_id AS rule_id FROM (SELECT finding_id, unnest({_hits_sql('file', FILE_RULES)}) AS h FROM f WHERE file IS NOT NULL)")
def risky_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.name_findings(findings(spark, sf_dir).select("finding_id", "file")).select("finding_id", "rule_id")


_DIFF = f"""WITH {_PATCHES}, raw AS (SELECT pr_id, ordinal, file, unnest(string_split(patch, chr(10))) AS raw, unnest(generate_series(1, len(string_split(patch, chr(10))))) AS pos FROM patches WHERE patch IS NOT NULL AND patch != ''),
 marked AS (SELECT *, raw[1:2] = '@@' AS header, raw[1:1] = '+' AND raw[1:3] != '+++' AS added, CASE WHEN raw[1:2] = '@@' THEN CAST(nullif(regexp_extract(raw, '\\+(\\d+)', 1), '') AS BIGINT) END AS start FROM raw),
 run AS (SELECT *, sum(CASE WHEN header OR raw[1:1] = '-' THEN 0 ELSE 1 END) OVER w AS seen FROM marked WINDOW w AS (PARTITION BY pr_id, ordinal ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 based AS (SELECT *, last_value(CASE WHEN start IS NOT NULL THEN {{'start': start, 'seen': seen}} END IGNORE NULLS) OVER (PARTITION BY pr_id, ordinal ORDER BY pos ROWS UNBOUNDED PRECEDING) AS base FROM run),
 added AS (SELECT pr_id, ordinal, file, CAST(coalesce(base.start - 1, 0) + seen - coalesce(base.seen, 0) AS INTEGER) AS line, raw[2:] AS text FROM based WHERE added) """


@query(_DIFF + "SELECT * FROM added")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.added_lines(sent_patches(spark, sf_dir), ["pr_id", "fetched_at", "ordinal", "file"]).drop("fetched_at").distinct()


@query(_DIFF + f", kept AS (SELECT * FROM added WHERE NOT {_ignored_sql('file')}) SELECT pr_id, ordinal, file, line, h.rule_id AS rule_id, h.severity AS severity, match FROM (SELECT pr_id, ordinal, file, line, {_strip_sql('text')} AS match, unnest({_hits_sql('text', (*SECRET_RULES, *VULNERABILITY_RULES))}) AS h FROM kept) UNION ALL SELECT pr_id, ordinal, file, NULL, h.rule_id, h.severity, NULL FROM (SELECT pr_id, ordinal, file, unnest({_hits_sql('file', FILE_RULES)}) AS h FROM patches WHERE NOT {_ignored_sql('file')})")
def diff_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in the added lines and the names of pull requests."""
    return scan.scan_patches(sent_patches(spark, sf_dir), ["pr_id", "fetched_at", "ordinal"]).drop("fetched_at").distinct()


@query(_DIFF + f", c AS (SELECT pr_id, count(*) FILTER (NOT {_ignored_sql('file')} AND coalesce(patch, '') != '') AS files_scanned FROM patches GROUP BY pr_id), h AS (SELECT DISTINCT ON (pr_id) pr_id, changed_files FROM pr) SELECT h.pr_id, h.changed_files AS total_files, coalesce(files_scanned, 0) AS files_scanned FROM h LEFT JOIN c ON c.pr_id = h.pr_id")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned beside the header's count."""
    heads = table(spark, sf_dir, "pr").select("pr_id", "changed_files").distinct()
    seen = sent_patches(spark, sf_dir).groupBy("pr_id", "fetched_at").agg(F.count_if(~ignored(F.col("file")) & (F.coalesce("patch", F.lit("")) != "")).alias("files_scanned")).groupBy("pr_id").agg(F.max("files_scanned").alias("files_scanned"))
    return heads.join(seen, "pr_id", "left").select("pr_id", F.col("changed_files").alias("total_files"), F.coalesce("files_scanned", F.lit(0)).alias("files_scanned"))


CUSTOM = (Rule("CUS001", "low", r"\b\d+ open findings\b"), Rule("CUS002", "info", r"\bthe [a-z]+ plugin\b", include=(r"^wiki/", r"^forum/"), exclude=(r"-lab$",)), Rule("CUS003", "medium", r"(?i)todo|open points"), Rule("CUS004", "high", "off", enabled=False))


def _custom_sql(rules) -> str:
    parts = []
    for r in rules:
        if r.enabled:
            scope = " AND ".join(["TRUE", *(["(" + " OR ".join(f"regexp_matches(file, {_q(p)})" for p in r.include) + ")"] if r.include else []), *[f"NOT regexp_matches(file, {_q(p)})" for p in r.exclude]])
            parts.append(f"SELECT doc_id, file, line, '{r.id}' AS rule_id, '{r.severity}' AS severity, unnest(regexp_extract_all(text, {_q(r.pattern)})) AS match FROM code WHERE {scope}")
    return f"WITH code AS (SELECT doc_id, coalesce(source, '') AS file, unnest({_lines_sql('text')}) AS text, CAST(unnest(generate_series(1, len({_lines_sql('text')}))) AS INTEGER) AS line FROM documents WHERE text IS NOT NULL AND text != '') " + " UNION ALL ".join(parts)


@query(_custom_sql(CUSTOM))
def custom_pattern_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of custom rules with scopes in the lines of the documents."""
    rows = scan.code_lines(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("file"), F.col("text").alias("content")))
    return scan.pattern_findings(rows, CUSTOM)


@query(f"WITH {_FILES} SELECT snapshot_id, file FROM files WHERE NOT {_ignored_sql('file')}")
def default_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).where(~ignored(F.col("file"))).select("snapshot_id", "file").distinct()


IGNORE_LINES = ("# third-party", "vendor/", "*.min.js", "docs/**/*.md", "!src/*", "test?/", "build/")


@query(rf"WITH {_FILES} SELECT snapshot_id, file FROM files WHERE NOT ((regexp_matches(file, 'vendor') OR regexp_matches(file, '[^/]*\.min\.js') OR regexp_matches(file, 'docs/(.*/)?[^/]*\.md') OR regexp_matches(file, 'test[^/]') OR regexp_matches(file, 'build')) AND NOT regexp_matches(file, 'src/[^/]*'))")
def ignore_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an ignore file with negation leaves."""
    return repo_files(spark, sf_dir).where(~ignore_predicate(F.col("file"), IGNORE_LINES)).select("snapshot_id", "file").distinct()


@query()
def ast_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.ast_violations(repo_files(spark, sf_dir), ["snapshot_id"]).distinct()


@query(_scan_sql((*SECRET_RULES, *VULNERABILITY_RULES)).replace("WITH ", "WITH all_rows AS (WITH ", 1) + ") SELECT snapshot_id, CASE WHEN starts_with(rule_id, 'SEC') THEN 'secret' ELSE 'vulnerability' END AS category, count(*) AS findings FROM all_rows GROUP BY ALL")
def findings_union_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of both analyzers as one table, counted by category."""
    found = _scanned(spark, sf_dir, (*SECRET_RULES, *VULNERABILITY_RULES))
    category = F.when(F.startswith("rule_id", F.lit("SEC")), "secret").otherwise("vulnerability")
    return found.groupBy("snapshot_id", category.alias("category")).agg(F.count(F.lit(1)).alias("findings"))


@query(
    _scan_sql((*SECRET_RULES, *VULNERABILITY_RULES)).replace("WITH ", "WITH hits AS (WITH ", 1)
    + f"), {_FILES}, l AS (SELECT snapshot_id, file, {_lines_sql('content')} AS all_lines FROM files) SELECT hits.snapshot_id, hits.file, line, rule_id, array_to_string(list_transform(generate_series(greatest(1, line - 5), least(len(all_lines), line + 5)), lambda n: (CASE WHEN n = line THEN '>>> ' ELSE '    ' END) || printf('%4d', n) || ' | ' || all_lines[n]), chr(10)) AS context FROM hits JOIN l USING (snapshot_id, file)"
)
def finding_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines around each finding in a file, cut out in the scan itself: no content is joined or shuffled."""
    once = first_sent(table(spark, sf_dir, "repo_snapshot").select("snapshot_id", "received_at", "file_contents"), "snapshot_id", "received_at")
    files = once.select("snapshot_id", F.explode("file_contents").alias("file", "content")).where("content is not null")
    return fixes.found_in_context(files, ["snapshot_id"]).select("snapshot_id", "file", "line", "rule_id", "context")


# ---------------------------------------------------------------- complexity

_RISK = "CASE WHEN coalesce(cyclomatic > 20, false) OR coalesce(length > 100, false) OR coalesce(max_nesting > 6, false) THEN 'high' WHEN coalesce(cyclomatic > 10, false) OR coalesce(length > 50, false) OR coalesce(max_nesting > 4, false) THEN 'medium' ELSE 'low' END"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).withColumn("risk", complexity.function_risk(F.col("cyclomatic"), F.col("length"), F.col("max_nesting")))


@query(f"WITH {_METRICS} SELECT fn_id, {_RISK} AS risk FROM m")
def fn_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("fn_id", "risk").distinct()


@query(f"WITH {_METRICS} SELECT file, count(*) AS functions, coalesce(avg(cyclomatic), 0.0) AS avg_cyclomatic, coalesce(max(cyclomatic), 0) AS max_cyclomatic FROM m WHERE file IS NOT NULL GROUP BY file")
def file_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir).where("file is not null").select("fn_id", "file", "cyclomatic").distinct()
    return complexity.file_complexity(None, rows, ["file"])


@query(
    f"""WITH {_METRICS}, r AS (SELECT split_part(file, '/', 1) AS root, cyclomatic, {_RISK} AS risk FROM m WHERE file IS NOT NULL),
    a AS (SELECT root, count(*) AS functions, avg(cyclomatic) AS avg_cyclomatic, {", ".join(f"CAST(count(*) FILTER (risk = '{x}') AS INTEGER) AS {x}_risk" for x in ("high", "medium", "low"))} FROM r GROUP BY root)
    SELECT *, greatest(0, least(100, CAST(trunc(greatest(0.0, 100.0 - avg_cyclomatic * 4) - high_risk * 5) AS INTEGER))) AS score,
      CASE WHEN avg_cyclomatic <= 5 AND high_risk = 0 THEN 'A' WHEN avg_cyclomatic <= 10 AND high_risk <= 2 THEN 'B' WHEN avg_cyclomatic <= 20 AND high_risk <= 5 THEN 'C' WHEN avg_cyclomatic <= 25 THEN 'D' ELSE 'F' END AS grade FROM a"""
)
def report_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rated(spark, sf_dir).where("file is not null").select("fn_id", F.substring_index("file", "/", 1).alias("root"), "cyclomatic", "risk").distinct()
    return complexity.report(rows, ["root"])


LIMITS = (Rule("THR001", "high", type="threshold", metric="cyclomatic", max_value=20), Rule("THR002", "medium", type="threshold", metric="length", max_value=80, include=(r"\.py$",)), Rule("THR003", "low", type="threshold", metric="nesting", max_value=1), Rule("THR004", "low", type="threshold", metric="params", max_value=4, exclude=(r"/tests?/",)))


@query(rf"WITH {_METRICS} SELECT fn_id, 'THR001' AS rule_id, cyclomatic AS value FROM m WHERE cyclomatic > 20 AND file IS NOT NULL UNION ALL SELECT fn_id, 'THR002', length FROM m WHERE length > 80 AND regexp_matches(file, '\.py$') UNION ALL SELECT fn_id, 'THR004', params FROM m WHERE params > 4 AND NOT regexp_matches(file, '/tests?/')")
def threshold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.threshold_violations(metrics(spark, sf_dir).where("file is not null"), LIMITS).select("fn_id", "rule_id", "value").distinct()


@query(f"WITH {_METRICS} SELECT fn_id, cyclomatic FROM m WHERE cyclomatic >= 10 ORDER BY cyclomatic DESC, fn_id LIMIT 20")
def most_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).where("cyclomatic >= 10").select("fn_id", "cyclomatic").distinct().orderBy(F.desc("cyclomatic"), "fn_id").limit(20)


@query(f"WITH {_METRICS}, r AS (SELECT fn_id, name, file, line, cyclomatic, {_RISK} AS risk FROM m) SELECT fn_id, risk FROM r WHERE risk = 'high' UNION ALL (SELECT fn_id, risk FROM r WHERE risk = 'medium' ORDER BY cyclomatic DESC NULLS LAST, file NULLS FIRST, line NULLS FIRST, encode(name) NULLS FIRST LIMIT 15)")
def report_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All functions of high risk and the first 15 of medium risk."""
    rows = _rated(spark, sf_dir).where("risk != 'low'").select("fn_id", "name", "file", "line", "cyclomatic", "risk").distinct()
    return function_rows(rows).select("fn_id", "risk")


@query()
def measured_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every function in the files of the snapshots, in all languages."""
    return complexity.measured_functions(repo_files(spark, sf_dir), ["snapshot_id"]).distinct()


@query()
def pr_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of what pull requests add to Python files."""
    added = scan.added_lines(sent_patches(spark, sf_dir), ["pr_id", "fetched_at", "ordinal", "file"]).drop("fetched_at").distinct()
    return complexity.measured_functions(review.python_additions(added, ["pr_id", "ordinal"]), ["pr_id", "ordinal"])


@query(
    f"WITH {_FILES} SELECT snapshot_id, file, len(l) AS total_lines, len(list_filter(l, lambda x: {_strip_sql('x')} != '' AND NOT (starts_with({_strip_sql('x')}, '//') OR starts_with({_strip_sql('x')}, '/*') OR starts_with({_strip_sql('x')}, '*') OR (regexp_matches(lower(file), '[^/]\\.py$') AND starts_with({_strip_sql('x')}, '#'))))) AS code_lines FROM (SELECT snapshot_id, file, {_lines_sql('content')} AS l FROM files)"
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.line_counts(repo_files(spark, sf_dir), ["snapshot_id"]).select("snapshot_id", "file", F.col("total_lines").cast("long").alias("total_lines"), F.col("code_lines").cast("long").alias("code_lines")).distinct()


@query(
    rf"WITH {_FILES}, l AS (SELECT snapshot_id, CASE regexp_extract(regexp_extract(file, '[^/]*$'), '^.+(\.[^.]+)$', 1) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
    + " END AS language FROM files WHERE NOT list_has_any(string_split(file, '/'), ["
    + ", ".join(f"'{x}'" for x in IGNORED_FOLDERS)
    + "])), c AS (SELECT snapshot_id, language, count(*) AS files FROM l WHERE language IS NOT NULL GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY files DESC, language) AS INTEGER) AS place FROM c"
)
def language_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each snapshot by number of files."""
    files = repo_files(spark, sf_dir).select("snapshot_id", "file").distinct()
    return language_counts(files, ["snapshot_id"])


@query()
def snapshot_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collected files of each snapshot as a tree."""
    return tree_text(repo_files(spark, sf_dir).select("snapshot_id", "file"), ["snapshot_id"])


@query(
    f"""WITH s AS (SELECT DISTINCT ON (snapshot_id) * FROM repo_snapshot), k AS (SELECT snapshot_id, coalesce(map_keys(dependency_files), []) AS deps, coalesce(map_keys(file_contents), []) AS files, languages FROM s)
    SELECT snapshot_id, coalesce(nullif(array_to_string(list_sort(list_filter(files, lambda x: x IN ({", ".join(f"'{x}'" for x in ENTRY_POINTS)}))), ','), ''), 'See README for entry points') AS entry_points, array_to_string(list_sort(files)[1:6], ',') AS key_files,
      CASE WHEN list_contains(deps, 'requirements.txt') THEN 'pip install -r requirements.txt' WHEN list_contains(deps, 'pyproject.toml') THEN 'pip install -e .' WHEN list_contains(deps, 'package.json') THEN 'npm install' WHEN list_contains(deps, 'go.mod') THEN 'go mod download' END AS setup,
      coalesce(nullif(array_to_string(languages[1:2], ', '), ''), 'unknown') AS stack FROM k"""
)
def first_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a newcomer to each project is told; file names only are read of the contents."""
    heads = table(spark, sf_dir, "repo_snapshot").select("snapshot_id", F.map_keys("file_contents").alias("files"), F.map_keys("dependency_files").alias("manifests"), "languages").dropDuplicates(["snapshot_id"])
    told = guide(heads)
    return told.select("snapshot_id", F.concat_ws(",", "entry_points").alias("entry_points"), F.concat_ws(",", "key_files").alias("key_files"), "setup", "stack")


@query(
    rf"""WITH {_FILES}, t AS (SELECT *, regexp_extract(file, '[^/]*$') AS name, regexp_extract(regexp_extract(file, '[^/]*$'), '^.+(\.[^.]+)$', 1) AS kind, string_split(file, '/') AS parts FROM files),
    k AS (SELECT * FROM t WHERE (kind IN ({", ".join(f"'{x}'" for x in TEXT_SUFFIXES)}) OR name IN ('Makefile', 'Dockerfile')) AND NOT list_has_any(parts, [{", ".join(f"'{x}'" for x in IGNORED_FOLDERS)}])),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY len(parts), encode(file)) AS INTEGER) AS rank FROM k)
    SELECT snapshot_id, file, left(content, 3000) AS content, rank FROM r WHERE rank <= 20"""
)
def shallowest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 shallowest text files of each snapshot, cut to 3,000 characters (a report's excerpt)."""
    return snapshot_sources(repo_files(spark, sf_dir), ["snapshot_id"])


@query(f"WITH {_FILES} SELECT snapshot_id, file, greatest(1, length(content) // 4) AS tokens, octet_length(encode(content)) AS bytes FROM files")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).select("snapshot_id", "file", token_estimate(F.col("content")).cast("long").alias("tokens"), F.octet_length("content").cast("long").alias("bytes")).distinct()


@query(f"WITH {_FILES}, b AS (SELECT snapshot_id, file, CAST(octet_length(encode(content)) AS DOUBLE) AS n FROM files) SELECT snapshot_id, file, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) ELSE printf('%.1f MB', n / 1048576) END AS size, regexp_extract(regexp_extract(file, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS suffix, regexp_extract(file, '[^/]*$') AS name FROM b")
def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_sizes(spark, sf_dir).select("snapshot_id", "file", human_size(F.col("bytes")).alias("size"), suffix(F.col("file")).alias("suffix"), basename(F.col("file")).alias("name"))


# ---------------------------------------------------------------- dependencies


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "repo_snapshot").select("snapshot_id", F.explode("dependency_files").alias("file", "content"))
    return rows.distinct()


_DEPS = rf"""WITH d AS (SELECT DISTINCT snapshot_id, e.key AS file, e.value AS content FROM (SELECT snapshot_id, unnest(map_entries(dependency_files)) AS e FROM repo_snapshot)),
 req AS (SELECT snapshot_id, file, {_strip_sql("t")} AS t FROM (SELECT snapshot_id, file, unnest({_lines_sql("content")}) AS t FROM d WHERE regexp_matches(file, '(^|/)requirements\.txt$'))),
 req2 AS (SELECT snapshot_id, file, 'PyPI' AS ecosystem, CASE WHEN regexp_matches(t, '^([A-Za-z0-9_.-]+)\s*([><=!~]+)\s*(.+)') THEN regexp_extract(t, '^([A-Za-z0-9_.-]+)\s*([><=!~]+)\s*(.+)', 1) ELSE {_strip_sql("split_part(split_part(t, ';', 1), '[', 1)")} END AS name,
   CASE WHEN regexp_matches(t, '^([A-Za-z0-9_.-]+)\s*([><=!~]+)\s*(.+)') THEN {_strip_sql(r"regexp_extract(t, '^([A-Za-z0-9_.-]+)\s*([><=!~]+)\s*(.+)', 3)")} ELSE '*' END AS version FROM req WHERE t != '' AND t[1:1] NOT IN ('#', '-')),
 js AS (SELECT snapshot_id, file, unnest(['dependencies', 'devDependencies']) AS section, content FROM d WHERE regexp_matches(file, '(^|/)package\.json$') AND json_valid(content)),
 js2 AS (SELECT snapshot_id, file, 'npm' AS ecosystem, unnest(json_keys(content, '$.' || section)) AS name, section, content FROM js),
 gm AS (SELECT snapshot_id, file, 'Go' AS ecosystem, unnest(regexp_extract_all(content, '(?m)^\s+\S+\s+v[\d.]+\S*')) AS x FROM d WHERE regexp_matches(file, '(^|/)go\.mod$')),
 deps AS (SELECT snapshot_id, file, ecosystem, name, version FROM req2 WHERE name != '' UNION ALL SELECT snapshot_id, file, ecosystem, name, regexp_replace(content ->> ('$.' || section || '."' || name || '"'), '^[\^~]+', '') FROM js2 UNION ALL SELECT snapshot_id, file, ecosystem, regexp_extract(x, '(\S+)\s+(v[\d.]+\S*)$', 1), regexp_extract(x, '(\S+)\s+(v[\d.]+\S*)$', 2) FROM gm) """


@query(_DEPS + "SELECT * FROM deps")
def dependency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.dependencies(manifests(spark, sf_dir), "snapshot_id")


ADVISORIES = """[{"id":"ADV-1","summary":"one","severity":[{"type":"CVSS_V3","score":"9.8"}],"affected":[{"package":{"name":"drata0","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":[{"introduced":"0"},{"fixed":"5.0.0"},{"fixed":"6.0.0"}]}]}],"references":[{"type":"WEB","url":""},{"type":"WEB","url":"https://advisories.example/1"}],"aliases":["A-1"]},
{"id":"ADV-2","severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N"}],"affected":[{"package":{"name":"tolmar1","ecosystem":"npm"},"ranges":[]}]},
{"id":"ADV-3","summary":"three","severity":[{"type":"CVSS_V2","score":"4.0"}],"affected":[{"ranges":[{"type":"SEMVER","events":[{"fixed":"1.2"}]}]}]},
{"id":"ADV-4","affected":[{"package":{"name":"drata0","ecosystem":"npm"},"ranges":[{"type":"SEMVER","events":[{"fixed":"1.0.0"}]}]}]}]"""


def advisories(spark: SparkSession) -> DataFrame:
    return deps.advisory_rows(spark.createDataFrame([(ADVISORIES,)], "vulns string"))


@query("SELECT * FROM (VALUES ('ADV-1', 'critical', '5.0.0', 'https://advisories.example/1', 'drata0'), ('ADV-2', 'unknown', '', '', 'tolmar1'), ('ADV-3', 'medium', '1.2', '', NULL), ('ADV-4', 'unknown', '1.0.0', '', 'drata0')) t(advisory, severity, fixed_in, url, name)")
def advisory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, first fix, first address and package of advisories."""
    return advisories(spark).select("advisory", "severity", "fixed_in", "url", "name")


_PARTS = "list_transform(string_split(regexp_replace({c}, '^v', ''), '.'), lambda x: try_cast(x AS INTEGER))"


@query(_DEPS + "SELECT DISTINCT snapshot_id, name, version, advisory FROM deps JOIN (VALUES ('ADV-1', 'drata0', 'npm', '5.0.0'), ('ADV-2', 'tolmar1', 'npm', ''), ('ADV-4', 'drata0', 'npm', '1.0.0')) a(advisory, aname, aeco, fixed) ON name = aname AND ecosystem = aeco WHERE version = '*' OR fixed = '' OR NOT (" + _PARTS.replace("{c}", "version") + " >= " + _PARTS.replace("{c}", "fixed") + ")")
def vuln_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.vulnerable(dependency_list(spark, sf_dir), advisories(spark)).select("snapshot_id", "name", "version", "advisory").distinct()


# ---------------------------------------------------------------- documents

_BLOCK = r"(?s)```\w*\n.*?```"
_MD = rf"""md AS (SELECT snapshot_id, file, content FROM files WHERE ends_with(file, '.md')),
 b0 AS (SELECT snapshot_id, file, regexp_extract_all(content, '{_BLOCK}') AS blocks, regexp_split_to_array(content, '{_BLOCK}') AS parts FROM md WHERE contains(content, '```')),
 b1 AS (SELECT *, unnest(blocks) AS block, unnest(generate_series(0, len(blocks) - 1)) AS i FROM b0 WHERE len(blocks) > 0),
 b2 AS (SELECT snapshot_id, file, CAST(i AS INTEGER) AS block_index, lower(regexp_extract(block, '^```(\w*)', 1)) AS tag, {_strip_sql(r"regexp_extract(block, '(?s)^```\w*\n(.*?)```', 1)")} AS code, array_to_string(parts[1:i + 1], '') || coalesce(array_to_string(blocks[1:i], ''), '') AS before FROM b1),
 blocks AS (SELECT snapshot_id, file, block_index, CASE WHEN tag = '' THEN 'text' ELSE tag END AS language, code, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line_number FROM b2),
 issues AS (SELECT snapshot_id, file, block_index, 'untagged block' AS issue FROM blocks WHERE language = 'text' AND code != '' UNION ALL SELECT snapshot_id, file, block_index, 'single-line example' FROM blocks WHERE language IN ('python', 'py', 'bash', 'sh') AND len({_lines_sql("code")}) = 1)"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).where(F.endswith("file", F.lit(".md")))


@query(f"WITH {_FILES}, {_MD} SELECT *, language IN ('python', 'py', 'bash', 'sh', 'shell') AS runnable FROM blocks")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.code_blocks(_markdown(spark, sf_dir), ["snapshot_id", "file"], "content").distinct()


@query(f"WITH {_FILES}, {_MD} SELECT * FROM issues")
def docs_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.block_issues(code_blocks(spark, sf_dir), ["snapshot_id", "file"]).select("snapshot_id", "file", "block_index", "issue")


@query(f"WITH {_FILES}, {_MD}, h AS (SELECT m.snapshot_id, m.file, CAST((SELECT count(*) FROM blocks b WHERE b.snapshot_id = m.snapshot_id AND b.file = m.file) AS INTEGER) AS blocks, CAST((SELECT count(*) FROM issues i WHERE i.snapshot_id = m.snapshot_id AND i.file = m.file) AS INTEGER) AS issues FROM md m) SELECT *, CASE WHEN blocks = 0 THEN 70 ELSE greatest(60, 95 - 3 * issues) END AS score FROM h")
def docs_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = code_blocks(spark, sf_dir)
    issues = docs.block_issues(blocks, ["snapshot_id", "file"])
    return docs.docs_health(_markdown(spark, sf_dir).select("snapshot_id", "file").distinct(), blocks, issues, ["snapshot_id", "file"]).drop("errors", "warnings")


# ---------------------------------------------------------------- pull requests


def _parts_sql(parts) -> str:
    return "(" + " OR ".join(f"contains(n, {_q(p)})" for p in parts) + ")"


@query(
    f"""WITH {_PATCHES}, c AS (SELECT pr_id, ordinal, file, lower(file) AS n, additions + deletions AS size FROM patches),
    k AS (SELECT pr_id, ordinal, file, size, CASE WHEN {_parts_sql(review.SAFE)} THEN 'safe' {" ".join(f"WHEN {_parts_sql(v)} THEN '{k}'" for k, v in review.RISKY.items())} WHEN size > 200 THEN 'large' ELSE 'standard' END AS category FROM c)
    SELECT pr_id, ordinal, file, category, CASE WHEN category IN ('security', 'config', 'database', 'api') AND size > 100 THEN 'high' WHEN category IN ('security', 'config', 'database', 'api', 'large') THEN 'medium' END AS severity FROM k"""
)
def pr_static_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.triage(patches(spark, sf_dir)).select("pr_id", "ordinal", "file", "category", "severity")


@query(
    f"""WITH {_PATCHES}, s AS (SELECT pr_id, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, count(DISTINCT CASE WHEN contains(file, '.') THEN nullif(regexp_extract(file, '\\.([^.]*)$', 1), '') END) AS extensions, count(DISTINCT CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) END) AS folders FROM patches GROUP BY pr_id)
    SELECT *, CASE WHEN additions + deletions < 100 THEN 'low' WHEN additions + deletions < 500 THEN 'medium' ELSE 'high' END AS impact FROM s"""
)
def pr_summary_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = review.summary(patches(spark, sf_dir))
    return told.select("pr_id", "files", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), F.size("extensions").cast("long").alias("extensions"), F.size("folders").cast("long").alias("folders"), "impact")


@query(
    f"""WITH {_PATCHES}, e AS (SELECT *, CASE WHEN contains(file, '.') THEN nullif(regexp_extract(file, '\\.([^.]*)$', 1), '') END AS ext, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) END AS folder FROM patches),
    s AS (SELECT pr_id, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, list_sort(list(DISTINCT ext) FILTER (ext IS NOT NULL)) AS extensions, list_sort(list(DISTINCT folder) FILTER (folder IS NOT NULL)) AS folders,
      bool_or(contains(lower(file), 'test')) AS tests, bool_or(file IN ('pyproject.toml', 'package.json', 'requirements.txt', 'go.mod')) AS deps, list(file ORDER BY additions + deletions DESC, ordinal)[1:5] AS key_changes FROM e GROUP BY pr_id)
    SELECT pr_id, files, additions, deletions, coalesce(array_to_string(extensions, ','), '') AS extensions, coalesce(array_to_string(folders, ','), '') AS folders, array_to_string(key_changes, ',') AS key_changes, CASE WHEN additions + deletions < 100 THEN 'low' WHEN additions + deletions < 500 THEN 'medium' ELSE 'high' END AS impact,
      coalesce(nullif(concat_ws(',', CASE WHEN list_has_any(coalesce(extensions, []), ['md', 'rst', 'txt']) THEN 'docs' END, CASE WHEN tests OR list_has_any(coalesce(extensions, []), ['test', 'spec']) THEN 'test' END, CASE WHEN deps THEN 'deps' END), ''), 'feature') AS categories FROM s"""
)
def pr_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = review.summary(patches(spark, sf_dir))
    return told.select("pr_id", "files", F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), *[F.concat_ws(",", c).alias(c) for c in ("extensions", "folders", "key_changes", "categories")], "impact")


@query(
    f"""WITH p AS (SELECT DISTINCT ON (pr_id) * FROM pr), f AS (SELECT pr_id, list_transform(files, lambda f: '### ' || f.filename || ' (' || coalesce(f.status, '') || ', +' || coalesce(f.additions, 0) || ' -' || coalesce(f.deletions, 0) || ')' || chr(10) || coalesce(array_to_string({_lines_sql("coalesce(f.patch, '')")}[1:80], chr(10)), '')) AS parts FROM p)
    SELECT p.pr_id, 'Pull request ' || number || ': ' || coalesce(title, '') || chr(10) || 'Author: ' || coalesce(author, '') || chr(10) || 'Branches: ' || coalesce(head_branch, '') || ' into ' || coalesce(base_branch, '') || chr(10) || 'Changes: +' || coalesce(additions, 0) || ' -' || coalesce(deletions, 0) || ' in ' || coalesce(changed_files, 0) || ' files' || chr(10) || 'Labels: ' || coalesce(nullif(array_to_string(labels, ', '), ''), 'none')
      || chr(10) || chr(10) || 'Description:' || chr(10) || coalesce(body, '(no description)') || chr(10) || chr(10) || 'Files:' || chr(10) || coalesce(array_to_string(parts, chr(10) || chr(10)), '') AS prompt FROM p JOIN f ON f.pr_id = p.pr_id"""
)
def pr_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review prompts of medium detail; their sizes are the feature."""
    once = first_sent(table(spark, sf_dir, "pr"), "pr_id", "fetched_at")
    return review_prompt(once)


# ---------------------------------------------------------------- cache


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files to analyse, and a cache in which every other document has changed since."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    files = d.select(F.lit("quality").alias("analyzer"), F.col("doc_id").cast("string").alias("filepath"), F.sha2("text", 256).alias("file_hash"))
    kept = d.select(F.lit("quality").alias("analyzer"), F.col("doc_id").cast("string").alias("filepath"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("changed").alias("file_hash"), F.lit("1").alias("version"), F.lit("c").alias("config_hash"), F.col("created_at").alias("ts"), F.coalesce("lang", F.lit("")).alias("data"))
    return files, kept


_NOW = "2024-07-01 00:00:00"
_CACHE = f"WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS filepath, CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE 'changed' END AS file_hash, sha256(text) AS own, epoch(TIMESTAMPTZ '{_NOW}+00') - epoch(created_at) <= 31536000 AS live, coalesce(lang, '') AS data FROM documents WHERE text IS NOT NULL) "


def _how() -> dict:
    return {"version": "1", "now": F.to_timestamp(F.lit(_NOW + "Z"), "yyyy-MM-dd HH:mm:ssX"), "ttl_seconds": 31_536_000}


@query(_CACHE + "SELECT filepath FROM c WHERE live AND own = file_hash")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _cache(spark, sf_dir)
    return cachetable.hits(files, kept, **_how()).select("filepath")


@query(_CACHE + "SELECT filepath FROM c WHERE NOT (coalesce(live, false) AND own = file_hash)")
def uncached_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, kept = _cache(spark, sf_dir)
    return cachetable.work_list(files, kept, **_how()).select("filepath")


@query(_CACHE + "SELECT 'quality' AS analyzer, count(*) AS entries, count(*) FILTER (live) AS valid, count(*) FILTER (NOT live) AS expired, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM c")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cachetable.stats(_cache(spark, sf_dir)[1], **_how())


# ---------------------------------------------------------------- events as editor and call logs


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, count(*) AS changes, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, n")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, an hour apart."""
    return debounced(table(spark, sf_dir, "events"), key="user_id", quiet="1 hour").select("user_id", "changes", F.unix_micros(F.col("last_change").cast("timestamp")).alias("last_us"))


@query("WITH w AS (SELECT value, unnest(generate_series(0, 5)) AS k, time_bucket(INTERVAL 10 SECOND, ts) AS b FROM events) SELECT epoch_us(b - k * INTERVAL 10 SECOND) AS from_us, count(*) AS requests FROM w GROUP BY 1")
def rate_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in sliding windows of 60 seconds."""
    calls = table(spark, sf_dir, "events").select("ts", F.lit(1).alias("tokens"))
    return rate_windows(calls).select(F.unix_micros(F.col("from").cast("timestamp")).alias("from_us"), "requests")


@query("SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id")
def latest_result_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_per_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_type"), key="user_id")
    return rows.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"))


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) <= 604800")
def unexpired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return unexpired(rows, ttl_seconds=604_800, now=F.to_timestamp(F.lit("2024-01-31 00:00:00Z"), "yyyy-MM-dd HH:mm:ssX")).select("event_id")


# ---------------------------------------------------------------- rules and plugins

BAD_RULES = (Rule("A", "low", "ok"), Rule("A", "low", "ok"), Rule("B", "low", "("), Rule("C", "odd", ""), Rule("D", "low", type="threshold"), Rule("E", "low", type="threshold", metric="size", max_value=1), Rule("F", "low", type="ast", ast_check="no-goto"), *[Rule(n, s, type="ast", ast_check=n) for n, s in AST_RULES.items()])


@query("SELECT * FROM (VALUES ('A', 'id'), ('B', 'pattern'), ('C', 'pattern'), ('C', 'severity'), ('D', 'metric'), ('D', 'max_value'), ('E', 'metric'), ('F', 'ast_check')) t(rule_id, field)")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything wrong with a list of rules."""
    return spark.createDataFrame(validate(BAD_RULES, spark), "rule_id string, field string, message string").select("rule_id", "field")


@query("WITH r AS (SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS n FROM (VALUES (1, 'A'), (2, 'B'), (3, 'A'), (4, 'A')) t(seq, rule_id)) SELECT rule_id, n FROM r WHERE n > 1")
def duplicate_rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "A")], "seq int, rule_id string")
    return rows.selectExpr("rule_id", "CAST(row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS BIGINT) AS n").where("n > 1")


@query("SELECT name, d AS missing FROM (SELECT name, unnest(dependencies) AS d FROM (VALUES ('a', []), ('b', ['a', 'x']), ('c', ['b', 'y'])) t(name, dependencies)) WHERE d NOT IN ('a', 'b', 'c')")
def missing_plugin_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", []), ("b", ["a", "x"]), ("c", ["b", "y"])], "name string, dependencies array<string>")
    return rows.select("name", F.explode("dependencies").alias("missing")).join(rows.select(F.col("name").alias("missing")), "missing", "left_anti").select("name", "missing")
