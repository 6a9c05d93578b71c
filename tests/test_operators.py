import datetime
import json

from pyspark.sql import functions as F

from lintlake.operators import cachetable, deps, docs, fixes, review, scoreboard
from lintlake.plans.model_calls import Limited, Window60, answered, with_retries
from lintlake.plans.plugins import Option, Plugin, Registry, run_order, run_plugins
from lintlake.plans.report import html_page, json_rows, markdown_table
from lintlake.sources import documents, tree
from lintlake.streaming import streams


def test_leaderboard(spark):
    rows = [(1, "t1", "a", {"reviews": 2.0, "complexity_avg": 20.25, "fix_count": 1.0}), (2, "t2", "a", {"complexity_avg": 20.45}), (3, "t3", "b", {}), (4, "t4", "c", {"reviews": None, "security_issues": 1.0}), (5, "t5", "b", {"reviews": float("nan")})]
    df = spark.createDataFrame([*rows, rows[0]], "seq int, ts string, author string, metrics map<string,double>")
    board = scoreboard.ranked(scoreboard.leaderboard(scoreboard.once(df))).orderBy("place").collect()
    assert [(r["author"], r["reviews"]) for r in board] == [("b", 1.0), ("a", 3.0), ("c", 0.0)]
    top = {r["author"]: r for r in board}
    assert top["a"]["avg_complexity"] == round((20.25 + 20.45) / 2, 1) and top["a"]["reviews"] == 3.0 and top["b"]["avg_complexity"] == 0.0
    assert scoreboard.latest(df).first()["seq"] == 5
    assert [r["value"] for r in scoreboard.trend(scoreboard.once(df), "complexity_avg", "a").collect()] == [20.25, 20.45]
    assert [r["seq"] for r in scoreboard.last_entries(scoreboard.once(df), 2).collect()] == [5, 4]


def test_manifests(spark):
    req = "requests[security]==2.0\n# c\n-r x\nflask>=2,<3 ; python_version > '3'\nbare ; x\n  pin ~= 1.0  \n"
    pkg = json.dumps({"dependencies": {"@a/b": "^~1.2"}, "devDependencies": {"c": "*"}})
    rows = spark.createDataFrame([("x/requirements.txt", req), ("package.json", pkg), ("package.json", "{bad"), ("go.mod", "module m\n\nrequire (\n\tx/y v1.2.3-rc1\n)\nz v1\n"), ("pyproject.toml", "x = 1")], "file string, content string")
    got = sorted((r["ecosystem"], r["name"], r["version"]) for r in deps.dependencies(rows).collect())
    assert got == [("Go", "x/y", "v1.2.3-rc1"), ("PyPI", "bare", "*"), ("PyPI", "flask", "2,<3 ; python_version > '3'"), ("PyPI", "pin", "1.0"), ("PyPI", "requests", "*"), ("npm", "@a/b", "1.2"), ("npm", "c", "*")]
    v = spark.createDataFrame([("1.10", "1.9"), ("v2.0", "2"), ("1.x", "1.1"), ("0.9", "1")], "a string, b string")
    assert [r[0] for r in v.select(deps.version_at_least(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_code_blocks(spark):
    text = "# a\n```\nx\n```\ntext\n```Python\nprint(1)\n```\n```shell\nls\n```\n\n```py\na\nb\n```"
    rows = spark.createDataFrame([(1, text), (2, "no blocks"), (3, ""), (4, None)], "id int, text string")
    blocks = docs.code_blocks(rows, ["id"])
    assert [(r["language"], r["line_number"], r["runnable"]) for r in blocks.orderBy("block_index").collect()] == [("text", 2, False), ("python", 6, True), ("shell", 9, True), ("py", 13, True)]
    issues = docs.block_issues(blocks, ["id"])
    assert sorted(r["issue"] for r in issues.collect()) == ["single-line example", "untagged block"]
    assert {r["id"]: r["score"] for r in docs.docs_health(rows.select("id"), blocks, issues, ["id"]).collect()} == {1: 89, 2: 70, 3: 70, 4: 70}


def test_cache(spark):
    now = datetime.datetime(2024, 1, 10)
    cache = spark.createDataFrame([("x", "a", "h", "1", "c", datetime.datetime(2024, 1, 9), "d"), ("x", "b", "old", "1", "c", datetime.datetime(2024, 1, 9), "d"), ("x", "c", "h", "1", "c", datetime.datetime(2023, 1, 1), "d"), ("x", "d", "h", "0", "c", datetime.datetime(2024, 1, 9), None)], "analyzer string, filepath string, file_hash string, version string, config_hash string, ts timestamp, data string")
    files = spark.createDataFrame([("x", k, "h") for k in "abcde"], "analyzer string, filepath string, file_hash string")
    how = {"version": "1", "now": F.lit(now)}
    assert [r["filepath"] for r in cachetable.hits(files, cache, **how).collect()] == ["a"]
    assert sorted(r["filepath"] for r in cachetable.work_list(files, cache, **how).collect()) == list("bcde")
    assert cachetable.hits(files, cache, config_hash="other", **how).count() == 0
    assert tuple(cachetable.stats(cache, **how).first()) == ("x", 4, 2, 2, 3)
    assert cachetable.merged(cache, cache.where("filepath = 'a'").withColumn("file_hash", F.lit("n"))).where("file_hash = 'n'").count() == 1


def test_review(spark):
    files = [("README.md", 500, 0), ("src/auth.py", 60, 50), ("big.py", 150, 51), ("x.py", 1, 1), ("conf.yml", 1, 0)]
    rows = spark.createDataFrame([(1, i, f, a, d) for i, (f, a, d) in enumerate(files)], "pr_id int, ordinal int, file string, additions int, deletions int")
    got = {r["file"]: (r["category"], r["severity"]) for r in review.triage(rows).collect()}
    assert got == {"README.md": ("safe", None), "src/auth.py": ("security", "high"), "big.py": ("large", "medium"), "x.py": ("standard", None), "conf.yml": ("config", "medium")}
    s = review.summary(rows).first()
    assert (s["impact"], s["extensions"], s["folders"], s["categories"], s["key_changes"][:2]) == ("high", ["md", "py", "yml"], ["src"], ["docs"], ["README.md", "big.py"])
    added = spark.createDataFrame([(1, "a.py", 2, "b"), (1, "a.py", 1, "a"), (1, "a.js", 1, "x")], "pr_id int, file string, line int, text string")
    assert [tuple(r) for r in review.python_additions(added, ["pr_id"]).collect()] == [(1, "a.py", "a\nb")]


def test_fixes_and_contexts(spark):
    found = spark.createDataFrame([("SEC001", "critical", "a.py", 3, "k"), ("SEC004", "high", "a.py", 1, "x"), ("VLN005", "low", "b.py", None, None)], "rule_id string, severity string, file string, line int, match string")
    assert [r["rule_id"] for r in fixes.suggested(found, 2, "file").collect()] == ["SEC001"]
    assert fixes.suggested(found).where("rule_id = 'VLN005'").first()["diff"].startswith("--- a/b.py\n+++ b/b.py\n@@ -1,1 +1,1 @@\n-\n+# TODO: ")
    files = spark.createDataFrame([("a.py", "\n".join("l%d" % i for i in range(1, 20)))], "file string, content string")
    shown = {r["line"]: r["context"].split("\n") for r in fixes.contexts(found, files, ["file"], 2).collect()}
    assert shown[3] == ["       1 | l1", "       2 | l2", ">>>    3 | l3", "       4 | l4", "       5 | l5"] and len(shown[1]) == 3


def test_plugins(spark):
    def issues(path, content, settings):
        if "bad" in path:
            raise ValueError("no")
        yield {"message": settings["word"], "line": len(content), "severity": "info", "rule": "r", "metrics": {"n": 1.0}}

    word = Option("word", str, default="hi", choices=("hi", "ho"))
    one = Plugin("one", issues, options=(word,), priority=50, dependencies=("two",))
    two = Plugin("two", lambda p, c, s: [], priority=90)
    three = Plugin("three", issues, options=(word,), priority=10, languages=("Python",))
    registry = Registry()
    for p in (one, two, three, Plugin("lost", issues, dependencies=("none",)), Plugin("new", issues, needs="9.1")):
        registry.register(p)
    chosen = registry.usable("1.0.x")
    assert run_order(chosen) == ["three", "two", "one"]
    loop = {"a": Plugin("a", issues, dependencies=("b",), priority=2), "b": Plugin("b", issues, dependencies=("a",), priority=1)}
    assert run_order(loop) == ["b", "a"]
    files = spark.createDataFrame([("x.py", "abc"), ("bad.js", "d")], "file string, content string")
    rows = sorted((r["plugin"], r["file"], r["line"], r["error"]) for r in run_plugins(files, chosen, {"one": {"word": "ho"}}).collect())
    assert rows == [("one", "bad.js", None, "ValueError: no"), ("one", "x.py", 3, None), ("three", "x.py", 3, None)]
    for wrong in ({"word": "x"}, {"other": 1}):
        try:
            one.settings(wrong)
            raise AssertionError
        except ValueError:
            pass


def test_model_calls(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise Limited(5)
        if len(calls) == 2:
            raise OSError
        return "ok"

    waits = []
    assert with_retries(flaky, sleep=waits.append)("p") == "ok" and waits == [5, 2.0]
    clock = [0.0]
    window = Window60(2, 100, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    for tokens in (50, 60, 500, 1):
        window.acquire(tokens)
    assert clock[0] >= 120
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")
    off = answered(prompts, "m", None)
    assert [r["answer"] for r in off.collect()] == [None, None]
    cache = off.where("prompt = 'a'").select("key", F.lit("known").alias("answer"))
    on = answered(prompts, "m", lambda p: 1 / 0 if p == "x" else p.upper(), cache, retries=0)
    assert sorted((r["prompt"], r["answer"], r["error"]) for r in on.collect()) == [("a", "known", None), ("b", "B", None)]


def test_reports(spark):
    df = spark.createDataFrame([("a|b", None), ("<x>", 2)], "s string, n int")
    assert "a\\|b" in markdown_table(df, "t") and "&lt;x&gt;" in html_page("t", [("s", df)], [("card", "<b>")])
    assert json.loads(json_rows(df).first()["json"]) == {"s": "a|b", "n": None}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = '\xff\xc3\xa9'\n")
    (tmp_path / "src" / "big.py").write_bytes(b"#" * 2000)
    (tmp_path / "node_modules" / "b.py").write_text("no")
    (tmp_path / "c.md").write_text("# c")
    got = {r["file"]: r["content"] for r in tree.read_tree(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {"src/a.py": "x = 'é'\n", "src/big.py": None, "c.md": "# c"}
    assert [r["file"] for r in tree.read_tree(spark, str(tmp_path), suffixes=[".md"]).collect()] == ["c.md"]
    assert [r["file"] for r in tree.read_tree(spark, str(tmp_path), ignore_file=["*.py"]).collect()] == ["c.md"]
    listed = spark.createDataFrame([(1, f) for f in ("b.py", "a/z.py", "a/b/c/d/e.py")], "id int, file string")
    assert tree.tree_text(listed, ["id"]).first()["tree"].split("\n") == ["├── a", "│   ├── b", "│   │   └── c", "│   │       └── d", "│   │           └── e.py", "│   └── z.py", "└── b.py"]
    (tmp_path / "h.json").write_text(json.dumps([{"timestamp": "t", "author": "a", "metrics": {"reviews": 1}, "unknown": 1}, {"timestamp": "u", "author": "b", "metrics": {}}]))
    assert [r["author"] for r in documents.read_history(spark, str(tmp_path / "h.json")).orderBy("seq").collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text("{[")
    assert documents.read_history(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"id": "R", "pattern": "x", "flags": ["IGNORECASE"]}, {"pattern": "no id"}, {"id": "T", "type": "threshold", "metric": "length", "max": "9"}]}))
    rules = documents.rules_of({"builtin": ["no-eval"], "custom": [{"id": "C", "pattern": "y", "severity": "HIGH"}], "files": ["r.json"]}, tmp_path)
    assert [(r.id, r.pattern, r.max_value) for r in rules] == [("no-eval", "", None), ("C", "y", None), ("R", "(?i)x", None), ("T", "", 9)]
    assert documents.rules_of({"enabled": False}) == [] and len(documents.rules_of({})) == 6
    assert documents.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    (tmp_path / ".lintlakeignore").write_text("x\n")
    assert documents.find_ignore(tmp_path / "src") == ["x"]


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [("a", base), ("a", base + datetime.timedelta(milliseconds=500)), ("a", base + datetime.timedelta(seconds=9)), ("b", base)]
    df = spark.createDataFrame(rows, "uri string, ts timestamp")
    batch = sorted((r["uri"], r["changes"]) for r in streams.debounced(df).collect())
    assert batch == [("a", 1), ("a", 2), ("b", 1)]
    folder = str(tmp_path / "in")
    df.write.parquet(folder)
    later = spark.createDataFrame([("z", base + datetime.timedelta(days=1))], "uri string, ts timestamp")
    stream = streams.debounced(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(folder))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    later.write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert sorted((r["uri"], r["changes"]) for r in spark.table("bursts").collect()) == batch
    q = streams.arrivals(spark, folder, df.schema, lambda b: b.groupBy("uri").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == 5
    assert streams.latest_per_key(df).where("uri = 'a'").first()["ts"] == base + datetime.timedelta(seconds=9)


def test_expiry(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    schema = "key string, ts timestamp"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put([("a", base), ("b", base + datetime.timedelta(seconds=50))])
    stream = spark.readStream.schema(schema).parquet(folder)
    q = streams.expiring(stream, ttl_seconds=60, late="0 seconds").writeStream.format("memory").queryName("expiry").outputMode("append").start()
    q.processAllAvailable()
    put([("c", base + datetime.timedelta(seconds=100))])
    q.processAllAvailable()
    put([("d", base + datetime.timedelta(seconds=101))])
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["state"]) for r in spark.table("expiry").collect()}
    assert {("a", "set"), ("b", "set"), ("c", "set"), ("a", "expired")} <= got and ("c", "expired") not in got and ("b", "expired") not in got
    assert streams.first_seen(spark.createDataFrame([("a", base), ("a", base)], "uri string, ts timestamp")).count() == 1


def test_editor(spark):
    from lintlake.plans.editor import analysed, diagnostics, guide

    rows = spark.createDataFrame([("R", "critical", 1, "unused x"), (None, "odd", None, None), ("deprecated-call", "info", 7, "old")], "rule_id string, severity string, line int, message string")
    got = [(r["line"], r["end_line"], r["level"], r["code"], r["tags"]) for r in diagnostics(rows, "rules").collect()]
    assert got == [(0, 0, 1, "lintlake/rules/R", ["unnecessary"]), (0, 0, 3, "lintlake/rules/rules-issue", []), (6, 6, 4, "lintlake/rules/deprecated-call", ["deprecated"])]
    heads = spark.createDataFrame([(1, ["src/main.py", "README.md", "app.py"], ["package.json", "requirements.txt"], ["Python", "Go", "C"]), (2, None, None, None)], "id int, files array<string>, manifests array<string>, languages array<string>")
    one, two = guide(heads).orderBy("id").collect()
    assert (one["entry_points"], one["setup"], one["key_files"], one["stack"]) == (["app.py"], "pip install -r requirements.txt", ["README.md", "app.py", "src/main.py"], "Python, Go")
    assert (two["entry_points"], two["setup"], two["key_files"], two["stack"]) == (["See README for entry points"], None, [], "unknown")
    uris = spark.createDataFrame([("file:///a.py",), ("a.py",), ("file:///a.PY",)], "u string")
    assert [r[0] for r in uris.select(analysed(F.col("u"))).collect()] == [True, False, False]


def test_rounding_by_binary_values(spark):
    import random

    from lintlake.functions.grades import half_even_1

    rng = random.Random(3)
    values = [0.25, 0.35, 0.05, -0.25, -0.35, 10.05, 2.5, 1e300, float("inf"), 0.0, -0.0, 1e14 + 0.25, *[round(rng.uniform(-50, 50), 2) for _ in range(3000)], *[rng.uniform(-1e6, 1e6) for _ in range(3000)], *[k / 20 for k in range(-400, 400)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even_1(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in rows] == [round(r["v"], 1) if abs(r["v"]) < 1e15 else r["v"] for r in rows]


def test_whole_board(spark):
    from lintlake.operators.scoreboard import ranked

    board = spark.createDataFrame([(f"a{i}", float(i % 17), i) for i in range(500)], "author string, score double, first_seq int").repartition(7)
    want = {a: k for k, (_, _, a) in enumerate(sorted((-(i % 17), i, f"a{i}") for i in range(500)), 1)}
    assert {r["author"]: r["place"] for r in ranked(board).collect()} == want
    assert {r["author"]: r["place"] for r in ranked(board, 3).collect()} == {a: k for a, k in want.items() if k <= 3}


def test_pages(spark):
    from lintlake.functions.rules import described
    from lintlake.plans import pages

    found = spark.createDataFrame([("SEC009", "high", "a<b>.py", 3, "password = 'x' * 2" + "y" * 80), ("VLN004", "medium", "c.py", 1, "eval(x)"), ("own", None, None, None, None)], "rule_id string, severity string, file string, line int, match string")
    told = described(found)
    assert [r["title"] for r in told.collect()] == ["password", "dynamic evaluation", None]
    functions = spark.createDataFrame([(f"f{i}", "a.py", i) for i in range(70)], "name string, file string, cyclomatic int")
    issues = spark.createDataFrame([(f"{i:02d}.md", 0, "untagged block") for i in range(30)], "file string, block_index int, issue string")
    sections = pages.dashboard_sections(functions=functions, findings=told, issues=issues, violations=found)
    by = {x.name: x for x in sections}
    assert len(by["complexity"].rows) == 50 and by["complexity"].chart["values"][0] == 69 and len(by["complexity"].chart["labels"]) == 15
    assert len(by["docs"].rows) == 20 and dict(zip(by["security"].chart["labels"], by["security"].chart["values"])) == {"high": 1, "medium": 1, "none": 1}
    text = pages.page("t<", sections, {"findings": 3})
    assert "a&lt;b&gt;.py" in text and "<b>.py" not in text and "t&lt;" in text
    scan = {"pr_number": 5, "score": 80, "grade": "B", "files_scanned": 1, "total_files": 2}
    body = pages.security_comment(scan, told.where("severity is not null"))
    assert "🟡 score 80/100" in body and "| High | 1 |" in body and body.index("password") < body.index("dynamic") and "..." in body
    assert "No security issues" in pages.security_comment({**scan, "score": 95}, told.where("false"))
    assert "✅" in pages.review_comment(1, "Ready to merge", "s", [], []) and "⚠️" in pages.review_comment(1, "Needs changes", "s", [{"file": "a", "reason": "r"}], [])
    entries = spark.createDataFrame([(1, "2024-01-01", "ann", {"complexity_avg": 3.0}), (2, "2024-01-02", "bob<", {"reviews": 5.0})], "seq int, ts string, author string, metrics map<string,double>")
    board = pages.scoreboard_page(entries)
    assert "bob&lt;" in board and board.index("Podium") < board.index("Activity")
    assert pages.terminal_table(functions.orderBy("cyclomatic"), 2).split("\n")[2].split() == ["f0", "a.py", "0"]


def test_prompts(spark):
    from lintlake.plans import prompts

    files = [("a.py", "added", 3, 0, "\n".join(f"+l{i}" for i in range(300))), ("b.py", None, None, None, None)]
    prs = spark.createDataFrame([(1, 7, "T", None, "ann", "main", "dev", 3, 0, 2, [], files)], "pr_id int, number int, title string, body string, author string, base_branch string, head_branch string, additions int, deletions int, changed_files int, labels array<string>, files array<struct<filename string, status string, additions int, deletions int, patch string>>")
    text = lambda df: df.first()["prompt"]
    assert [text(prompts.review_prompt(prs, d)).count("+l") for d in ("low", "medium", "high", "odd")] == [30, 80, 200, 80]
    found = spark.createDataFrame([(1, "high", "x", "a.py"), (1, "high", "x", "a.py")], "pr_id int, severity string, title string, file string")
    secure = text(prompts.security_prompt(prs, found))
    assert secure.count("- [HIGH] x in a.py") == 1 and "(no description)" in secure and "--- b.py" not in secure
    assert "None" in text(prompts.security_prompt(prs, found.where("false")))
    assert len(text(prompts.task_prompt(spark.createDataFrame([(1, "z" * 90_000)], "id int, code string"), "review", "code", "id"))) < 51_000
    said = spark.createDataFrame([(1, '```json\n{"issues": [{"line": 3}, {"line": 4}]}\n```'), (2, '[{"line": 9}]'), (3, "no json"), (4, None)], "id int, answer string")
    got = [(r["id"], r["position"], r["item"]["line"]) for r in prompts.listed(said, "struct<line int>").orderBy("id", "position").collect()]
    assert got == [(1, 0, 3), (1, 1, 4), (2, 0, 9)]
    told = prompts.parsed(spark.createDataFrame([(1, 'So: {"summary": "s"} there'), (2, "nothing")], "id int, answer string"), "summary string", fallback=F.struct(F.lit("unable").alias("summary")))
    assert [r["said"]["summary"] for r in told.orderBy("id").collect()] == ["s", "unable"]
    issues = spark.createDataFrame([("a", 0, "i0"), ("a", 1, "i1"), ("b", 0, "j0")], "file string, index int, issue string")
    fixes = spark.createDataFrame([("a", 1, "fix"), ("a", 9, "lost")], "file string, issue_index int, replacement string")
    assert [(r["issue"], r["replacement"]) for r in prompts.fixed_issues(issues, fixes, "file").collect()] == [("i1", "fix")]
