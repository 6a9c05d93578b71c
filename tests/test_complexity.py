from pyspark.sql import functions as F

from lintlake.functions import bracemetrics, pymetrics
from lintlake.functions.rules import Rule
from lintlake.operators import complexity

PY = '''
class A:
    @property
    def m(self, a, /, b, *c, d=1, **e):
        if a and b and c:
            for x in b:
                try:
                    pass
                except ValueError:
                    with x: pass
        elif d:
            return 1 if a else 2
        return [y for y in b if y]

async def outer(x=[]):
    def inner(cls):
        while x or cls: assert x
    global g
    try: exec("1")
    except: eval("2")
from m import *
'''


def test_python_functions():
    got = {f[0]: f for f in pymetrics.functions(PY)}
    assert list(got) == ["m", "outer", "inner"]
    assert got["m"][3:] == (10, 10, 5, 12, 6)  # self is positional-only, so it counts
    assert got["outer"][4] == 1 + 1 + 1 + 1 + 1 + 1  # while, or and its operand, assert, except
    assert pymetrics.functions("def f(:") == [] == pymetrics.functions("\0")


def test_python_checks():
    found = [(c, d) for c, _, d in pymetrics.checks(PY, frozenset(["no-eval", "no-exec", "no-star-import", "no-mutable-default", "no-bare-except", "no-global"]))]
    assert sorted(found) == [("no-bare-except", "bare except"), ("no-eval", "call of eval"), ("no-exec", "call of exec"), ("no-global", "g"), ("no-mutable-default", "outer"), ("no-star-import", "m")]


def test_brace_languages():
    js = "export async function load(a, b) {\n  if (a && b) {\n    return a ?? b;\n  } else if (b) { return '}'; }\n}\nconst f = (x) => {\n  while (x) { x--; }\n};\nif (a) {\n}\n"
    got = {f[0]: f for f in bracemetrics.functions(js, "javascript")}
    assert set(got) == {"load", "f"}
    # 1, two ifs, else if, &&, ?? and the ? before a space
    assert got["load"][4:] == (7, 1, 6, 2)
    assert got["f"][1:4] == (6, 8, 3)
    go = "func (s *Store) Get(k string, n int) bool {\n\tfor {\n\t\tselect {}\n\t}\n}\n"
    assert bracemetrics.functions(go, "go")[0] == ("Get", 1, 5, 5, 3, 2, 5, 2)
    rust = "pub async fn run<T>(&self, x: T) {\n  loop { match x { _ => {} } }\n}"
    assert bracemetrics.functions(rust, "rust")[0][7] == 1
    java = "public int[] get(List<String> a, int b) throws X {\n return 1;\n}\nclass Q {}\n"
    assert [f[0] for f in bracemetrics.functions(java, "java")] == ["get"]
    assert bracemetrics.body_of("f { a { b }", 0) == ("{ a { b }", 11)


def test_operators_over_files(spark):
    files = spark.createDataFrame([(1, "a.py", PY), (1, "b.js", "function f(a) {\n if (a) { g() }\n}\n"), (2, "c.txt", "def f(): pass"), (2, "d.py", None), (2, "e.py", "def g(:")], "repo int, file string, content string")
    functions = complexity.measured_functions(files, ["repo"])
    assert {(r["repo"], r["file"], r["name"], r["risk"]) for r in functions.collect()} == {(1, "a.py", "m", "medium"), (1, "a.py", "outer", "low"), (1, "a.py", "inner", "low"), (1, "b.js", "f", "low")}
    assert {r["rule_id"] for r in complexity.ast_violations(files, ["repo"]).collect()} >= {"no-eval", "no-global"}
    heads = files.select("repo", "file").distinct()
    per = {(r["repo"], r["file"]): (r["functions"], r["max_cyclomatic"]) for r in complexity.file_complexity(heads, functions, ["repo", "file"]).collect()}
    assert per[2, "c.txt"] == (0, 0) and per[1, "a.py"] == (3, 10)
    assert complexity.report(functions, ["repo"]).first()["grade"] == "B"
    rules = [Rule("T1", "low", type="threshold", metric="cyclomatic", max_value=9), Rule("T2", "low", type="threshold", metric="nesting", max_value=0), Rule("T3", "low", type="threshold", metric="params", max_value=0, include=(r"\.js$",)), Rule("T4", "low", type="threshold", metric="params", max_value=0, enabled=False)]
    assert sorted((r["rule_id"], r["name"]) for r in complexity.threshold_violations(functions, rules).collect()) == [("T1", "m"), ("T3", "f")]
    assert complexity.threshold_violations(functions, []).count() == 0
    counted = spark.createDataFrame([("a.py", "# c\n\n x\n"), ("a.js", "# c\n// d\n * e\n/* f\nx"), ("a.go", "")], "file string, content string")
    assert [(r["total_lines"], r["code_lines"]) for r in complexity.line_counts(counted).collect()] == [(3, 1), (5, 2), (0, 0)]
    assert complexity.measured_functions(files.where(F.lit(False)), ["repo"]).count() == 0
