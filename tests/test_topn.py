import random

from pyspark.sql import functions as F

from lintlake.operators.topn import clean_path, top_n_per_group

SCHEMA = "grp string, score double, name string, id long, rank string, g string"


def best(spark, rows, n=3, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = top_n_per_group(df, F.col("grp"), F.col("score"), [F.col("name")], F.col("id"), n, group_name="key")
    return sorted((r["key"], r["rank"], r["id"]) for r in out.collect())


def brute(rows, n=3):
    groups = {}
    for g, s, name, i, *_ in rows:
        if g is not None and s is not None and s == s:
            groups.setdefault(g, set()).add((-s, (name or "").encode(), i))
    return sorted((g, k, x[2]) for g, v in groups.items() for k, x in enumerate(sorted(v)[:n], 1))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 12 + ["a", "b", "é", None]), rng.choice([1.0, 2.0, 2.0, 3.5, None, float("nan")]), rng.choice(["x", "X", "ä", None, "xx"]), rng.randint(1, 60), "clash", "g") for _ in range(600)]
    rows = list({(r[0], r[3]): r for r in rows}.values())  # an id is one row of a group
    rows += rows[::3]  # sent again
    assert best(spark, rows) == brute(rows)
    assert best(spark, rows, parts=1) == best(spark, rows, parts=8)
    assert best(spark, rows, n=1) == brute(rows, 1)


def test_empty_and_ties(spark):
    assert best(spark, []) == []
    rows = [("a", 1.0, "n", i, "r", "g") for i in range(10)]
    assert best(spark, rows) == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2)]


def test_group_limit_before_and_after_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1.0, "n", 1, "r", "g")], SCHEMA)
    plan = top_n_per_group(df, F.col("grp"), F.col("score"), [F.col("name")], F.col("id"), 3)._jdf.queryExecution().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2


def test_paths(spark):
    rows = spark.createDataFrame([("./a/b.py",), ("a\\b.py",), (".//./a/b",), ("a/./b",), (None,)], "p string")
    assert [r[0] for r in rows.select(clean_path(F.col("p"))).collect()] == ["a/b.py", "a/b.py", "a/b", "a/./b", None]
