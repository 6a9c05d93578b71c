import datetime
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators.rolling import parse_instant, rolling_totals, utc_day

SCHEMA = "who string, day int, v double, w double, entries string"


def got(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {(r["who"], (r["day"] - datetime.date(1970, 1, 1)).days): r for r in rolling_totals(df, "who", "day", ["v", "w"], **how).collect()}


def number(x):
    return x if x is not None and x == x else 0.0


@pytest.mark.parametrize("tile,block", [(1, 1), (7, 2), (64, 256)])
def test_against_brute_force(spark, tile, block):
    rng = random.Random(tile)
    rows = [(rng.choice(["a", "b", "ü", "idle", None]), rng.choice([rng.randint(0, 90), rng.randint(300, 420), None]), rng.choice([1.0, 2.0, None, float("nan")]), rng.random(), "clash") for _ in range(300)]
    out = got(spark, rows, tile_days=tile, block_entities=block)
    sums = {}
    for who, day, v, w, _ in rows:
        if who is not None and day is not None:
            n, a, b = sums.get((who, day), (0, 0.0, 0.0))
            sums[who, day] = (n + 1, a + number(v), b + number(w))
    keys = set()
    for who in {k[0] for k in sums}:
        days = [d for x, d in sums if x == who]
        for d in range(min(days), max(days) + 1):
            keys.add((who, d))
            r = out[who, d]
            assert r["entries"] == sums.get((who, d), (0,))[0] and r["day_number"] == d - min(days) + 1
            for p in (7, 30):
                for name, k in (("v", 1), ("w", 2)):
                    want = sum(sums.get((who, e), (0, 0.0, 0.0))[k] for e in range(d - p + 1, d + 1))
                    assert r[f"{name}_total_{p}d"] == pytest.approx(want) and r[f"{name}_avg_{p}d"] == pytest.approx(want / p)
    assert keys == set(out)


def test_partition_count_makes_no_difference(spark):
    rows = [("a", i % 50, 1.0, 2.0, "") for i in range(100)] + [("b", 1, None, None, "")]
    assert got(spark, rows, 1) == got(spark, rows, 8)
    assert got(spark, []) == {}


def test_infinities_count_in_their_own_periods(spark):
    inf = float("inf")
    rows = [("a", d, {40: inf, 60: -inf, 65: inf}.get(d, 1.0), 1.0, "") for d in range(1, 100)] + [("b", 40, 2.0, 2.0, "")]
    out = got(spark, rows)
    for d in range(1, 100):
        held = {x for x in (40, 60, 65) if d - 6 <= x <= d}
        want = 7.0 if d >= 7 else d * 1.0
        total = out["a", d]["v_total_7d"]
        if held >= {60, 65}:
            assert total is None
        else:
            assert total == (inf if held & {40, 65} else -inf if held else want), d
        assert out["a", d]["w_total_7d"] == want
    assert out["b", 40]["v_total_30d"] == 2.0


def test_instants(spark):
    told = {"2024-06-19T02:36:40+09:00": 19892, "2024-06-19T19:33:52Z": 19893, "2024-07-17 04:02:30": 19921, "20240701T102522Z": 19905, "20240701T0030+0200": 19904, "2024-01-02": 19724, "2024-01-02T10:20-05:00": 19724, " 2024-01-02T10:20:30,5Z ": 19724, "2025-13-40": None, "yesterday": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", utc_day(parse_instant(F.col("t"))).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == told
