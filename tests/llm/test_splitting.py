import random

from pyspark.sql import functions as F

from lintlake.llm.splitting import split_oversized

SCHEMA = "id int, content string, most int, lines int, piece_text string"


def pieces(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], SCHEMA)
    out = split_oversized(df, "content", F.col("most"), F.col("lines"))
    assert "content" not in out.columns
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.id, r.piece_no)):
        got.setdefault(r.id, []).append(r)
    return got


def check(text, most, lines, got):
    assert "".join(p.piece_text[p.piece_overlap :] for p in got) == text
    for a, b in zip(got, got[1:]):
        assert len(b.piece_text) <= most and len(a.piece_text) <= most
        assert b.piece_start == a.piece_start + len(a.piece_text) - a.piece_overlap
        repeated = b.piece_text[: b.piece_overlap]
        assert a.piece_text.endswith(repeated)
        k = max(lines or 0, 0)
        if k:  # the wanted lines are repeated whole if each of them is short or the piece leaves room for them
            before = text[: b.piece_start]
            tail = before.split("\n")
            tail = tail[-k - 1 :] if tail[-1] == "" else tail[-k:]
            want = "\n".join(tail)
            free = most - (len(b.piece_text) - b.piece_overlap)
            if all((len(x) + 1) * k <= most // 2 for x in tail) or len(want) <= free:
                assert repeated == want
            elif len(tail[-1] or tail[-2]) + 1 <= free:  # whole lines, as many as fit
                assert repeated and before[: len(before) - len(repeated)].endswith("\n")
            assert len(repeated) <= max(free, 0) and before.endswith(repeated)
        if not k:
            assert repeated == ""


def test_round_trip_against_constraints(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        lines = ["".join(rng.choice("abc ;{}é😀\t") for _ in range(rng.choice([0, 0, 3, 20, 40]))) for _ in range(rng.randint(1, 120))]
        rows.append((rng.choice(["\n", "\r\n"]).join(lines), rng.choice([10, 50, 200, 600]), rng.choice([0, 1, 3, 5, None, -2])))
    rows += [("x" * 5000, 700, 5), ("\n" * 900, 100, 3), ("😀a" * 3000, 1000, 2), ("ab\n" * 10_000 + "y" * 9000 + "\nz\n" * 50, 6000, 5)]
    got = pieces(spark, rows)
    for i, (text, most, lines) in enumerate(rows):
        if len(text) <= most:
            assert i not in got
        else:
            check(text, most, lines, got[i])


def test_a_long_line_shrinks_no_other_piece(spark):
    plain = "".join(f"line {i:03d} of some code\n" for i in range(200))
    long = plain[:2300] + "x" * 400 + "\n" + plain[2300:]
    got = pieces(spark, [(plain, 200, 2), (long, 200, 2)])
    own = lambda ps: [len(p.piece_text) - p.piece_overlap for p in ps]
    assert own(got[0])[:12] == own(got[1])[:12] and max(own(got[1])) >= max(own(got[0]))
    check(long, 200, 2, got[1])


def test_many_pieces(spark):
    got = pieces(spark, [("ab\n" * 3000, 6, 1)])[0]
    assert len(got) > 2000 and "".join(p.piece_text[p.piece_overlap :] for p in got) == "ab\n" * 3000


def test_natural_boundaries_win(spark):
    text = ("def f():\n    return 1\n\n    # more\n" * 3 + "\n") * 20
    got = pieces(spark, [(text, 400, 0)])[0]
    assert all(p.piece_text.endswith("\n\n") for p in got[:-1])


def test_defined_cases(spark):
    rows = [(None, 10, 1), ("", 10, 1), ("exactly 10", 10, 1), ("eleven char", 10, 0), ("eleven char", None, 1), ("eleven char", 0, 1), ("dup dup dup", 6, 0), ("dup dup dup", 6, 0), ("abc", 1, 2)]
    got = pieces(spark, rows)
    assert sorted(got) == [3, 6, 7, 8]
    assert [p.piece_text for p in got[8]] == ["a", "b", "c"]
    empty = spark.createDataFrame([], SCHEMA)
    assert split_oversized(empty, "content", F.col("most"), F.col("lines")).count() == 0
