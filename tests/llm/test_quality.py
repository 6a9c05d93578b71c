import string

import numpy as np
import pyarrow as pa
import pytest

from lintlake.llm.kernel import hash_words
from lintlake.llm.quality import measure, text_quality

COMMON = "the of and to in a is that it for was on are as with this be by not or have from at but which an we you has they when if there can so".split()
PROSE = "There is a simpler way to load the module than the one we have now. We agreed to look at the report again, for it was not in the list. If the cache is cold, the page becomes slow and the score drops by several points. "
ROWS = [
    (1, PROSE * 2), (2, "\n".join(f"- fixed module #{i}" for i in range(40))), (3, "\n".join(f"| fn_{i} | low | {i} | {i * 3} |" for i in range(40))), (4, " ".join("xqzt vbnm qwrtz plkjh"[i % 17 : i % 17 + 5] for i in range(200))), (5, "the of and to in a is that it for was on are as " * 12),
    (6, "We agreed to look at the report again. " * 40), (7, PROSE + "\n\n" + "\n".join(f"* item {i}" for i in range(5))), (8, "QmFzZTY0IGRhdGE" * 60), (9, None), (10, ""), (11, "   \n\n"), (12, PROSE), (12, PROSE),
    (13, "- " + PROSE.strip().replace(". ", ".\n- ")), (14, PROSE + "\n\n" + "\n".join(f"name_{i}: value {i * 7}" for i in range(90))),
]


def test_rules(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id int, text string, reasons string, words int")
    rows = text_quality(docs, spark.createDataFrame([(w,) for w in [*COMMON, None]], "word string")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert {i for i, r in got.items() if r.natural_prose} == {1, 7, 12}
    assert got[9].natural_prose is None and got[9].reasons is None and got[9].words is None
    assert got[10].reasons == ["no_words"] == got[11].reasons
    assert "repeated_runs" in got[6].reasons and "common_words" in got[5].reasons and "bullet_lines" in got[2].reasons and "ragged_lines" in got[14].reasons
    assert all((not r.reasons) == r.natural_prose for r in rows if r.natural_prose is not None)
    assert text_quality(docs.where("doc_id < 0"), spark.createDataFrame([], "word string")).count() == 0


def test_statistics():
    s = measure(pa.array(["The cat, über 12.\n- it… \n\n- it…\n# a b?", "x"]), np.unique(hash_words(["the", "it"])))
    assert [s[k][0] for k in ("words", "lines", "sentences")] == [11, 4, 2]
    assert s["chars"][0] == 38 and s["mean_word_length"][0] == pytest.approx((3 + 4 + 4 + 3 + 1 + 3 + 1 + 3 + 1 + 1 + 2) / 11)
    assert s["alphabetic_words"][0] == pytest.approx(7 / 11) and s["symbol_ratio"][0] == pytest.approx(2 / 11) and s["line_ends_per_word"][0] == pytest.approx(4 / 11) and s["short_lines"][0] == 1.0
    assert s["special_chars"][0] == pytest.approx(sum(c in string.punctuation + string.digits + string.whitespace for c in "The cat, über 12.\n- it… \n\n- it…\n# a b?") / 38)
    assert s["common_words"][0] == pytest.approx(3 / 8) and s["different_common_words"][0] == 2
    assert s["terminal_lines"][0] == 1.0 and s["bullet_lines"][0] == 0.5 and s["ellipsis_lines"][0] == 0.5 and s["repeated_lines"][0] == 0.25
    assert s["words"][1] == 1 and s["sentences"][1] == 0


def test_repetition():
    run = " ".join(f"w{i}" for i in range(12))
    s = measure(pa.array(["a bb a bb a c", f"{run} x {run}", "one line\nother\none line\n", "a b"]), np.zeros(0, np.uint64))
    assert s["top_pair_chars"][0] == pytest.approx(2 * 3 / 8) and s["top_pair_chars"][3] == 0
    assert s["repeated_runs"][1] == pytest.approx(3 / 16) and s["repeated_runs"][0] == 0
    assert s["repeated_lines"][2] == pytest.approx(1 / 3) and s["repeated_line_chars"][2] == pytest.approx(8 / 24)


def test_batches_make_no_difference():
    texts = [t for _, t in ROWS]
    common = np.unique(hash_words(COMMON))
    whole = measure(pa.array(texts), common)
    for i, t in enumerate(texts):
        one = measure(pa.array([t], pa.string()), common)
        assert all(one[k][0] == pytest.approx(whole[k][i]) for k in one)
