import random

import numpy as np

from lintlake.llm.contamination import align, leaked_items, plain

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
LEAD = "Read the following text and answer the question at the end"


def words(n, r):
    return [r.choice(WORDS) for _ in range(n)]


def slow_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_against_a_plain_one():
    r = random.Random(5)
    for _ in range(40):
        a = np.array([r.randint(0, 5) for _ in range(r.randint(1, 25))], np.uint64)
        b = np.array([r.randint(0, 5) for _ in range(r.randint(1, 25))], np.uint64)
        best = slow_score(a, b)
        covered = align(a, a + np.uint64(100), b, b + np.uint64(200), least=1, runs=1)
        assert covered.any() == (best >= 2)
        assert covered.sum() * 2 >= best


def test_planted_leaks(spark):
    r = random.Random(6)
    items = [(i, " ".join([*LEAD.split(), *words(110, r)])) for i in range(40)]
    text = dict(items)
    part = lambda i, a, b: text[i].split()[a:b]
    junk = lambda n: " ".join(words(n, r))
    edited = [w if k % 12 else junk(1) for k, w in enumerate(part(3, 0, 200))]
    swapped = [w[:1] + w[2:3] + w[1:2] + w[3:] if k % 5 == 0 else w for k, w in enumerate(part(5, 20, 120))]
    docs = [
        (0, junk(50) + " " + text[1] + " " + junk(50)), (1, "> " + text[2].upper().replace(" ", "\n> ")), (2, " ".join(edited)), (3, text[4].replace("a", "а").replace("o", "о")),
        (4, junk(30) + " " + " ".join(swapped)), (5, " ".join(part(6, 60, 110)) + " " + junk(40) + " " + " ".join(part(6, 15, 50))), (6, "<p>" + text[7].replace(" ", "&nbsp;", 40) + "</p>"), (7, text[8].replace("e", "e​")),
        (8, " ".join(part(9, 0, 30))), (9, LEAD), (10, junk(400)), (11, None), (12, ""), (13, " ".join(words(20_000, r)) + " " + text[10] + " " + junk(20)), (14, text[11] + " " + text[12]), (15, text[1]), (15, text[1]),
    ]
    corpus = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id int, text string, item_id string").repartition(3)
    held = spark.createDataFrame([*items, (90, None), (91, "")], "item_id int, text string")
    want = {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (13, 10), (14, 11), (14, 12), (15, 1)}
    got = leaked_items(corpus, held).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) + 1
    blocks = leaked_items(corpus, held, block_words=300)
    assert {(x.doc_id, x.item_id) for x in blocks.collect()} == want
    assert leaked_items(corpus, held.where("item_id < 0")).count() == 0 == leaked_items(corpus.where("doc_id < 0"), held).count()


def test_repeated_and_short_items(spark):
    r = random.Random(8)
    same = " ".join(words(60, r))
    alike = [" ".join([*same.split()[:30], w, *same.split()[31:]]) for w in words(4, r)]
    other = " ".join(words(50, r))
    short = "seven words that no other item has"
    items = [*[(i, same) for i in range(4)], *[(10 + i, t) for i, t in enumerate(alike)], (20, short), (21, "one"), (22, "two words"), (None, other)]
    held = spark.createDataFrame(items, "item_id int, text string")
    docs = [(0, "x y " + same + " z"), (1, "in front " + short + " and after"), (2, "seven words that no other text has"), (3, "two other words"), (4, "one two words"), (5, alike[2]), (6, other)]
    corpus = spark.createDataFrame(docs, "doc_id int, text string")
    near = {*range(4), 10, 11, 12, 13}
    want = {*((d, i) for d in (0, 5) for i in near), (1, 20), (4, 22), (6, None)}
    for size in (2_000_000, 150, 1):
        got = leaked_items(corpus, held, block_words=size).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)


def test_many_items_of_common_words_keep_seeds(spark):
    r = random.Random(9)
    few = WORDS[:40]
    items = [(i, " ".join(r.choice(few) for _ in range(80))) for i in range(300)]
    corpus = spark.createDataFrame([(i, "a b " + t) for i, t in items[:20]], "doc_id int, text string")
    got = leaked_items(corpus, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(i, i) for i in range(20)} <= {(x.doc_id, x.item_id) for x in got}


def test_plain():
    assert plain("Ｆull ﬁ Ünïcode сору &amp; <b>x</b>\\ny sp​lit so-\nme") == "full fi unicode copy &  x  y split some"
