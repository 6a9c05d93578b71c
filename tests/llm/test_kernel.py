import random
import re

import numpy as np
import pyarrow as pa

from lintlake.llm.kernel import hash_words, portions, words_of_column


def split(text):
    """The words as the kernel finds them, by Python."""
    return [w for w in re.findall(r"[A-Za-z0-9_À-῿぀-퟿]+", text)]


def test_words_against_python():
    rng = random.Random(1)
    texts = [None, "", "a", "über-groß „zitat“ x…y", "a b​c", " lead", "trail ", "日本 語"] + ["".join(rng.choice("ab_9 é.\n-") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    column = pa.array(texts, pa.string())
    for col in (column, column.slice(3), column.cast(pa.large_string()), pa.chunked_array([column.slice(0, 50), column.slice(50)])):
        start = 3 if len(col) == len(texts) - 3 else 0
        found = words_of_column(col)
        got = [[] for _ in range(len(col))]
        for a, b, t in zip(found.start, found.end, found.text):
            got[t].append(found.raw[a:b].tobytes().decode())
        assert got == [split(t or "") for t in texts[start:]]


def test_hashes_and_grams():
    found = words_of_column(pa.array(["The cat the CAT", "cat the"]))
    h = hash_words(["the", "cat"])
    assert found.hash.tolist() == [h[0], h[1], h[0], h[1], h[1], h[0]]
    grams, at = found.grams(2)
    assert at.tolist() == [0, 1, 2, 4] and grams[0] == grams[2] and grams[1] == grams[3] and grams[0] != grams[1]
    assert len(words_of_column(pa.array([], pa.string())).hash) == 0
    rng = random.Random(2)
    words = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20_000)})
    assert len(np.unique(hash_words(words))) == len(words)


def test_portions():
    texts = ["x" * n for n in (10, 0, 500, 3, 3, 3, 2000, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = portions(batch, 1, 100)
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(8))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 100 for p in parts)
    assert portions(batch.slice(0, 0), 1) == []
