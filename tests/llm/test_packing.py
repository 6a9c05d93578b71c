import itertools
import random

import numpy as np

from lintlake.llm.packing import bucket_bounds, pack, pack_documents, plan_batches


def padding(sizes, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in sizes]
        k = rng.randint(1, 4)
        got = bucket_bounds(np.array(sizes), np.array(counts), k).tolist()
        best = min(padding(sizes, counts, [*c, sizes[-1]]) for n in range(k) for c in itertools.combinations(sizes[:-1], min(n, len(sizes) - 1)))
        assert len(got) <= k and got[-1] == sizes[-1] and padding(sizes, counts, got) == best


def test_layout_never_overfills():
    rng = random.Random(2)
    for _ in range(50):
        capacity = rng.randint(5, 100)
        bounds = np.array(sorted(rng.sample(range(1, capacity + 1), rng.randint(1, 5))))
        counts = np.array([rng.randint(0, 40) for _ in bounds])
        segments, used = plan_batches(bounds, counts, capacity)
        load, placed = {}, [0] * len(bounds)
        for s in segments:
            for r in range(s.low, s.high):
                c = s.start + (r - s.low) // s.per
                load[c] = load.get(c, 0) + int(bounds[s.bucket])
                placed[s.bucket] += 1
        assert placed == counts.tolist() and all(v <= capacity for v in load.values()) and set(load) == set(range(used))


def test_every_token_once_and_little_space_left(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 5, 64, 100, 129, 300, 1000, rng.randint(1, 60)]) if i % 3 else 7) for i in range(900)]
    kinds = [("a", 64), ("b", 300), ("none", 0), ("null", None)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").repartition(5)
    rows = pack(df, spark.createDataFrame(kinds, "container_kind string, capacity_tokens int"), rows_a_salt=50).collect()
    again = pack(df.repartition(2), spark.createDataFrame(kinds, "container_kind string, capacity_tokens int"), rows_a_salt=50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    for kind, capacity in kinds[:2]:
        own = [r for r in rows if r.container_kind == kind]
        load, docs = {}, {}
        for r in own:
            load[r.container_no] = load.get(r.container_no, 0) + r.tokens
            docs.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.tokens))
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        for i, n in sizes:
            parts = sorted(docs.get(i, []))
            assert sum(p[2] for p in parts) == n and (n > capacity or len(parts) == (n > 0))
            assert all(p[1] == k * capacity for k, p in enumerate(parts))
        assert sum(load.values()) / (len(load) * capacity) > 0.9
    assert {r.container_kind for r in rows} == {"a", "b"}


def test_texts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "ü" * 3000), (5, "hello world")], "doc_id long, text string")
    rows = pack_documents(docs, spark.createDataFrame([("s", 100)], "container_kind string, capacity_tokens int")).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5} and sum(r.tokens for r in rows if r.doc_id == 1) == 2
    empty = docs.where("doc_id < 0")
    assert pack_documents(empty, spark.createDataFrame([("s", 100)], "container_kind string, capacity_tokens int")).count() == 0


def test_bounds_are_optimal_among_many_sizes():
    r = np.random.default_rng(5)
    for m in (7, 60, 1500):
        sizes = np.sort(r.choice(np.arange(1, 8193), m, replace=False))
        counts = r.integers(1, 50, m)
        n, t = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * sizes)]
        cost = sizes[None, :] * (n[None, 1:] - n[:-1, None]) - (t[None, 1:] - t[:-1, None])
        cost = np.where(np.arange(m)[:, None] <= np.arange(m)[None, :], cost, 1 << 60)
        best = cost[0]
        for _ in range(5):
            best = np.minimum(best, (np.r_[1 << 60, best[:-1]][:, None] + cost).min(axis=0))
        got = bucket_bounds(sizes, counts, 6)
        at = np.searchsorted(got, sizes)
        assert len(got) <= 6 and int((counts * (got[at] - sizes)).sum()) == best[-1]
