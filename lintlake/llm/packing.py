"""Filling containers of fixed capacity: optimal length buckets, batches of a token budget inside each."""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.kernel import portions
from lintlake.sources.tables import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The word pattern that belongs to this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_ENCODERS: dict[int, object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    key = hash((vocabulary, pattern))
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def token_counts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id and tokens of every text that is not null; the driver reads the vocabulary (a fixed file) and sends it to the tasks."""
    shared = documents.sparkSession.sparkContext.broadcast((Path(tokenizer).read_bytes(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*shared.value).encode_ordinary
        for batch in (part for whole in batches for part in portions(whole, 1)):
            counts = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("tokens", T.LongType())])
    return documents.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").mapInArrow(run, schema)


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most `buckets` length buckets with the least padding, by dynamic programming.

    Padding is the sum over all items of the bound of its bucket less its size. The bounds are
    optimal among all sizes that occur. With n and t the items and tokens before size i, a bucket from i to j costs
    bound[j] * (n[j + 1] - n[i]) - (t[j + 1] - t[i]): for each i a line in bound[j], so that the lower hull of the
    lines gives a step of the programming in time linear in the number of sizes, in whole numbers.
    """
    order = np.argsort(sizes)
    bound = np.asarray(sizes, np.int64)[order].tolist()
    n, t = [0], [0]
    for size, count in zip(bound, np.asarray(counts, np.int64)[order].tolist()):
        n.append(n[-1] + count)
        t.append(t[-1] + count * size)
    m = len(bound)
    best = [bound[j] * n[j + 1] - t[j + 1] for j in range(m)]
    back = [[0] * m]
    for _ in range(min(buckets, m) - 1):
        hull: list[tuple[int, int, int]] = []  # (slope, value at 0, i), slopes falling
        at, now, choice = 0, list(best), [-1] * m
        for j in range(1, m):
            line = (-n[j], best[j - 1] + t[j], j)
            if not hull or line[0] < hull[-1][0] or line[1] < hull[-1][1]:
                while hull and hull[-1][0] == line[0] or len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            at = min(at, len(hull) - 1)
            x = bound[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            cost = hull[at][0] * x + hull[at][1] + x * n[j + 1] - t[j + 1]
            if cost < best[j]:
                now[j], choice[j] = cost, hull[at][2]
        best = now
        back.append(choice)
    ends, j, level = [], m - 1, len(back) - 1
    while j >= 0:
        while level > 0 and back[level][j] < 0:
            level -= 1
        ends.append(bound[j])
        i = back[level][j]
        if i <= 0:
            break
        j, level = i - 1, level - 1
    return np.array(sorted(ends), np.int64)


@dataclass
class Segment:
    """Items of a bucket from rank `low` to `high` (without it) go to containers from `start` on, `per` to each."""

    bucket: int
    low: int
    high: int
    start: int
    per: int


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[Segment], int]:
    """Where the items of each bucket go, from arithmetic on the buckets' counts alone.

    From the longest bucket down, items first fill what earlier containers left (least gap that fits
    first), then open containers of capacity // bound items each. Returns the segments and the
    number of containers.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first container, containers), sorted
    segments, used = [], 0
    for b in range(len(bounds) - 1, -1, -1):
        size, left, rank = int(bounds[b]), int(counts[b]), 0
        k = bisect.bisect_left(gaps, (size,))
        fresh: list[tuple[int, int, int]] = []
        while left and k < len(gaps):
            gap, start, number = gaps.pop(k)
            per = gap // size
            full = min(number, left // per)
            if full:
                segments.append(Segment(b, rank, rank + full * per, start, per))
                rank, left = rank + full * per, left - full * per
                fresh.append((gap - per * size, start, full))
            if full < number:
                if left:
                    segments.append(Segment(b, rank, rank + left, start + full, per))
                    fresh.append((gap - left * size, start + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < number:
                    fresh.append((gap, start + full, number - full))
        if left:
            per = max(1, capacity // size)
            full, rest = divmod(left, per)
            segments.append(Segment(b, rank, rank + left, used, per))
            if full:
                fresh.append((capacity - per * size, used, full))
            if rest:
                fresh.append((capacity - rest * size, used + full, 1))
            used += full + bool(rest)
        for x in fresh:
            if x[0] > 0:
                bisect.insort(gaps, x)
    return segments, used


def pack(sizes: DataFrame, capacities: DataFrame, *, buckets: int = 128, rows_a_salt: int = 200_000) -> DataFrame:
    """Assign every text (doc_id, tokens) to containers of every kind (container_kind, capacity_tokens).

    A text within the capacity stays whole; a longer one is cut into full pieces and a rest. The
    histogram of piece sizes, at most one row for each token of the capacities, comes to the driver,
    where dynamic programming chooses the bucket bounds that minimise padding and the batches are
    laid out by arithmetic on the bucket counts. Every piece then finds its place from its rank in
    its bucket. Ranks are numbered in salted parts of about rows_a_salt rows, so a bucket that holds
    a third of all pieces is no single task; the counts of the parts are joined as a table.

    sizes is read twice: give a written table (token_counts through materialize). Returns
    container_kind, container_no (from 0 in each kind), doc_id, piece_no (from 0), token_start and tokens.
    Defined results: texts of no tokens are left out; null or non-positive capacities are left out;
    of repeated kinds each capacity counts; doc_id should be unique (of repeated ones each row is placed).
    """
    spark = sizes.sparkSession
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in capacities.select("container_kind", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("container_kind", "capacity_tokens").collect()]
    out_schema = f"container_kind string, container_no bigint, doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece_no int, token_start bigint, tokens int"
    if not kinds:
        return spark.createDataFrame([], out_schema)
    kind_rows = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("c")) for i, (_, c) in enumerate(kinds)])
    pieces = (
        sizes.where("tokens > 0")
        .select("doc_id", F.col("tokens").alias("whole"), F.explode(kind_rows).alias("kind"))
        .select("doc_id", "kind.k", "whole", F.explode(F.expr("sequence(0, CAST((whole - 1) DIV kind.c AS INT))")).alias("piece_no"), F.col("kind.c").alias("c"))
        .select("doc_id", "k", "piece_no", (F.col("piece_no").cast("long") * F.col("c")).alias("token_start"), F.expr("CAST(least(whole - CAST(piece_no AS BIGINT) * c, c) AS INT)").alias("tokens"))
    )
    histogram = np.array([(r["k"], r["tokens"], r["n"]) for r in pieces.groupBy("k", "tokens").agg(F.count(F.lit(1)).alias("n")).collect()], np.int64).reshape(-1, 3)
    table, laid = [], []
    for k, (_, capacity) in enumerate(kinds):
        own = histogram[histogram[:, 0] == k]
        if not len(own):
            continue
        bounds = bucket_bounds(own[:, 1], own[:, 2], buckets)
        bucket = np.searchsorted(bounds, own[:, 1])
        counts = np.bincount(bucket, own[:, 2], len(bounds)).astype(np.int64)
        salts = np.maximum(1, -(-counts // rows_a_salt))
        table += [(k, int(s), int(b), int(salts[b])) for s, b in zip(own[:, 1], bucket)]
        for s in plan_batches(bounds, counts, capacity)[0]:
            laid.append((k, s.bucket, s.low, s.high, s.start, s.per))
    if not table:
        return spark.createDataFrame([], out_schema)
    # at most one row for each token of the capacities
    lookup = F.broadcast(spark.createDataFrame(table, "k int, tokens int, bucket int, salts int"))
    placed = pieces.join(lookup, ["k", "tokens"]).withColumn("salt", F.expr("CAST(pmod(xxhash64(doc_id, piece_no), salts) AS INT)"))
    # one row for each bucket and each rows_a_salt pieces: written, so that its size is known when it is joined
    before = F.sum("n").over(Window.partitionBy("k", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offset = materialize(placed.groupBy("k", "bucket", "salt").agg(F.count(F.lit(1)).alias("n")).select("k", "bucket", "salt", F.coalesce(before, F.lit(0)).alias("below")), "offsets")
    by_bucket: dict[tuple[int, int], list] = {}
    for k, b, low, high, start, per in laid:
        by_bucket.setdefault((k, b), []).append((low, high, start, per))
    segment = F.broadcast(spark.createDataFrame([(k, b, kinds[k][0], s) for (k, b), s in by_bucket.items()], "k int, bucket int, container_kind string, places array<struct<low:bigint,high:bigint,start:bigint,per:bigint>>"))
    numbered = placed.selectExpr("*", "row_number() OVER (PARTITION BY k, bucket, salt ORDER BY doc_id, piece_no) - 1 AS own")
    ranked = numbered.join(offset, ["k", "bucket", "salt"]).join(segment, ["k", "bucket"]).withColumn("rank", F.col("own") + F.col("below"))
    at = ranked.withColumn("at", F.expr("filter(places, s -> rank >= s.low AND rank < s.high)[0]"))
    return at.selectExpr("container_kind", "at.start + (rank - at.low) DIV at.per AS container_no", "doc_id", "piece_no", "token_start", "tokens")


def pack_documents(documents: DataFrame, capacities: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN, buckets: int = 128) -> DataFrame:
    """token_counts and pack: each text is tokenized once, and only ids and sizes are written."""
    return pack(materialize(token_counts(documents, doc_id=doc_id, text=text, tokenizer=tokenizer, pattern=pattern), "tokens"), capacities, buckets=buckets)
