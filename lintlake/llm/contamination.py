"""Test items inside a training corpus: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.kernel import Words, portions, words_of_column
from lintlake.sources.tables import materialize

# Letters of other alphabets that look like Latin ones.
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j", "ß": "ss",
}
_TABLE = str.maketrans(_LOOKALIKE | {k.upper(): v for k, v in _LOOKALIKE.items() if len(k.upper()) == 1 and k.upper() != k})
_DROP = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]|[̀-ͯ]")
_MARKUP = re.compile(r"<[^<>\n]{0,300}>|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});|\\[nrt]|-[ \t]*\r?\n[ \t]*(?=[a-z])|[^\W\d_](?:[*_]{1,2})(?=[^\W\d_])")
_ODD = r"[&<\\]|-[ \t]*\r?\n[ \t]*[a-z]|[a-z][*_]{1,2}[a-z]"


def _plain_markup(found: re.Match) -> str:
    s = found.group()
    if s[0] == "&":
        if s[1] == "#":
            code = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else " "
        return {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&shy;": ""}.get(s.lower(), " ")
    if s[0] == "-":
        return ""
    return s[0] if s[-1] in "*_" and s[0] not in "<\\" else " "


def plain(text: str) -> str:
    """Text as its words are compared: without markup, invisible characters, accents and look-alike letters."""
    text = _MARKUP.sub(_plain_markup, text)
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKD", text).translate(_TABLE))
    return text.lower()


def plain_column(texts: pa.Array) -> pa.Array:
    """plain() over a column; texts without anything to change keep their bytes and cost no Python string."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    odd = pc.fill_null(pc.or_(pc.invert(pc.string_is_ascii(texts)), pc.match_substring_regex(texts, _ODD)), False)
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(at):
        return texts
    changed = pa.array([plain(t) for t in texts.take(pa.array(at)).to_pylist()], texts.type)
    return pc.replace_with_mask(texts, odd, changed)


@dataclass
class Items:
    """Test items as hashed words, and the seeds that point to them (ascending, with the item of each)."""

    ids: list
    words: list[np.ndarray]
    letters: list[np.ndarray]
    seeds: np.ndarray
    seed_item: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], seeds: list[np.ndarray]) -> Items:
        found = words_of_column(plain_column(pa.array(texts, pa.string())))
        first = found.first_of()
        first = np.r_[first, np.full(max(0, len(texts) + 1 - len(first)), len(found.hash))]
        sums = letter_sums(found)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in seeds])
        flat = np.concatenate([np.zeros(0, np.uint64), *seeds])
        order = np.argsort(flat, kind="stable")
        return cls(ids, [found.hash[a:b] for a, b in zip(first, first[1:])], [sums[a:b] for a, b in zip(first, first[1:])], flat[order], owner[order])

    def needed(self, seeds: int) -> np.ndarray:
        """How many different seeds of each item a text must hold."""
        return np.minimum(seeds, np.maximum(np.bincount(self.seed_item, minlength=len(self.ids)), 1))

    def bits(self) -> np.ndarray:
        """A table of about 16 bits a seed that says whether a gram may be one."""
        table = np.zeros(1 << max(20, (16 * len(self.seeds)).bit_length()), bool)
        table[(self.seeds & np.uint64(len(table) - 1)).astype(np.int64)] = True
        return table


def letter_sums(found: Words) -> np.ndarray:
    """A hash of each word's letters whatever their order, to know words with swapped letters."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(found.raw) + 1, np.uint64)
    np.cumsum((found.raw | np.uint8(32)).astype(np.uint64) ** np.uint64(5), out=total[1:])
    return total[found.end] - total[found.start]


def align(item: np.ndarray, item_letters: np.ndarray, text: np.ndarray, text_letters: np.ndarray, *, least: int, runs: int) -> np.ndarray:
    """Which words of the item lie in a run that the text carries: Smith-Waterman on words, repeated.

    Equal words score 2, words of the same letters in another order 1, other pairs and gaps -1. The
    best local alignment is a run; its words are taken out on both sides and the next one is sought,
    up to the given number of runs or until one scores below 2 * least.
    """
    m, n = len(item), len(text)
    covered = np.zeros(m, bool)
    score = np.where(item[:, None] == text[None, :], 2, np.where(item_letters[:, None] == text_letters[None, :], 1, -1)).astype(np.int32)
    ramp = np.arange(n + 1, dtype=np.int32)
    for _ in range(runs):
        h = np.zeros((m + 1, n + 1), np.int32)
        for i in range(m):
            row = h[i + 1]
            np.maximum(h[i, :-1] + score[i], h[i, 1:] - 1, out=row[1:])
            np.maximum(row, 0, out=row)
            np.maximum(np.maximum.accumulate(row + ramp) - ramp, 0, out=row)
        i, j = np.unravel_index(int(h.argmax()), h.shape)
        if h[i, j] < 2 * least:
            break
        i_end, j_end = i, j
        while h[i, j] > 0:
            if h[i, j] == h[i - 1, j - 1] + score[i - 1, j - 1]:
                i, j = i - 1, j - 1
            elif h[i, j] == h[i - 1, j] - 1:
                i -= 1
            else:
                j -= 1
        covered[i:i_end] = True
        score[i:i_end, :] = -9
        score[:, j:j_end] = -9
    return covered


def leaks_of(texts: pa.Array, items: Items, bits: np.ndarray, *, gram: int, seeds: int, least: int, runs: int, share: float) -> Iterator[tuple[int, int, float, int]]:
    """(number of the text, number of the item, share of its words, seeds hit) of every leak in a batch."""
    found = words_of_column(plain_column(texts))
    grams, at = found.grams(gram)
    if not len(grams) or not len(items.seeds):
        return
    needed = items.needed(seeds)
    near = np.flatnonzero(bits[(grams & np.uint64(len(bits) - 1)).astype(np.int64)])
    grams, at = grams[near], at[near]
    lo, hi = np.searchsorted(items.seeds, grams, "left"), np.searchsorted(items.seeds, grams, "right")
    times = hi - lo
    at = np.repeat(at, times)
    seed = np.repeat(lo, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    item = items.seed_item[seed]
    if not len(at):
        return
    order = np.lexsort((at, item, found.text[at]))
    at, item, seed = at[order], item[order], seed[order]
    text = found.text[at]
    edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
    first = found.first_of()
    sums = None
    for a, b in zip(edge, [*edge[1:], len(at)]):
        if b - a < needed[item[a]] or (distinct := len(np.unique(seed[a:b]))) < needed[item[a]]:
            continue
        if sums is None:
            sums = letter_sums(found)
        t, k = int(text[a]), int(item[a])
        m = len(items.words[k])
        places = at[a:b]
        cut = np.flatnonzero(np.diff(places) > 2 * m) + 1
        covered = np.zeros(m, bool)
        for part in np.split(places, cut):
            x, y = max(int(first[t]), int(part[0]) - m), min(int(first[t + 1]), int(part[-1]) + m + gram)
            if len(part) >= min(2, needed[k]) and not covered.all():
                covered |= align(items.words[k], items.letters[k], found.hash[x:y], sums[x:y], least=min(least, m), runs=runs)
        got = float(covered.mean())
        if got >= share:
            yield t, k, got, distinct


def _seeded(items: DataFrame, gram: int, rare: int, keep: int) -> DataFrame:
    """key, text and seeds of every distinct item text (key, t): its grams that at most `rare` texts hold, and the
    `keep` rarest of its grams in any case. Rarity is counted over all texts; nothing of it reaches the driver."""

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            found = words_of_column(plain_column(batch.column(1)))
            grams, at = found.grams(gram)
            pair = np.unique(np.stack([found.text[at].astype(np.uint64), grams], 1), axis=0) if len(grams) else np.zeros((0, 2), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[:, 0].astype(np.int64))), pa.array(pair[:, 1].copy().view(np.int64))], names=["key", "gram"])

    held = materialize(items.mapInArrow(grams_of, "key string, gram bigint"), "grams")
    known = held.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "gram")
    place = F.row_number().over(Window.partitionBy("key").orderBy("texts", "gram"))
    seeds = known.withColumn("place", place).where(f"texts <= {rare:d} or place <= {keep:d}").groupBy("key").agg(F.collect_list("gram").alias("seeds"))
    return items.join(seeds, "key").select("key", "t", "seeds")


def leaked_items(
    corpus: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    gram: int = 2,
    rare_items: int = 3,
    keep_seeds: int = 24,
    seeds: int = 5,
    least_run: int = 8,
    runs: int = 5,
    share: float = 0.5,
    block_words: int = 2_000_000,
) -> DataFrame:
    """Every (document, item) where the document carries at least `share` of the item's words in a few runs.

    Seeds are the items' n-grams of `gram` words that at most `rare_items` distinct item texts hold, so
    that lead-ins common to many items seed nothing, and in any case the keep_seeds rarest n-grams of each
    item, so that no item is left without seeds however many items there are. Each task hashes all words of its documents, looks their
    n-grams up among the seeds (hash bits first, then binary search), and aligns each document that
    holds at least `seeds` different seeds of an item (all of them, if it has fewer) with that item. The corpus is read once, is not
    shuffled, and only leaks leave the tasks. An item that leaks into a third of all documents costs
    each task only its own documents.

    The test items are a stated query set: their distinct texts are read to the driver in blocks of `block_words`
    words, at most that many (16 MB of hashes) are sent to the tasks at a time, and a larger set
    takes several passes over the corpus. Rarity is counted over all blocks, so the result does not depend on their size.

    Returns doc_id, item_id, item_share, seeds_hit. Defined results: null or empty texts give no row; an
    item of fewer than `gram` words is never reported; one of fewer than least_run words must be
    carried whole, in one run; an item text under several ids is sought once and reported for each; repeated documents and
    repeated item rows are all reported; other columns are ignored, their names may clash; empty tables give no rows.
    """
    schema = T.StructType([T.StructField("doc_id", corpus.schema[doc_id].dataType), T.StructField("key", T.StringType()), T.StructField("item_share", T.DoubleType()), T.StructField("seeds_hit", T.IntegerType())])
    docs = corpus.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null and t != ''")
    wanted = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("t")).where("t is not null and t != ''").withColumn("key", F.sha2("t", 256))
    seeded = materialize(_seeded(materialize(wanted.groupBy("key").agg(F.first("t").alias("t")), "items"), gram, rare_items, keep_seeds), "seeds").orderBy("key")
    spark = corpus.sparkSession
    result, ids, texts, known, words = None, [], [], [], 0

    def scan() -> DataFrame:
        shared = spark.sparkContext.broadcast(Items.build(list(ids), list(texts), list(known)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            bits = block.bits()
            for batch in (part for whole in batches for part in portions(whole, 1)):
                rows = list(leaks_of(batch.column(1), block, bits, gram=gram, seeds=seeds, least=least_run, runs=runs, share=share))
                if rows:
                    own = batch.column(0).take(pa.array([r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([own, pa.array([block.ids[r[1]] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32())], names=schema.names)

        return docs.mapInArrow(run, schema)

    for row in seeded.toLocalIterator():
        ids.append(row["key"])
        texts.append(row["t"])
        known.append(np.array(row["seeds"], np.int64).view(np.uint64))
        words += row["t"].count(" ") + 1
        if words >= block_words:
            result = scan() if result is None else result.unionAll(scan())
            ids, texts, known, words = [], [], [], 0
    if ids or result is None:
        result = scan() if result is None else result.unionAll(scan())
    return result.join(wanted.select("key", "item_id"), "key").select("doc_id", "item_id", "item_share", "seeds_hit")
