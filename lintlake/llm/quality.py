"""Text quality statistics of each document, and published fixed-threshold rules with a reason for each failure."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.kernel import IS_DIGIT, IS_LETTER, IS_SPACE, Words, count_in, hash_words, mix, portions, runs, word_mask, words_of_column

# Name of the rule: bounds (statistic, least, most) that hold; a text fails a rule if it breaks all of its bounds.
# Thresholds as published:
#   MassiveText (Gopher): mean word length 3-10, symbols a word 0.1, bulleted lines 0.9, lines that end in an
#     ellipsis 0.3, words with a letter 0.8, two different stop words, repeated lines 0.3, characters in repeated
#     lines 0.2, characters in the most frequent pair of words 0.2;
#   FineWeb: line ends a word 0.3, and its two rules on lines (ending in punctuation 0.12, up to 30 characters
#     0.67), of which both must fail: one alone fails prose with headings or hard line breaks;
#   ROOTS: special characters 0.4; Data-Juicer: repeated runs of ten words 0.5 (here without each run's first
#     occurrence, so that a passage held twice does not fail).
# "own" marks the one pair of bounds that is not published (see the README for how many documents it decides).
RULES = {
    "no_words": (("words", 1, None),),
    "mean_word_length": (("mean_word_length", 3.0, None), ("mean_word_length", None, 10.0)),
    "symbols": (("symbol_ratio", None, 0.1),),
    "bullet_lines": (("bullet_lines", None, 0.9),),
    "ellipsis_lines": (("ellipsis_lines", None, 0.3),),
    "few_alphabetic_words": (("alphabetic_words", 0.8, None),),
    "few_stop_words": (("different_common_words", 2, None),),
    "repeated_lines": (("repeated_lines", None, 0.3),),
    "repeated_line_chars": (("repeated_line_chars", None, 0.2),),
    "frequent_pair": (("top_pair_chars", None, 0.2),),
    "line_ends": (("line_ends_per_word", None, 0.3),),
    "ragged_lines": (("terminal_lines", 0.12, None), ("short_lines", None, 0.67)),
    "special_characters": (("special_chars", None, 0.4),),
    "repeated_runs": (("repeated_runs", None, 0.5),),
    "common_words": (("common_words", 0.2, None), ("common_words", None, 0.75)),  # own
}
_ALL_BOUNDS = ("ragged_lines",)
PUBLISHED = tuple(name for name in RULES if name != "common_words")

_STATS = ("chars", "words", "mean_word_length", "symbol_ratio", "alphabetic_words", "common_words", "different_common_words", "digit_ratio", "special_chars", "lines", "words_per_line", "line_ends_per_word", "terminal_lines", "short_lines", "bullet_lines", "ellipsis_lines", "repeated_lines", "repeated_line_chars", "top_pair_chars", "repeated_runs", "sentences", "words_per_sentence")
_WHOLE = ("chars", "words", "different_common_words", "lines", "sentences")

_SPECIAL = np.isin(np.arange(256), [ord(c) for c in string.punctuation + string.digits + string.whitespace])
_CLOSER = np.isin(np.arange(256), [ord(c) for c in "\"')]}*_`"])
_TERMINAL = np.isin(np.arange(256), [ord(c) for c in ".!?:"])
_BULLET = np.isin(np.arange(256), [ord(c) for c in "-*+"])
_SHORT, _RUN = 30, 10
_TEXT = np.uint64(0x9E3779B97F4A7C15)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a), np.float64), where=np.asarray(b) > 0)


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, and in all."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total


def _previous(flag_places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the last of the sorted flag_places that is not after it, or -1."""
    k = np.searchsorted(flag_places, at, side="right") - 1
    return np.where(k >= 0, flag_places[np.maximum(k, 0)] if len(flag_places) else -1, -1)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that brings equal keys together, places in it where a new key begins, how many of each key)."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, first, np.diff(np.r_[first, len(keys)])


def _pairs(found: Words, length: np.ndarray, n: int) -> np.ndarray:
    """Share of each text's word characters in its most frequent pair of words (of equally frequent ones the longest)."""
    grams, at = found.grams(2)
    text = found.text[at]
    order, first, times = _grouped(mix(grams + text.astype(np.uint64) * _TEXT))
    one = order[first]
    own, size = text[one], (length[at[one]] + length[at[one] + 1]) if len(one) else one
    rank = np.lexsort((size, times, own))
    last = rank[np.r_[own[rank][1:] != own[rank][:-1], True]] if len(rank) else rank
    held = np.zeros(n)
    held[own[last]] = np.where(times[last] > 1, times[last] * size[last], 0)
    return _ratio(held, np.bincount(found.text, length, n)[:n])


def _repeated_runs(found: Words, n: int) -> np.ndarray:
    """Share of the runs of ten words that repeat an earlier one of their text."""
    grams, at = found.grams(_RUN)
    text = found.text[at]
    order, first, times = _grouped(mix(grams + text.astype(np.uint64) * _TEXT))
    return _ratio(np.bincount(text[order[first]], times - 1, n)[:n], np.bincount(text, minlength=n)[:n])


def measure(column: pa.Array, common: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of every text of a batch; common: sorted hashes of the frequent words of all languages.

    Words that are measured are what white space parts, as in the published rules; words that are compared are
    runs of letters and digits."""
    found = words_of_column(column)
    raw, offsets, n = found.raw, found.offsets, len(column)
    chars_in = _before((raw & 0xC0) != 0x80)
    out = {"chars": chars_in[offsets[1:]] - chars_in[offsets[:-1]]}
    bounds = np.r_[found.first_of(), len(found.start)][: n + 1]
    parts = np.diff(bounds)

    begin, end = runs(~IS_SPACE[raw], offsets)
    inside = np.searchsorted(begin, offsets)
    words = np.diff(inside)
    out["words"] = np.where(parts > 0, words, 0)
    size = _before(np.zeros(0, bool)) if not len(begin) else np.r_[0, np.cumsum(chars_in[end] - chars_in[begin])]
    out["mean_word_length"] = _ratio(size[inside[1:]] - size[inside[:-1]], words)
    hashes = count_in(raw == ord("#"), offsets)
    dots = raw == ord(".")
    run_begin, run_end = runs(dots, offsets)
    three = np.zeros(len(raw), bool)
    three[run_begin[run_end - run_begin >= 3]] = True
    if len(raw) > 2:
        three[:-2] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x80) & (raw[2:] == 0xA6)  # the character …
    out["symbol_ratio"] = _ratio(np.maximum(hashes, count_in(three, offsets)), words)
    letters_in = _before(word_mask(raw) & IS_LETTER[raw]) if len(raw) else np.zeros(1, np.int64)
    out["alphabetic_words"] = _ratio(count_in(letters_in[end] > letters_in[begin], inside), words)

    is_common, which = np.zeros(len(found.hash), bool), np.zeros(len(found.hash), np.int64)
    if len(common) and len(found.hash):
        which = np.minimum(np.searchsorted(common, found.hash), len(common) - 1)
        is_common = common[which] == found.hash
    out["common_words"] = _ratio(count_in(is_common, bounds), parts)
    kinds = max(len(common), 1)
    out["different_common_words"] = np.bincount(np.unique(found.text[is_common] * kinds + which[is_common]) // kinds, minlength=n)[:n]
    out["digit_ratio"] = _ratio(count_in(IS_DIGIT[raw], offsets), out["chars"])
    out["special_chars"] = _ratio(count_in(_SPECIAL[raw], offsets), out["chars"])
    out["line_ends_per_word"] = _ratio(count_in(raw == 10, offsets), words)

    ink = np.flatnonzero(~IS_SPACE[raw])
    newline = _before(raw == 10)
    text_of = np.searchsorted(offsets, ink, side="right") - 1
    head = np.flatnonzero(np.r_[True, (newline[ink[1:]] > newline[ink[:-1]]) | (text_of[1:] != text_of[:-1])]) if len(ink) else np.zeros(0, np.int64)
    begin = ink[head]
    finish = ink[np.r_[head[1:], len(ink)] - 1] if len(ink) else begin
    line_text = text_of[head]
    line_of = np.searchsorted(line_text, np.arange(n + 1))
    lines = np.diff(line_of)
    line_chars = chars_in[finish + 1] - chars_in[begin] if len(begin) else begin
    out["lines"] = lines
    out["words_per_line"] = _ratio(words, lines)
    # the last byte of a line that closes nothing
    open_places = ink[~_CLOSER[raw[ink]]]
    tail = np.maximum(_previous(open_places, finish), begin) if len(begin) else begin
    one = (raw[tail] == 0xA6) & (raw[np.maximum(tail - 1, 0)] == 0x80)  # the character …
    out["terminal_lines"] = _ratio(count_in(_TERMINAL[raw[tail]] | one, line_of), lines)
    many = (raw[tail] == 46) & (raw[np.maximum(tail - 1, 0)] == 46) & (raw[np.maximum(tail - 2, 0)] == 46)
    out["ellipsis_lines"] = _ratio(count_in(many | one, line_of), lines)
    out["short_lines"] = _ratio(count_in(line_chars <= _SHORT, line_of), lines)
    after = raw[np.minimum(begin + 1, max(len(raw) - 1, 0))] if len(begin) else begin
    second = raw[np.minimum(begin + 2, max(len(raw) - 1, 0))] if len(begin) else begin
    number = IS_DIGIT[raw[begin]] & (np.isin(after, [41, 46]) | (IS_DIGIT[after] & np.isin(second, [41, 46])))
    round_bullet = (raw[begin] == 0xE2) & (after == 0x80) & (second == 0xA2)
    box = (raw[begin] == 91) & ((second == 93) | (after == 93))
    out["bullet_lines"] = _ratio(count_in((_BULLET[raw[begin]] & IS_SPACE[after]) | number | round_bullet | box, line_of), lines)

    line_words = np.searchsorted(found.start, np.r_[begin, len(raw)]) if len(begin) else np.zeros(1, np.int64)
    chain = np.zeros(len(found.hash) + 1, np.uint64)
    place = np.arange(len(found.hash))
    place_in_line = place - line_words[np.maximum(np.searchsorted(line_words, place, side="right") - 1, 0)]
    np.cumsum(found.hash * (np.uint64(2) * place_in_line.astype(np.uint64) + np.uint64(1)), out=chain[1:])
    order, first, _ = _grouped(mix(chain[line_words[1:]] - chain[line_words[:-1]] + line_text.astype(np.uint64) * _TEXT))
    again = np.ones(len(order), bool)
    again[order[first]] = False
    out["repeated_lines"] = _ratio(count_in(again, line_of), lines)
    out["repeated_line_chars"] = _ratio(np.bincount(line_text[again], line_chars[again], n)[:n], out["chars"])
    out["top_pair_chars"] = _pairs(found, chars_in[found.end] - chars_in[found.start], n)
    out["repeated_runs"] = _repeated_runs(found, n)

    stop = np.isin(raw, [33, 46, 63]) if len(raw) else np.zeros(0, bool)
    if len(raw):
        ends = offsets[1:][offsets[1:] > 0] - 1
        last = stop[ends]
        stop[:-1] &= IS_SPACE[raw[1:]] | _CLOSER[raw[1:]]
        stop[ends] |= last
    out["sentences"] = count_in(stop, offsets)
    out["words_per_sentence"] = _ratio(words, np.maximum(out["sentences"], 1))
    return out


def judge(stats: dict[str, np.ndarray]) -> tuple[list[list[str]], np.ndarray]:
    """(rules that each text fails, whether it is natural prose: it fails none)."""
    n = len(stats["words"])
    reasons: list[list[str]] = [[] for _ in range(n)]
    prose = np.ones(n, bool)
    for name, bounds in RULES.items():
        broken = [(stats[stat] < low) if most is None else (stats[stat] > most) for stat, low, most in bounds]
        bad = np.logical_and.reduce(broken) if name in _ALL_BOUNDS else np.logical_or.reduce(broken)
        if name != "no_words":
            bad &= stats["words"] > 0
        prose &= ~bad
        for i in np.flatnonzero(bad):
            reasons[i].append(name)
    return reasons, prose


def text_quality(documents: DataFrame, common_words: DataFrame, *, doc_id: str = "doc_id", text: str = "text", word: str = "word", most_common_words: int = 100_000) -> DataFrame:
    """One row for each document: its statistics, the rules it fails and whether it is natural prose.

    Statistics are array operations over whole Arrow batches of texts; nothing is shuffled and no
    text becomes a Python string. The words of common_words (fixed lists of frequent words of each
    language) count for every document, whatever its lang column says, for that is often wrong; they
    are read to the driver and sent to the tasks, and a table of more than most_common_words words
    is refused. A language without words in the list fails few_stop_words.

    Returns doc_id, the statistics, reasons (array of rule names) and natural_prose. Defined
    results: a null text gives null statistics, null reasons and null natural_prose; an empty one is
    no prose for the reason no_words, as is one without a letter or digit; a text is prose if and only if its
    reasons are empty; repeated documents each get a row; other columns are ignored.
    """
    words = [r[0] for r in common_words.select(F.lower(F.trim(F.col(f"`{word}`")))).where(f"`{word}` is not null").distinct().limit(most_common_words + 1).collect()]
    if len(words) > most_common_words:
        raise ValueError(f"more than {most_common_words} common words")
    known = np.unique(hash_words([w for w in words if w and w.replace("_", "a").isalnum()])) if words else np.zeros(0, np.uint64)
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema[doc_id].dataType), *[T.StructField(s, T.LongType() if s in _WHOLE else T.DoubleType()) for s in _STATS], T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("natural_prose", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, 1)):
            stats = measure(batch.column(1), known)
            reasons, prose = judge(stats)
            null = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            columns = [pa.array(stats[s], pa.int64() if s in _WHOLE else pa.float64(), mask=null) for s in _STATS]
            told = pa.array([None if x else r for r, x in zip(reasons, null)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, told, pa.array(prose, pa.bool_(), mask=null)], names=schema.names)

    return documents.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)
