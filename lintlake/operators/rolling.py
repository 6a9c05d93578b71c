"""Totals and averages over trailing periods of days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_USUAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"
_EXTENDED = r"^\s*(\d{4}-\d{2}-\d{2})([Tt ](\d{2}:\d{2})(:\d{2})?([.,]\d{1,9})?)?\s*(Z|z|[+-]\d{2}:?\d{2})?\s*$"
_BASIC = r"^\s*(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?([.,]\d{1,9})?(Z|z|[+-]\d{2}:?\d{2})?\s*$"


def _zoned(text: Column) -> Column:
    """Text that ends without an offset is UTC."""
    return F.when(F.endswith(text, F.lit("Z")) | F.substring(text, -6, 1).isin("+", "-"), text).otherwise(F.concat(text, F.lit("Z")))


def parse_instant(text: Column) -> Column:
    """ISO 8601 text (extended or basic notation, any offset, none meaning UTC) to a timestamp, null if unreadable.

    The usual notation costs one regular expression; only what it does not match is rewritten.
    """
    plain = F.when(text.rlike(_EXTENDED), text).when(text.rlike(_BASIC), F.regexp_replace(text, _BASIC, "$1-$2-$3T$4:$5:$6$7$8"))
    plain = F.upper(F.translate(F.regexp_replace(plain, r"^\s+|\s+$", ""), ",", "."))
    plain = F.regexp_replace(F.regexp_replace(plain, r"([T ]\d{2}:\d{2}):?\s*(Z|[+-]|$)", "$1:00$2"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    plain = F.regexp_replace(plain, r"\s+(Z|[+-]\d{2}:\d{2})$", "$1")
    rare = F.when(F.length(plain) == 10, F.concat(plain, F.lit("T00:00:00Z"))).otherwise(_zoned(plain))
    return F.when(text.rlike(_USUAL), _zoned(text)).otherwise(rare).try_cast("timestamp")


def utc_day(instant: Column) -> Column:
    """Days since 1970-01-01 in UTC, whatever the session's time zone."""
    return F.floor(F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int")


def rolling_totals(df: DataFrame, entity: str, day: str, values: Sequence[str], *, periods: Sequence[int] = (7, 30), tile_days: int = 64, block_entities: int = 256) -> DataFrame:
    """For each entity and every calendar day from its first to its last, totals and averages over the trailing periods.

    df has an entity column, an int day column (days since 1970) and numeric values. Rows are
    summed to one row per entity and day before they are shuffled by entity, so a hot entity costs
    a task no more than its number of days. Each task reads its entities in order, packs up to
    block_entities of them into dense blocks of tile_days days preceded by a halo of the longest
    period less one day, and multiplies the blocks by banded matrices, one for each period.

    Returns entity, day, day_number (1 on the entity's first day), entries (rows of that day) and,
    for each value v and period p, v_total_<p>d and v_avg_<p>d (the total over p days, active or not).

    Defined results: null entity or day: left out; null and NaN values count 0; an infinite one makes the
    totals infinite of those days whose period holds it, and infinities of both signs make them null; repeated rows all count (drop
    re-sent rows first); an empty table gives no rows; other columns of df are ignored.
    """
    periods = tuple(sorted(set(map(int, periods))))
    if not periods or periods[0] < 1 or tile_days < 1:
        raise ValueError("periods and tile_days must be positive")
    values = list(values)
    daily = (
        df.select(F.col(entity).cast("string").alias("e"), F.col(day).cast("int").alias("d"), *[F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(values)])
        .where("e is not null and d is not null")
        .groupBy("e", "d")
        .agg(F.count(F.lit(1)).cast("double").alias("entries"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(len(values))])
    )
    names = [(f"{v}_{what}_{p}d") for v in values for p in periods for what in ("total", "avg")]
    schema = T.StructType([T.StructField(entity, T.StringType()), T.StructField("day", T.DateType()), T.StructField("day_number", T.IntegerType()), T.StructField("entries", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    n_values = len(values)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = _bands(periods, tile_days)
        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if kept.empty:
                continue
            last = kept["e"].iloc[-1]
            start = int(kept["e"].searchsorted(last)) if kept["e"].is_monotonic_increasing else int((kept["e"] != last).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if start:
                yield from _dense(kept.iloc[:start], n_values, periods, bands, tile_days, block_entities, list(schema.names))
                kept = kept.iloc[start:]
        if kept is not None and len(kept):
            yield from _dense(kept, n_values, periods, bands, tile_days, block_entities, list(schema.names))

    return daily.repartition("e").sortWithinPartitions("e", "d").mapInPandas(blocks, schema)


def _bands(periods: Sequence[int], tile: int) -> dict[int, np.ndarray]:
    """For each period the matrix that turns halo + tile days into the trailing sums of the tile's days."""
    halo = max(periods) - 1
    at, to = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return {p: ((at <= to) & (at > to - p)).astype(np.float64) for p in periods}


def _banded(block: np.ndarray, band: np.ndarray) -> np.ndarray:
    """block @ band, where an infinity counts in the days of its own period only."""
    if np.isfinite(block).all():
        return block @ band
    wild = np.isnan(block)
    above, below = ((block == np.inf) | wild) @ band > 0, ((block == -np.inf) | wild) @ band > 0
    total = np.where(np.isfinite(block), block, 0.0) @ band
    return np.where(above & below, np.nan, np.where(above, np.inf, np.where(below, -np.inf, total)))


def _dense(rows: pd.DataFrame, n_values: int, periods: Sequence[int], bands: dict[int, np.ndarray], tile: int, per_block: int, names: list[str]) -> Iterator[pd.DataFrame]:
    codes, labels = pd.factorize(rows["e"])
    days = rows["d"].to_numpy(np.int64)
    data = rows[["entries", *[f"v{i}" for i in range(n_values)]]].to_numpy(np.float64)
    halo = max(periods) - 1
    for lo in range(0, len(labels), per_block):
        a, b = np.searchsorted(codes, [lo, lo + per_block])
        code, day, value = codes[a:b] - lo, days[a:b], data[a:b]
        n = int(code[-1]) + 1
        first = np.full(n, np.iinfo(np.int64).max)
        final = np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(first, code, day)
        np.maximum.at(final, code, day)
        who = np.asarray(labels[lo : lo + n], dtype=object)
        for begin in range(int(first.min()), int(final.max()) + 1, tile):
            here = (day >= begin - halo) & (day < begin + tile)
            live = np.flatnonzero((first < begin + tile) & (final >= begin))
            if not len(live):
                continue
            place = np.full(n, -1)
            place[live] = np.arange(len(live))
            here &= place[code] >= 0
            dense = np.zeros((value.shape[1], len(live), halo + tile))
            dense[:, place[code[here]], day[here] - (begin - halo)] = value[here].T
            dates = np.arange(begin, begin + tile)
            i, j = np.nonzero((dates >= first[live, None]) & (dates <= final[live, None]))
            out = {names[0]: who[live[i]], names[1]: dates[j].astype("datetime64[D]").astype("datetime64[s]"), names[2]: (dates[j] - first[live[i]] + 1).astype(np.int32), names[3]: dense[0, i, halo + j].astype(np.int64)}
            k = 4
            for v in range(n_values):
                for p in periods:
                    total = _banded(dense[v + 1], bands[p])[i, j]
                    out[names[k]], out[names[k + 1]] = total, total / p
                    k += 2
            yield pd.DataFrame(out)
