"""Splitting oversized texts at natural boundaries, with an overlap of whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.arrays import sums_before


def _pattern(size: Column, least: Column) -> Column:
    """Alternatives by strength of the boundary, each with bounded quantifiers; the first that fits wins.

    The rest of the text if it fits; a blank line before an unindented line; any blank line; a line
    end in the second half; any line end; the end of a statement; white space; any character.
    """
    most = F.concat(F.lit(r"[\s\S]{1,"), size, F.lit("}"))
    half = F.concat(F.lit(r"[\s\S]{"), least, F.lit(","), size, F.lit("}"))
    return F.concat(
        most, F.lit(r"\z|"),
        half, F.lit(r"(?<=\n\r?\n)(?=\S)|"),
        half, F.lit(r"(?<=\n\r?\n)|"),
        half, F.lit(r"(?<=\n)|"),
        most, F.lit(r"(?<=\n)|"),
        half, F.lit(r"(?<=[;{}])|"),
        half, F.lit(r"(?<=\s)(?<!\r)|"),
        most, F.lit(r"(?<!\r)|"), most,
    )


def split_oversized(df: DataFrame, text: str, limit: Column, overlap_lines: Column, *, prefix: str = "piece") -> DataFrame:
    """One row for each piece of every text that has more than limit characters (code points).

    Adds <prefix>_no (from 1), <prefix>_count, <prefix>_start (0-based place of the piece's own
    text), <prefix>_overlap (characters repeated from the piece before) and <prefix>_text; existing
    columns of these names and the text column are replaced. A piece is never longer than limit. Its own part ends
    at the strongest boundary that a bounded regular expression finds, and is preceded by the last
    overlap_lines lines of the piece before; the own parts in order make up the text again.

    Room for the overlap is set aside beforehand: overlap_lines times the longest of those lines that are
    short enough to be repeated within half the limit. Such lines are always repeated whole. Longer ones are repeated
    whole where the piece leaves them room up to the limit, else the lines after them alone; if the last
    line alone does not fit, as many of its last characters as the room takes.

    All by SQL functions in the JVM, row by row, without a shuffle; pieces are cut out of the text by
    place. Characters outside the basic plane are masked while boundaries are sought, one for one.

    Defined results: a null text, one of limit characters or fewer (the empty one too) gives no row; a null or
    non-positive limit means no limit; a null or negative overlap is 0; equal rows each come out;
    \\r\\n is never cut in two where the limit is 2 or more; an empty table gives no rows.
    """
    rest = [f"`{c}`" for c in df.columns if c != text and c not in {f"{prefix}_{x}" for x in ("no", "count", "start", "overlap", "text")}]
    long = (
        df.select(F.struct(*[F.col(c) for c in rest]).alias("row") if rest else F.struct(F.lit(0).alias("_")).alias("row"), F.col(f"`{text}`").alias("t"), limit.cast("int").alias("most"), F.greatest(F.coalesce(overlap_lines.cast("int"), F.lit(0)), F.lit(0)).alias("lines"))
        .where("most > 0 and length(t) > most")
        .withColumn("masked", F.expr(r"CASE WHEN t RLIKE '[\\x{10000}-\\x{10FFFF}]' THEN regexp_replace(t, '[\\x{10000}-\\x{10FFFF}]', 'x') ELSE t END"))
        .withColumn("half", F.expr("most DIV 2"))
        .withColumn("room", F.expr(r"CASE WHEN lines = 0 THEN 0 ELSE CAST(least(CAST(lines AS BIGINT) * (coalesce(array_max(filter(transform(split(t, '\n'), x -> length(x) + 1), n -> CAST(n AS BIGINT) * lines <= half)), half) ), CAST(half AS BIGINT)) AS INT) END"))
        .withColumn("size", F.expr("most - room"))
        .withColumn("lengths", F.transform(F.regexp_extract_all("masked", _pattern(F.col("size").cast("string"), F.expr("CAST(greatest(size DIV 2, 1) AS STRING)")), F.lit(0)), F.length))
        .withColumn("starts", sums_before(F.col("lengths")))
    )
    cut = long.select("row", "t", "lines", "room", "most", F.size("lengths").alias("n"), F.posexplode(F.arrays_zip(F.col("starts").alias("at"), F.col("lengths").alias("own"))).alias("i", "p"))
    # what precedes the piece, as far as the piece leaves room, and one character more that tells whether it begins a line
    seen = cut.withColumn("free", F.expr("CASE WHEN i = 0 OR lines = 0 THEN 0 ELSE least(most - p.own, p.at) END")).withColumn("before", F.expr("substring(t, p.at - free + 1, free)"))
    last = seen.withColumn("wanted", F.expr(r"substring_index(before, '\n', -(lines + CASE WHEN endswith(before, '\n') THEN 1 ELSE 0 END))"))
    # the wanted lines are whole if fewer than all characters are wanted, or the first one begins a line
    whole = F.expr(r"length(wanted) < free OR free = p.at OR substring(t, p.at - free, 1) = '\n'")
    complete = F.expr(r"CASE WHEN instr(wanted, '\n') > 0 THEN length(wanted) - instr(wanted, '\n') ELSE 0 END")
    back = last.withColumn("overlap", F.when(F.col("free") == 0, 0).when(whole, F.length("wanted")).when(complete > 0, complete).otherwise(F.least(F.length("wanted"), F.col("room"))).cast("int"))
    return back.select(
        *[F.col(f"row.{c}") for c in rest],
        (F.col("i") + 1).alias(f"{prefix}_no"),
        F.col("n").alias(f"{prefix}_count"),
        F.col("p.at").alias(f"{prefix}_start"),
        F.col("overlap").alias(f"{prefix}_overlap"),
        F.expr("substring(t, p.at - overlap + 1, overlap + p.own)").alias(f"{prefix}_text"),
    )
