"""Top N rows within every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: Column, score: Column, ties: Sequence[Column], row_id: Column, n: int, *, group_name: str = "group_key", rank_name: str = "rank") -> DataFrame:
    """The n rows of each group with the highest score; ties go to the smaller tie columns, then to the smaller id.

    Two ranked steps over one shuffle. The first keeps dense ranks up to n: the optimiser puts a
    group limit before and after the exchange on the group, so a mapper sends at most n distinct
    rows of a group (and their repeats) however many it holds; a hot group costs no more than
    n rows a mapper. The second drops repeats and numbers the rows with row_number.

    Defined results: rows whose group or score is null (or NaN) are left out; null ties count as
    the empty string if they are text; rows that agree in group, score, ties and id are one row (a
    re-sent row), whichever copy; fewer than n rows in a group all come out; an empty table gives
    no rows. Columns of df named like group_name or rank_name are replaced.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rest = [c for c in df.columns if c not in (group_name, rank_name)]
    bare = df.select(group.alias("g"), score.alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(ties)], row_id.alias("id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    if dict(bare.dtypes)["s"] in ("double", "float"):
        bare = bare.where(~F.isnan("s"))
    bare = bare.withColumns({c: F.coalesce(c, F.lit("")) for c, kind in bare.dtypes if c[0] == "t" and kind == "string"})
    keys = ", ".join(["s DESC", *[f"t{i} ASC" for i in range(len(ties))], "id ASC"])
    near = df.sparkSession.sql(
        f"""SELECT * FROM (
              SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY {keys}) AS dense
              FROM {{rows}} WHERE g IS NOT NULL AND s IS NOT NULL)
            WHERE dense <= {n:d}""",
        rows=bare,
    ).drop("dense")
    once = near.groupBy(*[c for c in near.columns if c != "row"]).agg(F.first("row").alias("row"))
    best = df.sparkSession.sql(
        f"""SELECT * FROM (
              SELECT g, row, row_number() OVER (PARTITION BY g ORDER BY {keys}) AS place FROM {{rows}})
            WHERE place <= {n:d}""",
        rows=once,
    )
    return best.select(F.col("g").alias(group_name), F.col("place").alias(rank_name), *[F.col(f"row.`{c}`").alias(c) for c in rest])


def clean_path(path: Column) -> Column:
    """A path with / for every backslash and without leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")
