"""Code blocks in Markdown and the health of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import lines, strip

_BLOCK = r"(?s)```(\w*)\n(.*?)```"
_RUNNABLE = ("python", "py", "bash", "sh", "shell")
_SHORT = ("python", "py", "bash", "sh")


def code_blocks(documents: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Fenced blocks: index (from 0), language (text if none), code, line number, runnable. No shuffle.

    The place of a block is the length of the texts between blocks and of the blocks before it."""
    c = F.col(text)
    told = documents.where(F.contains(c, F.lit("```"))).select(*keys, F.regexp_extract_all(c, F.lit(_BLOCK), F.lit(0)).alias("blocks"), F.split(c, _BLOCK).alias("between"))
    one = told.select(*keys, "blocks", "between", F.posexplode("blocks").alias("block_index", "block"))
    before = F.concat(F.array_join(F.slice("between", F.lit(1), F.col("block_index") + 1), ""), F.array_join(F.slice("blocks", F.lit(1), F.col("block_index")), ""))
    language = F.lower(F.regexp_extract("block", _BLOCK, 1))
    return one.select(
        *keys,
        "block_index",
        F.when(language == "", "text").otherwise(language).alias("language"),
        strip(F.regexp_extract("block", _BLOCK, 2)).alias("code"),
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line_number"),
    ).withColumn("runnable", F.col("language").isin(*_RUNNABLE))


def block_issues(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks without a language, and single-line examples."""
    untagged = F.when((F.col("language") == "text") & (F.col("code") != ""), "untagged block")
    single = F.when(F.col("language").isin(*_SHORT) & (F.size(lines(F.col("code"))) == 1), "single-line example")
    return blocks.select(*keys, "block_index", "language", F.explode(F.filter(F.array(untagged, single), lambda x: x.isNotNull())).alias("issue")).withColumn("severity", F.lit("info"))


def docs_health(heads: DataFrame, blocks: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks, issues and score of every document; one without blocks scores 70."""
    b = blocks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("blocks"))
    i = issues.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("issues"), *[F.count_if(F.col("severity") == s).cast("int").alias(f"{s}s") for s in ("error", "warning")])
    all_ = heads.join(b, list(keys), "left").join(i, list(keys), "left").fillna(0, ["blocks", "issues", "errors", "warnings"])
    errors, warnings = F.col("errors"), F.col("warnings")
    score = F.when(F.col("blocks") == 0, 70).when(errors > 0, F.greatest(F.lit(20), 80 - errors * 15 - warnings * 5)).otherwise(F.greatest(F.lit(60), 95 - warnings * 5 - F.col("issues") * 3))
    return all_.withColumn("score", score)
