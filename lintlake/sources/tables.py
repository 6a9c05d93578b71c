"""Parquet table access and tables written once in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in spark.checkpoint.dir; a temporary folder takes its place only in a local session that names none.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(shared_dir, "own", "") or tempfile.mkdtemp(prefix="lintlake-")
        shared_dir.own = named
    return named.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, nothing is computed twice,
    and the rows survive the loss of any executor. The table is removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def first_sent(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """The rows of df that arrived first for their key; a null key or arrival counts as first.

    Only keys and arrivals are shuffled. What comes of it, the keys that were sent again, is written, so that its
    size is known when the join is planned: it is broadcast if it is small, and joined by a shuffle of both sides
    beyond Spark's threshold. Rows of equal key and arrival all stay."""
    again = df.groupBy(key).agg(F.min(arrival).alias("first_"), F.count(F.lit(1)).alias("n_")).where("n_ > 1").select(F.col(key).alias("key_"), "first_")
    return df.join(materialize(again, "again"), F.col(key) == F.col("key_"), "left").where(f"first_ is null or `{arrival}` is null or `{arrival}` = first_").drop("key_", "first_")
