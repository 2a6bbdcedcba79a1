"""Parquet tables of one data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repeated keys that a join may send to every executor; more are shuffled with their rows.
REPEATED_SENT = 200_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns``, only those, so the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than the cluster has cores dealt out over all of them; a larger one as it is.

    Small tables come as one split, which would leave heavy row-wise work to one core. A table of the size the
    cluster is made for has splits enough and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with each key once, of repeated rows any one.

    Only the keys are grouped, and only rows of repeated keys are shuffled, so long texts stay where they were read.
    """
    named = {k: f"_repeated_key_{k}" for k in keys}  # names apart from those of the table
    repeated = df.groupBy(*(F.col(k).alias(v) for k, v in named.items())).agg(F.count(F.lit(1)).alias("_repeated")).filter("_repeated > 1").drop("_repeated")
    count = repeated.count()
    if not count:
        return df
    if count > REPEATED_SENT:
        return df.dropDuplicates(keys)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(v)) for k, v in named.items()))
    repeated = F.broadcast(repeated)
    return df.join(repeated, same, "left_anti").union(df.join(repeated, same, "left_semi").dropDuplicates(keys))
