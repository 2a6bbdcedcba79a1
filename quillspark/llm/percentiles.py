"""Exact percentiles per group over very large columns, from one distributed sort.

All values are range-partitioned and sorted by (group, value, tie), so a group of any size, and a value that
stands in it any number of times, is spread over as many partitions as it needs. The rows of each group are counted
per partition, the counts give the offset of every partition in its group, and the offsets say in which partition
and row each wanted order statistic lies. These are looked up by row number, and neighbouring ones are interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.times import log_time, utc_day
from quillspark.session import written

MEASURES = ("llm_generate_s", "total_s")
PERCENTS = (50, 95)
LEAST_VALUES = 20
#: The seconds above which a group is slow, by measure and percentile.
SLOW = (("llm_generate_s", 50, 9.0), ("llm_generate_s", 95, 25.0), ("total_s", 50, 20.0), ("total_s", 95, 40.0))


def sorted_values(df: DataFrame, groups: list[str], value: str, tie: str | None = None) -> DataFrame:
    """``groups``, ``value`` and ``tie`` in one total order, with ``row_id``: the partition in the high bits, the row in it below.

    Null and NaN values are dropped; null group keys form groups of their own. Column ``tie`` spreads equal values. The
    result is a Parquet table in the shared folder, so row ids stay the same when it is read again or an executor is lost.
    """
    clean = df.select(*groups, value, (F.col(tie) if tie else F.lit(0)).alias("tie")).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ordered = clean.repartitionByRange(*groups, value, "tie").sortWithinPartitions(*groups, value, "tie")
    return written(ordered.withColumn("row_id", F.monotonically_increasing_id()))


def percentiles(ordered: DataFrame, groups: list[str], value: str, percents: tuple[int, ...] = PERCENTS, least: int = 1) -> DataFrame:
    """(groups, n, pct, percentile) from the output of ``sorted_values``; groups of fewer than ``least`` values are left out.

    The percentile lies at position pct/100 * (n - 1) of the sorted values, counted from 0, between order
    statistics by linear interpolation. Ties keep their places; an empty table gives no rows.
    """
    counts = ordered.groupBy(F.shiftright("row_id", 33).alias("part"), *groups).agg(
        F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("rows_here")
    )
    own = Window.partitionBy(*groups)
    offsets = counts.withColumn("n", F.sum("rows_here").over(own)).withColumn(
        "before", F.sum("rows_here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    )
    wanted = (
        offsets.filter(F.col("n") >= least)
        .withColumn("before", F.coalesce("before", F.lit(0)))
        .withColumn("pct", F.explode(F.array(*map(F.lit, percents))))
        .withColumn("at", F.col("pct") * (F.col("n") - 1) / F.lit(100.0))
        .withColumn("side", F.explode(F.array(F.floor("at"), F.ceil("at"))))
        .filter((F.col("side") >= F.col("before")) & (F.col("side") < F.col("before") + F.col("rows_here")))
        .select(*groups, "n", "pct", "at", "side", (F.col("first_row") + F.col("side") - F.col("before")).alias("row_id"))
    )
    share = F.max("at") - F.floor(F.max("at"))
    low, high = F.min_by("found", "side"), F.max_by("found", "side")
    return (
        wanted.join(ordered.select("row_id", F.col(value).alias("found")), "row_id")
        .groupBy(*groups, "n", "pct")
        .agg((low + (high - low) * share).alias("percentile"))
    )


def ok_values(timings: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(deployment, day, measure, value, tie) of the runs that ended well, one row per run and measure; ``tie`` is a hash of the run.

    A run counts once by run_id, whatever the number of its lines; its status is compared without letter case
    and blanks around it. Values that are null, NaN or negative, runs without a readable time, and rows with a
    null run_id do not count.
    """
    blanks = F.lit(" \t\r\n")
    runs = (
        timings.filter(F.lower(F.trim("status", blanks)) == "ok")
        .filter(F.col("run_id").isNotNull())
        .select("run_id", F.struct("deployment", "log_ts", *measures).alias("line"))
        .groupBy("run_id")
        .agg(F.min("line").alias("line"))
        .select(F.xxhash64("run_id").alias("tie"), "line.*")
    )
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures)))
    return (
        runs.withColumn("day", utc_day(log_time(F.col("log_ts"))))
        .filter(F.col("day").isNotNull())
        .select("deployment", "day", "tie", pairs.alias("p"))
        .select("deployment", "day", "p.measure", "p.value", "tie")
        .filter((F.col("value") >= 0) & ~F.isnan("value"))
    )


DAY_KEYS = ["deployment", "day", "measure"]


def day_values(timings: DataFrame) -> DataFrame:
    """What is kept for the days: their values in order. Tables kept by several runs, each for its days, can be put together by union."""
    return sorted_values(ok_values(timings), DAY_KEYS, "value", "tie")


def weeks_of(kept: DataFrame) -> DataFrame:
    """The values of weeks (Monday to Sunday) in order, from those kept for days, without another look at the log."""
    return sorted_values(kept.withColumn("day", F.trunc("day", "week")), DAY_KEYS, "value", "tie")


def period_percentiles(timings: DataFrame, percents: tuple[int, ...] = PERCENTS, least: int = LEAST_VALUES) -> DataFrame:
    """(deployment, period, start_day, measure, pct, n, percentile) per day and per week (Monday to Sunday, UTC); all exact."""
    kept = day_values(timings)
    out = None
    for period, ordered in (("day", kept), ("week", weeks_of(kept))):
        part = percentiles(ordered, DAY_KEYS, "value", percents, least).select(
            "deployment", F.lit(period).alias("period"), F.date_format("day", "yyyy-MM-dd").alias("start_day"), "measure", "pct", "n", "percentile"
        )
        out = part if out is None else out.union(part)
    return out


def slow_groups(timings: DataFrame) -> DataFrame:
    """(deployment, period, start_day, measure, pct) of the groups above the limits of ``SLOW``."""
    slow = F.lit(False)
    for measure, pct, limit in SLOW:
        slow |= (F.col("measure") == measure) & (F.col("pct") == pct) & (F.col("percentile") > limit)
    return period_percentiles(timings).filter(slow).select("deployment", "period", "start_day", "measure", F.col("pct").cast("int"))
