"""The timing log as JSON lines, and the span and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillspark.functions.times import utc_text
from quillspark.operators.telemetry import STAGES

TIMING_SCHEMA = S.StructType(
    [
        S.StructField("run_id", S.LongType()),
        S.StructField("query_id", S.StringType()),
        S.StructField("deployment", S.StringType()),
        S.StructField("log_ts", S.StringType()),
        S.StructField("question", S.StringType()),
        *(S.StructField(s, S.DoubleType()) for s in STAGES),
        S.StructField("status", S.StringType()),
        S.StructField("error_type", S.StringType()),
        S.StructField("error_message", S.StringType()),
        S.StructField("received_at", S.TimestampType()),
    ]
)
SPAN_SCHEMA = "trace_id string, name string, level string, status_message string, output map<string,string>"
SCORE_SCHEMA = "trace_id string, name string, value int, comment string"
QUESTION_CHARS = 80


def records(timings: DataFrame) -> DataFrame:
    """Log records: the question cut at 80 characters, times rounded to 4 decimals, NaN as null."""
    seconds = [F.round(F.nanvl(F.col(s), F.lit(None).cast("double")), 4).alias(s) for s in STAGES]
    names = [f.name for f in TIMING_SCHEMA]
    done = timings.withColumns({"question": F.substring("question", 1, QUESTION_CHARS)})
    return done.select(*(seconds[STAGES.index(n)] if n in STAGES else F.col(n) for n in names))


def stamped(timings: DataFrame) -> DataFrame:
    """Records with ``log_ts`` set to the time of writing in UTC where it is missing."""
    return timings.withColumn("log_ts", F.coalesce("log_ts", utc_text(F.current_timestamp())))


def to_lines(timings: DataFrame) -> DataFrame:
    """(value): one JSON record per row, null fields kept."""
    rows = records(timings)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of JSON lines; a line that is no record gives nulls in every field."""
    return lines.select(F.from_json("value", TIMING_SCHEMA).alias("r")).select("r.*")


def append_timings(timings: DataFrame, path: str) -> None:
    """Append log records to a folder of JSON lines; those without a time get that of writing."""
    records(stamped(timings)).write.mode("append").json(path)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """The log with its fixed schema; nothing is inferred, broken lines give null fields."""
    return spark.read.schema(TIMING_SCHEMA).json(path)


def spans_of(timings: DataFrame) -> DataFrame:
    """One span per run and stage with a time, in the shape of ``SPAN_SCHEMA``; failed runs have level ERROR."""
    from quillspark.operators.telemetry import stage_rows, status_of

    rows = stage_rows(timings, "query_id", "status", "error_message")
    level = F.when(status_of(F.col("status")) == "error", "ERROR").otherwise("DEFAULT")
    return rows.select(
        F.coalesce("query_id", F.col("run_id").cast("string")).alias("trace_id"),
        F.regexp_replace("stage", "_s$", "").alias("name"),
        level.alias("level"),
        F.col("error_message").alias("status_message"),
        F.create_map(F.lit("seconds"), F.col("seconds").cast("string")).alias("output"),
    )


def append_spans(spans: DataFrame, path: str | None) -> bool:
    """Append spans to a table; without a path nothing is written, as without keys of a trace service."""
    if not path:
        return False
    spans.write.mode("append").parquet(path)
    return True


def append_scores(scores: DataFrame, path: str | None) -> bool:
    """Append feedback scores, 0 or 1; other values are refused."""
    if not path:
        return False
    if not scores.filter(~F.coalesce(F.col("value").isin(0, 1), F.lit(False))).isEmpty():
        raise ValueError("a feedback score is 0 or 1")
    scores.write.mode("append").parquet(path)
    return True
