"""Times in UTC, whatever the time zone of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ZONED = r"(?i)(z|utc|gmt|[+-][0-9]{2}(:?[0-9]{2})?)\s*$"
_DAY = 86_400_000_000


def log_time(c: Column) -> Column:
    """ISO-8601 text to a timestamp, without an offset taken as UTC; null if it is none."""
    return F.try_to_timestamp(F.when(c.rlike(_ZONED), c).otherwise(F.concat(c, F.lit("Z"))))


def event_time(df: DataFrame, name: str) -> Column:
    """Column ``name`` as an instant; a timestamp without time zone is taken as UTC."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
    return c.cast("timestamp")


def utc_day(c: Column) -> Column:
    """The UTC day of a timestamp."""
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / F.lit(_DAY)).cast("int"))


def utc_text(c: Column) -> Column:
    """ISO-8601 of a timestamp in UTC with microseconds, as the logs write it: 2026-05-15T14:02:00.000000+00:00."""
    second = F.floor(F.unix_micros(c) / F.lit(1_000_000))
    day, rest = F.date_from_unix_date(F.floor(second / 86_400).cast("int")), F.pmod(second, F.lit(86_400))
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat_ws(":", part(rest / 3600), part(F.pmod(rest, F.lit(3600)) / 60), part(F.pmod(rest, F.lit(60))))
    micros = F.lpad(F.pmod(F.unix_micros(c), F.lit(1_000_000)).cast("string"), 6, "0")
    return F.when(c.isNotNull(), F.concat(day.cast("string"), F.lit("T"), clock, F.lit("."), micros, F.lit("+00:00")))
