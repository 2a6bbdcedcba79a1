"""Compliance and incident operators over resource and log tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Minutes to acknowledge and to resolve by severity.
SLA_MINUTES = (("P1", 15, 240), ("P2", 60, 1440), ("P3", 480, 10080))


def missing_tags(df: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """(key, missing): rows that lack a required tag, with the names of those; a blank tag is lacking too. Narrow."""
    lacking = F.array_compact(F.array(*(F.when(T.is_blank(F.col(t).cast("string")), F.lit(t)) for t in required)))
    return df.select(key, lacking.alias("missing")).filter(F.size("missing") > 0)


def findings(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, rule, severity) of every broken rule; ``rules`` maps a name to its severity and the condition that breaks it.

    All rules are tested in one pass over the table.
    """
    hits = F.array_compact(
        F.array(*(F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity"))) for name, (sev, cond) in rules.items()))
    )
    return df.select(key, F.explode(hits).alias("hit")).select(key, "hit.rule", "hit.severity")


def by_severity(parts: list[DataFrame]) -> DataFrame:
    """(severity, rule, findings) over the findings of several services."""
    every = reduce(DataFrame.unionByName, (p.select("rule", "severity") for p in parts))
    return every.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("findings"))


def sla_breaches(incidents: DataFrame) -> DataFrame:
    """(incident_id, severity, minutes, acknowledged_late, resolved_late) of incidents that broke a limit of their severity.

    Incidents have ``opened``, ``acknowledged`` and ``resolved``; one never acknowledged or resolved broke no limit yet.
    """
    limits = incidents.sparkSession.createDataFrame(SLA_MINUTES, "severity string, ack_minutes int, resolve_minutes int")
    took = lambda c: (F.unix_micros(c) - F.unix_micros("opened")) / F.lit(60_000_000.0)
    late = incidents.join(F.broadcast(limits), "severity").select(
        "incident_id", "severity", F.round(took("acknowledged"), 4).alias("minutes"),
        F.coalesce(took("acknowledged") > F.col("ack_minutes"), F.lit(False)).alias("acknowledged_late"),
        F.coalesce(took("resolved") > F.col("resolve_minutes"), F.lit(False)).alias("resolved_late"),
    )
    return late.filter("acknowledged_late OR resolved_late")


def unknown_origins(log: DataFrame, known: DataFrame, key: str, event: Column | None = None) -> DataFrame:
    """Log rows, with ``event`` only those of that kind, whose ``key`` is not among the known ones; a null key is unknown."""
    return (log if event is None else log.filter(event)).join(known.select(key).distinct(), key, "left_anti")


def error_patterns(log: DataFrame, message: str, patterns: dict[str, str]) -> DataFrame:
    """(pattern, lines): how many messages each named pattern is found in; a message can count for several."""
    names = F.array_compact(F.array(*(F.when(F.col(message).rlike(p), F.lit(n)) for n, p in patterns.items())))
    return log.select(F.explode(names).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("lines"))


def name_parts(c: Column) -> Column:
    """(project, environment, kind, qualifier) of ``project-environment-kind[-qualifier]``; nulls if the name is no such name."""
    pattern = r"^([a-z][a-z0-9]*)-([a-z0-9]+)-([a-z0-9]+)(?:-([a-z0-9-]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.struct(part(1).alias("project"), part(2).alias("environment"), part(3).alias("kind"), part(4).alias("qualifier"))
