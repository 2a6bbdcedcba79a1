"""Queries over the timing log, token usage and request events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.times import event_time
from quillspark.operators import platform, telemetry
from quillspark.plans import sql
from quillspark.sources import logs
from quillspark.sources.tables import table

#: Monthly token budget the budget query measures against, and requests a minute above which a target scales out.
MONTHLY_TOKENS, SCALE_ABOVE = 1_000_000.0, 1
PATTERNS = {"not_found": "(?i)not found", "timeout": "(?i)time[sd]? ?out", "refused": "(?i)refused", "parse": "(?i)parse", "filter": "(?i)filter"}


def _runs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return telemetry.runs(table(spark, folder, "rag_timings"), *columns)


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def stage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.stage_summary(_runs(spark, folder, "deployment", *telemetry.STAGES))


def stage_top2(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.slowest_stages(_runs(spark, folder, *telemetry.STAGES[:-1]))


def timing_table(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.timing_lines(_runs(spark, folder, *telemetry.STAGES))


def timing_log_json(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines as JSON records and read back with the log's schema: field by field what was written."""
    lines = logs.to_lines(_runs(spark, folder))
    return logs.from_lines(lines).select("run_id", "question", "status", F.round("total_s", 4).alias("total_s"))


def error_class(spark: SparkSession, folder: str) -> DataFrame:
    failed = _runs(spark, folder, "error_message", "error_type").filter(F.col("error_message").isNotNull())
    flags = [T.unreachable(F.col("error_message"), g).alias(f"unreachable_v{g}") for g in (1, 2, 3)]
    return failed.groupBy("error_type", *flags).agg(F.count(F.lit(1)).alias("runs"))


def question_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by what the input checks say: blank, over 200 characters, cut at 80 for the log."""
    q = F.col("question")
    rows = _runs(spark, folder, "question").select(
        T.is_blank(q).alias("blank"), (F.coalesce(F.length(q), F.lit(0)) <= 200).alias("fits"), F.coalesce(F.length(F.substring(q, 1, 80)), F.lit(0)).alias("logged_chars")
    )
    return rows.groupBy("blank", "fits").agg(F.count(F.lit(1)).alias("runs"), F.sum("logged_chars").alias("logged_chars"))


def usage_cost(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.usage_cost(table(spark, folder, "token_usage"))


def usage_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Usage rows whose parts do not add up, after nulls became 0."""
    spent = telemetry.usage_cost(table(spark, folder, "token_usage"))
    gap = F.col("total_tokens") - F.col("prompt_tokens") - F.col("completion_tokens")
    return spent.filter(gap != 0).select("query_id", gap.alias("gap"))


def availability_30d(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.availability(_runs(spark, folder, "deployment", "log_ts", "status"))


def growth_projection(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.growth(_runs(spark, folder, "deployment", "log_ts"))


def trailing_use(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.trailing_use(_runs(spark, folder, "deployment", "log_ts", "total_s"))


def cost_attribution(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.cost_by_tag(_runs(spark, folder, "deployment", "query_id"), table(spark, folder, "token_usage"))


def log_retention(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.retained(_runs(spark, folder, "deployment", "log_ts", "status"), ok_days=5, error_days=6)


def escalations(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.escalations(_runs(spark, folder, "deployment", "log_ts", "status"))


def windows_5m(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.windowed(_events(spark, folder)).drop("tokens")


def windows_by_model(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly windows with the tokens of every kind of request, which stands for the model asked."""
    return telemetry.windowed(_events(spark, folder), 60, "event_type").withColumnRenamed("event_type", "model")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of all periods: request windows for rates and latencies, deployments with failed runs as hosts out of
    order, the share of ten minutes that requests keep one worker busy, and days for the token budget."""
    events = _events(spark, folder)
    by_5 = telemetry.alerts(telemetry.windowed(events), {"error_rate": "error_rate", "latency_p95": "latency_p95"})
    failed = _runs(spark, folder, "deployment", "log_ts", "status").filter((telemetry.status_of(F.col("status")) == "error") & F.col("ts").isNotNull())
    hosts = failed.groupBy(F.window("ts", "2 minutes").alias("w")).agg(F.count_distinct("deployment").alias("unhealthy"))
    by_2 = telemetry.alerts(hosts.select(F.col("w.start").alias("window_start"), "unhealthy"), {"unhealthy": "unhealthy"}, minutes=2)
    load = events.groupBy(F.window(event_time(events, "ts"), "10 minutes").alias("w")).agg(F.round(F.sum("value") / 6.0, 4).alias("cpu"))
    by_10 = telemetry.alerts(load.select(F.col("w.start").alias("window_start"), "cpu"), {"cpu": "cpu"}, minutes=10)
    spent = token_budget(spark, folder).select(F.col("day").cast("timestamp").alias("window_start"), F.round(F.col("spent") / MONTHLY_TOKENS, 6).alias("budget_share"))
    by_day = telemetry.alerts(spent, {"budget_share": "budget_share"}, minutes=1440)
    return by_5.unionByName(by_2).unionByName(by_10).unionByName(by_day)


def change_failure_rate(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.change_failure_rate(_runs(spark, folder, "deployment", "log_ts", "status"))


def consumer_rate(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.floods(_events(spark, folder), least=2)


def consumer_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.anomalies(_events(spark, folder), deviations=2.0)


def token_budget(spark: SparkSession, folder: str) -> DataFrame:
    tokens = _events(spark, folder).select("ts", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"))
    return telemetry.token_budget(tokens, MONTHLY_TOKENS)


def scale_outs(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.scale_outs(_events(spark, folder), above=SCALE_ABOVE)


def quota_minutes(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.quota_minutes(_events(spark, folder))


def error_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return platform.error_patterns(_runs(spark, folder, "error_message"), "error_message", PATTERNS)


def resource_names(spark: SparkSession, folder: str) -> DataFrame:
    named = _runs(spark, folder, "deployment").select(platform.name_parts(F.col("deployment")).alias("n"))
    return named.groupBy("n.project", "n.environment", "n.kind", "n.qualifier").agg(F.count(F.lit(1)).alias("runs"))


def _findings(spark: SparkSession, folder: str) -> list[DataFrame]:
    documents = {
        "no_source": ("P2", F.col("source").isNull()),
        "no_language": ("P3", F.col("lang").isNull()),
        "no_text": ("P1", F.coalesce(F.length("text"), F.lit(0)) == 0),
    }
    timings = {
        "negative_time": ("P2", F.coalesce(F.col("total_s") < 0, F.lit(False))),
        "no_status": ("P3", F.col("status").isNull()),
        "failed_without_type": ("P2", (telemetry.status_of(F.col("status")) == "error") & F.col("error_type").isNull()),
    }
    return [
        platform.findings(table(spark, folder, "documents"), "doc_id", documents),
        platform.findings(_runs(spark, folder, "total_s", "status", "error_type"), "run_id", timings),
    ]


def rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    return _findings(spark, folder)[1]


def findings_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return platform.by_severity(_findings(spark, folder))


def sla_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """Failed runs as incidents: opened when logged, acknowledged when received; a timeout is P1, another failure P2."""
    failed = _runs(spark, folder, "error_message", "log_ts").filter(F.col("error_message").isNotNull() & F.col("ts").isNotNull())
    severity = F.when(F.col("error_message").contains("timed out"), "P1").otherwise("P2")
    incidents = failed.select(
        F.col("run_id").alias("incident_id"), severity.alias("severity"), F.col("ts").alias("opened"), F.col("received_at").alias("acknowledged"), F.col("received_at").alias("resolved")
    )
    return platform.sla_breaches(incidents)


def untraced_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with a query_id for which no usage row exists."""
    traced = _runs(spark, folder, "query_id").filter(F.col("query_id").isNotNull()).select("run_id", "query_id")
    return platform.unknown_origins(traced, table(spark, folder, "token_usage"), "query_id")


def anomalous_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Error events of consumers that never viewed or bought anything."""
    events = _events(spark, folder)
    known = events.filter(F.col("event_type").isin("view", "purchase")).select("user_id")
    found = platform.unknown_origins(events, known, "user_id", F.col("event_type") == "error")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (
        stage_summary, stage_top2, timing_table, timing_log_json, error_class, question_checks, usage_cost, usage_mismatch,
        availability_30d, growth_projection, trailing_use, cost_attribution, log_retention, escalations, windows_5m, windows_by_model, alerts, change_failure_rate,
        consumer_rate, consumer_anomalies, token_budget, scale_outs, quota_minutes, error_patterns, resource_names, rule_findings,
        findings_by_severity, sla_breaches, untraced_usage, anomalous_errors,
    )
}

_STAGE_ROWS = f"""
{sql.RUNS},
stages AS (SELECT run_id, deployment, s.stage, s.pos, s.v FROM (
    SELECT run_id, deployment, unnest([{", ".join(f"{{'stage': '{s}', 'pos': {i}, 'v': {s}}}" for i, s in enumerate(telemetry.STAGES))}]) AS s FROM runs))
"""

_MODELS = """
SELECT event_type AS model, time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       CAST(sum(coalesce(CAST(props ->> '$.k' AS BIGINT), 0)) AS BIGINT) AS tokens, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 6) AS error_rate,
       round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.95), 6) AS latency_p95, round(quantile_cont(value, 0.99), 6) AS latency_p99
FROM events GROUP BY 1, 2
"""

_BUDGET = """
d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(coalesce(CAST(props ->> '$.k' AS BIGINT), 0)) AS BIGINT) AS tokens FROM events GROUP BY 1),
r AS (SELECT strftime(day, '%Y-%m') AS month, day, tokens, CAST(sum(tokens) OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY day) AS BIGINT) AS spent FROM d)
"""

_WINDOWS = """
w AS (
    SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
           round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.95), 6) AS latency_p95, round(quantile_cont(value, 0.99), 6) AS latency_p99
    FROM events GROUP BY 1),
rated AS (SELECT window_start, requests, errors, round(errors / requests, 6) AS error_rate, latency_p50, latency_p95, latency_p99 FROM w)
"""

_DAILY = f"""
{sql.RUNS},
daily AS (SELECT deployment, CAST(ts AS DATE) AS day, count(*) AS r, sum(CASE WHEN lower(trim(status)) = 'ok' THEN 1 ELSE 0 END) AS k FROM runs WHERE ts IS NOT NULL GROUP BY 1, 2)
"""

_FOUND = """
found_runs AS (
    SELECT run_id, unnest([CASE WHEN total_s < 0 THEN 'negative_time' END, CASE WHEN status IS NULL THEN 'no_status' END,
                           CASE WHEN lower(trim(status)) = 'error' AND error_type IS NULL THEN 'failed_without_type' END]) AS rule FROM runs),
rated AS (SELECT run_id, rule, CASE WHEN rule = 'no_status' THEN 'P3' ELSE 'P2' END AS severity FROM found_runs WHERE rule IS NOT NULL)
"""

SQL = {
    "stage_summary": f"""
WITH {_STAGE_ROWS}
SELECT deployment, stage, count(*) AS runs, round(avg(v), 6) AS mean_s, max(v) AS max_s,
       array_to_string(list_transform(string_split(replace(regexp_replace(stage, '_s$', ''), '_', ' '), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS label
FROM stages WHERE v >= 0 AND NOT isnan(v) GROUP BY deployment, stage
""",
    "stage_top2": f"""
WITH {_STAGE_ROWS},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, pos) AS rank FROM stages WHERE v IS NOT NULL AND NOT isnan(v) AND stage <> 'total_s')
SELECT run_id, CAST(rank AS INTEGER) AS rank, stage, v AS seconds FROM r WHERE rank <= 2
""",
    "timing_table": f"""
WITH {_STAGE_ROWS}
SELECT run_id, pos, '  ' || rpad(stage, 26, ' ') || ':  ' || CASE WHEN v IS NULL OR isnan(v) THEN '—' ELSE CAST(CAST(v AS DECIMAL(18, 4)) AS VARCHAR) || ' s' END AS line,
       CASE WHEN v IS NULL OR isnan(v) THEN '—' ELSE CAST(CAST(round(CAST(v AS DECIMAL(18, 4)), 3) AS DECIMAL(18, 3)) AS VARCHAR) END AS shown
FROM stages
""",
    "timing_log_json": f"WITH {sql.RUNS} SELECT run_id, question, status, CASE WHEN isnan(total_s) THEN NULL ELSE round(total_s, 4) END AS total_s FROM runs",
    "error_class": f"""
WITH {sql.RUNS},
f AS (SELECT error_type, regexp_matches(lower(error_message), 'connection|refused|timeout') AS unreachable_v1,
             regexp_matches(lower(error_message), 'connection|api|authenticate') AS unreachable_v2,
             regexp_matches(lower(error_message), 'connection|api|authenticate|401|403') AS unreachable_v3 FROM runs WHERE error_message IS NOT NULL)
SELECT error_type, unreachable_v1, unreachable_v2, unreachable_v3, count(*) AS runs FROM f GROUP BY ALL
""",
    "question_checks": f"""
WITH {sql.RUNS}
SELECT coalesce({sql.trim_all("question")} = '', true) AS blank, coalesce(length(question), 0) <= 200 AS fits, count(*) AS runs,
       CAST(sum(coalesce(length(substring(question, 1, 80)), 0)) AS BIGINT) AS logged_chars
FROM runs GROUP BY 1, 2
""",
    "usage_cost": """
SELECT DISTINCT query_id, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, coalesce(total_tokens, 0) AS total_tokens,
       round(coalesce(total_tokens, 0) * 0.00000022::DOUBLE, 9) AS cost FROM token_usage
""",
    "usage_mismatch": """
WITH u AS (SELECT DISTINCT query_id, coalesce(prompt_tokens, 0) AS p, coalesce(completion_tokens, 0) AS c, coalesce(total_tokens, 0) AS t FROM token_usage)
SELECT query_id, CAST(t - p - c AS INTEGER) AS gap FROM u WHERE t - p - c <> 0
""",
    "availability_30d": f"""
WITH {_DAILY},
s AS (SELECT deployment, day, sum(r) OVER w AS runs, sum(k) OVER w AS ok_runs FROM daily
      WINDOW w AS (PARTITION BY deployment ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))
SELECT deployment, day, CAST(runs AS BIGINT) AS runs, CAST(ok_runs AS BIGINT) AS ok_runs, round(ok_runs / runs, 6) AS availability FROM s
""",
    "growth_projection": f"""
WITH {_DAILY},
x AS (SELECT deployment, date_diff('day', DATE '1970-01-01', day) AS x, r AS y FROM daily),
f AS (SELECT deployment, count(*) AS days, regr_slope(y, x) AS slope, avg(x) AS mx, avg(y) AS my, max(x) AS last FROM x GROUP BY deployment HAVING count(*) >= 2)
SELECT deployment, days, round(slope, 4) AS slope, round(my + slope * (last + 90 - mx), 2) AS projected FROM f
""",
    "trailing_use": f"""
WITH {sql.RUNS},
d AS (SELECT deployment, CAST(ts AS DATE) AS day, sum(total_s) AS busy FROM runs WHERE total_s >= 0 AND NOT isnan(total_s) AND ts IS NOT NULL GROUP BY 1, 2)
SELECT deployment, day, round(busy, 4) AS busy_s, round(avg(busy) OVER (PARTITION BY deployment ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 8) AS trailing_mean FROM d
""",
    "cost_attribution": f"""
WITH {sql.RUNS},
u AS (SELECT query_id, max(coalesce(total_tokens, 0)) AS tokens FROM token_usage GROUP BY query_id)
SELECT string_split(deployment, '-')[1] AS environment, string_split(deployment, '-')[2] AS region, deployment, count(*) AS runs,
       CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens, round(sum(coalesce(tokens, 0)) * 0.00000022::DOUBLE, 9) AS cost
FROM runs LEFT JOIN u USING (query_id) GROUP BY 1, 2, 3
""",
    "log_retention": f"""
WITH {sql.RUNS}, n AS (SELECT max(ts) AS newest FROM runs),
k AS (SELECT deployment, coalesce(date_diff('day', CAST(ts AS DATE), CAST(newest AS DATE)) <= CASE WHEN lower(trim(status)) = 'error' THEN 6 ELSE 5 END, true) AS kept FROM runs, n)
SELECT deployment, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM k GROUP BY deployment
""",
    "escalations": f"""
WITH {sql.RUNS},
f AS (SELECT deployment, run_id, ts FROM runs WHERE lower(trim(status)) = 'error' AND ts IS NOT NULL),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY deployment ORDER BY ts, run_id)) <= 900000000 THEN 0 ELSE 1 END AS fresh FROM f),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY deployment ORDER BY ts, run_id) AS island FROM g)
SELECT deployment, min(ts) AS started, max(ts) AS ended, count(*) AS failures, CASE WHEN count(*) >= 3 THEN 'P1' ELSE 'P2' END AS severity
FROM i GROUP BY deployment, island
""",
    "scale_outs": f"""
WITH RECURSIVE m AS (SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > {SCALE_ABOVE}),
s AS (
    SELECT event_type, min(minute) AS minute FROM m GROUP BY event_type
    UNION ALL SELECT s.event_type, min(m.minute) FROM s JOIN m ON m.event_type = s.event_type AND m.minute >= s.minute + INTERVAL 300 SECOND GROUP BY s.event_type)
SELECT event_type, minute, requests FROM s JOIN m USING (event_type, minute)
""",
    "change_failure_rate": f"""
WITH {sql.RUNS},
t AS (SELECT deployment, ts, CAST(ts AS DATE) AS day, CASE WHEN lower(trim(status)) = 'error' THEN 1 ELSE 0 END AS bad FROM runs WHERE ts IS NOT NULL),
d AS (SELECT deployment, day, min(ts) AS began FROM t GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY deployment ORDER BY day), day) AS gap FROM d) WHERE gap IS NULL OR gap > 1),
r AS (SELECT c.deployment, c.began, avg(bad) AS share FROM c JOIN t ON c.deployment = t.deployment AND t.ts >= c.began AND t.ts < c.began + INTERVAL 24 HOUR GROUP BY 1, 2)
SELECT deployment, count(*) AS changes, count(*) FILTER (share > 0.05) AS failed, round(count(*) FILTER (share > 0.05) / count(*), 6) AS rate FROM r GROUP BY deployment
""",
    "windows_5m": f"WITH {_WINDOWS} SELECT * FROM rated",
    "windows_by_model": _MODELS,
    "alerts": f"""
WITH {_WINDOWS}, {_BUDGET}, {sql.RUNS},
m AS (
    SELECT window_start, 'error_rate' AS metric, 5 AS minutes, CAST(error_rate AS DOUBLE) AS value FROM rated
    UNION ALL SELECT window_start, 'latency_p95', 5, latency_p95 FROM rated
    UNION ALL SELECT time_bucket(INTERVAL 2 MINUTE, ts), 'unhealthy', 2, CAST(count(DISTINCT deployment) AS DOUBLE) FROM runs WHERE lower(trim(status)) = 'error' AND ts IS NOT NULL GROUP BY 1
    UNION ALL SELECT time_bucket(INTERVAL 10 MINUTE, ts), 'cpu', 10, round(sum(value) / 6.0::DOUBLE, 4) FROM events GROUP BY 1
    UNION ALL SELECT CAST(day AS TIMESTAMP), 'budget_share', 1440, round(spent / 1000000.0::DOUBLE, 6) FROM r),
rules AS (SELECT * FROM (VALUES ('error_rate_high', 'error_rate', 5, 0.05, 'P1'), ('latency_p95_high', 'latency_p95', 5, 3.0, 'P2'),
                                ('invocation_error_rate_high', 'error_rate', 5, 0.01, 'P2'), ('endpoint_unavailable', 'unhealthy', 2, 0.0, 'P1'),
                                ('cpu_high', 'cpu', 10, 85.0, 'P3'),
                                ('token_budget_high', 'budget_share', 1440, 0.8, 'P3')) AS t(alert, metric, minutes, threshold, severity))
SELECT window_start, alert, severity, metric, value, CAST(threshold AS DOUBLE) AS threshold FROM m JOIN rules USING (metric, minutes) WHERE value > threshold
""",
    "consumer_rate": """
WITH s AS (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(k AS INTEGER)) AS window_start FROM events, generate_series(0, 4) AS g(k))
SELECT user_id, window_start, count(*) AS requests FROM s GROUP BY 1, 2 HAVING count(*) >= 2
""",
    "consumer_anomalies": """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM events GROUP BY 1, 2),
o AS (SELECT user_id, avg(requests) AS mean, stddev_pop(requests) AS spread FROM d GROUP BY 1)
SELECT user_id, day, requests, round(mean, 6) AS mean, round(spread, 6) AS spread FROM d JOIN o USING (user_id) WHERE requests > mean + 2 * spread
""",
    "token_budget": f"""
WITH {_BUDGET}
SELECT month, day, tokens, spent, spent > 0.8 * 1000000 AS over FROM r
""",
    "quota_minutes": """
SELECT event_type, date_trunc('minute', ts) AS minute, count(*) AS requests, CAST(sum(coalesce(CAST(props ->> '$.k' AS BIGINT), 0)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2
""",
    "error_patterns": f"""
WITH {sql.RUNS}
SELECT pattern, count(*) AS lines FROM runs, (VALUES {", ".join(f"('{n}', '{p}')" for n, p in PATTERNS.items())}) AS p(pattern, re)
WHERE error_message IS NOT NULL AND regexp_matches(error_message, re) GROUP BY pattern
""",
    "resource_names": f"""
WITH {sql.RUNS},
n AS (SELECT regexp_extract(deployment, '^([a-z][a-z0-9]*)-([a-z0-9]+)-([a-z0-9]+)(?:-([a-z0-9-]+))?$', ['project', 'environment', 'kind', 'qualifier']) AS n FROM runs)
SELECT nullif(n.project, '') AS project, nullif(n.environment, '') AS environment, nullif(n.kind, '') AS kind, nullif(n.qualifier, '') AS qualifier, count(*) AS runs FROM n GROUP BY ALL
""",
    "rule_findings": f"WITH {sql.RUNS}, {_FOUND} SELECT run_id, rule, severity FROM rated",
    "findings_by_severity": f"""
WITH {sql.RUNS}, {_FOUND},
d AS (SELECT unnest([CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN lang IS NULL THEN 'no_language' END, CASE WHEN coalesce(length(text), 0) = 0 THEN 'no_text' END]) AS rule FROM documents),
e AS (SELECT rule, severity FROM rated UNION ALL
      SELECT rule, CASE rule WHEN 'no_source' THEN 'P2' WHEN 'no_language' THEN 'P3' ELSE 'P1' END FROM d WHERE rule IS NOT NULL)
SELECT severity, rule, count(*) AS findings FROM e GROUP BY severity, rule
""",
    "sla_breaches": f"""
WITH {sql.RUNS},
i AS (SELECT run_id, CASE WHEN contains(error_message, 'timed out') THEN 'P1' ELSE 'P2' END AS severity,
             (epoch_us(received_at) - epoch_us(ts)) / 60000000.0::DOUBLE AS m FROM runs WHERE error_message IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, m > CASE severity WHEN 'P1' THEN 15 ELSE 60 END AS a, m > CASE severity WHEN 'P1' THEN 240 ELSE 1440 END AS r FROM i)
SELECT run_id AS incident_id, severity, round(m, 4) AS minutes, coalesce(a, false) AS acknowledged_late, coalesce(r, false) AS resolved_late FROM l WHERE a OR r
""",
    "untraced_usage": f"""
WITH {sql.RUNS} SELECT run_id, query_id FROM runs WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT query_id FROM token_usage WHERE query_id IS NOT NULL)
""",
    "anomalous_errors": """
SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND (user_id IS NULL OR user_id NOT IN (
    SELECT user_id FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS NOT NULL)) GROUP BY user_id
""",
}
