"""Timings, usage and request logs: stage statistics, windows, alerts, budgets, attribution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.times import event_time, log_time, utc_day

#: The timing columns in their declared order.
STAGES = (
    "index_load_s", "bge_model_load_s", "query_embed_s", "faiss_search_s", "bm25_score_s",
    "rrf_mmr_s", "cross_encoder_load_s", "cross_encoder_rank_s", "llm_generate_s", "total_s",
)
#: Fixed value: price of a token in dollars.
TOKEN_PRICE = 0.00000022
#: Alert rules as (alert, metric, threshold, minutes, severity); an alert is raised above its threshold.
ALERT_RULES = (
    ("error_rate_high", "error_rate", 0.05, 5, "P1"),
    ("latency_p95_high", "latency_p95", 3.0, 5, "P2"),
    ("model_latency_p95_high", "model_latency_p95", 2.0, 5, "P2"),
    ("invocation_error_rate_high", "error_rate", 0.01, 5, "P2"),
    ("endpoint_unavailable", "unhealthy", 0.0, 2, "P1"),
    ("cpu_high", "cpu", 85.0, 10, "P3"),
    ("memory_high", "memory", 90.0, 10, "P2"),
    ("token_budget_high", "budget_share", 0.8, 1440, "P3"),
)


def runs(timings: DataFrame, *columns: str) -> DataFrame:
    """One row per run_id: repeated lines, which differ only in received_at, count once, the first received.

    With ``columns`` only those are read and shuffled. ``ts`` is the time of ``log_ts``, if that is among them.
    """
    rest = list(columns) or [c for c in timings.columns if c not in ("run_id", "received_at")]
    first = timings.groupBy("run_id").agg(F.min(F.struct("received_at", *rest)).alias("line"))
    found = first.select("run_id", "line.received_at", *(f"line.{c}" for c in rest))
    return found.withColumn("ts", log_time(F.col("log_ts"))) if "log_ts" in rest else found


def status_of(c: Column) -> Column:
    """Status in lower case without blanks around; null stays null."""
    return F.lower(F.trim(c))


def stage_rows(one_per_run: DataFrame, *keys: str) -> DataFrame:
    """(run_id, keys, stage, pos, seconds): one row per run and stage that has a proper time."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(i).alias("pos"), F.col(s).alias("seconds")) for i, s in enumerate(STAGES)))
    return (
        one_per_run.select("run_id", *keys, F.explode(stages).alias("s"))
        .select("run_id", *keys, "s.stage", "s.pos", "s.seconds")
        .filter(F.col("seconds").isNotNull() & ~F.isnan("seconds"))
    )


def stage_summary(one_per_run: DataFrame) -> DataFrame:
    """(deployment, stage, label, runs, mean_s, max_s) of all proper, not negative times."""
    rows = stage_rows(one_per_run, "deployment").filter(F.col("seconds") >= 0)
    return rows.groupBy("deployment", "stage").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("seconds"), 6).alias("mean_s"), F.max("seconds").alias("max_s")
    ).withColumn("label", T.stage_label(F.col("stage")))


def slowest_stages(one_per_run: DataFrame, k: int = 2) -> DataFrame:
    """(run_id, rank, stage, seconds): the slowest stages of each run without the total; ties by declared order.

    Sorted within the row, so nothing is shuffled.
    """
    parts = [F.struct((-F.col(s)).alias("less"), F.lit(i).alias("pos"), F.lit(s).alias("stage"), F.col(s).alias("seconds")) for i, s in enumerate(STAGES[:-1])]
    known = F.filter(F.array(*parts), lambda x: x.seconds.isNotNull() & ~F.isnan(x.seconds))
    best = F.slice(F.array_sort(known), 1, k)
    return one_per_run.select("run_id", F.posexplode(best).alias("at", "s")).select("run_id", (F.col("at") + 1).alias("rank"), "s.stage", "s.seconds")


def timing_lines(one_per_run: DataFrame) -> DataFrame:
    """(run_id, pos, line, shown): the aligned line of every stage and the value with three decimals; a dash for none.

    Halves are rounded away from zero.
    """
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(i).alias("pos"), F.col(s).alias("v")) for i, s in enumerate(STAGES)))
    rows = one_per_run.select("run_id", F.explode(stages).alias("s")).select("run_id", "s.stage", "s.pos", "s.v")
    known = F.col("v").isNotNull() & ~F.isnan("v")
    head = F.concat(F.lit("  "), F.rpad("stage", 26, " "), F.lit(":  "))
    line = F.when(known, F.concat(head, F.format_string("%.4f", "v"), F.lit(" s"))).otherwise(F.concat(head, F.lit("—")))
    return rows.select("run_id", "pos", line.alias("line"), F.when(known, F.format_string("%.3f", "v")).otherwise("—").alias("shown"))


def usage_cost(usage: DataFrame) -> DataFrame:
    """(query_id, prompt_tokens, completion_tokens, total_tokens, cost): nulls count as 0, repeated rows once."""
    kinds = ("prompt_tokens", "completion_tokens", "total_tokens")
    filled = usage.select("query_id", *(F.coalesce(F.col(k), F.lit(0)).alias(k) for k in kinds)).distinct()
    return filled.withColumn("cost", F.round(F.col("total_tokens") * F.lit(TOKEN_PRICE), 9))


def windowed(events: DataFrame, minutes: int = 5, *keys: str) -> DataFrame:
    """(keys, window_start, requests, errors, tokens, error_rate, latency p50, p95, p99) per tumbling window.

    Requests are counted per different latency first, so the exact percentiles of a busy window are taken from the
    counts of its values and not from all its rows. Tokens are the ``k`` of the JSON props.
    """
    error = F.when(F.col("event_type") == "error", 1).otherwise(0)
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) if "props" in events.columns else F.lit(0).cast("long")
    exact = {f"latency_p{p}": F.percentile("value", F.lit(p / 100), F.col("n")) for p in (50, 95, 99)}
    return (
        events.groupBy(F.window(event_time(events, "ts"), f"{minutes} minutes").alias("w"), *keys, "value")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("e"), F.sum(tokens).alias("t"))
        .groupBy("w", *keys)
        .agg(F.sum("n").alias("requests"), F.sum("e").alias("errors"), F.sum("t").alias("tokens"), *(F.round(v, 6).alias(k) for k, v in exact.items()))
        .select(*keys, F.col("w.start").alias("window_start"), "requests", "errors", "tokens", F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"), *exact)
    )


def alerts(windows: DataFrame, metrics: dict[str, str], minutes: int = 5) -> DataFrame:
    """(window_start, alert, severity, metric, value, threshold) of every window of ``minutes`` above a rule of that period.

    ``metrics`` maps metrics of the rules to columns of ``windows``; a null value raises nothing.
    """
    spark = windows.sparkSession
    rules = [(a, m, t, s) for a, m, t, period, s in ALERT_RULES if period == minutes]
    known = spark.createDataFrame(rules, "alert string, rule_metric string, threshold double, severity string")
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()))
    long = windows.select("window_start", F.explode(values).alias("m")).select("window_start", "m.metric", "m.value")
    hit = (F.col("metric") == F.col("rule_metric")) & (F.col("value") > F.col("threshold"))
    return long.join(F.broadcast(known), hit).select("window_start", "alert", "severity", "metric", "value", "threshold")


def floods(events: DataFrame, minutes: int = 5, slide: int = 1, least: int = 3) -> DataFrame:
    """(user_id, window_start, requests) of sliding windows in which a consumer sent at least ``least`` requests."""
    span = F.window(event_time(events, "ts"), f"{minutes} minutes", f"{slide} minutes")
    counted = events.groupBy("user_id", span.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.filter(F.col("requests") >= least).select("user_id", F.col("w.start").alias("window_start"), "requests")


def anomalies(events: DataFrame, deviations: float = 3.0) -> DataFrame:
    """(user_id, day, requests, mean, spread): days on which a consumer's count is far above its own mean."""
    daily = events.groupBy("user_id", utc_day(event_time(events, "ts")).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    own = daily.groupBy("user_id").agg(F.avg("requests").alias("mean"), F.stddev_pop("requests").alias("spread"))
    far = F.col("requests") > F.col("mean") + deviations * F.col("spread")
    return daily.join(own, "user_id").filter(far).select("user_id", "day", "requests", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


def token_budget(tokens: DataFrame, monthly: float, share: float = 0.8) -> DataFrame:
    """(month, day, tokens, spent, over): running sum of a month and whether it passes ``share`` of the budget.

    Tokens are added up per day before the window, which then holds at most 31 rows a month.
    """
    daily = tokens.groupBy(utc_day(event_time(tokens, "ts")).alias("day")).agg(F.sum("tokens").alias("tokens"))
    month = F.date_format("day", "yyyy-MM")
    running = Window.partitionBy("month").orderBy("day")
    return (
        daily.withColumn("month", month)
        .withColumn("spent", F.sum("tokens").over(running))
        .select("month", "day", "tokens", "spent", (F.col("spent") > share * monthly).alias("over"))
    )


def availability(one_per_run: DataFrame, days: int = 30) -> DataFrame:
    """(deployment, day, runs, ok_runs, availability): share of ok runs in the ``days`` days up to each day."""
    ok = F.when(status_of(F.col("status")) == "ok", 1).otherwise(0)
    daily = one_per_run.filter(F.col("ts").isNotNull()).groupBy("deployment", utc_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("r"), F.sum(ok).alias("k"))
    span = Window.partitionBy("deployment").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    summed = daily.withColumn("runs", F.sum("r").over(span)).withColumn("ok_runs", F.sum("k").over(span))
    return summed.select("deployment", "day", "runs", "ok_runs", F.round(F.col("ok_runs") / F.col("runs"), 6).alias("availability"))


def growth(one_per_run: DataFrame, ahead: int = 90) -> DataFrame:
    """(deployment, days, slope, projected): line through the runs per day, ``ahead`` days after the last."""
    daily = one_per_run.filter(F.col("ts").isNotNull()).groupBy("deployment", F.unix_date(utc_day(F.col("ts"))).alias("x")).agg(F.count(F.lit(1)).alias("y"))
    fit = daily.groupBy("deployment").agg(
        F.count(F.lit(1)).alias("days"), F.regr_slope(F.col("y").cast("double"), F.col("x").cast("double")).alias("slope"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max("x").alias("last"),
    )
    projected = F.col("my") + F.col("slope") * (F.col("last") + ahead - F.col("mx"))
    return fit.filter(F.col("days") >= 2).select("deployment", "days", F.round("slope", 4).alias("slope"), F.round(projected, 2).alias("projected"))


def cost_by_tag(one_per_run: DataFrame, usage: DataFrame) -> DataFrame:
    """(environment, region, deployment, runs, tokens, cost): tokens of traced runs by the parts of the deployment name."""
    spent = usage_cost(usage).groupBy("query_id").agg(F.max("total_tokens").alias("tokens"))
    joined = one_per_run.join(spent, "query_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    parts = F.split("deployment", "-")
    return joined.groupBy(
        F.try_element_at(parts, F.lit(1)).alias("environment"), F.try_element_at(parts, F.lit(2)).alias("region"), "deployment"
    ).agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * F.lit(TOKEN_PRICE), 9).alias("cost"))


def trailing_use(one_per_run: DataFrame, days: int = 30) -> DataFrame:
    """(deployment, day, busy_s, trailing_mean): seconds of work per day and their mean over the ``days`` days up to it."""
    good = (F.col("total_s") >= 0) & ~F.isnan("total_s") & F.col("ts").isNotNull()
    daily = one_per_run.filter(good).groupBy("deployment", utc_day(F.col("ts")).alias("day")).agg(F.sum("total_s").alias("busy"))
    span = Window.partitionBy("deployment").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.select("deployment", "day", F.round("busy", 4).alias("busy_s"), F.round(F.avg("busy").over(span), 8).alias("trailing_mean"))


def retained(one_per_run: DataFrame, ok_days: int = 30, error_days: int = 90) -> DataFrame:
    """(deployment, kept, dropped): runs inside and outside retention, counted back from the newest run.

    Failed runs are kept longer. Runs without a readable time are kept.
    """
    newest = one_per_run.agg(F.max("ts").alias("newest"))
    limit = F.when(status_of(F.col("status")) == "error", error_days).otherwise(ok_days)
    kept = F.coalesce(F.date_diff(utc_day(F.col("newest")), utc_day(F.col("ts"))) <= limit, F.lit(True))
    counted = one_per_run.crossJoin(F.broadcast(newest)).withColumn("kept", kept)
    return counted.groupBy("deployment").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def islands(df: DataFrame, key: str, time: str, gap_s: float, closed: bool = True) -> DataFrame:
    """``df`` with ``island``: rows of a key belong together while they follow each other within ``gap_s`` (below it, unless ``closed``).

    Rows are compared within an hour of their key; the last time of the hour before, and the number of islands
    up to it, are carried over by windows over hours, so no task holds more than one hour of a key and no island ends with one.
    Rows without a time must be left out.
    """
    columns = df.columns
    hours = df.withColumn("_at", F.unix_micros(time)).withColumn("_hour", F.floor(F.col("_at") / F.lit(3_600_000_000)))
    by_hour = Window.partitionBy("_key").orderBy("_of")
    within = Window.partitionBy(key, "_hour").orderBy("_at")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hour") == F.col("_of"))

    def of_hours(rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy(F.col(key).alias("_key"), F.col("_hour").alias("_of")).agg(value.alias("_value"))

    last = of_hours(hours, F.max("_at")).select("_key", "_of", F.lag("_value").over(by_hour).alias("_before"))
    gap = F.col("_at") - F.coalesce(F.lag("_at").over(within), F.col("_before"))
    together = gap <= gap_s * 1_000_000 if closed else gap < gap_s * 1_000_000
    marked = hours.join(last, same).withColumn("_new", F.when(together, 0).otherwise(1)).drop("_key", "_of", "_before")
    upto = of_hours(marked, F.sum("_new")).select("_key", "_of", (F.sum("_value").over(by_hour) - F.col("_value")).alias("_upto"))
    numbered = marked.withColumn("island", F.sum("_new").over(within)).join(upto, same)
    return numbered.select(*columns, (F.col("island") + F.col("_upto")).alias("island"))


def escalations(one_per_run: DataFrame, quiet_minutes: int = 15, least: int = 3) -> DataFrame:
    """(deployment, started, ended, failures, severity): runs of failures with gaps of at most ``quiet_minutes``.

    Gaps and islands over the failures of a deployment; an island of ``least`` failures is P1, else P2.
    """
    failed = one_per_run.filter((status_of(F.col("status")) == "error") & F.col("ts").isNotNull()).select("deployment", "ts")
    grouped = islands(failed, "deployment", "ts", quiet_minutes * 60).groupBy("deployment", "island")
    found = grouped.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("failures"))
    return found.select("deployment", "started", "ended", "failures", F.when(F.col("failures") >= least, "P1").otherwise("P2").alias("severity"))


def scale_outs(events: DataFrame, above: int, cooldown_s: int = 300) -> DataFrame:
    """(event_type, minute, requests): minutes above the limit at which a target is scaled out, with a cooldown between.

    Requests are counted per minute first. Busy minutes with gaps below the cooldown form an island, at the start of
    which no cooldown can still run; the cooldown walks over one island at a time, also across midnight.
    """
    minute = F.date_trunc("minute", event_time(events, "ts")).alias("minute")
    minutes = events.groupBy("event_type", minute).agg(F.count(F.lit(1)).alias("requests")).filter((F.col("requests") > above) & F.col("minute").isNotNull())

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("minute", ignore_index=True)
        keep, last = [], None
        for i, at in enumerate(pdf.minute):
            if last is None or (at - last).total_seconds() >= cooldown_s:
                keep.append(i)
                last = at
        return pdf.iloc[keep][["event_type", "minute", "requests"]]

    busy = islands(minutes, "event_type", "minute", cooldown_s, closed=False)
    return busy.groupBy("event_type", "island").applyInPandas(walk, "event_type string, minute timestamp, requests long")


def change_failure_rate(one_per_run: DataFrame, hours: int = 24, tolerated: float = 0.05) -> DataFrame:
    """(deployment, changes, failed, rate): changes of a deployment, and those followed by too many failed runs.

    A change is the first day of runs after a day without any, so the first day too; it failed if more than
    ``tolerated`` of the runs in the ``hours`` hours from its first run did.
    """
    timed = one_per_run.filter(F.col("ts").isNotNull()).withColumn("bad", F.when(status_of(F.col("status")) == "error", 1).otherwise(0))
    daily = timed.groupBy("deployment", utc_day(F.col("ts")).alias("day")).agg(F.min("ts").alias("began"))
    before = F.lag("day").over(Window.partitionBy("deployment").orderBy("day"))
    changes = daily.withColumn("gap", F.date_diff("day", before)).filter(F.col("gap").isNull() | (F.col("gap") > 1)).select(F.col("deployment").alias("of"), "began")
    after = F.unix_micros("ts") - F.unix_micros("began")
    followed = changes.join(timed, F.col("of").eqNullSafe(F.col("deployment")) & (after >= 0) & (after < hours * 3_600_000_000))
    rated = followed.groupBy("of", "began").agg(F.avg("bad").alias("share"))
    done = rated.groupBy(F.col("of").alias("deployment")).agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("share") > tolerated).alias("failed"))
    return done.withColumn("rate", F.round(F.col("failed") / F.col("changes"), 6))


def quota_minutes(events: DataFrame) -> DataFrame:
    """(event_type, minute, requests, tokens): requests and tokens per minute; tokens are the ``k`` of the JSON props."""
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return events.groupBy("event_type", F.date_trunc("minute", event_time(events, "ts")).alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")
    )
