import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import percentiles as P


def test_against_numpy_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", float(rng.choice([1, 2, 2, 3, rng.random() * 50]))) for _ in range(6000)]
    rows += [(rng.choice("abc"), rng.random()) for _ in range(500)] + [("one", 7.0), (None, 1.0), (None, 3.0), ("nan", float("nan")), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("row_id", F.lit("clash"))
    got = {(r.g, r.pct): (r.n, r.percentile) for r in P.percentiles(P.sorted_values(df, ["g"], "v"), ["g"], "v", (0, 25, 50, 95, 100)).collect() if r.g}
    groups = {}
    for g, v in rows:
        if g and v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert {g for g, _ in got} == set(groups)
    for (g, p), (n, value) in got.items():
        assert n == len(groups[g]) and abs(value - np.percentile(groups[g], p)) < 1e-9


def test_empty_and_least(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert P.percentiles(P.sorted_values(df, ["g"], "v"), ["g"], "v").count() == 0
    df = spark.createDataFrame([("a", 1.0)] * 19 + [("b", 2.0)] * 20, "g string, v double")
    assert {r.g for r in P.percentiles(P.sorted_values(df, ["g"], "v"), ["g"], "v", (50,), 20).collect()} == {"b"}


def test_runs_count_once_and_odd_rows_do_not(spark):
    at = dt.datetime(2026, 5, 4, 12)
    line = lambda run, status, ts, gen, total: (run, "d", ts, status, gen, total, at)
    rows = [
        line(1, " OK ", "2026-05-04T23:30:00-02:00", 1.0, 2.0),
        line(1, " OK ", "2026-05-04T23:30:00-02:00", 1.0, 2.0),
        line(2, "error", "2026-05-04T01:00:00Z", 9.0, 9.0),
        line(3, None, "2026-05-04T01:00:00Z", 9.0, 9.0),
        line(4, "ok", "no time", 9.0, 9.0),
        line(5, "ok", "2026-05-05T01:00:00+00:00", -1.0, float("nan")),
        line(6, "ok", None, None, None),
        line(None, "ok", "2026-05-05T01:00:00Z", 3.0, 3.0),
    ]
    df = spark.createDataFrame(rows, "run_id long, deployment string, log_ts string, status string, llm_generate_s double, total_s double, received_at timestamp")
    got = sorted((str(r.day), r.measure, r.value) for r in P.ok_values(df).collect())
    assert got == [("2026-05-05", "llm_generate_s", 1.0), ("2026-05-05", "total_s", 2.0)]
    weeks = P.period_percentiles(df, (50,), 1).filter("period = 'week'").collect()
    assert {r.start_day for r in weeks} == {"2026-05-04"}
