import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import times
from quillspark.operators import platform as P
from quillspark.operators import telemetry as M
from quillspark.sources import artefacts, logs
from quillspark.streaming import telemetry as stream


def line(run, ts="2026-05-04T10:00:00Z", status="ok", message=None, **times):
    base = {s: None for s in M.STAGES} | times
    return (run, f"q{run}", "rag-east-01", ts, "question " * 20, *(base[s] for s in M.STAGES), status, "E" if message else None, message, dt.datetime(2026, 5, 4, 10, 5))


def timings(spark, *rows):
    return spark.createDataFrame(list(rows), logs.TIMING_SCHEMA)


def test_slowest_stages_golden(spark):
    every = {s: 1.0 for s in M.STAGES} | {"total_s": 9.0, "index_load_s": None}
    got = M.slowest_stages(M.runs(timings(spark, line(1, **every), line(1, **every), line(2)))).orderBy("rank").collect()
    assert [(r.run_id, r.stage) for r in got] == [(1, "bge_model_load_s"), (1, "query_embed_s")]


def test_cost_golden(spark):
    usage = spark.createDataFrame([("q", 900, 100, 1000), ("q", 900, 100, 1000), ("n", None, None, None)], "query_id string, prompt_tokens int, completion_tokens int, total_tokens int")
    assert {r.query_id: r.cost for r in M.usage_cost(usage).collect()} == {"q": 0.00022, "n": 0.0}


def test_log_round_trip_and_truncation(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_timings(timings(spark, line(1, total_s=1.23456), line(2, total_s=float("nan"))), path)
    logs.append_timings(timings(spark, line(3)), path)
    back = {r.run_id: r for r in logs.read_timings(spark, path).collect()}
    assert set(back) == {1, 2, 3} and back[1].total_s == 1.2346 and back[2].total_s is None and len(back[1].question) == 80
    assert [r.run_id for r in logs.from_lines(spark.createDataFrame([("no json",)], "value string")).collect()] == [None]


def test_spans_and_scores(spark, tmp_path):
    spans = logs.spans_of(M.runs(timings(spark, line(1, total_s=2.0, status="error", message="x"))))
    assert [(r.name, r.level) for r in spans.collect()] == [("total", "ERROR")]
    assert not logs.append_spans(spans, None) and logs.append_spans(spans, str(tmp_path / "s"))
    good = spark.createDataFrame([("t", "helpful", 1, None)], logs.SCORE_SCHEMA)
    assert logs.append_scores(good, str(tmp_path / "f"))
    with pytest.raises(ValueError):
        logs.append_scores(good.withColumn("value", F.lit(2)), str(tmp_path / "f"))


def test_escalations(spark):
    rows = [line(i, f"2026-05-04T10:{m:02d}:00Z", "error", "x") for i, m in enumerate((0, 10, 20, 50))] + [line(9, "2026-05-04T10:05:00Z")]
    got = sorted((r.failures, r.severity) for r in M.escalations(M.runs(timings(spark, *rows))).collect())
    assert got == [(1, "P2"), (3, "P1")]


def test_escalations_over_midnight_and_hours(spark):
    at = lambda m: (dt.datetime(2026, 5, 4, 23, 50) + dt.timedelta(minutes=m)).isoformat() + "Z"
    rows = [line(i, at(m), "error", "x") for i, m in enumerate((0, 5, 11, 15, 70, 86, 101))]
    got = sorted((r.started.isoformat()[11:16], r.failures, r.severity) for r in M.escalations(M.runs(timings(spark, *rows), "deployment", "log_ts", "status")).collect())
    assert got == [("01:00", 1, "P2"), ("01:16", 2, "P2"), ("23:50", 4, "P1")]


def test_islands_against_a_walk(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, dt.datetime(2026, 1, 1, 22) + dt.timedelta(seconds=rng.randint(0, 40_000))) for _ in range(400)] * 2
    df = spark.createDataFrame(rows, "k string, ts timestamp").withColumn("_keep", F.lit(1))
    for closed in (True, False):
        got = sorted((r.k or "", r.ts, r.island) for r in M.islands(df, "k", "ts", 120, closed).collect())
        last, number = {}, {}
        for k, ts, island in got:
            gap = (ts - last[k]).total_seconds() if k in last else 1e9
            number[k] = number.get(k, 0) + (gap > 120 or (gap == 120 and not closed))
            last[k] = ts
            assert island == number[k]


def test_alert_rules_of_every_period(spark):
    at = dt.datetime(2026, 1, 1)
    windows = spark.createDataFrame([(at, 0.1, 0.0, 90.0, 95.0, 0.9, None)], "window_start timestamp, e double, u double, c double, m double, b double, n double")
    names = lambda minutes, **m: sorted(r.alert for r in M.alerts(windows, m, minutes).collect())
    assert names(5, error_rate="e", latency_p95="n") == ["error_rate_high", "invocation_error_rate_high"]
    assert names(2, unhealthy="u") == [] and names(10, cpu="c", memory="m") == ["cpu_high", "memory_high"] and names(1440, budget_share="b") == ["token_budget_high"]


def test_times_do_not_depend_on_the_session(spark):
    rows = [("2026-05-04T23:30:00-02:00",), ("2026-05-04T10:00:00Z",), ("2026-05-04T10:00:00",), ("no time",), (None,)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ts = times.log_time(F.col("t"))
        got = spark.createDataFrame(rows, "t string").select(F.unix_seconds(ts).alias("s"), times.utc_day(ts).cast("string").alias("d"), times.utc_text(ts).alias("x")).collect()
        event = spark.sql("SELECT timestamp_ntz'2026-05-04 10:00:00' AS ts")
        assert event.select(F.unix_seconds(times.event_time(event, "ts")).alias("s")).first().s == got[1].s
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.d for r in got] == ["2026-05-05", "2026-05-04", "2026-05-04", None, None] and got[1].s == got[2].s
    assert [r.x for r in got][:2] == ["2026-05-05T01:30:00.000000+00:00", "2026-05-04T10:00:00.000000+00:00"]


def test_change_failure_rate(spark):
    rows = [line(1, "2026-05-04T10:00:00Z"), line(2, "2026-05-05T10:00:00Z", "error", "x"), line(3, "2026-05-08T10:00:00Z", "error", "x"), line(4, "2026-05-08T11:00:00Z")]
    assert [tuple(r) for r in M.change_failure_rate(M.runs(timings(spark, *rows))).collect()] == [("rag-east-01", 2, 1, 0.5)]


def test_scale_out_cooldown(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(minutes=m, seconds=s), "view") for m in (0, 1, 4, 5, 6) for s in range(3)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string")
    assert sorted(r.minute.minute for r in M.scale_outs(events, above=2).collect()) == [0, 5]


def test_scale_out_cooldown_goes_on_after_midnight(spark):
    start = dt.datetime(2026, 1, 1, 23, 58)
    rows = [(start + dt.timedelta(minutes=m, seconds=s), "view") for m in (0, 3, 5) for s in range(3)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string")
    assert sorted(r.minute.minute for r in M.scale_outs(events, above=2).collect()) == [3, 58]


def test_platform_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " ", "b"), (3, "a", "b")], "id int, team string, project string")
    assert {r.id: r.missing for r in P.missing_tags(df, "id", ("team", "project")).collect()} == {1: ["project"], 2: ["team"]}
    names = spark.createDataFrame([("rag-east-07",), ("rag-prod-api-blue-2",), ("Bad name",), (None,)], "n string").select(P.name_parts(F.col("n")).alias("p"))
    assert [r.p.qualifier if r.p else None for r in names.collect()] == [None, "blue-2", None, None]
    at = dt.datetime(2026, 1, 1)
    inc = spark.createDataFrame([(1, "P1", at, at + dt.timedelta(minutes=16), None), (2, "P1", at, at + dt.timedelta(minutes=15), at), (3, "P2", at, None, None)], "incident_id int, severity string, opened timestamp, acknowledged timestamp, resolved timestamp")
    assert [(r.incident_id, r.minutes) for r in P.sla_breaches(inc).collect()] == [(1, 16.0)]


def pages_file(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text)


def test_ingest_twice_adds_once_and_bad_files_are_rows(spark, tmp_path):
    folder, out = tmp_path / "docs", str(tmp_path / "index")
    pages_file(folder, "a.txt", ("Intro\n\n" + "word " * 300 + "\fsecond page").encode())
    pages_file(folder, "b.txt", b"\xff\xfe broken")
    read = artefacts.read_pages(spark, str(folder))
    rows = read.collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.error is None for r in rows) == 2
    parents = artefacts.parent_table(read.filter("error IS NULL").drop("error"))
    with pytest.raises(artefacts.IndexMissing):
        artefacts.load_index(spark, out)
    first = artefacts.add_to_index(parents, out)
    assert first == 3 and artefacts.add_to_index(parents, out) == 0
    tables = artefacts.load_index(spark, out)
    assert tables["parents"].count() == 3 < tables["chunks"].count() == tables["doc_stats"].count() == tables["embeddings"].count()


def test_a_broken_ingest_is_not_seen_and_can_be_done_again(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "index")
    schema = "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double"
    page = lambda n: artefacts.parent_table(spark.createDataFrame([("d", n, [f"Head {n}\ntext of page {n}"], [0], 10.0)], schema))
    assert artefacts.add_to_index(page(0), out) == 1
    with monkeypatch.context() as m:
        m.setattr(artefacts, "COMMITS", "commits\0")
        m.setattr(artefacts, "load_index", lambda spark, folder: {"parents": spark.read.parquet(f"{folder}/parents")})
        with pytest.raises(Exception):
            artefacts.add_to_index(page(1), out)
    assert artefacts.load_index(spark, out)["postings"].select("chunk_id").distinct().count() == 1
    assert artefacts.add_to_index(page(1), out) == 1 and artefacts.add_to_index(page(1), out) == 0
    tables = artefacts.load_index(spark, out)
    assert {t: tables[t].count() for t in ("parents", "chunks", "doc_stats", "embeddings")} == dict.fromkeys(("parents", "chunks", "doc_stats", "embeddings"), 2)
    assert tables["term_counts"].filter("term = 'Head'").agg(F.sum("df")).first()[0] == 2


def test_ids_stay_when_a_section_is_put_before(spark):
    schema = "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double"
    pages = lambda *rows: spark.createDataFrame([("d", n, [t], [0], 10.0) for n, t in rows], schema)
    ids = lambda df: {r.parent_id for r in artefacts.parent_table(df).collect()}
    assert ids(pages((3, "Third\ntext"))) < ids(pages((1, "First\ntext"), (3, "Third\ntext")))


def test_stream_equals_batch_for_closed_windows(spark, data, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{data}/events.parquet").repartition(1).write.parquet(source)
    stream.write_table(stream.windowed(stream.event_stream(spark, source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.window_start: (r.requests, r.errors, r.error_rate) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.window_start: (r.requests, r.errors, r.error_rate) for r in M.windowed(spark.read.parquet(source)).collect()}
    assert len(got) > 0.9 * len(batch) - 5 and all(batch[k] == v for k, v in got.items())


def test_scale_out_state_goes_on_between_batches(spark, tmp_path):
    source, start = str(tmp_path / "events"), dt.datetime(2026, 1, 1)
    make = lambda minutes: spark.createDataFrame([(start + dt.timedelta(minutes=m, seconds=s), "view") for m in minutes for s in range(3)], "ts timestamp, event_type string")
    for minutes in ((0, 1), (4, 5, 6)):
        make(minutes).coalesce(1).write.mode("append").parquet(source)
        stream.write_table(stream.scale_outs(stream.event_stream(spark, source), above=2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r.minute.minute for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0, 5] == sorted(r.minute.minute for r in M.scale_outs(make((0, 1, 4, 5, 6)), above=2).collect())


def test_log_stream_counts_each_run_once(spark, tmp_path):
    path = str(tmp_path / "log")
    logs.append_timings(timings(spark, line(1), line(1), line(2)), path)
    runs = stream.first_lines(stream.timing_stream(spark, path))
    stream.write_table(runs.select("run_id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_ingest_stream(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "index")
    schema = "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double"
    spark.createDataFrame([("d", 0, ["Head\ntext"], [0], 10.0)], schema).write.parquet(source)
    pages = spark.readStream.schema(schema).parquet(source)
    for n in range(2):
        stream.ingest_stream(pages, out, str(tmp_path / f"cp{n}")).awaitTermination()
    assert artefacts.load_index(spark, out)["chunks"].count() == 1
