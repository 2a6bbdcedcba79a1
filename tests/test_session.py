import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspark import session
from quillspark.functions import text as T
from quillspark.sources import tables


def test_a_cluster_without_a_shared_folder_raises():
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, other: other))
    with pytest.raises(ValueError):
        session.shared_folder(cluster)


def test_written_tables_come_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    assert sorted(map(str, session.written(df).collect())) == sorted(map(str, df.collect()))
    assert session.written(df.limit(0)).count() == 0


def test_each_key_once(spark, monkeypatch):
    rows = [("a", 1, "x"), ("a", 1, "x"), (None, 1, "y"), (None, 1, "y"), (None, None, "z"), ("b", 2, "w")]
    df = spark.createDataFrame(rows, "k string, n int, t string").withColumn("_n", F.lit(5))
    want = sorted(map(str, df.distinct().collect()))
    assert sorted(map(str, tables.once(df, ["k", "n"]).collect())) == want
    monkeypatch.setattr(tables, "REPEATED_SENT", 0)
    assert sorted(map(str, tables.once(df, ["k", "n"]).collect())) == want
    assert tables.once(df.limit(0), ["k", "n"]).count() == 0


def test_windows_of_a_very_long_text(spark):
    long = "ab 字\n" * 1_000_000
    began = time.time()
    got = spark.createDataFrame([(long,)], "t string").select(F.explode(T.windows(F.col("t"), 400, 80)).alias("w")).select("w.*").orderBy("start").collect()
    assert [r.start for r in got] == list(range(0, len(long) - 80, 320)) and all(r.text == long[r.start : r.start + 400] for r in got[::997])
    assert time.time() - began < 60
