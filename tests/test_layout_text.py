from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import layout as L


def pages(spark, texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "source string, page_number int, text string")


def test_repeated_edge_lines_golden(spark):
    three = pages(spark, ["ACME\nalpha\nPage 1", "ACME\nbeta\nPage 2", "ACME\ngamma\nPage 3"])
    assert [tuple(r) for r in L.header_footer_lines(three).collect()] == [("d", "ACME")]
    assert L.header_footer_lines(three.limit(2)).count() == 0
    gone = spark.createDataFrame([("d", "ACME")], "source string, line string")
    assert L.strip_lines(pages(spark, ["x\n  ACME \ny ACME"]), gone).first().text == "x\ny ACME"
    assert L.header_footer_lines(three.filter("false")).count() == 0


def test_markdown_table_golden(spark):
    df = spark.createDataFrame([(1, [["A", None], ["x\ny", " z "]]), (2, []), (3, None), (4, [["h"]])], "n int, g array<array<string>>")
    got = {r.n: r.m for r in df.select("n", T.markdown_table(F.col("g")).alias("m")).collect()}
    assert got == {1: "| A |  |\n| --- | --- |\n| x y | z |", 2: "", 3: "", 4: "| h |\n| --- |"}


def test_sizes_and_headings_golden(spark):
    schema = "n int, g array<struct<text:string,size:double>>"
    rows = [
        (1, [("a", 10.0), ("b", 10.0), ("c", 10.0), ("d", 14.0)]), (2, [("a", 10.0), ("b", 12.0)]), (3, []), (4, None),
        (5, [("cab ride\n", 10.0), ("c", 14.0), (" ", None), ("at", 14.0), ("x", 10.0), ("y", 10.0)]), (6, [("a", 0.0), (None, 3.0), (" ", 9.0)]),
    ]
    made = spark.createDataFrame(rows, schema).withColumn("body", L.body_size(F.col("g"))).withColumn("s", L.section_starts(F.col("g"), F.col("body")))
    got = {r.n: (r.body, r.s) for r in made.collect()}
    assert got[1] == (10.0, [3]) and got[2] == (11.0, []) and got[3] == (0.0, []) and got[5] == (10.0, [9]) and got[6] == (0.0, [])


def test_regions(spark):
    df = spark.createDataFrame([(1, "a\n| x |\n | y |\nb\nc"), (2, "| only |"), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.region_no, r.kind, r.top, r.lines, r.body) for r in L.regions(df).collect())
    assert got == [(1, 0, "text", 0, 1, "a"), (1, 1, "table", 1, 2, "| x |\n | y |"), (1, 2, "text", 3, 2, "b\nc"), (2, 0, "table", 0, 1, "| only |")]


def test_small_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(T.score_color(F.lit(x).cast("double"))) for x in (0.80, 0.799, 0.50, 0.49, None, float("nan"))] == ["green", "orange", "orange", "red", "red", "red"]
    assert value(T.preview(F.lit("x" * 280))) == "x" * 280 and value(T.preview(F.lit("x" * 281))) == "x" * 280 + "…"
    assert all(value(T.is_blank(F.lit(x).cast("string"))) for x in ("", "  ", "  ", None)) and not value(T.is_blank(F.lit(" a ")))
    assert value(T.stage_label(F.lit("bm25_score_s"))) == "Bm25 Score"
    assert value(T.tokens(F.lit(" A b\n a "))) == ["A", "b", "a"] and value(T.tokens(F.lit(None).cast("string"))) == []
    assert value(T.unreachable(F.lit("HTTP 403"), 3)) and not value(T.unreachable(F.lit("HTTP 403"), 2)) and not value(T.unreachable(F.lit(None).cast("string")))
    assert value(T.redact(F.lit("mail a.b@c.org now"))) == "mail [email] now"
    assert value(T.prompt(F.lit("C"), F.lit("Q"))).endswith("Context:\nC\n\nQuestion:\nQ\n\nAnswer:")
