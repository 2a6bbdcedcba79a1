import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.config import Settings, SplitterSettings
from quillspark.functions import text as T
from quillspark.operators import chunking as C


def test_child_windows_golden(spark):
    want = {0: [], 4: [(0, 4)], 400: [(0, 400)], 401: [(0, 400), (320, 81)], 720: [(0, 400), (320, 400)], 721: [(0, 400), (320, 400), (640, 81)],
            1500: [(0, 400), (320, 400), (640, 400), (960, 400), (1280, 220)]}
    df = spark.createDataFrame([(n, "字" * n) for n in want] + [(-1, None)], "n int, text string").withColumn("child", F.lit(1)).withColumn("start", F.lit(2))
    got = {}
    for r in C.child_windows(df, ["n"]).collect():
        got.setdefault(r.n, []).append((r.start, len(r.child)))
    assert {n: sorted(got.get(n, [])) for n in want} == want and -1 not in got


@pytest.mark.parametrize(("text", "want"), [("a\n\n\nb", [3, 4]), ("ab\n\n", []), ("", []), (None, []), ("\n\n\nx", [2, 3]), ("a\n\nb\n\nc", [3, 6])])
def test_paragraph_starts(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.paragraph_starts(F.col("t")).alias("s")).first().s == want


def test_fold_golden():
    sizes = lambda rows: [len(t) for _, _, t, _ in C.fold_parents(rows, 1500)]
    assert sizes([("a" * 700, False), ("b" * 900, False), ("c" * 3200, False)]) == [700, 900, 1500, 1500, 200]
    made = C.fold_parents([("Intro\n" + "x" * 1994, True)], 1500)
    assert [(h, len(t)) for _, h, t, _ in made] == [("Intro", 1500), (None, 500)]
    made = C.fold_parents([("one ", False), ("Head\nbody", True), ("Next", True)], 1500)
    assert [(i, h, t, b) for i, h, t, b in made] == [(0, None, "one", []), (1, "Head", "Head\nbody", [0]), (2, "Next", "Next", [0])]


SCHEMA = "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double"


def test_segments_and_parents_with_odd_rows(spark):
    rows = [
        ("d", 0, ["Head\ntext one", None, "more\n\nparts"], [0, 14, 14, 999, -1], 10.0),
        ("d", 0, ["Head\ntext one", None, "more\n\nparts"], [0, 14, 14, 999, -1], 10.0),
        ("d", 1, ["goes on"], None, None),
        ("d", 2, None, [1], None),
        ("d", 3, [], None, None),
        ("e", 0, ["  ", "x"], None, None),
    ]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("clash"))
    got = sorted(tuple(r) for r in C.segments(pages).collect())
    assert got == [
        ("d", 0, 0, 0, 0, True, "Head\ntext one"), ("d", 0, 1, 0, 0, True, "more\n\n"), ("d", 0, 1, 1, 6, False, "parts"),
        ("d", 1, 0, 0, 0, False, "goes on"), ("e", 0, 1, 0, 0, False, "x"),
    ]
    parents = sorted((r.source, r.section_no, r.heading, r.text) for r in C.parents(pages).collect())
    assert parents == [("d", 1, "Head", "Head\ntext one"), ("d", 2, "more", "more\n\npartsgoes on"), ("e", 0, None, "x")]
    assert C.parents(pages.limit(0)).count() == 0


def test_running_total_of_a_hot_key(spark):
    rows = [("hot", i, 1) for i in range(3000)] + [(None, i, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, v long")
    for r in C.running_total(df, ["k"], ["i"], "v", "total").collect():
        assert r.total == (r.i + 1) * (1 if r.k else 2)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=1500))
def test_recursive_pieces(text):
    parts = C.split_recursively(text, 100, 20)
    assert all(0 < len(p) <= 100 and p == p.strip() for p in parts)
    assert set("".join(parts).split()) <= set(text.split()) or any(len(w) > 100 for w in text.split())
    assert sum(map(len, parts)) >= len("".join(text.split())) * 0.99


def test_recursive_chunks_rows(spark):
    df = spark.createDataFrame([(1, "word " * 900), (2, None), (3, " "), (4, "x" * 2500)], "doc_id long, text string").withColumn("chunk", F.lit(0))
    got = {}
    for r in C.recursive_chunks(df, "doc_id").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert set(got) == {1, 4} and all(len(c) <= 1000 for v in got.values() for c in v)


def test_windows_snap_to_boundaries_in_the_overlap(spark):
    def plain(n, bounds):
        starts = [0]
        while starts[-1] + 400 < n:
            end = starts[-1] + 400
            starts.append(min([b for b in bounds if max(end - 80, starts[-1] + 1) <= b < end], default=end - 80))
        return starts

    rows = [(i, "x" * n, b) for i, (n, b) in enumerate([(0, []), (400, [350]), (1500, []), (1500, None), (1500, [100, 350, 390, 700, 1040]), (1500, [399, 799, 1199]), (721, [320]), (5000, list(range(0, 5000, 37)))])]
    df = spark.createDataFrame(rows, "n int, text string, b array<int>")
    got = {}
    for r in C.child_windows(df, ["n"], boundaries="b").collect():
        got.setdefault(r.n, []).append(r.start)
    assert {i: sorted(got.get(i, [])) for i, t, b in rows} == {i: plain(len(t), b or []) if t else [] for i, t, b in rows}


def test_settings_are_checked():
    for bad in ({"child_size": 10}, {"child_overlap": 300}, {"parent_size": 100}, {"top_k": 20}, {"min_score": 2.0}, {"candidate_k": 3}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(ValueError):
        SplitterSettings(chunk_size=50)
