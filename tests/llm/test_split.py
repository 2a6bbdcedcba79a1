import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import split

SCHEMA = "source string, page_number int, blocks array<string>, section_boundaries array<int>, body_font_size double"


def words(n, seed=1):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) + len(out) < n:
        out.append("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", "", ".", ",", "\n"]))
    return " ".join(out)[:n]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n字é", min_size=0, max_size=6000))
def test_pieces_cover_the_text_within_limits(text):
    parts = split.spans(text, 1500, 500, 80)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert c == b - 80 and d > b
    assert all(b - a <= 1500 for a, b in parts)


def test_one_piece_exactly_at_the_limit():
    assert len(split.spans("x" * 1500, 1500, 500, 80)) == 1
    assert len(split.spans("x" * 1501, 1500, 500, 80)) == 2


def test_cuts_fall_on_natural_places():
    text = words(20000)
    cuts = split.cut_points(text, 1500, 500, 80)
    assert cuts and all(text[c - 1] in " \n" or (text[c - 1] in ".,;:" and text[c] == " ") for c in cuts)


def test_an_edit_changes_only_near_pieces():
    text = words(60000, 3)
    edited = text[:3000] + " inserted words here " + text[3000:]
    a = set(split.cut_points(text, 1500, 500, 80))
    b = {c - 21 for c in split.cut_points(edited, 1500, 500, 80) if c > 3000}
    late = {c for c in a if c > 12000}
    assert len(late & b) > 0.9 * len(late)


def test_rolling_hash_is_the_same_in_slices():
    import numpy as np

    codes = np.arange(split._SPAN * 2 + 77, dtype=np.uint32) % 251
    whole = split.rolling_hash(codes)
    at = split._SPAN + 500
    assert whole[at] == split.rolling_hash(codes[at - split.WINDOW + 1 : at + 1])[-1]


def brute(rows):
    found = set()
    for source, page, blocks, bounds, _ in rows:
        text = "\n".join(b for b in blocks or [] if b is not None)
        marks = sorted({0, *(b for b in bounds or [] if b is not None and 0 < b < len(text))}) if text else []
        for a, b in zip(marks, [*marks[1:], len(text)]):
            if len(text[a:b].strip(" \t\r\n")) > 1500:
                found.add((source, page, a))
    return found


def test_oversized_against_brute_force_with_odd_rows(spark):
    long = words(4000, 7)
    rows = [
        ("a", 0, [long, None, "", "tail"], [100, 3000, 100, -5, 99999], 10.0),
        ("a", 0, [long, None, "", "tail"], [100, 3000, 100, -5, 99999], 10.0),
        ("a", 1, None, [5], None),
        ("a", 2, [], None, 0.0),
        ("b", 0, [" \t\n" + "x" * 1500 + "\n  "], None, 10.0),
        ("b", 1, ["x" * 1501], [], 10.0),
        ("b", 2, [None, None], [0], 10.0),
        ("b", 3, ["字" * 5000], [1600, 3100], 10.0),
        (None, 4, ["y " * 2000], None, 10.0),
    ]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("piece_no", F.lit("clash")).withColumn("body", F.lit(1))
    assert {tuple(r) for r in split.oversized(pages).collect()} == brute(rows)
    made = split.pieces(pages).collect()
    for r in made:
        assert len(r.piece_text) <= 1500
    text = "\n".join(b for b in rows[0][2] if b is not None)
    for r in made:
        if (r.source, r.page_number) == ("a", 0):
            assert text[r.piece_start : r.piece_start + len(r.piece_text)] == r.piece_text


def test_empty_table_and_wrong_sizes(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert split.oversized(pages).count() == 0 and split.pieces(pages).count() == 0
    with pytest.raises(ValueError):
        split.split_sections(pages, max_chars=100, min_chars=90, overlap=80)
