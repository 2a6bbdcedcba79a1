import os
import random

import pytest
import tiktoken

from quillspark.llm import encode
from quillspark.llm.queries import vocabulary

PATH = vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

TEXTS = ["", " ", "a", "hello world", "  two  spaces \n\n x", "it's they've I'M", "naïve Überraschung 字符串 🧩🧩", "don't stop​", "x" * 5000, "0123456789 " * 50, "\ud800 lone", "\n" * 40 + "end"]


@pytest.fixture(scope="module")
def own():
    return encode.encoder(PATH)


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})


def test_same_ids_as_the_public_library(own, reference):
    rng = random.Random(4)
    alphabets = ["abcdefghinrst  -=e'", "абвгд ё", "日本語の文字列", "\t\n 0159.,;", "🧩🙂é€"]
    texts = TEXTS[:-2] + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    for text in texts:
        assert list(own.encode(text)) == reference.encode_ordinary(text), text


def test_a_small_vocabulary_that_needs_lookahead():
    ranks = {bytes([b]): b for b in range(256)}
    for i, piece in enumerate((b"ab", b"bc", b"abc", b"cd", b"abcd")):
        ranks[piece] = 256 + i
    t = encode.Transducer(ranks)
    for text in (b"abcd", b"bcd", b"abcabcd", b"xbcd", b"ab", b"abc", b"cdcd", b"a"):
        assert t.encode(text) == t.merge(text), text


def test_memo_bounds_do_not_change_ids(own, reference, monkeypatch):
    monkeypatch.setattr(encode, "MEMO_WORDS", 3)
    monkeypatch.setattr(encode, "MEMO_STATES", 5)
    fresh = encode.Encoder(PATH)
    text = "the quick brown fox jumps over the lazy dog, twice over"
    assert list(fresh.encode(text)) == reference.encode_ordinary(text)
    assert len(fresh.memo) <= 3 and len(fresh.transducer.moves) <= 5


def test_round_trip_and_odd_rows(spark, own):
    rows = [(i, t) for i, t in enumerate(TEXTS) if "\ud800" not in t] + [(100, None), (0, ""), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS id")
    ids = encode.encode(df, PATH)
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = ids.collect()
    assert len(got) == len(rows)
    assert [r.ids for r in got if r.doc_id == 100] == [[]]
    back = {r.doc_id: r.text for r in encode.decode(ids, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert encode.encode(df.limit(0), PATH).count() == 0


def test_utf8_stream_splits_and_repairs():
    for raw in ("é字🧩".encode(), b"\xff\xe5\xad", b"\xe5a", b"\xed\xa0\x80", b"\xf0\x9f\xa7"):
        stream = encode.Utf8Stream()
        out = "".join(stream.feed(raw[i : i + 1]) for i in range(len(raw))) + stream.end()
        if raw == "é字🧩".encode():
            assert out == "é字🧩"
        else:
            assert "�" in out
    assert encode.decode_ids([999999], {}) == "�"


def test_vocabulary_without_all_bytes_is_refused(tmp_path):
    bad = tmp_path / "v"
    bad.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        encode.Encoder(str(bad))
