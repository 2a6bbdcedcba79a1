import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import lines as L

SCHEMA = "source string, page_number int, blocks array<string>"


def make(seed=1):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        for p in range(14):
            body = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(9)) for _ in range(3)]
            blocks = [f"ACME Report No. {p}\n" + "\n".join(body), None, f"page-{p} of the Report\n\n12 34"]
            if p % 2:
                blocks.append(f"Printed by Person{'abcdefghijklmn'[p]} on 2024-01-{p + 1:02d}")
            if p < 5:
                blocks.append("stands on five pages only\nStands, on five pages only!")
            rows.append((s, p, blocks))
    rows += [("a", 0, rows[0][2]), ("a", 99, None), ("a", 98, []), ("c", 0, ["", "Übung macht den Meister"]), ("c", 1, ["ÜBUNG  macht den meister?"])]
    return rows


def brute(rows):
    pages, places = defaultdict(set), defaultdict(set)
    for s, p, blocks in rows:
        for i, b in enumerate(blocks or []):
            for j, line in enumerate(b.split("\n") if b is not None else []):
                key = "".join(c for c in line if c.isalpha()).lower()
                if len(key) >= 4:
                    pages[s, key].add(p)
                    places[s, key].add((s, p, i, j))
    return set().union(*(places[k] for k in places if len(pages[k]) >= 6))


def test_against_brute_force(spark, monkeypatch):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit("x")).withColumn("k1", F.lit(1))
    want = brute(rows)
    got = L.repeated_places(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(L, "SMALL_ROWS", 0)
    assert {tuple(r) for r in L.repeated_places(df).collect()} == want


def test_near_duplicates_join_the_cluster(spark):
    rows = make()
    near = L.repeated_near(spark.createDataFrame(rows, SCHEMA)).collect()
    printed = {(r.source, r.page_number) for r in near if r.line_pages < 6}
    assert {("a", p) for p in range(1, 14, 2)} <= printed


def test_clean_blocks(spark):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    clean = {(r.source, r.page_number, r.block_no): r for r in L.clean_blocks(df, L.repeated_places(df)).collect()}
    gone = brute(rows)
    for s, p, blocks in rows:
        for i, b in enumerate(blocks or []):
            if b is None:
                assert (s, p, i) not in clean
            else:
                kept = [x for j, x in enumerate(b.split("\n")) if (s, p, i, j) not in gone]
                assert clean[s, p, i].block == "\n".join(kept)


def test_masking_and_signatures():
    assert L.masked("Exported on 2026-05-15 at 14:02") == L.masked("Exported on 2025-01-02 at 09:59")
    assert L.masked("not approved by Alice") == L.masked("not approved by Bob")
    a, b, c = L.signatures(["abc", "the same line of text here", "quite another thing altogether"])
    assert (a != b).any() and (b == c).mean() < 0.3
    assert L.similarity("abcd", "abcd") == 1.0 and L.similarity("", "") == 1.0
    assert L.signatures([]).shape == (0, L.BANDS * L.ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.repeated_places(df).count() == 0 and L.repeated_near(df).count() == 0


def test_variants_on_one_page_each_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    pages = [[] for _ in range(6)]
    for _ in range(60):
        base = [word() for _ in range(14)]
        for p in range(6):  # every variant differs from the base in one letter of one word
            own = list(base)
            own[2 * p] = own[2 * p][:3] + "é" + own[2 * p][4:]
            pages[p].append(" ".join(own))
    families = [{pages[p][f] for p in range(6)} for f in range(60)]
    assert all(L.similarity(L.masked(a), L.masked(b)) >= L.SIMILAR for x in families for a in x for b in x)
    df = spark.createDataFrame([("a", p, ["\n".join(x)]) for p, x in enumerate(pages)], SCHEMA)
    near = L.repeated_near(df).collect()
    assert len(near) == 360 and {r.cluster_pages for r in near} == {6}


def test_lines_that_fail_their_head_get_another():
    link = L._link(L.SIMILAR)
    text = ["the reader stores the full report", "many short notes drop the old index after every single night her", "many short notes drop the old index after every single night his"]
    batch = pa.table({"band": [1, 1, 1], "part": [0, 0, 0], "k1": [1, 2, 3], "line": text}).to_batches()
    assert [tuple(r.values()) for b in link(iter(batch)) for r in b.to_pylist()] == [(1, 1, None), (1, 2, None), (1, 3, 2)]


def test_buckets_across_batches(monkeypatch):
    monkeypatch.setattr(L, "PART", 3)
    rng = random.Random(2)
    for _ in range(50):
        rows = sorted((rng.randint(0, 9), rng.randint(0, 12)) for _ in range(60))
        cut = sorted(rng.sample(range(61), 3))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, 60])]
        batches = [pa.record_batch({"band": [r[0] for r in p], "k1": [r[1] for r in p]}, schema=pa.schema([("band", pa.int64()), ("k1", pa.int64())])) for p in parts]
        got = [tuple(r.values()) for b in L._meet(iter(batches)) for r in b.to_pylist()]
        buckets = defaultdict(list)
        for band, k in sorted(set(rows)):
            buckets[band].append(k)
        assert got == [(band, i // 3, k) for band in sorted(buckets) for i, k in enumerate(buckets[band]) if len(buckets[band]) > 1]


def test_connected_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = [tuple(r) for r in L.connected(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: top(x) for x in list(parent)}
    assert L.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parts_of_a_bucket_meet_again(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 2)
    rows = make()
    near = L.repeated_near(spark.createDataFrame(rows, SCHEMA)).collect()
    monkeypatch.setattr(L, "PART", 2000)
    whole = L.repeated_near(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, near)) == sorted(map(str, whole))


def test_pairs_at_the_limit_meet_in_a_band():
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 1500:
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)]
        b = list(a)
        for at in rng.sample(range(80), 2):
            b[at] = "é"
        a, b = "".join(a), "".join(b)
        if 0.8 <= L.similarity(a, b) < 0.84:
            pairs.append((a, b))
    x, y = (L.signatures([p[i] for p in pairs]).reshape(len(pairs), L.BANDS, L.ROWS) for i in (0, 1))
    assert (x == y).all(2).any(1).mean() >= 0.95


def test_clean_through_near_clusters(spark):
    df = spark.createDataFrame(make(), SCHEMA)
    left = [r.block for r in L.clean_blocks(df, L.repeated_near(df)).collect()]
    assert not any("Printed by" in b for b in left) and any("stands on five pages" in b for b in left)


def test_heads_are_followed_to_their_own_head(spark):
    # a (3 pages) is near b (5), b is near c (7), and c is near d (8), but not a near c or b near d
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
    chain = [list(base)]
    for i in range(3):
        chain.append([w[:3] + "é" + w[4:] if n in (3 * i, 3 * i + 1) else w for n, w in enumerate(chain[-1])])
    text = [" ".join(x) for x in chain]
    alike = {(i, j) for i in range(4) for j in range(i) if L.similarity(L.masked(text[i]), L.masked(text[j])) >= L.SIMILAR}
    assert alike == {(1, 0), (2, 1), (3, 2)}
    rows, page = [], 0
    for line, pages in zip(text, (3, 5, 7, 8)):
        rows += [("a", page + p, [line]) for p in range(pages)]
        page += pages
    near = L.repeated_near(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(near) == 23 and {r.cluster_pages for r in near} == {23}


def linked(rows, similar, size=7):
    """Groups of keys that the links of one bucket connect."""
    group = {k: {k} for k, _ in rows}
    table = pa.table({"band": [1] * len(rows), "part": [i // 2 for i in range(len(rows))], "k1": [k for k, _ in rows], "line": [t for _, t in rows]})
    for batch in L._link(similar)(iter(table.to_batches(size))):
        for r in batch.to_pylist():
            if r["b"] is not None:
                joined = group[r["a"]] | group[r["b"]]
                for k in joined:
                    group[k] = joined
    return {frozenset(g) for g in group.values()}


def test_members_of_different_heads_are_linked():
    # a - c - d - b is a chain; a and b come first and are heads, c is near a only and d near b only
    rng = random.Random(9)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]]
    for i in range(3):
        words.append([w[:3] + "é" + w[4:] if n in (3 * i, 3 * i + 1) else w for n, w in enumerate(words[-1])])
    a, c, d, b = (" ".join(w) for w in words)
    near = lambda x, y: L.similarity(L.masked(x), L.masked(y)) >= L.SIMILAR
    assert near(a, c) and near(c, d) and near(d, b) and not (near(a, b) or near(a, d) or near(c, b))
    assert linked([(1, a), (2, b), (3, c), (4, d)], L.SIMILAR) == {frozenset({1, 2, 3, 4})}


def test_links_of_a_bucket_against_all_pairs():
    rng = random.Random(10)
    for n in range(60):
        letters, similar = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([4, 26])], rng.choice([0.4, 0.6, 0.8])
        texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(3)]
        while len(texts) < 60:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(len(t))] = rng.choice(letters)
            texts.append("".join(t)[rng.randint(0, 1) :])
        rng.shuffle(texts)
        rows = list(enumerate(texts))
        want = {k: {k} for k, _ in rows}
        for i, x in rows:
            for j, y in rows[:i]:
                if L.similarity(x, y) >= similar:
                    joined = want[i] | want[j]
                    for k in joined:
                        want[k] = joined
        assert linked(rows, similar) == {frozenset(g) for g in want.values()}


def test_every_form_of_a_line_is_signed():
    forms = ["approved by alice", "approved by Alice", "approved by alice"]
    batch = pa.record_batch({"k1": [7] * 3, "s": [1] * 3, "line": forms})
    bands = [r["band"] for b in L._sign(iter([batch, batch])) for r in b.to_pylist()]
    alone = [{r["band"] for b in L._sign(iter([pa.record_batch({"k1": [7], "s": [1], "line": [f]})])) for r in b.to_pylist()} for f in forms[:2]]
    assert alone[0] != alone[1] and set(bands) == alone[0] | alone[1] and len(bands) == 2 * L.BANDS
