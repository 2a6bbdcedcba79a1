import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import subset as S

CHUNKS = "query_id string, chunk_id string, faiss_score double, rrf_score double, embedding array<float>"


def data(spark, queries=6, seed=1):
    rng = np.random.default_rng(seed)
    rows, requests, want = [], [], set()
    for q in range(queries):
        groups = int(rng.integers(2, 6))
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0][:groups]
        best = {}
        for n in range(groups + int(rng.integers(5, 40))):
            g = n if n < groups else int(rng.integers(0, groups) ** 2 // groups)
            v = axes[g] * rng.uniform(0.5, 4) + 0.02 * rng.normal(size=64)
            score = round(float(rng.choice([0.1, 0.5, 0.5, 0.9])), 3)
            rows.append((f"q{q}", f"c{n:03d}", score, 0.1, [float(x) for x in v]))
            best[g] = min(best.get(g, (9, "")), (-score, f"c{n:03d}"))
        want |= {(f"q{q}", b[1]) for b in best.values()}
        requests.append((f"q{q}", groups))
        rows.append(rows[-1][:3] + (0.9, rows[-1][4]))
        rows += [(f"q{q}", "bad1", float("nan"), 0.1, [1.0] * 64), (f"q{q}", "bad2", 2.0, 0.1, None), (f"q{q}", "bad3", None, 0.1, [1.0] * 64), (f"q{q}", None, 3.0, 0.1, [1.0] * 64)]
    rows.append(("unasked", "c1", 0.5, 0.5, [1.0] * 64))
    requests += [("none", 3), (None, 2), ("q0", None), ("q1", 0)]
    df = spark.createDataFrame(rows, CHUNKS).withColumn("block", F.lit("x")).withColumn("score", F.lit("y"))
    return df, spark.createDataFrame(requests, "query_id string, subset_size int"), want


def chosen(df):
    rows = df.select("query_id", "chunk_id").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_best_of_every_group(spark):
    df, requests, want = data(spark)
    assert chosen(S.select_varied(df, requests)) == want


def test_blocks_give_the_same(spark, monkeypatch):
    df, requests, want = data(spark, seed=2)
    assert chosen(S.select_varied(df, requests, block=6)) == want
    monkeypatch.setattr(S, "CORE", 1)
    assert chosen(S.select_varied(df, requests, block=3)) == want


def test_chains_are_linked_across_blocks(spark):
    angles = np.deg2rad(np.arange(0, 151, 50))
    rows = [("q", f"c{i}", float(i), 0.0, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, CHUNKS)
    requests = spark.createDataFrame([("q", 1)], "query_id string, subset_size int")
    assert chosen(S.select_varied(df, requests, block=1)) == {("q", "c3")}


def test_local_search_is_a_local_optimum_and_beats_the_start():
    rng = np.random.default_rng(0)
    x = S.unit(rng.normal(size=(30, 8)))
    d = 1 - x @ x.T
    rows = S.search_cosines(x, 6)
    total = lambda r: d[np.ix_(r, r)].sum() / 2
    assert len(rows) == 6 and total(rows) >= total(np.arange(6))
    assert abs(total(rows) - S.total_distance(x[rows], None)) < 1e-9
    for out in rows:
        for into in set(range(30)) - set(rows.tolist()):
            assert total(np.array([*(r for r in rows if r != out), into])) <= total(rows) + 1e-9


def test_local_search_over_groups_is_a_local_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        group = rng.integers(0, rng.integers(1, 7), rng.integers(1, 25))
        size = int(rng.integers(0, len(group) + 2))
        rows = S.search_groups(group, size)
        total = lambda r: (group[r][:, None] != group[r][None, :]).sum() / 2
        assert len(rows) == len(set(rows.tolist())) == min(size, len(group)) and total(rows) == S.total_distance(None or np.zeros((len(rows), 1)), group[rows])
        for out in rows:
            for into in set(range(len(group))) - set(rows.tolist()):
                swapped = np.array([*(r for r in rows if r != out), into])
                assert total(swapped) < total(rows) or (total(swapped) == total(rows) and into > out)


def test_components_with_labels_against_a_matrix():
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = S.unit(rng.normal(size=(40, 3)))
        label = np.array([None if rng.random() < 0.7 else int(rng.integers(0, 5)) for _ in range(40)], dtype=object)
        links = (x @ x.T >= 0.9) | np.array([[a is not None and a == b for b in label] for a in label])
        reach = np.eye(40, dtype=bool) | links
        for _ in range(6):
            reach = reach @ reach
        assert (S.components(x, 0.9, label) == reach.argmax(1)).all()


def test_look_alikes_above_the_block_fill_the_request(spark):
    rng = np.random.default_rng(7)
    x = np.ones((5000, 64)) + 0.1 * rng.normal(size=(5000, 64))
    df = spark.createDataFrame([("q", f"c{i:05d}", i / 5000, 0.0, [float(v) for v in x[i]]) for i in range(5000)], CHUNKS)
    requests = spark.createDataFrame([("q", 100)], "query_id string, subset_size int")
    got = S.select_varied(df, requests).collect()
    assert {r.chunk_id for r in got} == {f"c{i:05d}" for i in range(4900, 5000)} and {r.groups for r in got} == {1}


def test_unlike_candidates_above_the_block(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    rows = [("q", f"c{i:05d}", i / 6000, 0.0, [float(v) for v in x[i]]) for i in range(6000)]
    df, requests = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("q", 300)], "query_id string, subset_size int")
    group = S.components(S.unit(x.astype(np.float32).astype(float))[::-1], 0.5)[::-1]
    got = S.select_varied(df, requests).collect()
    assert len(got) == 300 and len({group[int(r.chunk_id[1:])] for r in got}) == 300


def test_large_requests_are_shared_out(spark, monkeypatch):
    df, requests, _ = data(spark, 3)
    monkeypatch.setattr(S, "LARGE", 4)
    many = requests.filter("query_id LIKE 'q_'").withColumn("subset_size", F.lit(9))
    for alike in (None, 0.5):
        got = S.select_varied(df, many, alike=alike, block=5)
        assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {9} and {r.subset_size for r in got.collect()} == {9}
        assert len(chosen(got)) == 27


def test_sizes_and_empty(spark):
    df, requests, _ = data(spark, 2)
    many = requests.filter("query_id = 'q1'").withColumn("subset_size", F.lit(999))
    got = S.select_varied(df, many, alike=None)
    assert got.count() == df.filter("query_id = 'q1' AND embedding IS NOT NULL AND faiss_score < 2 AND chunk_id IS NOT NULL").select("chunk_id").distinct().count()
    assert S.select_varied(df.limit(0), requests).count() == 0 and S.select_varied(df, requests.limit(0)).count() == 0


def test_copies_fill_a_request_above_the_block(spark):
    rows = [("q", f"c{i:03d}", i / 100, 0.0, [float(i % 4 == k) for k in range(64)]) for i in range(60)]
    df = spark.createDataFrame(rows, CHUNKS)
    requests = spark.createDataFrame([("q", 20)], "query_id string, subset_size int")
    whole, blocks = (S.select_varied(df, requests, alike=None, block=b).collect() for b in (60, 25))
    assert len(whole) == len(blocks) == 20
    assert abs(whole[0].dispersion - blocks[0].dispersion) < 1e-6


def test_the_size_of_a_block_does_not_change_the_choice(spark):
    rng = np.random.default_rng(11)
    x = np.pad(rng.normal(size=(700, 4)), ((0, 0), (0, 60))).astype(np.float32)
    df = spark.createDataFrame([("q", f"c{i:03d}", i / 700, 0.0, [float(v) for v in x[i]]) for i in range(700)], CHUNKS)
    requests = spark.createDataFrame([("q", 40)], "query_id string, subset_size int")
    u = S.unit(x.astype(float))[::-1]  # in order of preference
    reach = (u @ u.T >= 0.97).astype(np.float32)
    for _ in range(10):
        reach = (reach @ reach > 0).astype(np.float32)
    group = reach.argmax(1)
    for block in (50, 5000):
        got = S.select_varied(df, requests, alike=0.97, block=block).collect()
        assert {r.groups for r in got} == {len(set(group))}
        assert {r.chunk_id for r in got} == {f"c{699 - i:03d}" for i in S.search_groups(group, 40)}
    far, near = (S.select_varied(df, requests, alike=None, block=b).collect() for b in (50, 5000))
    assert len(far) == 40 and sorted(map(tuple, far)) == sorted(map(tuple, near))


def test_components_over_cells_against_a_matrix():
    rng = np.random.default_rng(12)
    crowds = np.linalg.qr(rng.normal(size=(16, 16)))[0][rng.integers(0, 9, 1500)] + 0.05 * rng.normal(size=(1500, 16))
    for x in (S.unit(crowds), S.unit(np.concatenate([crowds[:700], rng.normal(size=(700, 16))])), S.unit(rng.normal(size=(1200, 5)))):
        for alike in (0.5, 0.8, 0.95):
            reach = (x @ x.T >= alike).astype(np.float32)
            for _ in range(11):
                reach = (reach @ reach > 0).astype(np.float32)
            assert (S.components(x, alike, block=100) == reach.argmax(1)).all()
