import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import neighbours as N

SCHEMA = "query_id string, chunk_id string, faiss_score double, embedding array<float>"


def chunks(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, 64))
    x = centres[rng.integers(0, 25, n)] + 0.6 * rng.normal(size=(n, 64))
    rows = [("q", f"c{i:05d}", 0.5, [float(v) for v in x[i]]) for i in range(n)]
    rows += [("r", f"c{i:05d}", 0.4, [float(v) for v in x[i]]) for i in range(0, n, 7)]
    for j in range(30):  # equal and scaled vectors under other ids
        rows.append(("q", f"t{j:05d}", 0.1, [float(v) for v in x[5]]))
    bad = [None, [0.0] * 64, [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [("q", f"bad{i}", 0.5, v) for i, v in enumerate(bad)] + [("q", None, 0.1, [1.0] * 64)]
    proper = {r[1]: np.array(r[3], np.float32).astype(float) for r in rows if r[1] and r[3] and not r[1].startswith("bad")}
    return spark.createDataFrame(rows, SCHEMA).withColumn("vid", F.lit(1)).withColumn("v", F.lit("x")), proper


def exact(proper):
    ids = np.array(sorted(proper))
    x = np.array([proper[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return ids, s


def test_recall_with_small_leaves_and_blocks(spark, monkeypatch):
    df, proper = chunks(spark)
    ids, s = exact(proper)
    monkeypatch.setattr(N, "BLOCK", 60)
    got = {}
    for r in N.similar_chunks(df, region=150, leaf=40, visits=4, sample=400).collect():
        got.setdefault(r.chunk_id, {})[r.rank] = (r.other_id, r.cosine)
    assert set(got) == set(ids) and all(len(v) == 10 and sorted(v) == list(range(1, 11)) for v in got.values())
    hits = 0
    for i, c in enumerate(ids):
        worst = np.sort(s[i])[-10]
        for other, cosine in got[c].values():
            j = int(np.searchsorted(ids, other))
            assert other != c and abs(s[i, j] - cosine) < 2e-3
            hits += s[i, j] >= worst - 1e-3
    assert hits / (10 * len(ids)) >= 0.9


def test_close_pairs_against_brute_force(spark):
    df, proper = chunks(spark)
    ids, s = exact(proper)
    found = {(r.chunk_a, r.chunk_b) for r in N.close_pairs(df, least=0.8).collect()}
    want = set()
    for i in range(len(ids)):
        if ids[i].startswith("t") or ids[i] == "c00005":
            continue  # many equal neighbours: any ten of them will do
        for j in np.argsort(-s[i])[:10]:
            if s[i, j] >= 0.8:
                want.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    assert want <= found
    assert all(a < b and s[np.searchsorted(ids, a), np.searchsorted(ids, b)] >= 0.8 - 1e-6 for a, b in found)


def test_empty_and_single(spark):
    df, _ = chunks(spark, 20)
    assert N.similar_chunks(df.limit(0)).count() == 0 and N.close_pairs(df.filter("chunk_id LIKE 'bad%'")).count() == 0
    assert N.similar_chunks(df.filter("chunk_id = 'c00001'")).count() == 0
    assert N.similar_chunks(df.filter("chunk_id IN ('c00001', 'c00002')")).count() == 2
