import numpy as np

from taskframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def brute(rows, queries, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if i in queries:
            near = {(float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in fine if j != i and len(w) == len(v)}
            out[i] = sorted(near)[:k]
    return out


def f32(v):
    return [None if x is None else float(np.float32(x)) for x in v]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    vectors = [f32(centres[i % 20] + rng.normal(size=16) * 0.4) for i in range(3000)]
    vectors += [vectors[5]] * 400  # one very common vector
    rows = [(i, v) for i, v in enumerate(vectors)] + [(9000, None), (9100, [0.0] * 16), (9200, f32([float("nan")] * 16)), (9300, [None] + [1.0] * 15), (None, [1.0] * 16), (9400, f32([float("inf")] * 16)), (9500, []), (100, vectors[100])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    index = neighbours.build_index(df, 11, shard=500)
    asked = df.filter("vec_id % 100 = 0 OR vec_id = 5")
    got = {}
    for r in sorted(neighbours.nearest(index, asked, 10).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id, r.rank))
    want = brute(rows, {i for i, _ in rows if i is not None and (i % 100 == 0 or i == 5)}, 10)
    assert set(got) == set(want) and index.count() >= 6
    assert all([x[2] for x in g] == list(range(1, 11)) for g in got.values())
    truth = dict(rows)
    for q, g in got.items():
        for score, j, _ in g:
            assert abs(score - np.sqrt(((np.array(truth[j]) - np.array(truth[q])) ** 2).sum())) < 1e-12
    hits = [len({j for _, j, _ in got[q]} & {j for _, j in want[q]}) / 10 for q in want]
    assert np.mean(hits) > 0.97
    assert [(s, j) for s, j, _ in got[5]] == want[5]  # ties of the common vector go to the smallest ids


def test_fewer_rows_than_results_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [3.0, 1.0]), (100, [1.0, 1.0, 1.0]), (200, [2.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = neighbours.nearest(neighbours.build_index(df, 11), df.filter("vec_id % 100 = 0"), 10).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(0, 1, 1), (0, 2, 2), (100, 1, 200), (200, 1, 100)}
    assert neighbours.nearest(neighbours.build_index(df.limit(0), 11), df.limit(0), 10).count() == 0


def test_recall_on_test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    v, ids = np.array([x for _, x in rows], float), np.array([i for i, _ in rows])
    asked = df.filter("vec_id % 20 = 0")
    got = {}
    for r in neighbours.nearest(neighbours.build_index(df, 11, shard=1000), asked, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q, found in got.items():
        d = ((v - v[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits.append(len(found & set(ids[np.argsort(d)[:10]])) / 10)
    assert len(hits) == 100 and np.mean(hits) > 0.95


def test_recall_at_default_parameters(spark):
    rng = np.random.default_rng(4)
    vectors = np.concatenate([rng.normal(size=(5000, 24)), rng.normal(size=(30, 24))[rng.integers(0, 30, 4000)] * 2 + rng.normal(size=(4000, 24)) * 0.3]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1, "x", 2) for i, v in enumerate(vectors)], SCHEMA)
    index = neighbours.build_index(df, 11)
    got = {}
    for r in neighbours.nearest(index, df.filter("vec_id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert index.count() == 3 and sorted(r.shard for r in index.select("shard").collect()) == [0, 1, 2]
    hits = []
    for q, found in got.items():
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(found & set(np.argsort(d)[:10].tolist())) / 10)
    print("recall", np.mean(hits))
    assert len(hits) == 180 and np.mean(hits) > 0.98
