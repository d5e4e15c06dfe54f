import numpy as np

from tessera.llm import neighbours as N


def brute(rows, k, every=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted(((-float((ok[i] * ok[q]).sum()), i) for i in ok if i != q))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def test_recall_and_exact_scores(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(t.vec_id, t.embedding, strict=True)]
    want = brute(rows, 20)
    got = {}
    for r in N.nearest(spark.createDataFrame(t)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    vec = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        assert all(abs(s - (vec[q] * vec[i]).sum()) < 1e-12 for i, s in found.values())
        order = [(-s, i) for _, (i, s) in sorted(found.items())]
        assert order == sorted(order)


def test_odd_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.5]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in N.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute(rows, 20)
    assert N.nearest(df.limit(0)).count() == 0
    assert N.nearest(df.filter("vec_id = 3")).count() == 0


def test_blocks_of_a_hot_leaf_give_the_same(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).round(1).tolist()) for i in range(300)] + [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (N.nearest(df, N.TreeConfig(k=5, leaf=50, recall=1.0, block=n, queries=m)).collect() for n, m in ((16, 2), (4096, 16_384)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_repeated_ids_and_odd_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [9.0, 9.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (4, [0.2, 0.1])]
    got = {r.vec_id: r.score for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 0.5, 4: 0.2}


def test_small_leaves_still_give_all_ranks(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(0, 1, 8)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in N.nearest(df, N.TreeConfig(leaf=2, recall=0.0)).collect():
        got.setdefault(x.query_id, []).append(x.rank)
    assert sorted(got) == list(range(0, 300, 20)) and all(sorted(v) == list(range(1, 21)) for v in got.values())
