"""The approximate index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector as V
from tessera.operators.ann import Index, IndexConfig


def table(spark, x, first=0):
    rows = [(f"n{first + i:05d}", first + i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "node_id string, seq long, vector array<float>")


def exact(x, q, k, metric):
    return np.lexsort((np.arange(len(x)), V.distances(x.astype(np.float32).astype(float), q, metric)))[:k]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_recall_at_10(spark, tmp_path, metric):
    r = np.random.default_rng(2)
    x, queries = r.uniform(-1, 1, (1000, 48)), r.uniform(-1, 1, (8, 48))
    index = Index.build(table(spark, x), str(tmp_path / "i"), metric)
    assert len(index.centres) == 1000 // 64
    hit = 0
    for q in queries:
        got = [int(t.node_id[1:]) for t in index.search(q.tolist(), 10, ef=128).collect()]
        hit += len(set(got) & set(exact(x, q, 10, metric).tolist()))
    assert hit / 80 > 0.95


def test_insert_scope_hidden_reopen_and_rebuild(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.uniform(-1, 1, (400, 16))
    index = Index.build(table(spark, x), str(tmp_path / "i"), "cosine", IndexConfig(per_cell=20))
    index.insert(table(spark, x[:3] * 2 + 0.01, 400))
    again = Index.open(spark, str(tmp_path / "i"))
    assert np.allclose(again.centres, index.centres) and again.rows().count() == 403
    top = [t.node_id for t in again.search(x[1].tolist(), 2).collect()]
    assert top[0] == "n00001" and top[1] == "n00401"
    hidden = spark.createDataFrame([("n00001",)], "node_id string")
    assert again.search(x[1].tolist(), 1, hidden=hidden).first().node_id == "n00401"
    scope = again.rows().filter(F.pmod("seq", F.lit(40)) == 7).select(F.col("node_id").alias("id"))
    assert again.search(x[1].tolist(), 10, ef=32, scope=scope).count() == 10  # on to all cells where few rows pass
    smaller = again.rebuild(str(tmp_path / "j"), hidden)
    assert smaller.rows().count() == 402
    with pytest.raises(ValueError):
        again.search([0.0] * 3)


def test_cells_are_pruned_at_the_scan(spark, tmp_path):
    x = np.random.default_rng(4).uniform(-1, 1, (300, 8))
    index = Index.build(table(spark, x), str(tmp_path / "i"), "euclidean", IndexConfig(per_cell=10))
    plan = index.rows().filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:60]


def test_empty_and_equal_vectors(spark, tmp_path):
    none = table(spark, np.ones((1, 4))).limit(0)
    assert Index.build(none, str(tmp_path / "e")).search([1.0, 0, 0, 0]).count() == 0
    same = Index.build(table(spark, np.ones((200, 4))), str(tmp_path / "s"))
    assert [t.node_id for t in same.search([1.0] * 4, 3).collect()] == ["n00000", "n00001", "n00002"]
