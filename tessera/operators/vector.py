"""Exact vector search: three metrics over an Arrow kernel, namespaces, batch search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1.1920929e-7
METRICS = {"cosine": "cosine", "cos": "cosine", "euclidean": "euclidean", "l2": "euclidean", "dot": "dot", "dotproduct": "dot", "ip": "dot"}


def parse_metric(name: str) -> str:
    key = name.lower().replace("_", "").replace("-", "")
    if key not in METRICS:
        raise ValueError(f"unknown metric: {name!r}")
    return METRICS[key]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.where(n <= EPS, x, x / np.where(n <= EPS, 1, n))


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """In double precision; a vector of no length stays as it is, at cosine distance 1."""
    if metric == "euclidean":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    if metric == "dot":
        return -(x @ q)
    return 1 - _unit(x) @ _unit(q)


def distance(vector: Column, query, metric: str = "cosine") -> Column:
    q, metric = np.asarray(query, float), parse_metric(metric)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(distances(np.stack(s.to_list()).astype(float), q, metric) + 0.0 if len(s) else [], dtype=float)

    return F.pandas_udf(run, "double")(vector)


def native_distance(vector: Column, query, metric: str = "cosine") -> Column:
    """The same without Python, from higher-order functions."""
    metric = parse_metric(metric)
    q = np.asarray(query, float)
    q = _unit(q) if metric == "cosine" else q
    lit = F.array(*(F.lit(float(x)) for x in q))
    total = lambda col: F.aggregate(col, F.lit(0.0), lambda a, b: a + b)
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = total(F.zip_with(v, lit, lambda a, b: a * b))
    if metric == "euclidean":
        return F.sqrt(total(F.zip_with(v, lit, lambda a, b: (a - b) * (a - b))))
    norm = F.sqrt(total(F.transform(v, lambda a: a * a)))
    return -dot if metric == "dot" else 1 - F.when(norm <= EPS, dot).otherwise(dot / norm)


def similarity(d: Column, metric: str = "cosine") -> Column:
    m = parse_metric(metric)
    return F.least(F.greatest(1 - d, F.lit(-1.0)), F.lit(1.0)) if m == "cosine" else -d if m == "dot" else 1 / (1 + F.greatest(d, F.lit(0.0)))


def namespaces(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("namespace").agg(F.max(F.size("vector")).alias("dim"), F.count(F.lit(1)).alias("count"))


def resolve_namespace(vectors: DataFrame, model: str | None) -> tuple[str, int]:
    """An exact name, else the only namespace of that model; without one, the only namespace.

    A name ends in its dimension, so an exact one needs no look at the table, and others only at its names: one row a namespace.
    """
    def dim(name: str) -> int:
        size = name.rpartition(":")[2]
        return int(size) if size.isdigit() else vectors.filter(F.col("namespace") == name).select(F.size("vector").alias("d")).first().d

    if model and model.rpartition(":")[2].isdigit() and vectors.filter(F.col("namespace") == model).select("namespace").take(1):
        return model, dim(model)
    known = [r.namespace for r in vectors.select("namespace").distinct().collect()]
    if model in known:
        return model, dim(model)
    fit = [n for n in known if model is None or n.rpartition(":")[0] == model]
    if len(fit) == 1:
        return fit[0], dim(fit[0])
    if model is None and not known:
        raise LookupError("there are no embeddings yet")
    raise LookupError(f"specify one of the embedding models {sorted(fit)}" if fit else f"unknown embedding model: {model!r}")


def search(vectors: DataFrame, query, k: int = 10, model: str | None = None, metric: str = "cosine", scope: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """(node_id, distance, score) of the k nearest in one namespace, ties by insertion. ``scope`` (id) and ``hidden`` (node_id)
    apply before the ranking, so k results are found if there are as many."""
    ns, dim = resolve_namespace(vectors, model)
    if len(query) != dim:
        raise ValueError(f"dimension mismatch: {ns} holds {dim}, the query has {len(query)}")
    v = vectors.filter(F.col("namespace") == ns)
    if scope is not None:
        v = v.join(scope.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    if hidden is not None:
        v = v.join(hidden.select("node_id"), "node_id", "left_anti")
    v = v.select("node_id", "seq", distance(F.col("vector"), query, metric).alias("distance"))
    return v.orderBy("distance", "seq").limit(k).select("node_id", "distance", similarity(F.col("distance"), metric).alias("score"))


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, node_id, distance, rank): the k nearest by squared Euclidean distance for (query_id, vector).

    Queries go in blocks to every partition of the vectors; each returns its k best, of which the best k stay.
    """
    spark = queries.sparkSession
    parts = max(1, -(-queries.count() // block))
    out = None
    for p in range(parts):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toPandas()
        q, ids = np.stack(some.vector.to_list()).astype(float) if len(some) else np.zeros((0, 1)), some.query_id.tolist()

        def run(batches, q=q, ids=ids):
            for b in batches:
                if not len(b) or not len(q):
                    continue
                x = np.stack(b.vector.to_list()).astype(float)
                for i, row in zip(ids, q, strict=True):
                    d = ((x - row) ** 2).sum(axis=1)
                    best = np.lexsort((b.node_id.to_numpy(str), d))[: k + 1]
                    yield pd.DataFrame({"query_id": i, "node_id": b.node_id.to_numpy()[best], "distance": d[best]})

        near = vectors.select("node_id", "vector").mapInPandas(run, "query_id string, node_id string, distance double")
        out = near if out is None else out.unionByName(near)
    w = Window.partitionBy("query_id").orderBy("distance", "node_id")
    return out.filter("query_id <> node_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pca_2d(points: DataFrame) -> DataFrame:
    """(id, x, y) for (id, vector): first two principal components by power iteration on a distributed Gram matrix, scaled into -1..1."""
    stat = points.mapInPandas(_moments, "n long, mean array<double>, gram array<double>").toPandas()
    if not len(stat) or stat.n.sum() < 3:
        rows = [(r.id, float(i), 0.0) for i, r in enumerate(points.select("id").orderBy("id").collect())]
        return points.sparkSession.createDataFrame(rows, "id string, x double, y double")
    n = stat.n.sum()
    mean = np.sum(stat["mean"].to_list(), axis=0) / n
    d = len(mean)
    cov = np.sum(stat["gram"].to_list(), axis=0).reshape(d, d) / n - np.outer(mean, mean)
    axes = []
    for _ in range(2):
        v = np.array([(i + 1) * 0.618034 % 1 for i in range(d)])
        v /= np.linalg.norm(v)
        for _ in range(64):
            w = cov @ v
            if (size := np.linalg.norm(w)) < 1e-12:
                break
            v = w / size
        axes.append(v)
        cov = cov - np.outer(v, v) * (v @ cov @ v)
    basis = np.stack(axes, axis=1)

    def project(batches):
        for b in batches:
            xy = (np.stack(b.vector.to_list()).astype(float) - mean) @ basis
            yield pd.DataFrame({"id": b.id, "x": xy[:, 0], "y": xy[:, 1]})

    flat = points.select("id", "vector").mapInPandas(project, "id string, x double, y double")
    box = flat.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    half = max(box[1] - box[0], box[3] - box[2]) / 2 or 1.0
    return flat.select("id", ((F.col("x") - (box[0] + box[1]) / 2) / half).alias("x"), ((F.col("y") - (box[2] + box[3]) / 2) / half).alias("y"))


def _moments(batches):
    for b in batches:
        if len(b):
            x = np.stack(b.vector.to_list()).astype(float)
            yield pd.DataFrame({"n": [len(x)], "mean": [x.sum(axis=0).tolist()], "gram": [(x.T @ x).ravel().tolist()]})
