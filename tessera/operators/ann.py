"""Approximate search: an inverted file over k-means cells, kept as Parquet partitions that a query prunes to a few.

Centroids are fitted on a bounded sample and stay; new vectors go to the cells they are nearest to, so inserting appends.
Deleted nodes are hidden at read, and ``rebuild`` fits anew.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector as V

SCHEMA = "node_id string, seq long, vector array<float>, cell int"


@dataclass(frozen=True)
class IndexConfig:
    """``sample`` bounds the vectors that centroids are fitted on (least hashes of the id first); ``per_cell`` of them make a cell."""

    sample: int = 50_000
    per_cell: int = 64
    rounds: int = 10
    seed: int = 1


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    return V._unit(x) if metric == "cosine" else x


def fit(vectors: DataFrame, metric: str, cfg: IndexConfig) -> np.ndarray:
    """Centroids by Lloyd's rounds over the sample."""
    some = vectors.select("node_id", "vector").orderBy(F.xxhash64("node_id"), "node_id").limit(cfg.sample).toPandas()
    if not len(some):
        return np.zeros((0, 0))
    x = _prepared(np.stack(some.vector.to_list()).astype(float), metric)
    rng = np.random.default_rng(cfg.seed)
    centres = x[rng.choice(len(x), max(1, len(x) // cfg.per_cell), replace=False)]
    for _ in range(cfg.rounds):
        at = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


@dataclass(frozen=True)
class Index:
    """One namespace's index at ``root``: ``meta.json`` rows and the folder ``cells``, partitioned by cell."""

    spark: SparkSession
    root: str
    metric: str
    centres: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, root: str, metric: str = "cosine", cfg: IndexConfig = IndexConfig()) -> Index:
        """Over (node_id, seq, vector) of one namespace; replaces what ``root`` holds."""
        metric = V.parse_metric(metric)
        out = cls(vectors.sparkSession, root.rstrip("/"), metric, fit(vectors, metric, cfg))
        out._assigned(vectors).write.mode("overwrite").partitionBy("cell").parquet(f"{out.root}/cells")
        out.spark.createDataFrame([(json.dumps({"metric": metric, "centres": out.centres.tolist()}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{out.root}/meta")
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        root = root.rstrip("/")
        meta = json.loads(spark.read.text(f"{root}/meta").first()[0])
        return cls(spark, root, meta["metric"], np.array(meta["centres"], float))

    def _assigned(self, vectors: DataFrame) -> DataFrame:
        centres, metric = self.centres, self.metric

        def cell(s: pd.Series) -> pd.Series:
            return pd.Series(_nearest(_prepared(np.stack(s.to_list()).astype(float), metric), centres) if len(s) else [], dtype="int32")

        rows = vectors.select("node_id", "seq", F.col("vector").cast("array<float>").alias("vector")).filter("vector is not null")
        # as many tasks as there are cells would write small files; a hash of the cell keeps each cell's rows together
        return rows.withColumn("cell", F.pandas_udf(cell, "int")("vector")).repartition("cell")

    def insert(self, vectors: DataFrame) -> None:
        """Adds rows; those of ids that are there already hide the older ones."""
        self._assigned(vectors).write.mode("append").partitionBy("cell").parquet(f"{self.root}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/cells")

    def search(self, query, k: int = 10, ef: int = 64, scope: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
        """(node_id, distance, score) of the k nearest in the ``ef / 8`` cells nearest to the query, ties by insertion.

        ``scope`` (id) and ``hidden`` (node_id) apply before the ranking. With fewer than k rows there, all cells are searched.
        """
        q = np.asarray(query, float)
        if not len(self.centres):
            return self.spark.createDataFrame([], "node_id string, distance double, score double")
        if len(q) != self.centres.shape[1]:
            raise ValueError(f"dimension mismatch: the index holds {self.centres.shape[1]}, the query has {len(q)}")
        p = _prepared(q[None], self.metric)[0]
        # the inner product is nearest to long vectors, not to near ones
        far = -(self.centres @ p) if self.metric == "dot" else ((self.centres - p) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable").tolist()
        some = order[: max(1, -(-ef // 8))]
        for cells in (some, order) if len(some) < len(order) else (order,):
            v = self.rows().filter(F.col("cell").isin(cells))
            v = v.groupBy("node_id").agg(F.max("seq").alias("seq"), F.max_by("vector", "seq").alias("vector"))
            if scope is not None:
                v = v.join(scope.select(F.col("id").alias("node_id")), "node_id", "left_semi")
            if hidden is not None:
                v = v.join(hidden.select("node_id"), "node_id", "left_anti")
            v = v.select("node_id", "seq", V.distance(F.col("vector"), query, self.metric).alias("distance"))
            best = v.orderBy("distance", "seq").limit(k).select("node_id", "distance", V.similarity(F.col("distance"), self.metric).alias("score"))
            if cells is order or best.count() >= k:
                return best
        raise AssertionError("unreachable")

    def rebuild(self, root: str, hidden: DataFrame | None = None, cfg: IndexConfig = IndexConfig()) -> Index:
        """A new index at another place, without hidden nodes and older rows of an id."""
        v = self.rows().groupBy("node_id").agg(F.max("seq").alias("seq"), F.max_by("vector", "seq").alias("vector"))
        v = v if hidden is None else v.join(hidden.select("node_id"), "node_id", "left_anti")
        return Index.build(v, root, self.metric, cfg)
