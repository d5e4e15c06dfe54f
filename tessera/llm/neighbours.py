"""Nearest neighbours by inner product: hierarchical k-means tree, best-bin-first, calibrated leaf visits."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class TreeConfig:
    """The tree is fitted on ``sample`` vectors at most (least hashes of the id first), split ``branch`` ways down to
    ``leaf`` of them; every vector is indexed. ``recall`` is reached on ``probes`` queries that are compared with all
    vectors. ``block`` vectors of a leaf and ``queries`` of those that visit it meet in one task at a time: a vector is copied only for each
    such part of its own leaf's queries."""

    k: int = 20
    every: int = 20
    sample: int = 20_000
    branch: int = 8
    leaf: int = 100
    rounds: int = 8
    probes: int = 64
    recall: float = 0.97
    block: int = 4096
    queries: int = 16_384
    seed: int = 5


@dataclass
class Tree:
    """Nodes in breadth-first order; a node's children follow one another, a leaf has none."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf_of: np.ndarray
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at each level."""
        at, out = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                if not self.count[node]:
                    out[rows] = self.leaf_of[node]
                    at[rows] = -1
                    continue
                c = self.centre[self.first[node] : self.first[node] + self.count[node]]
                at[rows] = self.first[node] + ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            open_ = np.flatnonzero(at >= 0)
        return out

    def order(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves from the best bin on: a queue holds open branches by their centres' inner product with the query."""
        sim = self.centre @ q
        queue, out = [(-np.inf, 0)], []
        while queue and len(out) < visits:
            node = heapq.heappop(queue)[1]
            while self.count[node]:  # down to a leaf, siblings into the queue
                kids = range(self.first[node], self.first[node] + self.count[node])
                best = max(kids, key=lambda c: (sim[c], -c))
                for c in kids:
                    if c != best:
                        heapq.heappush(queue, (-sim[c], c))
                node = best
            out.append(int(self.leaf_of[node]))
        return out


def build_tree(x: np.ndarray, cfg: TreeConfig) -> Tree:
    rng = np.random.default_rng(cfg.seed)
    centre, first, count, members = [x.mean(axis=0)], [0], [0], [np.arange(len(x))]
    k = 0
    while k < len(centre):
        rows = members[k]
        if len(rows) > cfg.leaf:
            part, c = x[rows], x[rng.choice(rows, min(cfg.branch, len(rows)), replace=False)]
            for _ in range(cfg.rounds):
                near = ((c * c).sum(axis=1) - 2 * part @ c.T).argmin(axis=1)
                c = np.array([part[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            near = ((c * c).sum(axis=1) - 2 * part @ c.T).argmin(axis=1)
            used = [j for j in range(len(c)) if (near == j).any()]
            if len(used) > 1:  # equal vectors can't be split
                first[k], count[k] = len(centre), len(used)
                for j in used:
                    centre.append(c[j])
                    first.append(0)
                    count.append(0)
                    members.append(rows[near == j])
        members[k] = rows[:0]
        k += 1
    n = np.array(count)
    leaf_of = np.full(len(n), -1)
    leaf_of[n == 0] = np.arange((n == 0).sum())
    return Tree(np.array(centre), np.array(first), n, leaf_of, int((n == 0).sum()))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(len(col), -1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order, so that equal vectors tie."""
    return (x * q).sum(axis=-1)


def _top(ids: np.ndarray, x: np.ndarray, qid: int, q: np.ndarray, rough: np.ndarray, k: int):
    """The k nearest of a block, ties to the smaller id; ``rough`` may differ from the scores by rounding."""
    if len(ids) > k + 1:
        slack = 1e-9 * (1 + np.abs(rough).max())
        some = np.flatnonzero(rough >= np.partition(rough, -(k + 1))[-(k + 1)] - slack)
    else:
        some = np.arange(len(ids))
    some = some[ids[some] != qid]
    s = exact_scores(x[some], q)
    best = np.lexsort((ids[some], -s))[:k]
    return ids[some][best], s[best]


def _pairs(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, x, q = left.vec_id.to_numpy(), _matrix(left.vec), _matrix(right.vec)
            for i in range(0, len(q), 256):
                rough = q[i : i + 256] @ x.T
                for j, qid in enumerate(right.query_id.to_numpy()[i : i + 256]):
                    got, s = _top(ids, x, qid, q[i + j], rough[j], k)
                    cols["query_id"].append(np.full(len(got), qid))
                    cols["vec_id"].append(got)
                    cols["score"].append(s)
        return pd.DataFrame({c: np.concatenate([*v, np.zeros(0, float if c == "score" else np.int64)]) for c, v in cols.items()})

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score, leaves, recall) for (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows but the query's own. ``leaves`` is the number
    of leaves that each query visits, more if they hold too few candidates, and ``recall`` what that reached on the probes. Vectors that are null, zero or
    hold null or non-finite components, rows without vec_id, and vectors of another length than most take no
    part. Of rows that repeat a vec_id the one with the least vector counts. A leaf of any size is met in blocks.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "neighbours")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
    v = v.filter("size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(x, c -> c <> 0)")
    v = v.groupBy("vec_id").agg(F.min("x").alias("x"))
    v = tmp.save(v, "vectors")
    sizes = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double, leaves int, recall double"
    if not sizes:
        return spark.createDataFrame([], schema)
    v = v.filter(F.size("x") == sizes[0].d)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cfg.sample).toArrow()
    tree = build_tree(np.stack(sample.column("x").to_numpy()), cfg)

    def assign(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), pa.array(tree.assign(x), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "leaf", "vec"])

    indexed = tmp.save(v.mapInArrow(assign, "vec_id long, leaf int, vec binary"), "indexed")
    queries = indexed.filter(F.pmod("vec_id", F.lit(cfg.every)) == 0)

    # probes: what all vectors would give, and how far down the order of leaves it lies
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(cfg.probes).select("vec_id", "vec").collect()
    if not probes:
        return spark.createDataFrame([], schema)
    pid, px = np.array([r[0] for r in probes]), np.stack([np.frombuffer(bytes(r[1])) for r in probes])

    def brute(batches):
        for batch in batches:
            ids, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(batch.num_rows, -1)
            where = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
            rough = px @ x.T
            for q, vec, r in zip(pid, px, rough, strict=True):
                got, s = _top(ids, x, q, vec, r, cfg.k)
                yield pa.record_batch([pa.array(np.full(len(got), q)), pa.array(got), pa.array(s), pa.array([where[i] for i in got.tolist()], pa.int32())], ["query_id", "vec_id", "score", "leaf"])

    true = _best(indexed.mapInArrow(brute, "query_id long, vec_id long, score double, leaf int"), cfg.k).select("query_id", "leaf").collect()
    depth = {int(q): {leaf: n for n, leaf in enumerate(tree.order(x, tree.leaves))} for q, x in zip(pid, px, strict=True)}
    need = np.array([depth[r[0]][r[1]] for r in true])
    visits, reached = min(4, tree.leaves), 1.0
    while len(need):
        reached = float((need < visits).mean())
        if reached >= cfg.recall or visits >= tree.leaves:
            break
        visits = min(tree.leaves, visits * 5 // 4 + 1)

    sizes = {r[0]: r[1] for r in indexed.groupBy("leaf").count().collect()}  # leaves are bounded by the sample
    blocks = np.array([-(-sizes.get(i, 0) // cfg.block) for i in range(tree.leaves)])

    def route(batches):
        for batch in batches:
            ids, leaf, block, vec = [], [], [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = np.frombuffer(raw)
                some = tree.order(q, visits)
                held = sum(sizes.get(n, 0) for n in some)
                if held <= cfg.k:  # one of them may be the query: on until k others are held or no leaf is left
                    for n in tree.order(q, tree.leaves)[len(some) :]:
                        some.append(n)
                        held += sizes.get(n, 0)
                        if held > cfg.k:
                            break
                for n in some:
                    for b in range(blocks[n]):
                        ids.append(i)
                        leaf.append(n)
                        block.append(b)
                        vec.append(raw)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(leaf, pa.int32()), pa.array(block, pa.int32()), pa.array(vec, pa.binary())], ["query_id", "leaf", "block", "vec"])

    routed = tmp.save(queries.select("vec_id", "vec").mapInArrow(route, "query_id long, leaf int, block int, vec binary"), "routed")
    visitors = {r[0]: r[1] for r in routed.filter("block = 0").groupBy("leaf").count().collect()}
    of_leaf = lambda n: F.element_at(F.array(*(F.lit(int(max(1, x))) for x in n)), F.col("leaf") + 1)
    parts = of_leaf([-(-visitors.get(i, 0) // cfg.queries) for i in range(tree.leaves)])
    routed = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int"))
    dealt = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_leaf(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = ["leaf", "block", "part"]
    pairs = dealt.groupBy(*key).cogroup(routed.groupBy(*key)).applyInPandas(_pairs(cfg.k), "query_id long, vec_id long, score double")
    out = _best(pairs, cfg.k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(int(visits)).alias("leaves"), F.lit(reached).alias("recall"))
