"""Queries as a list of stages, their JSON form, and their compilation to one DataFrame plan.

Stages run in order and results are defined by it: a filter after a search sees only what the search returned.
Seed, search, filter and limit are composition; a traversal runs one job a hop.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.ids import EDGE_TYPES, parse_kind
from ..operators import graph as G
from ..operators import vector as V

RESULT = {"score": "double", "distance": "double", "hops": "int", "via": "string", "via_edge": "string", "_ord": "string"}
STAGES = ("seed", "seed_kind", "search", "traverse", "filter", "limit")


def _edges(types) -> tuple[str, ...]:
    out = tuple(t.upper() for t in types)
    if bad := set(out) - set(EDGE_TYPES):
        raise ValueError(f"unknown edge types: {sorted(bad)}")
    return out


@dataclass(frozen=True)
class Query:
    stages: tuple[dict, ...] = ()

    def _add(self, stage: str, **args) -> Query:
        return replace(self, stages=(*self.stages, {"stage": stage, **args}))

    def seed(self, *ids: str) -> Query:
        return self._add("seed", ids=list(ids))

    def seed_kind(self, kind: str) -> Query:
        return self._add("seed_kind", kind=P._snake(parse_kind(kind)))

    def search(self, vector, top_k: int = 10, model: str | None = None, metric: str = "cosine") -> Query:
        return self._add("search", vector=[float(x) for x in vector], top_k=top_k, model=model, metric=V.parse_metric(metric))

    def traverse(self, edge_types=(), max_hops: int = 1, direction: str = "both", limit: int | None = None, include_start: bool = False) -> Query:
        if direction not in ("out", "in", "both"):
            raise ValueError(f"unknown direction: {direction!r}")
        return self._add("traverse", edge_types=list(_edges(edge_types)), max_hops=max_hops, direction=direction, limit=limit, include_start=include_start)

    def filter(self, predicate: P.Predicate) -> Query:
        return self._add("filter", predicate=predicate)

    def latest(self) -> Query:
        return self.filter(P.latest())

    def of_kind(self, *kinds: str) -> Query:
        return self.filter(P.kind(*kinds))

    def limit(self, n: int) -> Query:
        return self._add("limit", n=n)

    def to_json(self) -> dict:
        return {"stages": [{k: v.to_json() if isinstance(v, P.Predicate) else v for k, v in s.items() if v is not None} for s in self.stages]}

    @staticmethod
    def from_json(data: dict) -> Query:
        """Of a traversal without a direction, outgoing edges are followed; without hops, one."""
        q = Query()
        for s in data["stages"]:
            args = {k: v for k, v in s.items() if k != "stage"}
            args.pop("ef", None)
            match s["stage"]:
                case "seed":
                    q = q.seed(*args["ids"])
                case "seed_kind":
                    q = q.seed_kind(args["kind"])
                case "search":
                    q = q.search(**args)
                case "traverse":
                    q = q.traverse(**({"direction": "out"} | args))
                case "filter":
                    q = q.filter(P.Predicate.from_json(args["predicate"]))
                case "limit":
                    q = q.limit(args["n"])
                case other:
                    raise ValueError(f"unknown stage: {other!r}")
        return q

    def run(self, g: G.Graph, prefilter: P.Predicate | None = None, compat_empty_scope: bool = False) -> DataFrame:
        return self.run_with_stats(g, prefilter, compat_empty_scope, count=False)[0]

    def run_with_stats(self, g: G.Graph, prefilter=None, compat_empty_scope: bool = False, count: bool = True) -> tuple[DataFrame, list[dict]]:
        """The result (node columns, score, distance, hops, via, via_edge, _ord) and, where asked for, each stage's row counts.

        ``prefilter`` narrows what searches rank. A search after an empty stage finds nothing,
        or searches everything with ``compat_empty_scope``.
        """
        if not self.stages:
            raise ValueError("the query has no stages")
        cur, base, told = None, 0, []
        for s in self.stages:
            before = cur.count() if count and cur is not None else 0
            cur, base = getattr(_Run(g, prefilter, compat_empty_scope), s["stage"])(cur, base, **{k: v for k, v in s.items() if k != "stage"})
            if count:
                told.append({"stage": s["stage"], "in_count": before, "out_count": cur.count()})
        return cur, told


def _rows(nodes: DataFrame, **cols) -> DataFrame:
    return nodes.select(*G.NODE_FIELDS, *(cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in RESULT.items()))


@dataclass(frozen=True)
class _Run:
    g: G.Graph
    prefilter: P.Predicate | None = None
    compat: bool = False
    _: None = field(default=None, repr=False)

    def seed(self, cur, base, ids):
        at = self.g.nodes.sparkSession.createDataFrame([(i, f"{k:012d}") for k, i in enumerate(ids)], "id string, pos string")
        return _rows(self.g.live().join(F.broadcast(at), "id"), _ord=F.concat(F.lit("0000|"), "pos")), 0

    def seed_kind(self, cur, base, kind):
        return _rows(self.g.live(parse_kind(kind)), _ord=F.concat(F.lit("0000|"), "id")), 0

    def search(self, cur, base, vector, top_k, model=None, metric="cosine"):
        scope = cur.select("id") if cur is not None else None
        if self.compat and cur is not None and not cur.take(1):
            scope = None
        if self.prefilter is not None:
            ok = self.filter(_rows(self.g.live()), 0, self.prefilter)[0].select("id")
            scope = ok if scope is None else scope.join(ok, "id", "left_semi")
        hits = V.search(self.g.vectors, vector, top_k, model, metric, scope, self.g.tombstones)
        place = F.format_string("0000|%012d", F.row_number().over(V.Window.orderBy("distance", "node_id")))  # of top_k rows
        hits = hits.select(F.col("node_id").alias("id"), "score", "distance", place.alias("_ord"))
        found = self.g.live().join(F.broadcast(hits), "id") if top_k <= 10_000 else self.g.live().join(hits, "id")
        return _rows(found, score=F.col("score"), distance=F.col("distance"), _ord=F.col("_ord")), 0

    def filter(self, cur, base, predicate):
        if not predicate.needs_latest():
            return cur.filter(predicate.condition()), base
        return self.g.with_superseded(cur).filter(predicate.column()).select(*cur.columns), base

    def limit(self, cur, base, n):
        return cur.orderBy("_ord").limit(n), base

    def traverse(self, cur, base, edge_types, max_hops, direction, limit=None, include_start=False):
        reached = G.expand(self.g, cur.select("id", "_ord"), edge_types, direction, max_hops, base)
        new = reached.join(self.g.live(), "id")
        new = _rows(new, hops=F.col("hops"), via=F.col("via"), via_edge=F.col("via_edge"), _ord=F.col("_ord"))
        if limit is not None:
            new = new.orderBy("_ord").limit(max(0, limit - (cur.count() if include_start else 0)))
        return (cur.unionByName(new) if include_start else new), base + max_hops
