"""Traversal, predicates and the wire form on graphs built by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions.ids import EDGE_CODE, EDGE_TYPES
from tessera.functions.props import pv
from tessera.operators import graph as G
from tessera.operators import vector as V
from tessera.plans.query import Query
from tessera.store import SCHEMAS


def build(spark, nodes, edges, vectors=(), gone=()):
    """nodes: (id, kind, dict of fields); edges: (src, type, dst)."""
    names = ["id", "kind", "title", "text", "name", "document_id", "source_uri", "version", "created_at", "metadata"]
    ddl = f"id string, kind string, title string, text string, name string, document_id string, source_uri string, version int, created_at long, metadata map<string,{G.PV}>"
    rows = [(i, k, *(f.get(c) for c in names[2:9]), {a: pv(b) for a, b in f.get("metadata", {}).items()}) for i, k, f in nodes]
    df = spark.createDataFrame(rows, ddl)
    out = [G.as_nodes(df.filter(F.col("kind") == k), k) for k in ("Document", "Chunk", "Entity", "PipelineRun")]
    n = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    e = spark.createDataFrame([(s, a, t, b, 0, None) for s, (a, t, b) in enumerate(edges)], SCHEMAS["edges"])
    v = spark.createDataFrame([("m:2", i, x, s) for s, (i, x) in enumerate(vectors)], SCHEMAS["vectors"])
    return G.Graph(n, e, v, spark.createDataFrame([(i, 1) for i in gone], SCHEMAS["tombstones"]))


def queue_bfs(ids, edges, gone, start, types, direction, hops):
    order = list(types) or list(EDGE_TYPES)
    seen, queue, out = set(start), [(s, 0) for s in start], []
    while queue:
        at, h = queue.pop(0)
        if h == hops or at not in ids or at in gone:
            continue
        for d in ("out", "in"):
            if direction not in (d, "both"):
                continue
            for t in order:
                far = sorted(b if d == "out" else a for a, k, b in edges if k == t and (a if d == "out" else b) == at)
                for x in far:
                    if x not in gone and x not in seen:
                        seen.add(x)
                        queue.append((x, h + 1))
                        if x in ids:
                            out.append((x, h + 1, at, t))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_traversal_equals_a_queue(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(14)]
    edges = list({(r.choice(ids), r.choice(["MENTIONS", "RELATES_TO", "PRECEDES"]), r.choice(ids)) for _ in range(26)})
    gone = r.sample(ids, 2)
    start = [x for x in r.sample(ids, 2) if x not in gone] or [next(x for x in ids if x not in gone)]
    types = r.choice([(), ("RELATES_TO", "MENTIONS")])
    direction = r.choice(["out", "in", "both"])
    g = build(spark, [(i, "Entity", {"name": i}) for i in ids], edges, gone=gone)
    got = Query().seed(*start).traverse(types, 3, direction).run(g).orderBy("_ord").select("id", "hops", "via", "via_edge").collect()
    assert [tuple(x) for x in got] == queue_bfs(set(ids), edges, set(gone), start, types, direction, 3)


def test_limit_counts_the_start_rows(spark):
    ids = list("abcdef")
    g = build(spark, [(i, "Entity", {}) for i in ids], [("a", "RELATES_TO", x) for x in "bcdef"])
    q = Query().seed("a").traverse(limit=3, include_start=True)
    assert [r.id for r in q.run(g).orderBy("_ord").collect()] == ["a", "b", "c"]
    assert Query().seed("a").traverse(max_hops=0).run(g).count() == 0


def test_seed_keeps_order_and_repeats(spark):
    g = build(spark, [(i, "Entity", {}) for i in "abc"], [])
    assert [r.id for r in Query().seed("c", "a", "c", "zz").run(g).orderBy("_ord").collect()] == ["c", "a", "c"]


def test_predicates_are_two_valued(spark):
    g = build(spark, [("a", "Entity", {"name": "Ada", "metadata": {"n": 3, "f": 3.0, "tags": ["x", "Y"], "s": "Hello", "nan": float("nan")}}), ("b", "Entity", {"name": "Bob"})], [])

    def ids(p):
        return {r.id for r in Query().seed_kind("entity").filter(P.Predicate.from_json(p.to_json())).run(g).collect()}

    assert ids(P.prop("n", "eq", 3)) == {"a"} and ids(P.prop("n", "eq", 3.0)) == set()
    assert ids(P.prop("n", "gte", 3.0)) == {"a"} and ids(P.prop("f", "lt", 4)) == {"a"}
    assert ids(~P.prop("n", "eq", 3)) == {"b"} and ids(P.prop("n", "ne", 3)) == {"b"}
    assert ids(~P.prop("zz", "eq", 1)) == {"a", "b"}
    assert ids(P.prop("nan", "gt", 0)) == set() and ids(P.prop("nan", "eq", float("nan"))) == set()
    assert ids(P.prop("s", "contains", "ELL")) == {"a"} and ids(P.prop("s", "starts_with", "he")) == {"a"}
    assert ids(P.prop("tags", "contains", "Y")) == {"a"} and ids(P.prop("tags", "contains", "y")) == set()
    assert ids(P.prop("n", "in", [1, 3])) == {"a"} and ids(P.prop("n", "in", [3.0])) == set()
    assert ids(P.all_of()) == {"a", "b"} and ids(P.any_of()) == set()


def test_search_is_scoped_filtered_and_replaces(spark):
    g = build(spark, [(f"c{i}", "Chunk", {"text": str(i), "document_id": "d"}) for i in range(5)] + [("e", "Entity", {})], [("c4", "MENTIONS", "e")], [(f"c{i}", [1.0, float(i)]) for i in range(5)], gone=["c0"])
    got = Query().search([1.0, 0.0], 2).run(g).orderBy("_ord").collect()
    assert [r.id for r in got] == ["c1", "c2"] and got[0].score > got[1].score
    assert [r.id for r in Query().seed("c4", "c3").search([1.0, 0.0], 5).run(g).orderBy("_ord").collect()] == ["c3", "c4"]
    empty = Query().seed("none").search([1.0, 0.0], 2)
    assert empty.run(g).count() == 0 and empty.run(g, compat_empty_scope=True).count() == 2
    out, told = Query().search([1.0, 0.0], 4).traverse(("MENTIONS",), 1, "out").filter(P.kind("entity")).run_with_stats(g)
    assert [r.id for r in out.collect()] == ["e"] and [t["stage"] for t in told] == ["search", "traverse", "filter"]
    with pytest.raises(ValueError):
        Query().search([1.0, 0.0, 0.0], 2).run(g)
    with pytest.raises((LookupError, ValueError)):
        Query().search([1.0, 0.0], 2, "other").run(g)
    with pytest.raises(ValueError):
        Query().run(g)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_kernels_agree(spark, metric):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],), ([-1.0, 0.5, 2.0],)], "v array<float>")
    q = [0.5, -1.0, 2.0]
    got = df.select(V.distance(F.col("v"), q, metric).alias("a"), V.native_distance(F.col("v"), q, metric).alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-6 for r in got)


def test_versions(spark):
    docs = [(f"d{i}", "Document", {"title": f"t{i}", "source_uri": "u", "version": i, "created_at": i}) for i in (1, 2, 3)]
    edges = [("d2", "SUPERSEDES", "d1"), ("d3", "SUPERSEDES", "d2")]
    g = build(spark, docs, edges)
    assert [r.id for r in G.history(g, "d2").collect()] == ["d1", "d2", "d3"]
    assert [r.id for r in Query().seed_kind("document").latest().run(g).collect()] == ["d3"]
    again = build(spark, docs, edges, gone=["d3"])
    assert [r.id for r in Query().seed_kind("document").latest().run(again).collect()] == ["d2"]
    with pytest.raises(ValueError):
        G.version_chains(build(spark, docs, [*edges, ("d1", "SUPERSEDES", "d3")]), rounds=6).count()


def test_wire_form():
    q = Query().seed("a").search([1, 2], 3).traverse(["mentions"], 2, "in", 5, True).filter(~P.latest() | P.prop("k", "in", [1])).limit(4)
    assert Query.from_json(q.to_json()) == q
    assert Query.from_json({"stages": [{"stage": "traverse"}]}).stages[0]["direction"] == "out"
    with pytest.raises(ValueError):
        Query.from_json({"stages": [{"stage": "nope"}]})
    assert EDGE_CODE["PART_OF"] == 1 and len(EDGE_TYPES) == 10
