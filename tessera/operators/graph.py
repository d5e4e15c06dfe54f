"""The graph as DataFrames, and operators on it: scans, neighbours, traversal, history, reports."""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import EDGE_CODE, EDGE_TYPES, KINDS
from ..functions.props import PV

NODE_FIELDS = {
    "id": "string", "kind": "string", "created_at": "bigint", "title": "string", "source_uri": "string", "content_hash": "string", "version": "int", "supersedes_id": "string", "run_id": "string",
    "document_id": "string", "text": "string", "chunk_index": "int", "token_count": "int", "embeddings": "array<struct<model:string,dim:int,run_id:string,embedded_at:bigint>>",
    "name": "string", "entity_type": "string", "canonical_id": "string", "pipeline_version": "string", "embedding_model": "string", "run_at": "bigint", "config_hash": "string", "chunker": "string", "metadata": f"map<string,{PV}>",
}


def as_nodes(df: DataFrame, kind: str) -> DataFrame:
    """All node columns, null where ``df`` lacks them."""
    df = df.withColumn("kind", F.lit(kind))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in NODE_FIELDS.items()))


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut at the session's checkpoint folder; a local one only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


@dataclass(frozen=True)
class Graph:
    """``nodes`` holds all rows, deleted ones too; ``tombstones`` (node_id) hides them from reads."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    tombstones: DataFrame

    def hidden(self, column: str) -> DataFrame:
        return self.tombstones.select(F.col("node_id").alias(column))

    def live(self, *kinds: str) -> DataFrame:
        rows = self.nodes.filter(F.col("kind").isin(list(kinds))) if kinds else self.nodes
        return rows.join(self.hidden("id"), "id", "left_anti")

    def superseded_ids(self) -> DataFrame:
        """Ids of documents that a node which isn't deleted supersedes."""
        e = self.edges.filter(F.col("edge_type") == "SUPERSEDES").select("src", F.col("dst").alias("_doc"))
        return e.join(self.hidden("src"), "src", "left_anti").select("_doc").distinct()

    def with_superseded(self, df: DataFrame) -> DataFrame:
        """Adds ``_superseded``: of a document, or of a chunk's document; false for other kinds."""
        key = F.when(F.col("kind") == "Chunk", F.col("document_id")).when(F.col("kind") == "Document", F.col("id"))
        marks = self.superseded_ids().withColumn("_superseded", F.lit(True))
        return df.join(marks, key == F.col("_doc"), "left").drop("_doc").withColumn("_superseded", F.coalesce("_superseded", F.lit(False)))

    def adjacency(self, edge_types=(), direction: str = "both") -> DataFrame:
        """(node, other, edge_type, dir, rank): edges seen from a node, without deleted far ends.

        The rank of a type is its place in the caller's list, or its code; outgoing edges come first.
        """
        types = list(edge_types) or list(EDGE_TYPES)
        e = self.edges.filter(F.col("edge_type").isin(types)) if edge_types else self.edges
        rank = F.element_at(F.create_map(*(F.lit(x) for t in dict.fromkeys(types) for x in (t, types.index(t)))), F.col("edge_type"))
        side = lambda a, b, d: e.select(F.col(a).alias("node"), F.col(b).alias("other"), "edge_type", F.lit(d).alias("dir"), rank.alias("rank"), "seq")
        parts = [side(*s) for s, on in ((("src", "dst", 0), direction in ("out", "both")), (("dst", "src", 1), direction in ("in", "both"))) if on]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.join(self.hidden("other"), "other", "left_anti")


def neighbours(g: Graph, node_id: str, edge_types=(), direction: str = "both") -> DataFrame:
    """(other, edge_type, dir, pos) of one node, in listing order."""
    adj = g.adjacency(edge_types, direction).filter(F.col("node") == node_id)
    return adj.orderBy("dir", "rank", "other").select("other", "edge_type", F.when(F.col("dir") == 0, "out").otherwise("in").alias("direction"))


def incident_edges(g: Graph, node_id: str, direction: str = "both") -> DataFrame:
    seen = g.adjacency((), direction).filter(F.col("node") == node_id).select("seq").distinct()
    return g.edges.join(seen, "seq", "left_semi").orderBy("seq")


def label() -> Column:
    """A node's short name: title, start of the text, name, or run."""
    head = F.concat(F.substring("text", 1, 60), F.when(F.char_length("text") > 60, "…").otherwise(""))
    return F.when(F.col("kind") == "Document", F.col("title")).when(F.col("kind") == "Chunk", head).when(F.col("kind") == "Entity", F.col("name")).otherwise(F.concat(F.lit("run "), "pipeline_version", F.lit(" ("), "embedding_model", F.lit(")")))


def node_detail(g: Graph, node_id: str) -> DataFrame:
    """(other, edge_type, direction, kind, label) of the node's edges; deleted far ends are left out."""
    far = g.nodes.select(F.col("id").alias("other"), "kind", label().alias("label"))
    return neighbours(g, node_id).join(far, "other", "left")


def expand(g: Graph, start: DataFrame, edge_types=(), direction: str = "both", max_hops: int = 1, base: int = 0) -> DataFrame:
    """(id, hops, via, via_edge, _ord) of nodes reached breadth-first from ``start`` (id, _ord).

    A node belongs to the first edge that reaches it, in the order of its parents, then direction, type and id. That
    order is a string key that grows by one step a hop, so no global numbering is needed; a node's first edge is a partial minimum,
    so hubs don't meet in one task. One round of joins a hop; the lineage is cut each time.
    """
    adj = g.adjacency(edge_types, direction).select("node", "other", "edge_type", "dir", "rank")
    frontier = start.groupBy("id").agg(F.min("_ord").alias("_ord"))
    seen, found = cut(frontier.select("id")), None
    for hop in range(1, max_hops + 1):
        step = F.format_string("%04d|%s|%d%02d%s", F.lit(base + hop), F.col("_ord"), F.col("dir"), F.col("rank"), F.col("other"))
        reached = adj.join(frontier.withColumnRenamed("id", "node"), "node").select(F.col("other").alias("id"), F.struct(step.alias("o"), F.col("node").alias("via"), F.col("edge_type").alias("via_edge")).alias("first"))
        new = reached.join(seen, "id", "left_anti").groupBy("id").agg(F.min("first").alias("first"))
        new = cut(new.select("id", F.lit(hop).alias("hops"), "first.via", "first.via_edge", F.col("first.o").alias("_ord")))
        if not new.take(1):
            break
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new.select("id"))
        frontier = new.select("id", "_ord").join(g.live().select("id"), "id", "left_semi")
    empty = start.sparkSession.createDataFrame([], "id string, hops int, via string, via_edge string, _ord string")
    return empty if found is None else found


def history(g: Graph, node_id: str) -> DataFrame:
    """The version chain of a document, oldest first, from any of its versions; deleted versions end the walk."""
    chains = version_chains(g)
    mine = chains.filter(F.col("id") == node_id).select("chain").first()
    return chains.filter(F.col("chain") == (mine.chain if mine else "")).orderBy("position")


def version_chains(g: Graph, rounds: int = 40) -> DataFrame:
    """(id, chain, position) of all documents: the oldest version that each reaches, and its distance.

    Pointer doubling: a chain of n versions takes log2(n) rounds of one join. A fork follows the smallest id. Chains that run in a circle are an error.
    """
    e = g.edges.filter(F.col("edge_type") == "SUPERSEDES").join(g.hidden("dst"), "dst", "left_anti")
    up = e.groupBy("src").agg(F.min("dst").alias("to"))
    docs = g.nodes.filter(F.col("kind") == "Document").select("id", "version")
    cur = cut(docs.join(up, docs.id == up.src, "left").select("id", "version", F.coalesce("to", "id").alias("chain"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("position")))
    for _ in range(rounds):
        hop = cur.select(F.col("id").alias("chain"), F.col("chain").alias("_next"), F.col("position").alias("_more"))
        nxt = cut(cur.join(hop, "chain", "left").select("id", "version", F.coalesce("_next", "chain").alias("chain"), (F.col("position") + F.coalesce("_more", F.lit(0))).alias("position")))
        if nxt.agg(F.max("position")).first()[0] == cur.agg(F.max("position")).first()[0]:
            return nxt
        cur = nxt
    raise ValueError("versions supersede one another in a circle")


def neighbourhood(g: Graph, centre: str, hops: int = 2, limit: int = 300) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes around a centre (limit 1..2000, hops 1..5), all edges among them, and whether the limit cut."""
    hops, limit = min(max(hops, 1), 5), min(max(limit, 1), 2000)
    spark = g.nodes.sparkSession
    start = spark.createDataFrame([(centre, "0")], "id string, _ord string")
    reached = expand(g, start, (), "both", hops).join(g.live().select("id"), "id", "left_semi")
    some = reached.orderBy("_ord").limit(limit - 1)
    nodes = start.select("id", F.lit(0).alias("hops")).unionByName(some.select("id", "hops"))
    ids = nodes.select("id")
    links = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, links, reached.count() > limit - 1


def documents(g: Graph, latest_only: bool = True) -> DataFrame:
    """Documents with chunk_count and is_latest, newest first."""
    docs = g.with_superseded(g.live("Document"))
    counts = g.live("Chunk").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    out = docs.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("is_latest", ~F.col("_superseded")).drop("_superseded")
    return (out.filter("is_latest") if latest_only else out).orderBy(F.desc("created_at"), "id")


def documents_matching(g: Graph, part: str) -> DataFrame:
    """Live documents whose title or uri holds the text, whatever its case."""
    return g.live("Document").filter(F.lower("title").contains(part.lower()) | F.lower("source_uri").contains(part.lower()))


def has_edge(g: Graph, nodes: DataFrame, edge_type: str, direction: str = "out") -> DataFrame:
    """(id, found): whether each of ``nodes`` (id) has an edge of the type."""
    end = "src" if direction == "out" else "dst"
    with_edge = g.edges.filter(F.col("edge_type") == edge_type).select(F.col(end).alias("_end")).distinct().withColumn("_found", F.lit(True))
    return nodes.select("id").join(with_edge, F.col("id") == F.col("_end"), "left").select("id", F.coalesce("_found", F.lit(False)).alias("found"))


def edge(g: Graph, src: str, edge_type: str, dst: str) -> DataFrame:
    """The one edge of that kind between the nodes, or no row."""
    return g.edges.filter((F.col("src") == src) & (F.col("edge_type") == edge_type) & (F.col("dst") == dst))


def first_writes(edges: DataFrame, order: str, *kept: str) -> DataFrame:
    """One row for each (src, edge_type, dst): the ``kept`` columns and ``order`` of its first write."""
    return edges.groupBy("src", "edge_type", "dst").agg(*(F.min_by(c, order).alias(c) for c in kept), F.min(order).alias(order))


def following(rows: DataFrame, by: str, order: str, item: str) -> DataFrame:
    """(by, src, dst): each item and the one after it within its group."""
    after = F.lead(item).over(Window.partitionBy(by).orderBy(order))
    return rows.select(by, F.col(item).alias("src"), after.alias("dst")).filter("dst is not null")


def counted_page(df: DataFrame, offset: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
    """A page and how many rows there are before paging."""
    return page(df, offset, limit), df.count()


def page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.offset(max(offset, 0)).limit(min(max(limit, 1), 1000))


def chunks_of(g: Graph, document_id: str) -> DataFrame:
    part = g.adjacency(("PART_OF",), "in").filter(F.col("node") == document_id).select(F.col("other").alias("id"))
    return g.live("Chunk").join(part, "id", "left_semi").orderBy("chunk_index")


def uri_heads(g: Graph) -> DataFrame:
    """The newest live document of each source_uri."""
    return g.live("Document").groupBy("source_uri").agg(F.max_by("id", F.struct("version", "id")).alias("id"), F.max("version").alias("version"))


def resolve_id(g: Graph, ref: str) -> str:
    """A full id, or at least four of its hex digits from either end."""
    short = ref.replace("-", "").lower()
    bare = F.replace(F.col("id"), F.lit("-"))
    found = [r.id for r in g.nodes.filter((F.col("id") == ref) | (bare.startswith(short) | bare.endswith(short) if len(short) >= 4 else F.lit(False))).select("id").limit(3).collect()]
    if ref in found:
        return ref
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} nodes match {ref!r}")
    return found[0]


def stats(g: Graph) -> DataFrame:
    """(metric, name, value): live nodes by kind, latest documents, edges by type, deleted nodes, vectors by namespace."""
    row = lambda df, metric, name: df.select(F.lit(metric).alias("metric"), name.cast("string").alias("name"), F.col("n").cast("long").alias("value"))
    n = F.count(F.lit(1)).alias("n")
    parts = [row(g.live().groupBy("kind").agg(n), "nodes", F.col("kind")), row(g.with_superseded(g.live("Document")).filter("not _superseded").agg(n), "latest_documents", F.lit("")), row(g.edges.groupBy("edge_type").agg(n), "edges", F.col("edge_type")), row(g.tombstones.agg(n), "deleted", F.lit("")), row(g.vectors.groupBy("namespace").agg(n), "vectors", F.col("namespace"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def provenance(g: Graph) -> DataFrame:
    """(id, run_id): the first run that embedded or extracted a node, else the run of its document."""
    e = g.edges.filter(F.col("edge_type").isin("EMBEDDED_BY", "EXTRACTED_BY")).groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.struct(F.when(F.col("edge_type") == "EMBEDDED_BY", 0).otherwise(1), "dst")).alias("made_by"))
    return g.live().select("id", "run_id").join(e, "id", "left").select("id", F.coalesce("made_by", "run_id").alias("run_id")).filter("run_id is not null")


def export_lines(g: Graph) -> DataFrame:
    """(rank, key, line): JSON lines of a header, nodes by kind and id, edges by seq, vectors by namespace and node."""
    kinds = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i))), F.col("kind"))
    line = lambda df, tag: F.to_json(F.struct(F.lit(tag).alias("type"), *(F.col(c) for c in df.columns)))
    spark = g.nodes.sparkSession
    head = spark.createDataFrame([(0, "", '{"type":"header","format":1,"note":"edges and vectors of deleted nodes are included"}')], "rank int, key string, line string")
    nodes = g.live()
    parts = [nodes.select(F.lit(1).alias("rank"), F.concat(kinds.cast("string"), "id").alias("key"), line(nodes, "node").alias("line")), g.edges.select(F.lit(2).alias("rank"), F.format_string("%020d", "seq").alias("key"), line(g.edges, "edge").alias("line")), g.vectors.select(F.lit(3).alias("rank"), F.concat_ws("\u0001", "namespace", "node_id").alias("key"), line(g.vectors, "vector").alias("line"))]
    for p in parts:
        head = head.unionByName(p)
    return head


def codes() -> dict[str, int]:
    return dict(EDGE_CODE)
