"""Registered queries of the graph and vector engine, each with the same rules in SQL where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixture as X
from .functions import predicates as P
from .functions import udfs
from .functions.providers import hashing, rule_extractor
from .functions.text import Chunker
from .operators import graph as G
from .operators import ingest as I
from .operators import vector as V
from .plans.query import Query

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None, fixture: bool = True):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = (X.SQL + "\n" + sql) if fixture else sql
        return fn

    return add


def _vector(spark, sf_dir, vec_id: int = 7) -> list[float]:
    return [float(x) for x in X.table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _query(fn, *cols):
    def run(spark, sf_dir):
        out = fn(Query(), spark, sf_dir).run(X.graph(spark, sf_dir))
        return out.select(*(F.round(c, 6).alias(c) if c in ("score", "distance") else F.col(c) for c in cols))

    return run


# ---- vector search -------------------------------------------------------------------------
_Q = "q AS (SELECT v AS qv FROM chk WHERE vec_id = 7)"
_N = "sqrt(list_inner_product(v, v))"
_DIST = {"cosine": "1 - list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv)))", "euclidean": "sqrt(list_sum(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", "dot": "-list_inner_product(v, qv)"}
_SIM = {"cosine": "least(greatest(1 - d, -1.0), 1.0)", "euclidean": "1 / (1 + greatest(d, 0.0))", "dot": "-d"}


def _topk_sql(metric: str, where: str = "true", k: int = 20) -> str:
    return f", {_Q}, r AS (SELECT id, vec_id, {_DIST[metric]} AS d FROM chk, q WHERE {where}), top AS (SELECT * FROM r ORDER BY d, vec_id LIMIT {k})"


for _m in ("cosine", "euclidean", "dot"):
    register(f"vec_topk_{_m}", _topk_sql(_m) + f" SELECT id, round(d + 0.0, 6) AS distance, round({_SIM[_m]} + 0.0, 6) AS score FROM top")(_query(lambda q, s, d, m=_m: q.search(_vector(s, d), 20, metric=m), "id", "distance", "score"))


@register("vec_native_distance", f", {_Q} SELECT id, round({_DIST['cosine']} + 0.0, 6) AS distance FROM chk, q")
def vec_native_distance(spark, sf_dir):
    return X.graph(spark, sf_dir).vectors.select(F.col("node_id").alias("id"), F.round(V.native_distance(F.col("vector"), _vector(spark, sf_dir)) + 0.0, 6).alias("distance"))


register("vec_search_scoped", _topk_sql("cosine", "label IN (1, 2, 3)", 10) + " SELECT id, round(d + 0.0, 6) AS distance FROM top")(_query(lambda q, s, d: q.seed_kind("chunk").filter(P.prop("label", "in", [1, 2, 3])).search(_vector(s, d), 10), "id", "distance"))
register("vec_search_postfilter_latest", _topk_sql("cosine") + " SELECT top.id, round(d + 0.0, 6) AS distance FROM top JOIN chk USING (id) WHERE document_id NOT IN (SELECT id FROM sup)")(_query(lambda q, s, d: q.search(_vector(s, d), 20).latest(), "id", "distance"))


@register("vec_search_prefilter_latest", _topk_sql("cosine", "document_id NOT IN (SELECT id FROM sup)") + " SELECT id, round(d + 0.0, 6) AS distance FROM top")
def vec_search_prefilter_latest(spark, sf_dir):
    out = Query().search(_vector(spark, sf_dir), 20).run(X.graph(spark, sf_dir), prefilter=P.latest())
    return out.select("id", F.round("distance", 6).alias("distance"))


@register("vec_knn_batch", """, p AS (SELECT a.id AS query_id, b.id AS node_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM chk a JOIN chk b ON a.id <> b.id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM p) SELECT query_id, node_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""")
def vec_knn_batch(spark, sf_dir):
    v = X.graph(spark, sf_dir).vectors
    out = V.knn_join(v.filter("seq % 20 = 0").select(F.col("node_id").alias("query_id"), "vector"), v, 5)
    return out.select("query_id", "node_id", F.round("distance", 6).alias("distance"), "rank")


@register("vec_namespaces", " SELECT 'fixture:64' AS namespace, 64 AS dim, count(*) AS count FROM chk")
def vec_namespaces(spark, sf_dir):
    return V.namespaces(X.graph(spark, sf_dir).vectors)


# ---- scans, seeds, limits --------------------------------------------------------------------
register("kind_scan", " SELECT id, kind FROM node WHERE kind = 'Entity'")(_query(lambda q, s, d: q.seed_kind("entity"), "id", "kind"))
register("seed_ids", " SELECT id, kind FROM (VALUES ('doc:0000000003'), ('ent:0000000001'), ('doc:0000000003')) AS s(id) JOIN node USING (id)")(_query(lambda q, s, d: q.seed("doc:0000000003", "missing", "ent:0000000001", "doc:0000000003"), "id", "kind"))
register("limit_keeps_order", " SELECT id FROM doc ORDER BY id LIMIT 25")(_query(lambda q, s, d: q.seed_kind("document").limit(25), "id"))

# ---- predicates: name -> (predicate, SQL over chunks c) -----------------------------------------
_PRED = {
    "eq": (P.prop("lang", "eq", "en"), "lang = 'en'"),
    "eq_is_type_strict": (P.prop("label", "eq", 3.0), "false"),
    "ne": (P.prop("label", "ne", 3), "label <> 3"),
    "ne_missing": (P.prop("nothing", "ne", 3), "true"),
    "lt": (P.prop("chunk_index", "lt", 2), "chunk_index < 2"),
    "lte": (P.prop("label", "lte", 4.5), "label <= 4.5"),
    "gt": (P.prop("id", "gt", "chk:0000000300"), "id > 'chk:0000000300'"),
    "gte": (P.prop("label", "gte", 5), "label >= 5"),
    "contains": (P.prop("text", "contains", "THE"), "contains(lower(text), 'the')"),
    "contains_list": (P.prop("embedding_model", "contains", X.MODEL), "true"),
    "starts_with": (P.prop("text", "starts_with", "th"), "starts_with(lower(text), 'th')"),
    "in": (P.prop("label", "in", [1, 4, 9.0]), "label IN (1, 4)"),
    "and_or_not": ((P.prop("label", "lt", 5) & ~P.prop("lang", "eq", "en")) | P.prop("chunk_index", "eq", 4), "(label < 5 AND lang <> 'en') OR chunk_index = 4"),
    "not_missing": (~P.prop("nothing", "eq", 1), "true"),
    "created_after": (P.created_after(250), "vec_id > 250"),
    "created_before": (P.created_before(100), "vec_id < 100"),
    "has_embedding": (P.has_embedding(X.NS), "true"),
    "in_document": (P.any_of(P.in_document("doc:0000000199"), P.in_document("doc:0000000950"), P.in_document("doc:0000009700")), "document_id IN ('doc:0000000199', 'doc:0000000950', 'doc:0000009700')"),
    "shadowing": (P.prop("title", "eq", "doc 3"), "false"),
}
for _n, (_p, _w) in _PRED.items():
    register(f"pred_{_n}", f" SELECT id FROM chk WHERE {_w}")(_query(lambda q, s, d, p=_p: q.seed_kind("chunk").filter(P.Predicate.from_json(p.to_json())), "id"))
register("pred_kind_all", " SELECT id FROM node WHERE kind IN ('Entity', 'PipelineRun')")(lambda s, d: X.graph(s, d).live().filter((P.all_nodes() & P.kind("entity", "run")).column()).select("id"))

# ---- versions ------------------------------------------------------------------------------------
register("latest_docs", " SELECT id FROM doc WHERE id NOT IN (SELECT id FROM sup)")(_query(lambda q, s, d: q.seed_kind("document").latest(), "id"))
register("superseded_docs", " SELECT id FROM sup")(_query(lambda q, s, d: q.seed_kind("document").filter(P.superseded()), "id"))
register("latest_chunks", " SELECT id FROM chk WHERE document_id NOT IN (SELECT id FROM sup)")(_query(lambda q, s, d: q.seed_kind("chunk").latest(), "id"))
register("superseded_entities", " SELECT id FROM ent WHERE false")(_query(lambda q, s, d: q.seed_kind("entity").filter(P.superseded()), "id"))


@register("version_chains", ", f AS (SELECT *, first_value(id) OVER (PARTITION BY uri ORDER BY version) AS chain FROM doc) SELECT id, chain, version - 1 AS position FROM f")
def version_chains(spark, sf_dir):
    return G.version_chains(X.graph(spark, sf_dir)).select("id", "chain", "position")


@register("history", ", h AS (SELECT uri FROM doc WHERE doc_id = 50) SELECT id, version, version - 1 AS position FROM doc JOIN h USING (uri)")
def history(spark, sf_dir):
    return G.history(X.graph(spark, sf_dir), "doc:0000000050").select("id", "version", "position")


@register("uri_heads", " SELECT uri AS source_uri, arg_max(id, version) AS id, max(version) AS version FROM doc GROUP BY uri")
def uri_heads(spark, sf_dir):
    return G.uri_heads(X.graph(spark, sf_dir))


# ---- neighbours and traversal ----------------------------------------------------------------------
_SIDE = {"out": "d = 0", "in": "d = 1", "both": "true"}
for _d in _SIDE:
    register(f"neighbours_{_d}", f" SELECT b AS other, t AS edge_type, CASE d WHEN 0 THEN 'out' ELSE 'in' END AS direction FROM adj WHERE a = 'ent:0000000003' AND {_SIDE[_d]}")(lambda s, d, w=_d: G.neighbours(X.graph(s, d), "ent:0000000003", (), w))
register("incident_edges", " SELECT src, dst, t AS edge_type FROM edg WHERE 'chk:0000000007' IN (src, dst)")(lambda s, d: G.incident_edges(X.graph(s, d), "chk:0000000007").select("src", "dst", "edge_type"))
register("node_detail", """, l AS (SELECT id, kind, CASE kind WHEN 'Document' THEN (SELECT title FROM doc WHERE doc.id = node.id) WHEN 'Entity' THEN (SELECT name FROM ent WHERE ent.id = node.id) WHEN 'PipelineRun' THEN 'run 1 (fixture)'
ELSE (SELECT left(text, 60) || CASE WHEN length(text) > 60 THEN '…' ELSE '' END FROM chk WHERE chk.id = node.id) END AS label FROM node)
SELECT b AS other, t AS edge_type, CASE d WHEN 0 THEN 'out' ELSE 'in' END AS direction, l.kind, l.label FROM adj JOIN l ON l.id = b WHERE a = 'chk:0000000007'""")(lambda s, d: G.node_detail(X.graph(s, d), "chk:0000000007").select("other", "edge_type", "direction", "kind", "label"))


def _bfs_sql(start: str, types: str, side: str, hops: int) -> str:
    return f", walk(id, h) AS (SELECT '{start}', 0 UNION SELECT b, h + 1 FROM walk JOIN adj ON a = walk.id WHERE h < {hops} AND {types} AND {side}), lo AS (SELECT id, min(h) AS hops FROM walk GROUP BY id)"


for _h in (1, 2, 3):
    register(f"bfs_hops_{_h}", _bfs_sql("chk:0000000007", "t IN ('PRECEDES', 'MENTIONS', 'RELATES_TO')", "true", _h) + " SELECT id, hops FROM lo WHERE hops > 0")(_query(lambda q, s, d, h=_h: q.seed("chk:0000000007").traverse(("PRECEDES", "MENTIONS", "RELATES_TO"), h), "id", "hops"))
register("bfs_include_start", _bfs_sql("doc:0000000150", "t = 'SUPERSEDES'", "d = 0", 4) + " SELECT id, nullif(hops, 0) AS hops FROM lo")(_query(lambda q, s, d: q.seed("doc:0000000150").traverse(("SUPERSEDES",), 4, "out", include_start=True), "id", "hops"))
register("bfs_via", """, s AS (SELECT id, row_number() OVER (ORDER BY id) AS o FROM chk WHERE vec_id < 40), c AS (SELECT adj.b AS id, adj.a AS via, adj.t AS via_edge, row_number() OVER (PARTITION BY adj.b ORDER BY s.o, d, code, adj.b) AS r FROM s JOIN adj ON adj.a = s.id JOIN typ USING (t) WHERE adj.b NOT IN (SELECT id FROM s))
SELECT id, via, via_edge FROM c WHERE r = 1""")(_query(lambda q, s, d: q.seed_kind("chunk").filter(P.created_before(40)).traverse((), 1, "both"), "id", "via", "via_edge"))
register("bfs_limit", """, c AS (SELECT b AS id, row_number() OVER (ORDER BY d, code, b) AS r FROM adj JOIN typ USING (t) WHERE a = 'ent:0000000003' QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, code) = 1) SELECT id FROM (SELECT id FROM c ORDER BY r LIMIT 12)""")(_query(lambda q, s, d: q.seed("ent:0000000003").traverse((), 1, "both", limit=12), "id"))


@register("graph_neighbourhood_links", _bfs_sql("chk:0000000007", "t IS NOT NULL", "true", 1) + " SELECT src, dst, t AS edge_type FROM edg WHERE src IN (SELECT id FROM lo) AND dst IN (SELECT id FROM lo)")
def graph_neighbourhood_links(spark, sf_dir):
    return G.neighbourhood(X.graph(spark, sf_dir), "chk:0000000007", 1, 300)[1].select("src", "dst", "edge_type")


register("search_expand_latest", _topk_sql("cosine") + """, hit AS (SELECT top.id, d FROM top JOIN chk USING (id) WHERE document_id NOT IN (SELECT id FROM sup)),
x AS (SELECT DISTINCT b AS id FROM hit JOIN adj ON a = hit.id WHERE t IN ('MENTIONS', 'PART_OF', 'PRECEDES') AND b NOT IN (SELECT id FROM hit)),
l AS (SELECT x.id FROM x LEFT JOIN chk USING (id) WHERE coalesce(document_id, x.id) NOT IN (SELECT id FROM sup))
SELECT id, round(1 - d, 6) AS score, NULL::INT AS hops FROM hit UNION ALL SELECT id, NULL, 1 FROM l""")(_query(lambda q, s, d: q.search(_vector(s, d), 20).latest().traverse(("MENTIONS", "PART_OF", "PRECEDES"), 1, "both", include_start=True).latest(), "id", "score", "hops"))

# ---- listings and reports ------------------------------------------------------------------------------
_LIST = "SELECT doc.id, version, (SELECT count(*) FROM chk WHERE document_id = doc.id) AS chunk_count, doc.id NOT IN (SELECT id FROM sup) AS is_latest FROM doc"
register("docs_with_chunk_counts", " " + _LIST)(lambda s, d: G.documents(X.graph(s, d), False).select("id", "version", "chunk_count", "is_latest"))
register("docs_page", f" SELECT id, chunk_count FROM ({_LIST}) WHERE is_latest ORDER BY id DESC LIMIT 10 OFFSET 5")(lambda s, d: G.page(G.documents(X.graph(s, d)), 5, 10).select("id", "chunk_count"))
register("docs_matching", " SELECT id FROM doc WHERE contains(lower(uri), 'src1')")(lambda s, d: G.documents_matching(X.graph(s, d), "SRC1").select("id"))
register("chunks_of", " SELECT id, chunk_index FROM chk WHERE document_id = 'doc:0000000950'")(lambda s, d: G.chunks_of(X.graph(s, d), "doc:0000000950").select("id", "chunk_index"))
register("stats", " SELECT 'nodes' AS metric, kind AS name, count(*) AS value FROM node GROUP BY kind UNION ALL SELECT 'latest_documents', '', count(*) FROM doc WHERE id NOT IN (SELECT id FROM sup) UNION ALL SELECT 'edges', t, count(*) FROM edg GROUP BY t UNION ALL SELECT 'deleted', '', 0 UNION ALL SELECT 'vectors', 'fixture:64', count(*) FROM chk")(lambda s, d: G.stats(X.graph(s, d)))
register("provenance", " SELECT id, 'run:0' AS run_id FROM node WHERE kind <> 'PipelineRun'")(lambda s, d: G.provenance(X.graph(s, d)))
register("edge_exists", " SELECT id, id IN (SELECT src FROM edg WHERE t = 'PRECEDES') AS has_next FROM chk")(lambda s, d: (lambda g: G.has_edge(g, g.live("Chunk"), "PRECEDES").withColumnRenamed("found", "has_next"))(X.graph(s, d)))
register("export_lines", " SELECT 0 AS rank, 1 AS n UNION ALL SELECT 1, count(*) FROM node UNION ALL SELECT 2, count(*) FROM edg UNION ALL SELECT 3, count(*) FROM chk")(lambda s, d: G.export_lines(X.graph(s, d)).groupBy("rank").agg(F.count(F.lit(1)).alias("n")))
register("edge_first_write_wins", " SELECT src, t AS edge_type, dst, 'first' AS note FROM edg")(lambda s, d: (lambda e: G.first_writes(e.withColumn("note", F.lit("first")).withColumn("n", F.lit(0)).unionByName(e.withColumn("note", F.lit("later")).withColumn("n", F.lit(1))), "n", "note").drop("n"))(X.graph(s, d).edges.select("src", "edge_type", "dst")))

# ---- text ------------------------------------------------------------------------------------------------
_DOC = lambda s, d: X.table(s, d, "documents").select("doc_id", "text")
register("chunk_fixed", """WITH t AS (SELECT doc_id, trim(text, ' ') AS x FROM documents), n AS (SELECT *, CASE WHEN length(x) <= 400 THEN 1 ELSE ceil((length(x) - 400) / 350.0)::INT + 1 END AS n FROM t),
p AS (SELECT doc_id, i, trim(substring(x, i::BIGINT * 350 + 1, 400), ' ') AS piece FROM n, unnest(range(n)) AS r(i)), q AS (SELECT * FROM p WHERE piece <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, piece FROM q""", fixture=False)(lambda s, d: _DOC(s, d).select("doc_id", F.posexplode(udfs.fixed_chunks(F.col("text"), 400, 50)).alias("chunk_index", "piece")))
register("token_estimate", r"SELECT doc_id, greatest(length(text) // 4, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS tokens FROM documents", fixture=False)(lambda s, d: _DOC(s, d).select("doc_id", udfs.token_estimate(F.col("text")).alias("tokens")))
register("normal_names", r"SELECT p_partkey, regexp_replace(trim(regexp_replace(lower('The ' || p_name), '[^a-z0-9&]+', ' ', 'g')), '^the (.)', '\1') AS norm FROM part", fixture=False)(lambda s, d: X.table(s, d, "part").select("p_partkey", udfs.normal_name(F.concat(F.lit("The "), "p_name")).alias("norm")))
register("chunk_recursive")(lambda s, d: _DOC(s, d).select("doc_id", F.posexplode(udfs.chunks(F.col("text"), Chunker.parse("recursive:500:50"))).alias("chunk_index", "piece")))
register("chunk_sentence")(lambda s, d: _DOC(s, d).select("doc_id", F.posexplode(udfs.chunks(F.col("text"), Chunker.parse("sentence:500:1"))).alias("chunk_index", "piece")))
register("html_text")(lambda s, d: X.table(s, d, "pages").select("page_id", udfs.html_text(F.col("html")).alias("text")))
register("titles", r"SELECT doc_id, coalesce(nullif(trim(list_filter(list_transform(string_split(text, chr(10))[:20], lambda x: trim(x, ' ')), lambda x: starts_with(x, '# '))[1][3:], ' '), ''), doc_id::VARCHAR) AS title FROM documents", fixture=False)(lambda s, d: _DOC(s, d).select("doc_id", udfs.title(F.col("text"), F.col("doc_id").cast("string")).alias("title")))
register("hash_embedding")(lambda s, d: _DOC(s, d).select("doc_id", hashing(64).column(F.col("text")).alias("embedding")))


def _found(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    e = _DOC(spark, sf_dir).select(key.alias("id"), key.alias("document_id"), F.explode(rule_extractor().column(F.col("text"))).alias("e"))
    return e.select("id", "document_id", "e.*").withColumn("entity", F.concat_ws("|", "norm", "entity_type"))


register("entities")(lambda s, d: _found(s, d).select("id", "name", "norm", "entity_type", "confidence", "mentions"))
register("entity_totals")(lambda s, d: I.entity_totals(_found(s, d)))
register("aliases")(lambda s, d: I.aliases(_found(s, d)))
register("cooccurrence_pairs", """, m AS (SELECT DISTINCT document_id AS id, label FROM chk) SELECT 'e' || a.label AS a, 'e' || b.label AS b, count(*) AS n FROM m a JOIN m b USING (id) WHERE 'e' || a.label < 'e' || b.label GROUP BY ALL""")(lambda s, d: I.cooccurrences(X.graph(s, d).edges.filter("edge_type = 'MENTIONS'").join(X.graph(s, d).live("Chunk").select(F.col("id").alias("src"), "document_id"), "src").select(F.col("document_id").alias("id"), F.concat(F.lit("e"), F.substring("dst", 5, 10).cast("int").cast("string")).alias("entity"))))
register("precedes_follows", """, w AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) SELECT conv_id, turn AS src, nx AS dst FROM w WHERE nx IS NOT NULL""")(lambda s, d: G.following(X.table(s, d, "conversations"), "conv_id", "turn", "turn"))


@register("projection_pca")
def projection_pca(spark, sf_dir):
    return V.pca_2d(X.graph(spark, sf_dir).vectors.select(F.col("node_id").alias("id"), "vector"))


@register("chunk_diff")
def chunk_diff(spark, sf_dir):
    """Lines of each document against those of the version that it supersedes."""
    from .operators.diff import diff_pairs

    g = X.graph(spark, sf_dir)
    text = X.table(spark, sf_dir, "documents").select(X._id("doc:", F.col("doc_id")).alias("id"), F.split("text", "\n").alias("parts"))
    pairs = g.edges.filter("edge_type = 'SUPERSEDES'").select("src", "dst").join(text.select(F.col("id").alias("src"), F.col("parts").alias("new")), "src").join(text.select(F.col("id").alias("dst"), F.col("parts").alias("old")), "dst")
    return diff_pairs(pairs)


@register("ingest_report")
def ingest_report(spark, sf_dir):
    src = X.table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("mem://"), "source", "lang").alias("source_uri"), F.format_string("%010d", "doc_id").alias("title"), "text", F.lit(None).cast("string").alias("skipped"))
    none = spark.createDataFrame([], "node_id string, lsn long")
    empty = G.Graph(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in G.NODE_FIELDS.items())), spark.createDataFrame([], f"seq long, src string, edge_type string, dst string, created_at long, properties map<string,{G.PV}>"), spark.createDataFrame([], "namespace string, node_id string, vector array<float>, seq long"), none)
    return I.ingest(empty, src, I.IngestConfig(chunker="fixed:400:50", dim=64, extractor="none"), now=0).report.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("chunks"))
