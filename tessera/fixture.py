"""A graph over the test tables, as DataFrames and as the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph as G

NS = "fixture:64"
MODEL = "fixture"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, col):
    return F.concat(F.lit(prefix), F.lpad(col.cast("string"), 10, "0"))


def graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    docs, emb = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    n = docs.count()
    w = Window.partitionBy("source_uri").orderBy("doc_id")
    d = docs.select("doc_id", _id("doc:", F.col("doc_id")).alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("mem:///"), "source", F.lit("/"), "lang").alias("source_uri"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("created_at"), F.lit("run:0").alias("run_id"))
    d = d.withColumn("version", F.row_number().over(w)).withColumn("supersedes_id", F.lag("id").over(w))
    e = emb.withColumn("doc_id", F.lit(n - 1) - F.expr("vec_id div 5")).withColumn("chunk_index", (F.col("vec_id") % 5).cast("int"))
    lang = docs.select("doc_id", "lang", "text")
    c = e.join(lang, "doc_id").select(_id("chk:", F.col("vec_id")).alias("id"), _id("doc:", F.col("doc_id")).alias("document_id"), "chunk_index", "text", "vec_id", "label", "lang", "embedding", F.floor(F.char_length("text") / 4).cast("int").alias("token_count"), F.col("vec_id").alias("created_at"))
    meta = lambda key, tok, num, txt: F.struct(tok.alias("tok"), num.cast("double").alias("num"), txt.cast("string").alias("txt"), F.lit(None).cast("array<string>").alias("items"))
    c = c.withColumn("metadata", F.create_map(F.lit("label"), meta("label", F.concat(F.lit("i:"), F.col("label").cast("string")), F.col("label"), F.lit(None)), F.lit("lang"), meta("lang", F.concat(F.lit("s:"), F.col("lang")), F.lit(None), F.col("lang"))))
    c = c.withColumn("embeddings", F.array(F.struct(F.lit(MODEL).alias("model"), F.lit(64).alias("dim"), F.lit("run:0").alias("run_id"), F.lit(0).cast("long").alias("embedded_at"))))
    ent = emb.select("label").distinct().select(_id("ent:", F.col("label")).alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), F.lit("concept").alias("entity_type"), F.lit(0).cast("long").alias("created_at"))
    run = spark.createDataFrame([("run:0", "1", MODEL, 0, "whole")], "id string, pipeline_version string, embedding_model string, run_at long, chunker string")
    nodes = G.as_nodes(d, "Document").unionByName(G.as_nodes(c, "Chunk")).unionByName(G.as_nodes(ent, "Entity")).unionByName(G.as_nodes(run, "PipelineRun"))

    def edge(df, a, b, t):
        return df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("edge_type"))

    run0, entity = F.lit("run:0"), _id("ent:", F.col("label"))
    cc = c.withColumn("run", run0).withColumn("entity", entity)
    nxt = c.withColumn("next", F.lead("id").over(Window.partitionBy("document_id").orderBy("chunk_index"))).filter("next is not null")
    pair = cc.select("document_id", F.col("label").alias("l"), "entity").distinct()
    rel = pair.join(pair.select("document_id", F.col("l").alias("l2"), F.col("entity").alias("other")), "document_id").filter("l < l2").select("entity", "other").distinct()
    parts = [edge(d.filter("supersedes_id is not null"), "id", "supersedes_id", "SUPERSEDES"), edge(cc, "id", "document_id", "PART_OF"), edge(cc, "id", "document_id", "DERIVED_FROM"), edge(cc, "id", "run", "EMBEDDED_BY"), edge(nxt, "id", "next", "PRECEDES"), edge(nxt, "next", "id", "FOLLOWS"), edge(cc, "id", "entity", "MENTIONS"), edge(ent.withColumn("run", run0), "id", "run", "EXTRACTED_BY"), edge(rel, "entity", "other", "RELATES_TO")]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    edges = edges.select(F.pmod(F.xxhash64("src", "edge_type", "dst"), F.lit(1 << 53)).alias("seq"), "src", "edge_type", "dst", F.lit(0).cast("long").alias("created_at"), F.lit(None).cast(f"map<string,{G.PV}>").alias("properties"))
    vectors = c.select(F.lit(NS).alias("namespace"), F.col("id").alias("node_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"))
    return G.Graph(nodes, edges, vectors, spark.createDataFrame([], "node_id string, lsn long"))


#: The same in DuckDB.
SQL = """WITH RECURSIVE nd AS (SELECT count(*) AS n FROM documents),
doc AS (SELECT doc_id, 'doc:' || lpad(doc_id::VARCHAR, 10, '0') AS id, 'mem:///' || source || '/' || lang AS uri, 'doc ' || doc_id AS title, doc_id AS created_at, lang, text,
  row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS version, lag('doc:' || lpad(doc_id::VARCHAR, 10, '0')) OVER (PARTITION BY source, lang ORDER BY doc_id) AS prev FROM documents),
chk AS (SELECT 'chk:' || lpad(vec_id::VARCHAR, 10, '0') AS id, doc.id AS document_id, (vec_id % 5)::INT AS chunk_index, vec_id, label, embedding::DOUBLE[] AS v, doc.lang, doc.text
  FROM embeddings JOIN nd ON true JOIN doc ON doc.doc_id = nd.n - 1 - vec_id // 5),
ent AS (SELECT DISTINCT label, 'ent:' || lpad(label::VARCHAR, 10, '0') AS id, 'label ' || label AS name FROM embeddings),
nxt AS (SELECT id, lead(id) OVER (PARTITION BY document_id ORDER BY chunk_index) AS nx FROM chk),
edg AS (SELECT id AS src, prev AS dst, 'SUPERSEDES' AS t FROM doc WHERE prev IS NOT NULL UNION ALL SELECT id, document_id, 'PART_OF' FROM chk UNION ALL SELECT id, document_id, 'DERIVED_FROM' FROM chk
  UNION ALL SELECT id, 'run:0', 'EMBEDDED_BY' FROM chk UNION ALL SELECT id, nx, 'PRECEDES' FROM nxt WHERE nx IS NOT NULL UNION ALL SELECT nx, id, 'FOLLOWS' FROM nxt WHERE nx IS NOT NULL
  UNION ALL SELECT c.id, e.id, 'MENTIONS' FROM chk c JOIN ent e USING (label) UNION ALL SELECT id, 'run:0', 'EXTRACTED_BY' FROM ent
  UNION ALL SELECT DISTINCT x.id, y.id, 'RELATES_TO' FROM (SELECT DISTINCT document_id, label FROM chk) a JOIN (SELECT DISTINCT document_id, label FROM chk) b ON a.document_id = b.document_id AND a.label < b.label JOIN ent x ON x.label = a.label JOIN ent y ON y.label = b.label),
sup AS (SELECT DISTINCT dst AS id FROM edg WHERE t = 'SUPERSEDES'),
typ(t, code) AS (VALUES ('PART_OF', 1), ('PRECEDES', 2), ('FOLLOWS', 3), ('SUPERSEDES', 4), ('MENTIONS', 5), ('RELATES_TO', 6), ('SIMILAR_TO', 7), ('DERIVED_FROM', 8), ('EMBEDDED_BY', 9), ('EXTRACTED_BY', 10)),
adj AS (SELECT src AS a, dst AS b, t, 0 AS d FROM edg UNION ALL SELECT dst, src, t, 1 FROM edg),
node AS (SELECT id, 'Document' AS kind FROM doc UNION ALL SELECT id, 'Chunk' FROM chk UNION ALL SELECT id, 'Entity' FROM ent UNION ALL SELECT 'run:0', 'PipelineRun')"""
