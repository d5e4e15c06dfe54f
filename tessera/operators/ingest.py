"""Batch ingest: sources to documents, chunks, vectors, entities and edges, set at a time."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.providers import Embedder, Extractor, hashing, rule_extractor
from ..functions.ids import config_hash, content_hash, derived_id, new_id
from ..functions.text import Chunker
from . import graph as G

PIPELINE = "1"

#: Fixed value: the confidence of a relation between names that one chunk mentions.
CO_OCCURS = 0.3


@dataclass(frozen=True)
class IngestConfig:
    chunker: str = "recursive"
    dim: int = 256
    extractor: str = "rule"
    min_mentions: int = 1
    dedup: bool = True
    threshold: float = 0.92
    across_types: bool = False
    skip_unchanged: bool = True

    @property
    def model(self) -> str:
        return f"hash-bow-v1-{self.dim}"

    @property
    def namespace(self) -> str:
        return f"{self.model}:{self.dim}"


@dataclass(frozen=True)
class Batch:
    """New rows of each table, to be appended; ``report`` has one row a source."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    report: DataFrame


def meta(**cols):
    """A metadata map of integer and float columns."""
    items = []
    for k, c in cols.items():
        tag = "i:" if k.startswith(("mention", "co_", "version", "from_", "to_")) else "f:"
        items += [F.lit(k), F.struct(F.concat(F.lit(tag), c.cast("string")).alias("tok"), c.cast("double").alias("num"), F.lit(None).cast("string").alias("txt"), F.lit(None).cast("array<string>").alias("items"))]
    return F.create_map(*items)


def text_meta(key: str, value: str):
    return F.create_map(F.lit(key), F.struct(F.lit(f"s:{value}").alias("tok"), F.lit(None).cast("double").alias("num"), F.lit(value).alias("txt"), F.lit(None).cast("array<string>").alias("items")))


def ingest(g: G.Graph, sources: DataFrame, cfg: IngestConfig = IngestConfig(), now: int | None = None, embedder: Embedder | None = None, extractor: Extractor | None = None) -> Batch:
    """``sources`` is (source_uri, title, text, skipped). Texts of one uri in one batch follow one another by title and text;
    a text equal to the newest version's is unchanged. An ``embedder`` or ``extractor`` of one's own replaces the configured one. Edges are unique in (src, type, dst): the first written stays."""
    now = int(time.time() * 1000) if now is None else now
    chunker, run = Chunker.parse(cfg.chunker), new_id()
    embedder = embedder or hashing(cfg.dim)
    if extractor is None and cfg.extractor not in ("rule", "none"):
        raise ValueError(f"unknown extractor: {cfg.extractor!r}")
    extractor = extractor or (rule_extractor(cfg.min_mentions) if cfg.extractor == "rule" else None)
    src = sources.withColumn("content_hash", content_hash(F.col("text"))).withColumn("pieces", udfs.chunks(F.col("text"), chunker))
    heads = g.live("Document").groupBy("source_uri").agg(F.max_by(F.struct("id", "version", "content_hash"), F.struct("version", "id")).alias("head"))
    src = src.join(heads, "source_uri", "left")
    by_uri = Window.partitionBy("source_uri").orderBy("title", "text")
    src = src.withColumn("prior", F.coalesce(F.lag("content_hash").over(by_uri), "head.content_hash"))
    state = F.when(F.col("skipped").isNotNull(), F.col("skipped")).when(F.lit(cfg.skip_unchanged) & (F.col("content_hash") == F.col("prior")), "unchanged").when(F.size("pieces") <= 0, "document has no text content")
    src = src.withColumn("state", state)
    fresh = src.filter("state is null").withColumn("step", F.row_number().over(by_uri)).withColumn("version", (F.coalesce("head.version", F.lit(0)) + F.col("step")).cast("int"))
    fresh = fresh.withColumn("id", derived_id("document", F.col("source_uri"), F.col("content_hash"), F.col("version").cast("string"), F.lit(run)))
    docs = G.cut(fresh.withColumn("supersedes_id", F.coalesce(F.lag("id").over(by_uri), "head.id")).withColumn("run_id", F.lit(run)).withColumn("created_at", F.lit(now)))

    pieces = docs.select(F.col("id").alias("document_id"), F.posexplode("pieces").alias("chunk_index", "text"))
    pieces = pieces.withColumn("id", derived_id("chunk", F.col("document_id"), F.col("chunk_index").cast("string")))
    chunks = G.cut(pieces.withColumn("token_count", udfs.token_estimate(F.col("text"))).withColumn("embeddings", F.array(F.struct(F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), F.lit(run).alias("run_id"), F.lit(now).alias("embedded_at")))).withColumn("created_at", F.lit(now)))
    vectors = chunks.select(F.lit(embedder.namespace).alias("namespace"), F.col("id").alias("node_id"), embedder.column(F.col("text")).alias("vector"), F.xxhash64("id").alias("seq"))

    edge = lambda df, a, b, kind, props=None: df.select(F.col(a).alias("src"), (b if not isinstance(b, str) else F.col(b)).alias("dst"), F.lit(kind).alias("edge_type"), (props if props is not None else F.lit(None).cast(f"map<string,{G.PV}>")).alias("properties"))
    linked = G.following(chunks, "document_id", "chunk_index", "id")
    edges = [edge(docs.filter("supersedes_id is not null"), "id", "supersedes_id", "SUPERSEDES", meta(from_version=F.col("version") - 1, to_version=F.col("version"))), edge(chunks, "id", "document_id", "PART_OF"), edge(chunks, "id", "document_id", "DERIVED_FROM"), edge(chunks, "id", F.lit(run), "EMBEDDED_BY"), edge(linked, "src", "dst", "PRECEDES"), edge(linked, "dst", F.col("src"), "FOLLOWS")]

    spark = docs.sparkSession
    runs = spark.createDataFrame([(run, PIPELINE, embedder.model, now, config_hash(**(asdict(cfg) | {"extractor": extractor.name if extractor else "none", "model": embedder.namespace}), pipeline=PIPELINE), chunker.name, now)], "id string, pipeline_version string, embedding_model string, run_at long, config_hash string, chunker string, created_at long")
    nodes = [G.as_nodes(docs, "Document"), G.as_nodes(chunks, "Chunk"), G.as_nodes(runs, "PipelineRun")]
    if extractor is not None:
        found = chunks.select("id", "document_id", F.explode(extractor.column(F.col("text"))).alias("e")).select("id", "document_id", "e.*")
        found = G.cut(found.withColumn("entity", derived_id("entity", F.concat_ws("|", "norm", F.lower("entity_type")))))
        new = entity_totals(found)
        old = g.live("Entity").select(F.col("id").alias("entity"), F.col("name").alias("_name"), F.col("created_at").alias("_at"), F.col("canonical_id").alias("_head"), F.col("metadata")["mentions"]["num"].alias("_n"))
        merged = new.join(old, "entity", "left").select(F.col("entity").alias("id"), "name", "entity_type", F.coalesce("_at", F.lit(now)).alias("created_at"), F.col("_head").alias("canonical_id"), meta(mentions=(F.col("mentions") + F.coalesce("_n", F.lit(0.0))).cast("long"), confidence=F.col("confidence")).alias("metadata"))
        placed = docs.select(F.col("id").alias("document_id"), F.struct("source_uri", "version").alias("place"))
        # as if the documents were written one after another: each counts its own chunks, and of an edge the first write stays
        pairs = cooccurrences(found, "document_id").join(placed, "document_id").groupBy("a", "b").agg(F.min_by("n", "place").alias("n"))
        edges += [edge(found, "id", "entity", "MENTIONS", meta(mentions=F.col("mentions"), confidence=F.col("confidence"))), edge(merged, "id", F.lit(run), "EXTRACTED_BY"), edge(pairs, "a", "b", "RELATES_TO", F.map_concat(text_meta("relation_type", "co_occurs_with"), meta(confidence=F.lit(CO_OCCURS), co_occurrences=F.col("n"))))]
        if cfg.dedup:
            alias = aliases(found, cfg.threshold, cfg.across_types)
            edges.append(edge(alias, "id", "head", "RELATES_TO", F.map_concat(text_meta("relation_type", "alias_of"), meta(similarity=F.col("similarity")))))
            best = alias.groupBy("id").agg(F.max_by("head", F.struct("similarity", "head")).alias("head"))
            merged = merged.join(best, "id", "left").withColumn("canonical_id", F.coalesce("head", "canonical_id")).drop("head")
        nodes.append(G.as_nodes(merged, "Entity"))
    out = nodes[0]
    for n in nodes[1:]:
        out = out.unionByName(n)
    wanted = edges[0].withColumn("_at", F.lit(0))
    for k, e in enumerate(edges[1:], 1):
        wanted = wanted.unionByName(e.withColumn("_at", F.lit(k)))
    same = ["src", "edge_type", "dst"]
    first = G.first_writes(wanted, "_at", "properties").join(g.edges.select(*same), same, "left_anti")
    last = g.edges.agg(F.max("seq")).first()[0] or 0
    # order, not density, is what sequence numbers are for: the batch's are its rank and a hash
    seq = F.lit(last + 1) + F.col("_at").cast("long") * (1 << 40) + F.pmod(F.xxhash64(*same), F.lit(1 << 40))
    final = first.select(seq.alias("seq"), *same, F.lit(now).alias("created_at"), "properties")
    outcome = F.when(F.col("state") == "unchanged", "unchanged").when(F.col("state").isNotNull(), "skipped").when(F.col("supersedes_id").isNotNull(), "superseded").otherwise("created")
    report = src.join(docs.select("source_uri", "title", "content_hash", F.col("id").alias("document_id"), "supersedes_id"), ["source_uri", "title", "content_hash"], "left").select("source_uri", outcome.alias("outcome"), F.when(outcome == "skipped", F.col("state")).alias("reason"), F.when(F.col("state").isNull(), F.size("pieces")).otherwise(0).alias("chunks"), "document_id")
    return Batch(out, final, vectors, report)


def entity_totals(found: DataFrame) -> DataFrame:
    """Mentions, the longest name and the best confidence of each entity."""
    return found.groupBy("entity").agg(F.sum("mentions").alias("mentions"), F.max_by("name", F.struct(F.octet_length("name"), "name")).alias("name"), F.first("entity_type").alias("entity_type"), F.max("confidence").alias("confidence"))


def cooccurrences(found: DataFrame, *by: str) -> DataFrame:
    """(*by, a, b, n): pairs of entities, and how many chunks mention both. A chunk's entities are few: pairs stay within it."""
    m = found.groupBy("id", *by).agg(F.sort_array(F.collect_set("entity")).alias("e"))
    pair = m.select(*by, F.posexplode("e").alias("k", "a"), "e").select(*by, "a", F.explode(F.slice("e", F.col("k") + 2, F.size("e"))).alias("b"))
    return pair.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def aliases(found: DataFrame, threshold: float = 0.92, across_types: bool = False) -> DataFrame:
    """(id, head, similarity) within each document."""
    dealt = found.select("document_id", "entity", "name", "entity_type", "mentions")
    dealt = dealt.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id")  # both aggregates keep to it; few bytes, much work: not to be coalesced
    rows = dealt.groupBy("document_id", "entity").agg(F.max_by("name", F.struct(F.octet_length("name"), "name")).alias("name"), F.first("entity_type").alias("entity_type"), F.sum("mentions").alias("mentions"))
    # an array of a document's entities, many documents in a batch, instead of a frame for each
    whole = rows.groupBy("document_id").agg(F.collect_list(F.struct("entity", "name", "entity_type", "mentions")).alias("rows"))
    return whole.select(F.explode(udfs.aliases(F.col("rows"), threshold, across_types)).alias("x")).select("x.id", "x.head", "x.similarity")
