"""The one API over a store: ingest, search, traverse, documents, history, export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions.providers import Embedder, Extractor, hashing
from .operators import graph as G
from .operators import vector as V
from .operators.ann import Index
from .operators.ingest import IngestConfig, ingest
from .plans.query import Query
from .sources import files
from .store import Store


@dataclass(frozen=True)
class Expansion:
    edge_types: tuple[str, ...] = ("MENTIONS", "RELATES_TO")
    max_hops: int = 1
    direction: str = "both"
    limit: int | None = None

    @staticmethod
    def from_json(data: dict) -> Expansion:
        """Defaults of the JSON form: all types, outgoing."""
        return Expansion(tuple(data.get("edge_types", ())), data.get("max_hops", 1), data.get("direction", "out"), data.get("limit"))


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 10
    latest_only: bool = True
    model: str | None = None
    filter: P.Predicate | None = None
    expand: Expansion | None = None


@dataclass
class Client:
    store: Store
    config: IngestConfig = field(default_factory=IngestConfig)
    embedder: Embedder | None = None
    extractor: Extractor | None = None

    @classmethod
    def create(cls, spark: SparkSession, root: str, config: IngestConfig = IngestConfig()) -> Client:
        return cls(Store(spark, root, create=True), config)

    @classmethod
    def open(cls, spark: SparkSession, root: str, config: IngestConfig = IngestConfig()) -> Client:
        return cls(Store(spark, root), config)

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, config: IngestConfig = IngestConfig()) -> Client:
        return cls(Store(spark, root, create=not Store.exists(root)), config)

    @property
    def graph(self) -> G.Graph:
        return self.store.graph()

    def _ingest(self, sources: DataFrame) -> DataFrame:
        """Entities are rewritten with their new totals; all else is appended."""
        b = ingest(self.graph, sources, self.config, embedder=self.embedder, extractor=self.extractor)
        report = G.cut(b.report)
        self.store.commit(append={"edges": b.edges, "vectors": b.vectors}, replace={"nodes": self._upserted(b.nodes)})
        return report

    def _upserted(self, nodes: DataFrame) -> DataFrame:
        nodes = G.cut(nodes)
        return self.graph.nodes.join(nodes.select("id"), "id", "left_anti").unionByName(nodes)

    def ingest(self, path: str, recursive: bool = True) -> DataFrame:
        return self._ingest(files.read_documents(self.store.spark, path, recursive))

    def ingest_text(self, uri: str, title: str, text: str) -> DataFrame:
        return self._ingest(files.from_texts(self.store.spark, [(uri, title, text)]))

    def embed_again(self, embedder: Embedder) -> int:
        """Vectors of another model for all stored chunks that lack them, under a namespace of its own."""
        g = self.graph
        have = g.vectors.filter(F.col("namespace") == embedder.namespace).select(F.col("node_id").alias("id"))
        rows = g.live("Chunk").join(have, "id", "left_anti")
        return self.store.commit(append={"vectors": rows.select(F.lit(embedder.namespace).alias("namespace"), F.col("id").alias("node_id"), embedder.column(F.col("text")).alias("vector"), F.xxhash64("id").alias("seq"))})

    def index(self, root: str, model: str | None = None, metric: str = "cosine") -> Index:
        """An approximate index of one namespace."""
        ns, _ = V.resolve_namespace(self.graph.vectors, model)
        return Index.build(self.graph.vectors.filter(F.col("namespace") == ns).join(self.graph.hidden("node_id"), "node_id", "left_anti"), root, metric)

    def search(self, text: str, options: SearchOptions = SearchOptions()) -> DataFrame:
        """By a vector of the model that the chunks were embedded with."""
        return self.search_vector((self.embedder or hashing(self.config.dim)).one(text), options)

    def search_vector(self, vector, options: SearchOptions = SearchOptions()) -> DataFrame:
        """Nearest chunks, then the filters, then the expansion with its start rows."""
        q = Query().search(vector, options.top_k, options.model or (self.embedder or self.config).namespace)
        if options.filter is not None:
            q = q.filter(options.filter)
        if options.latest_only:
            q = q.latest()
        if (x := options.expand) is not None:
            q = q.traverse(x.edge_types, x.max_hops, x.direction, x.limit, include_start=True)
            q = q.latest() if options.latest_only else q
        return q.run(self.graph)

    def query(self, query: Query | dict) -> DataFrame:
        return (query if isinstance(query, Query) else Query.from_json(query)).run(self.graph)

    def traverse(self, ids, edge_types=(), max_hops: int = 1, direction: str = "both") -> DataFrame:
        return Query().seed(*ids).traverse(edge_types, max_hops, direction).run(self.graph)

    def get(self, node_id: str) -> DataFrame:
        return self.graph.live().filter(F.col("id") == node_id)

    def show(self, ref: str) -> tuple[DataFrame, DataFrame]:
        node_id = G.resolve_id(self.graph, ref)
        return self.graph.nodes.filter(F.col("id") == node_id), G.node_detail(self.graph, node_id)

    def neighbours(self, node_id: str, edge_types=(), direction: str = "both") -> DataFrame:
        return G.neighbours(self.graph, node_id, edge_types, direction)

    def history(self, node_id: str) -> DataFrame:
        return G.history(self.graph, node_id)

    def document_by_uri(self, uri: str) -> DataFrame:
        return G.uri_heads(self.graph).filter(F.col("source_uri") == uri)

    def documents(self, latest_only: bool = True) -> DataFrame:
        return G.documents(self.graph, latest_only)

    def chunks_of(self, document_id: str) -> DataFrame:
        return G.chunks_of(self.graph, document_id)

    def stats(self) -> DataFrame:
        return G.stats(self.graph)

    def compact(self) -> int:
        return self.store.compact()

    def export(self, path: str, form: str = "jsonl") -> None:
        """JSON lines in order, spread over as many files as there are ranges."""
        if form not in ("jsonl", "ndjson"):
            raise ValueError(f"unknown export format: {form!r}")
        G.export_lines(self.graph).orderBy("rank", "key").select("line").write.text(path)
