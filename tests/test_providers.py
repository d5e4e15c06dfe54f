"""Embedders and extractors behind their interfaces."""

import pytest
from pyspark.sql import functions as F

from tessera.client import Client, SearchOptions
from tessera.functions import providers as R
from tessera.functions import text as T
from tessera.operators.ingest import IngestConfig

NOTE = "# Harbour\n\nMarta Olsen runs Harbour Bakery Ltd. Marta Olsen bakes in Oslo."


def test_specs():
    assert R.parse_embedder("hash").dim == 256 and R.parse_embedder(" HASH:32 ").namespace == "hash-bow-v1-32:32"
    for bad in ("hash:x", "hash:", "hash:0", "local", "openai:some", "what"):
        with pytest.raises(R.ProviderError):
            R.parse_embedder(bad)


def test_answers_are_checked_and_batched():
    sizes = []

    def embed(texts):
        sizes.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    assert R.Embedder("m", 2, embed, 3).checked(["a", "bb", "", "ccc"]) == [[1, 1], [2, 1], [0, 1], [3, 1]] and sizes == [3, 1]
    for answer in ([[1.0, 2.0]], [[1.0], [2.0]], [[1.0, float("nan")]] * 2):
        with pytest.raises(R.ProviderError):
            R.Embedder("m", 2, lambda t, a=answer: a).checked(["x", "y"])
    assert R.hashing(16).checked([]) == []


def test_names_of_stopwords_are_no_entities():
    assert [e[1] for e in T.entities("We saw The. They met Marta Olsen, then This.")] == ["marta olsen"]


def test_a_second_model_and_no_extractor(spark, tmp_path):
    c = Client.create(spark, str(tmp_path / "s"), IngestConfig(dim=16, extractor="none"))
    c.ingest_text("mem:///h", "Harbour", NOTE)
    assert c.graph.live("Entity").count() == 0
    length = R.Embedder("length", 2, lambda texts: [[float(len(t)), 1.0] for t in texts])
    c.embed_again(length)
    c.embed_again(length)
    n = c.graph.live("Chunk").count()
    assert c.graph.vectors.filter("namespace = 'length:2'").count() == n
    with pytest.raises(LookupError):
        c.search_vector([1.0, 1.0], SearchOptions(model="other"))
    d = Client.open(spark, str(tmp_path / "s"), c.config)
    d.embedder = length
    assert d.search("a text", SearchOptions(top_k=1)).count() == 1
    with pytest.raises(FileExistsError):
        Client.create(spark, str(tmp_path / "s"))
    assert Client.open_or_create(spark, str(tmp_path / "s")).documents().count() == 1


def test_relations_count_within_a_document(spark, tmp_path):
    c = Client.create(spark, str(tmp_path / "s"), IngestConfig(chunker="sentence:60:0", dim=16, dedup=False))
    both = "Marta Olsen met Harbour Bakery Ltd today. Marta Olsen sold Harbour Bakery Ltd again. "
    from tessera.sources import files

    c._ingest(files.from_texts(spark, [("mem:///a", "a", both), ("mem:///b", "b", both + both)]))
    e = c.graph.edges.filter("edge_type = 'RELATES_TO'").select(F.col("properties")["co_occurrences"]["num"].alias("n"), F.col("properties")["confidence"]["num"].alias("c")).collect()
    chunks = c.graph.live("Chunk").groupBy("document_id").count().agg(F.min("count")).first()[0]
    assert [(r.n, r.c) for r in e] == [(chunks, 0.3)]
