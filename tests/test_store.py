"""Ingest into a store, and the client, command line and stream over it."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.client import Client, Expansion, SearchOptions
from tessera.operators.ingest import IngestConfig
from tessera.sources import files
from tessera.store import ConflictError, Store
from tessera.streaming.ingest_stream import ingest_stream

ADA = "# Ada\n\nAda Lovelace worked with Charles Babbage. Charles Babbage designed the Analytical Engine."


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    c = Client.create(spark, str(tmp_path_factory.mktemp("store")), IngestConfig(dim=64))
    assert [r.outcome for r in c.ingest_text("mem:///ada", "Ada", ADA).collect()] == ["created"]
    return c


def test_ingest_versions_and_delete(client):
    assert [r.outcome for r in client.ingest_text("mem:///ada", "Ada", ADA).collect()] == ["unchanged"]
    before = client.graph.nodes.count()
    report = client.ingest_text("mem:///ada", "Ada", ADA + " More text was added.").collect()
    assert [r.outcome for r in report] == ["superseded"] and client.graph.nodes.count() > before
    assert [r.outcome for r in client.ingest_text("mem:///empty", "", "  ").collect()] == ["skipped"]
    docs = client.documents(latest_only=False).orderBy("version").collect()
    assert [(r.version, r.is_latest) for r in docs] == [(1, False), (2, True)]
    assert [r.version for r in client.history(docs[0].id).collect()] == [1, 2]
    assert client.document_by_uri("mem:///ada").first().version == 2
    assert client.graph.edges.groupBy("src", "edge_type", "dst").count().filter("count > 1").count() == 0
    found = client.search("Charles Babbage", SearchOptions(top_k=3, expand=Expansion())).collect()
    assert {r.kind for r in found} >= {"Chunk", "Entity"}
    client.store.delete(docs[1].id)
    assert [r.version for r in client.documents().collect()] == [1]
    client.store.undelete(docs[1].id)
    client.compact()
    assert [r.version for r in client.documents().collect()] == [2]
    assert client.stats().filter("metric = 'nodes' and name = 'Document'").first().value == 2


def test_conflict_and_missing(spark, client, tmp_path):
    a, b = Store(spark, client.store.root), Store(spark, client.store.root)
    a.delete("nobody")
    with pytest.raises(ConflictError):
        b.delete("nobody else")
    client.store = Store(spark, client.store.root)
    with pytest.raises(FileNotFoundError):
        Client.open(spark, str(tmp_path / "none"))


def test_discovery(spark, tmp_path):
    for name, raw in {"b.txt": b"text", "a.md": b"# Head\nbody", "skip.png": b"x", "data.txt": b"a\0b", "bad.txt": b"\xff\xfe", ".hidden/x.md": b"x", "sub/c.html": b"<p>x</p>"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    names = [p.rsplit("/", 1)[1] for p in files.discover(str(tmp_path))]
    assert names == ["a.md", "b.txt", "bad.txt", "data.txt", "c.html"]
    assert len(files.discover(str(tmp_path), recursive=False)) == 4
    rows = {r.source_uri.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.md"].title == "Head" and rows["c.html"].text == "x"
    assert rows["data.txt"].skipped and rows["bad.txt"].text is None
    with pytest.raises(FileNotFoundError):
        files.discover(str(tmp_path / "none"))


def test_command_line_and_export(spark, client, tmp_path, capsys):
    root = ["--store", client.store.root, "--json"]
    assert cli.main([*root, "docs"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["title"] == "Ada"
    assert cli.main([*root, "stats"], spark) == 0
    assert cli.main([*root, "export", str(tmp_path / "out")], spark) == 0
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {x["type"] for x in lines} == {"header", "node", "edge", "vector"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.md").write_text("# One\nAda Lovelace wrote.")
    c = Client.create(spark, str(tmp_path / "store"), IngestConfig(dim=16))
    ingest_stream(c, str(tmp_path / "in"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert c.documents().select(F.col("title")).first()[0] == "One"
