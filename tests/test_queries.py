"""Every registered query of the graph and vector engine against its SQL, or against plain rules of its own."""

import difflib
import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera import fixture as X
from tessera import registry

from .compare import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, DATA)) == sql_rows(registry.ORACLE_SQL[name])


def rows(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def texts(spark):
    return {r.doc_id: r.text for r in X.table(spark, DATA, "documents").select("doc_id", "text").collect()}


def pieces_of(spark, name):
    out = {}
    for r in rows(spark, name):
        out.setdefault(r.doc_id, {})[r.chunk_index] = r.piece
    return {d: [p[i] for i in range(len(p))] for d, p in out.items()}


def test_chunk_recursive(spark):
    """Pieces stand in the text in order, are within size and overlap, and leave out white space alone."""
    got, whole = pieces_of(spark, "chunk_recursive"), texts(spark)
    assert set(got) == {d for d, t in whole.items() if t and t.strip()}
    for d, pieces in got.items():
        seen, at = set(), 0
        for p in pieces:
            assert p == p.strip() and 0 < len(p) <= 550
            start = whole[d].find(p, max(0, at - 60))
            assert start >= 0
            seen.update(range(start, start + len(p)))
            at = start + len(p)
        assert all(c.isspace() for i, c in enumerate(whole[d]) if i not in seen)


def test_chunk_sentence(spark):
    """Each piece is a stretch of the text's words that begins within or right after the one before, and they reach to the end."""
    got, whole = pieces_of(spark, "chunk_sentence"), texts(spark)
    for d, pieces in got.items():
        words, ends, last = whole[d].split(), {0}, 0
        for p in pieces:
            w = p.split()
            ends = {s + len(w) for e in ends for s in range(max(0, e - last), e + 1) if words[s : s + len(w)] == w}
            last = len(w)
        assert len(words) in ends
    assert set(got) == {d for d, t in whole.items() if t and t.strip()}


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_text(spark):
    html = {r.page_id: r.html for r in X.table(spark, DATA, "pages").collect()}
    got = {r.page_id: r.text for r in rows(spark, "html_text")}
    assert set(got) == set(html)
    same = 0
    for i, h in html.items():
        p = Plain()
        p.feed(h or "")
        p.close()
        assert "<script" not in (got[i] or "") and all(x and x == x.strip() for x in (got[i] or "x").split("\n"))
        same += "".join(unescape(got[i] or "").split()) == "".join("".join(p.out).split())
    assert same >= 0.9 * len(html)  # broken tags may differ


def test_hash_embedding(spark):
    def fnv(b):
        h = 14695981039346656037
        for x in b:
            h = ((h ^ x) * 1099511628211) % 2**64
        return h

    whole = texts(spark)
    for r in rows(spark, "hash_embedding")[:40]:
        words = [w.lower() for w in re.findall(r"[^\W_]+", whole[r.doc_id] or "")]
        v = np.zeros(64)
        for term, n in (Counter(words) + Counter()).items():
            h = fnv(term.encode())
            g = fnv(h.to_bytes(8, "little"))
            v[h % 64] += n * (-1 if h >> 32 & 1 else 1)
            v[g % 64] += n * 0.5 * (-1 if g >> 32 & 1 else 1)
        for term, n in Counter(map(" ".join, zip(words, words[1:], strict=False))).items():
            h = fnv(term.encode())
            g = fnv(h.to_bytes(8, "little"))
            v[h % 64] += n * 0.5 * (-1 if h >> 32 & 1 else 1)
            v[g % 64] += n * 0.25 * (-1 if g >> 32 & 1 else 1)
        size = np.linalg.norm(v)
        assert np.allclose(r.embedding, v / size if size else v, atol=1e-5)


def test_entities_totals_and_aliases(spark):
    found, whole = rows(spark, "entities"), texts(spark)
    assert found
    for r in found:
        assert r.mentions >= 1 and 0 < r.confidence <= 1 and r.norm and r.norm not in ("the", "and", "of")
        assert set(re.findall(r"\w+", r.name)) <= set(re.findall(r"\w+", whole[int(r.id)]))
    total = {}
    for r in found:
        t = total.setdefault(f"{r.norm}|{r.entity_type}", [0, "", 0.0])
        t[0], t[1], t[2] = t[0] + r.mentions, max(t[1], r.name, key=lambda n: (len(n.encode()), n)), max(t[2], r.confidence)
    assert {r.entity: (r.mentions, r.name, r.confidence) for r in rows(spark, "entity_totals")} == {k: tuple(v) for k, v in total.items()}
    names = {(r.norm, r.entity_type) for r in found}
    for r in rows(spark, "aliases"):
        assert r.id != r.head and r.similarity >= 0.92
        assert tuple(r.id.split("|")) in names and r.id.split("|")[1] == r.head.split("|")[1]


def test_projection_pca(spark):
    """The plane of numpy's two first components, up to turning and scale."""
    v = {r.node_id: np.array(r.vector, float) for r in X.graph(spark, DATA).vectors.select("node_id", "vector").collect()}
    got = {r.id: (r.x, r.y) for r in rows(spark, "projection_pca")}
    ids = sorted(v)
    m = np.stack([v[i] for i in ids])
    m = m - m.mean(axis=0)
    u = m @ np.linalg.svd(m, full_matrices=False)[2][:2].T
    xy = np.array([got[i] for i in ids])
    assert abs(xy).max() <= 1 + 1e-9
    assert abs(np.corrcoef(u[:, 0], xy[:, 0])[0, 1]) > 0.99 and abs(np.corrcoef(u[:, 1], xy[:, 1])[0, 1]) > 0.95


def test_chunk_diff(spark):
    """What is kept and removed is the old text, what is kept and added the new; and no shorter script is known."""
    df = registry.QUERIES["chunk_diff"](spark, DATA)
    whole = {f"doc:{d:010d}": (t or "").split("\n") for d, t in texts(spark).items()}
    by = {}
    for r in df.collect():
        by.setdefault((r.src, r.dst), []).append(r)
    assert by
    for (src, dst), ops in by.items():
        ops = sorted(ops, key=lambda r: r.pos)
        assert [r.text for r in ops if r.op != "added"] == whole[dst] and [r.text for r in ops if r.op != "removed"] == whole[src]
        kept = sum(r.op == "same" for r in ops)
        assert kept >= sum(b.size for b in difflib.SequenceMatcher(None, whole[dst], whole[src], autojunk=False).get_matching_blocks())


def test_ingest_report(spark):
    docs = X.table(spark, DATA, "documents").select("doc_id", "text", "source", "lang").collect()
    by = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        by.setdefault((r.source, r.lang), []).append(r.text)
    want = Counter()
    for versions in by.values():
        before, first = None, True
        for t in versions:
            if t == before:
                want["unchanged"] += 1
            elif not (t or "").strip():
                want["skipped"] += 1
            else:
                want["created" if first else "superseded"] += 1
                first = False
            before = t
    assert {r.outcome: r.n for r in rows(spark, "ingest_report")} == dict(want)


def test_no_query_is_without_a_test():
    here = {"chunk_recursive", "chunk_sentence", "html_text", "hash_embedding", "entities", "entity_totals", "aliases", "projection_pca", "chunk_diff", "ingest_report"}
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == here


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
