import random

import numpy as np

from tessera.llm import decontaminate as D
from tessera.llm import queries

from ..compare import DATA


def edits(item, text):
    """Least edits between the item and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    t, at = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        new = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (t != c)))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def expected(texts, items, cfg):
    out = {}
    for d, t in texts.items():
        b = D.normalise(t)
        out[d] = sorted(i for i, x in items.items() if (n := D.normalise(x)) and edits(n, b) <= D.budget(len(n), cfg))
    return out


def spoil(r, text, k):
    s = list(text)
    for _ in range(k):
        p = r.randrange(len(s))
        s[p : p + 1] = r.choice([[], [s[p], "q"], ["z"]])
    return "".join(s)


def test_equals_full_alignment(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = {i: text(r.choice([1, 3, 8, 20, 40])) for i in range(25)} | {90: None, 91: "", 92: "ab", 93: "x" * 200}
    docs = {i: text(30) for i in range(20)} | {200: None, 201: "", 202: "x" * 2000, 203: "AB  cd"}
    for i in range(20, 80):
        k = r.randrange(25)
        docs[i] = text(20) + "  " + spoil(r, items[k].upper(), r.randint(0, max(1, int(len(items[k]) * 0.09)))) + "\n" + text(20)
    df = spark.createDataFrame([(i, t, True) for i, t in docs.items()], "doc_id long, text string, leaked boolean")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(None, "abc", 1)], "item_id long, text string, doc_id int")
    cfg = D.LeakConfig()
    want = expected(docs, items, cfg)
    for c in (cfg, D.LeakConfig(block_bytes=900), D.LeakConfig(slice_bytes=37, hits=5)):
        got = {x.doc_id: (x.items, x.leaked) for x in D.benchmark_leaks(df, bench, c).collect()}
        assert {d: v[0] for d, v in got.items()} == want and all(v[1] == bool(v[0]) for v in got.values())
    kept = {x.doc_id for x in D.drop_leaks(df, bench).collect()}
    assert kept == {d for d, v in want.items() if not v}
    assert D.benchmark_leaks(df.limit(0), bench).count() == 0
    assert not any(x.leaked for x in D.benchmark_leaks(df, bench.limit(0)).collect())


def test_query_finds_verbatim_items(spark):
    docs = {x.doc_id: D.normalise(x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = {x.item_id: D.normalise(x.text) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {x.doc_id: x.items for x in queries.op9_decontamination(spark, DATA).collect()}
    assert set(got) == set(docs)
    for d, b in docs.items():
        assert {i for i, x in items.items() if x and x in b} <= set(got[d])


def test_runs_of_one_byte_need_little_memory():
    import tracemalloc

    finder = D.Finder([(1, b"x" * 200), (2, b"y" * 199 + b"z")], D.LeakConfig())
    tracemalloc.start()
    assert finder.find("x" * 300_000) == {1: 0}
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_repeats_over_several_blocks_and_clashing_names(spark):
    items = {i: " ".join(f"{chr(97 + i) * 3}{j}{chr(107 + i)}" for j in range(12)) for i in range(6)}
    docs = [(1, "so " + items[2] + " so", 5), (1, "so " + items[2] + " so", 5), (2, "clean words only", 6), (None, items[4], 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leak_hash int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = sorted((r.doc_id or 0, r.items) for r in D.benchmark_leaks(df, bench, D.LeakConfig(block_bytes=100)).collect())
    assert got == [(0, [4]), (1, [2]), (1, [2]), (2, [])]
    left = D.drop_leaks(df, bench)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(2, "clean words only", 6)]
