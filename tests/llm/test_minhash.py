import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash as M
from tessera.llm import queries
from tessera.llm.common import Hasher, Scratch, connected_components, link_groups

from ..compare import DATA, spark_rows, sql_rows

CFG = M.NearDupConfig(shingle=3, num=85, den=100)


def components(texts, k, num, den):
    """{id: (size, least id)} by comparing all pairs of word shingle sets."""
    words = {i: [w for w in _split(t or "")] for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def test_query_equals_sql(spark):
    assert spark_rows(queries.op1_minhash(spark, DATA)) == sql_rows(queries.OP1_SQL)


def test_edge_cases_equal_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(120))
    texts = {1: base, 2: base + " tail", 3: base.upper(), 4: None, 5: "", 6: " \t\n", 7: "one", 8: "One", 9: "one two", 10: "x " * 3000, 11: base.replace("w60", "z"), 12: "É é", 13: "é é", 14: "a\x0bb c", 15: "a b c"}
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in texts.items()], "doc_id long, text string, key string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df, CFG).collect()}
    assert got == components(texts, 3, 85, 100)


def test_repeats_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (1, "other words stand here today"), (2, text), (None, text), (None, None)], "doc_id long, text string")
    rows = M.near_duplicates(df, CFG).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(1, 1, True), (2, 1, False), (None, None, True)}
    left = M.drop_near_duplicates(df.withColumn("more", F.lit(1)), CFG).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, text), (1, "other words stand here today"), (0, text), (0, "")])
    assert M.near_duplicates(df.limit(0), CFG).count() == 0


def test_groups_without_one_centre(spark):
    """Chains: neighbours are alike, ends aren't, and no member is alike to all."""
    texts = {}
    for i in range(60):
        words = [f"w{j}" for j in range(100)]
        for j in range(i):
            words[(j * 7) % 100] = f"v{j}"
        texts[i] = " ".join(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), CFG).collect()}
    assert got == components(texts, 3, 85, 100)


def test_sketch_bounds_the_difference():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, b = (np.unique(r.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: r.integers(0, 400)], b[:50]]))
        differ = sum(int(x).bit_count() for x in (M.parity_sketch(a) ^ M.parity_sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_signature_is_circulant():
    cfg = M.NearDupConfig(dim_bits=10)
    t = M.circulant_table(cfg)
    assert t.shape == (1024, 120) and all((t[i, 1:5] == t[i + 1, :4]).all() for i in range(1000))
    s = Hasher().shingles("some words that make a signature here", 2)
    assert len(M.signature(s, t, cfg)) == 120


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(1, i) for i in range(2, 40)], [(i, i + 1) for i in range(40)], [(7, 7)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_large_cells_of_several_components(spark, monkeypatch):
    """Copies of one text, alike in part only: few pivots, and cells that count as large, lose no link."""
    import functools
    import random

    r, texts = random.Random(3), {}
    for i in range(120):
        words = [f"w{j}" for j in range(100)]
        for _ in range(r.randint(1, 3)):
            words[r.randrange(100)] = f"v{r.randrange(10**6)}"
        texts[i] = " ".join(words)
    want = components(texts, 3, 85, 100)
    assert 1 < len({v[1] for v in want.values()}) < 120
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(M, "link_groups", functools.partial(M.link_groups, large=4, pivots=1))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in M.near_duplicates(df, CFG).collect()} == want


def test_columns_with_clashing_names_pass(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7), (1, "a b c d e f", 5, 6, 7), (2, None, 1, 2, 3)], "doc_id long, text string, kept_rows int, kept_hash int, KEPT_DOC int")
    got = M.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.kept_hash) for r in got.collect()) == [(1, 6), (2, 2)]


def test_pairs_that_share_one_cell_of_many_keys_are_linked(spark):
    """One cell with more keys than pivots see and than a block holds shows the links; or half of what they need, the rest being in a small cell."""
    df = spark.range(300).withColumnRenamed("id", "key").withColumn("h", F.xxhash64("key"))
    traits = df.withColumn("pair", F.expr("key div 2"))
    verify = lambda pairs: pairs.filter("a div 2 = b div 2")
    may = lambda a, b: F.col(f"{a}_pair") == F.col(f"{b}_pair")
    even, odd = (df.select(F.lit(c).cast("long").alias("cell"), "h") for c in (8, 7))
    for need, cells in ((1, odd), (2, even.unionByName(df.select(F.expr("1000 + 2 * (key div 2)").alias("cell"), "h")))):
        got = {r.node: r.label for r in link_groups(cells, verify, Scratch(spark, "t"), traits, may, need=need, large=100).collect()}
        assert got == {i: i // 2 * 2 for i in range(300)}


def test_each_pair_with_a_pivot_is_made_once(spark, monkeypatch):
    """Keys that share twenty large cells meet a pivot once, not once a cell."""
    made, save = [], Scratch.save

    def watched(self, df, name):
        if name.startswith("pairs-") and name != "pairs-0":
            df.collect()
            nodes = [df._jdf.queryExecution().executedPlan()]
            for node in nodes:
                nodes.extend(node.children().apply(i) for i in range(node.children().size()))
                if node.nodeName() == "Generate":
                    made.append(node.metrics().apply("numOutputRows").value())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(200).withColumnRenamed("id", "key").withColumn("h", F.xxhash64("key"))
        cells = df.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("cell"), "h")
        got = link_groups(cells, lambda pairs: pairs.filter("a div 10 = b div 10"), Scratch(spark, "t"), df, lambda a, b: F.lit(True)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.node: r.label for r in got} == {i: i // 10 * 10 for i in range(200)}
    # pivots are the same in all cells: 2, then 6 a key at most
    assert len(made) == 2 and made[0] <= 2 * 200 and made[1] <= 6 * 200, made
