from tessera.llm import mixing, queries

from ..compare import DATA, spark_rows, sql_rows


def test_query_equals_sql(spark):
    assert spark_rows(queries.op6_mixing(spark, DATA)) == sql_rows(queries.OP6_SQL)


def fill(sizes, weights, share, cap):
    """Targets by filling up, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, pool = {}, set(names), share * sum(sizes.values())
    while open_:
        level = pool / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            out |= {s: w[s] * level for s in open_}
            break
        out |= {s: cap * sizes[s] for s in full}
        pool -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_targets_budgets_and_edges(spark):
    rows = [(i, "w " * (i % 37), s) for i in range(300) for s in [["web", "books", "code", None, "Wiki"][i % 7 % 5]]]
    rows += [(400, None, "empty"), (401, "", "empty"), (None, "two words", "web"), (5, "a\tb\x0bc", "books"), (5, "a\tb\x0bc", "books"), (402, "x " * 20000, "code")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df, mixing.MixConfig(slice_rows=20)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = fill(sizes, (5, 2, 1), 1.5, 2)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert sum(r.taken for r in mine) == round(mine[0].target)
    assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == len(rows)
    again = mixing.mix_sources(df.repartition(9), mixing.MixConfig(slice_rows=1000)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0
