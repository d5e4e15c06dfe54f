from pyspark.sql import functions as F

from tessera.llm import hosts, queries

from ..compare import DATA, spark_rows, sql_rows

URLS = {1: "https://A.example.COM/en/7/x?q#f", 2: "http://other.com/en/1", 3: "ftp://net/de/8", 4: "x://example.net/de/8", 5: "https://b.example.net/de/81", 6: "https://org", 7: None, 8: "no scheme", 9: "://?x", 10: "http://h.org/es/\nz", 11: "a://b://c/d", 12: "http://notcom/en/", 13: ""}


def test_query_equals_sql(spark):
    assert spark_rows(queries.op8_hosts(spark, DATA)) == sql_rows(queries.OP8_SQL)


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in URLS.items()], "page_id long, url string, rule string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.page_id: r for r in hosts.judge_urls(pages, labels).collect()}
    assert len(got) == len(URLS)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7/x", "example.com/en/7", "allow")
    assert got[2].rule == "com/en/" and got[2].verdict == "block"
    assert got[3].rule == "net/de/" and got[4].rule == got[5].rule == "example.net/de/8"
    assert (got[6].host, got[6].path) == ("org", "") and got[12].rule is None
    assert all((got[i].host, got[i].path) == ("", "") for i in (7, 8, 9, 13))
    assert (got[10].rule, got[10].path) == ("org/es/", "/es/\nz") and (got[11].host, got[11].path) == ("b:", "//c/d")
    assert hosts.judge_urls(pages.limit(0), labels).count() == 0


def beta_below(a, b, limit, steps=400_000):
    """Share of Beta(a, b) up to ``limit``, by the midpoint rule over the sine squared."""
    import numpy as np

    t = (np.arange(steps) + 0.5) * np.pi / 2 / steps
    w = np.exp((2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t)))
    return w[np.sin(t) ** 2 <= limit].sum() / w.sum()


def brute(rows):
    """{host: (mean, below)} from lists of outcomes, level by level."""
    cfg, tally = hosts.ReputationConfig(), {}
    for host, bad in rows:
        n, k = tally.get(host, (0, 0))
        tally[host] = (n + (bad is not None), k + (bad or 0))

    def parents(h):
        parts = h.split(".")
        m = 3 if len(parts) > 2 and parts[-2] in hosts.SECOND and len(parts[-1]) == 2 else 2
        return ".".join(parts[-m:]), ".".join(parts[-(m - 1) :])

    def gathered(f):
        out = {}
        for h, (n, k) in tally.items():
            m, j = out.get(f(h), (0, 0))
            out[f(h)] = (m + n, j + k)
        return out

    def level(units, parent):
        over = sum(n * (k / n - parent[u]) ** 2 - parent[u] * (1 - parent[u]) for u, (n, k) in units.items() if n)
        room = sum((n - 1) * parent[u] * (1 - parent[u]) for u, (n, k) in units.items() if n)
        s = min(1000.0, max(1.0, room / over - 1)) if over > 0 and room > 0 else 1000.0
        return {u: (k + parent[u] * s, n - k + (1 - parent[u]) * s) for u, (n, k) in units.items()}

    n, k = (sum(x[i] for x in tally.values()) for i in (0, 1))
    share = lambda ab: {u: a / (a + b) for u, (a, b) in ab.items()}
    suffixes, domains = gathered(lambda h: parents(h)[1]), gathered(lambda h: parents(h)[0])
    of_suffix = share(level(suffixes, dict.fromkeys(suffixes, (k + 1.0) / (n + 10.0))))
    up = {parents(h)[0]: parents(h)[1] for h in tally}
    of_domain = share(level(domains, {d: of_suffix[up[d]] for d in domains}))
    return {h: (a / (a + b), beta_below(a, b, cfg.limit)) for h, (a, b) in level(tally, {h: of_domain[parents(h)[0]] for h in tally}).items()}


def test_reputation_equals_brute_force(spark):
    rows = [("bad.x.com", 1)] * 60 + [("ok.x.com", 0)] * 60 + [("one.y.com", 1)] + [("new.x.com", None)] + [("q.org", 0)] * 5
    rows += [("a.shop.co.uk", i % 3 == 0) for i in range(30)] + [("b.shop.co.uk", 1)] * 9 + [("c.other.co.uk", 0)] * 20 + [("co.uk", 0), ("", 1), ("localhost", None)]
    rows = [(h, None if b is None else int(b)) for h, b in rows]
    got = {r.host: r for r in hosts.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for h, (mean, below) in want.items():
        assert abs(got[h].mean - mean) < 1e-9 and abs(got[h].below - below) < 0.03
    assert got["bad.x.com"].below < 0.05 < got["one.y.com"].below and got["b.shop.co.uk"].mean > got["c.other.co.uk"].mean
    pages = spark.createDataFrame([(i, "http://bad.z.com/") for i in range(80)] + [(None, "http://bad.z.com/")], "page_id long, url string")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"))
    judged = hosts.judge_urls(pages, labels).collect()
    assert len(judged) == 81 and {r.verdict for r in judged} == {"block"}
    assert hosts.host_reputation(spark.createDataFrame([], "host string, bad int")).count() == 0
