"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, hosts, language, lines, minhash, mixing, neighbours, quality, suffix, toxicity


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), minhash.NearDupConfig(shingle=3, num=85, den=100)).drop("text_hash")


def op2_suffix(spark, sf_dir):
    return suffix.repeated_substrings(_read(spark, sf_dir, "documents")).drop("spans")


def op3_neighbours(spark, sf_dir):
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


def op4_lines(spark, sf_dir):
    out = lines.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark, sf_dir):
    docs, held_out = _read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learn=~held_out)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mixing(spark, sf_dir):
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_hosts(spark, sf_dir):
    return hosts.judge_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op9_decontamination(spark, sf_dir):
    return decontaminate.benchmark_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_hash")


def op10_language(spark, sf_dir):
    docs, held_out = _read(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 3, 1)
    net = language.fit(docs, learn=~held_out)
    return language.predict_language(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_suffix, op3_neighbours, op4_lines, op5_toxicity, op6_mixing, op7_quality, op8_hosts, op9_decontamination, op10_language)}

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, m AS component_id, doc_id = m AS kept FROM n JOIN m ON m.a = doc_id
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS top,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS pool FROM s),
f AS (SELECT *, coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS f,
             sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow FROM w),
l AS (SELECT *, greatest(0.0, pool - f) / ow AS lv FROM f),
t AS (SELECT source, source_size, least(top, coalesce(w * (max(CASE WHEN w * lv <= top THEN lv END) OVER ()), top)) AS target FROM l),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, source, size, source_size, target, (passes * size + least(size, greatest(0, budget - passes * source_size - start)))::BIGINT AS taken FROM q
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(a, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS a FROM pages)),
r(rule, says, h, pre) AS (VALUES ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'allow', 'net', '/de/'),
  ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')),
b AS (SELECT doc_id, (quality = 0)::INT AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL),
g AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k, string_split(host, '.') AS l FROM p LEFT JOIN b ON page_id = doc_id GROUP BY host),
h AS (SELECT host, n, k, array_to_string(l[(CASE WHEN long THEN -3 ELSE -2 END):], '.') AS domain, array_to_string(l[(CASE WHEN long THEN -2 ELSE -1 END):], '.') AS suffix
      FROM (SELECT *, len(l) > 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND regexp_full_match(l[-1], '[a-z]{2}') AS long FROM g)),
o AS (SELECT (sum(k) + 1.0) / (sum(n) + 10.0) AS p FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT p FROM o) AS p FROM h GROUP BY suffix),
s1 AS (SELECT sum(n * (k / n - p) ** 2 - p * (1 - p)) AS over, sum((n - 1) * p * (1 - p)) AS room FROM s WHERE n > 0),
s2 AS (SELECT CASE WHEN over > 0 AND room > 0 THEN least(1000.0, greatest(1.0, room / over - 1)) ELSE 1000.0 END AS s FROM s1),
sp AS (SELECT suffix, (k + p * (SELECT s FROM s2)) / (n + (SELECT s FROM s2)) AS p FROM s),
d AS (SELECT domain, x.n, x.k, p FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL) x JOIN sp USING (suffix)),
d1 AS (SELECT sum(n * (k / n - p) ** 2 - p * (1 - p)) AS over, sum((n - 1) * p * (1 - p)) AS room FROM d WHERE n > 0),
d2 AS (SELECT CASE WHEN over > 0 AND room > 0 THEN least(1000.0, greatest(1.0, room / over - 1)) ELSE 1000.0 END AS s FROM d1),
dp AS (SELECT domain, (k + p * (SELECT s FROM d2)) / (n + (SELECT s FROM d2)) AS p FROM d),
e AS (SELECT host, n, k, p FROM h JOIN dp USING (domain)),
e1 AS (SELECT sum(n * (k / n - p) ** 2 - p * (1 - p)) AS over, sum((n - 1) * p * (1 - p)) AS room FROM e WHERE n > 0),
e2 AS (SELECT CASE WHEN over > 0 AND room > 0 THEN least(1000.0, greatest(1.0, room / over - 1)) ELSE 1000.0 END AS s FROM e1),
m AS (SELECT host, k + p * (SELECT s FROM e2) AS a, n - k + (1 - p) * (SELECT s FROM e2) AS b FROM e),
y AS (SELECT host, a, b, (unnest(range(512)) + 0.5) * pi() / 1024 AS t FROM m),
z AS (SELECT host, t, (2 * a - 1) * ln(sin(t)) + (2 * b - 1) * ln(cos(t)) AS l FROM y),
q AS (SELECT host, t, exp(l - max(l) OVER (PARTITION BY host)) AS w FROM z),
x AS (SELECT host, sum(CASE WHEN sin(t) ** 2 <= 0.5 THEN w ELSE 0 END) / sum(w) <= 1 - 0.95::DOUBLE AS bad FROM q GROUP BY host),
v AS (SELECT page_id, host, path, (SELECT max({'n': length(rule), 'rule': rule, 'says': says}) FROM r WHERE (p.host = h OR suffix(p.host, '.' || h)) AND prefix(p.path, pre)) AS best FROM p)
SELECT page_id, v.host, path, best.rule AS rule, coalesce(best.says, CASE WHEN x.bad THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN x USING (host)
"""

ORACLE_SQL = {"op1_minhash": OP1_SQL, "op6_mixing": OP6_SQL, "op8_hosts": OP8_SQL}
