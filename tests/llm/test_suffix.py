import hashlib
import random

from tessera.llm import suffix as S


def brute(rows, n):
    """[(n_bytes, n_removed, n_spans, sha)] of (id, text) in order of id."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def result(spark, rows, cfg=S.SubstringConfig()):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(S.repeated_substrings(df, cfg).collect(), key=lambda r: r.doc_id)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé ") for _ in range(r.randint(2, 9)))
    passages = ["".join(word() for _ in range(40)) for _ in range(4)] + ["ab" * 300, "x" * 700]
    texts = ["".join(r.choice([word(), word(), r.choice(passages)[r.randint(0, 30) :]]) for _ in range(r.randint(0, 30))) for _ in range(40)]
    return list(enumerate([*texts, None, "", "short", texts[0], texts[0], "y" * 5000]))


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert result(spark, rows) == brute(rows, 100)


def test_large_buckets_and_deep_tries_agree(spark):
    rows = corpus(5)
    assert result(spark, rows, S.SubstringConfig(bucket=3)) == brute(rows, 100)
    assert result(spark, rows, S.SubstringConfig(shallow=0, chunk=64)) == brute(rows, 100)
    assert result(spark, rows, S.SubstringConfig(shallow=20, block=512)) == brute(rows, 100)


def test_null_ids_repeats_and_empty(spark):
    t = "the quick brown fox " * 10
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "z" + t)], "doc_id long, text string")
    rows = S.repeated_substrings(df, with_text=True).collect()
    assert len(rows) == 4 and all(r.n_bytes - r.n_removed == len(r.kept_text) for r in rows)
    assert next(r for r in rows if r.doc_id is None).n_removed == len(t)
    assert S.repeated_substrings(df.limit(0)).count() == 0
