"""Toxicity, language and quality: held-out accuracy, and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    t = queries.op5_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    assert t.score.between(0, 1).all() and ((t.score >= 0.3) == (t.predicted == 1)).all()
    assert auc(t.score.to_numpy(), t.toxic.to_numpy()) > 0.9
    assert t.predicted[t.toxic == 1].mean() > 0.8 and t.predicted[t.toxic == 0].mean() < 0.1


def pairs_of_terms(r, n):
    """Documents of common words, where an insult and a group say nothing alone: toxic are those with both, or with neither and another word."""
    terms = toxicity.Terms(toxicity.FMConfig())
    docs, labels = [], []
    for _ in range(n):
        a, b = r.integers(0, 2, 2)
        words = [f"word{x}" for x in r.integers(0, 200, 20)] + ["dimwit"] * a + ["villagers"] * b
        docs.append(terms.of(" ".join(words)))
        labels.append(float(a == b))
    return docs, np.array(labels)


def test_factors_learn_an_interaction():
    r = np.random.default_rng(0)
    docs, labels = pairs_of_terms(r, 1500)
    new, truth = pairs_of_terms(r, 400)
    right = lambda cfg: ((toxicity.train(docs, labels, cfg).scores(new) > 0.5) == truth).mean()
    assert right(toxicity.FMConfig()) > 0.95  # production parameters
    assert right(toxicity.FMConfig(rank=0)) < 0.65  # additive weights alone


def test_scores_equal_the_sum_over_pairs():
    r = np.random.default_rng(1)
    docs, labels = pairs_of_terms(r, 600)
    m = toxicity.train(docs, labels, toxicity.FMConfig())
    place = {int(t): k for k, t in enumerate(m.index)}
    for t, got in zip(docs[:40], m.scores(docs[:40]), strict=True):
        at = [place[x] for x in t.tolist() if x in place]
        want = m.bias + sum(m.w[i] for i in at) + sum(m.v[i] @ m.v[j] for x, i in enumerate(at) for j in at[x + 1 :])
        assert abs(got - 1 / (1 + np.exp(-want))) < 1e-9


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, "you awful idiot", 0.5), (2, "", 0.5), (3, None, 0.5), (None, "fine words", 0.5), (1, "you awful idiot", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(df, toxicity.fit(df, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text_hash or r.doc_id in (2, 3)}) == 1
    none = toxicity.fit(df, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(df, none).collect()} == {0}
    assert toxicity.drop_toxic(df, none).columns == df.columns and toxicity.drop_toxic(df, none).count() == 5
    assert toxicity.score_toxicity(df.limit(0), none).count() == 0


def test_caps_keep_the_prior(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "'plain words that say nothing' as text")
    labels = spark.range(600).selectExpr("id as doc_id", "int(id % 10 = 0) as toxic")
    whole = toxicity.fit(docs, labels)
    some = toxicity.fit(docs, labels, toxicity.FMConfig(positives=30, negatives=50))
    assert toxicity.drop_toxic(docs, some).count() == toxicity.drop_toxic(docs, whole).count() == 600
    a, b = (toxicity.score_toxicity(docs, m).first().score for m in (whole, some))
    assert abs(a - 0.1) < 0.03 and abs(b - 0.1) < 0.03


def test_capped_fit_agrees_with_the_whole(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 10 = 0 and id % 7 < 5 or id % 10 <> 0 and id % 41 = 1 then 'some awful words' else 'some fine words' end as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "int(id % 10 = 0) as toxic")
    whole, some = (toxicity.fit(docs, labels, c) for c in (toxicity.FMConfig(), toxicity.FMConfig(positives=150, negatives=250)))
    both = spark.createDataFrame([(1, "some awful words"), (2, "some fine words")], "doc_id long, text string")
    get = lambda m: [r.score for r in toxicity.score_toxicity(both, m).orderBy("doc_id").collect()]
    assert all(abs(a - b) < 0.15 for a, b in zip(get(whole), get(some), strict=True))


def test_language_held_out(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    t = queries.op10_language(spark, SF).join(lang, "doc_id").filter("held_out and lang_pred <> 'und'").toPandas()
    t = t[t.lang.notna()]
    assert (t.lang == t.lang_pred).mean() > 0.95 and t.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(10)] + [(20 + i, "der Hund und die Katze " * 5, "de") for i in range(10)]
    rows += [(40, None, "en"), (41, "123 ... 456", "de"), (42, "", None), (None, "the cat", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    net = language.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(df, net).collect()}
    assert got[40] == got[41] == got[42] == ("und", 0.0) and got[None][0] in ("en", "de")
    assert {r.lang_pred for r in language.predict_language(df, language.fit(df.limit(0))).collect()} == {"und"}
    assert language.predict_language(df.limit(0), net).count() == 0


def test_language_equals_plain_convolution(spark):
    """Each window by loops over its places and filters; the text's score is the mean by bytes."""
    rows = [(i, ("the cat and the dog ran " if i % 2 else "der Hund und die Katze lief ") * (1 + i), "en" if i % 2 else "de") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(df, language.CNNConfig(window=64, filters=3, embed=4, epochs=2))

    def window(w):
        tops = []
        for c, b in zip(net.conv, net.conv_b, strict=True):
            for f in range(c.shape[2]):
                tops.append(max(0.0, b[f] + max(sum(float(net.emb[w[p + j]] @ c[j, :, f]) for j in range(len(c))) for p in range(len(w) - len(c) + 1))))
        z = np.array(tops) @ net.out + net.out_b
        e = np.exp(z - z.max())
        return e / e.sum()

    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_language(df, net).collect()}
    for i, text, _ in rows[:8]:
        ws = language.windows(text, 64)
        p = sum(window(w) * (w != 0).sum() for w in ws) / (ws != 0).sum()
        assert got[i][0] == net.langs[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-4


def test_fits_are_bounded_by_rows(spark):
    """One labelled doc_id with many texts doesn't fill the learning task beyond the documented bounds."""
    many = spark.range(500).selectExpr("id % 2 as doc_id", "concat('some words ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(many, labels, toxicity.FMConfig(positives=20, negatives=20, held=100))
    assert toxicity.score_toxicity(many, model).count() == 500
    assert set(language.fit(many, language.CNNConfig(sample=2, per_doc=2, epochs=1)).langs) <= {"de", "en"}


def test_windows_hold_the_whole_text():
    text = "é" * 1000
    w = language.windows(text, 256)
    assert w.reshape(-1)[: len(text.encode())].tobytes() == text.encode() and len(language.windows(None, 256)) == 0


def test_quality_prefers_the_target_and_is_exact(spark):
    r = np.random.default_rng(3)
    text = lambda good: " ".join(r.choice(["clear", "precise", "sound", "useful"] if good else ["spam", "click", "buy", "now"], 40))
    rows = [(i, text(i % 2 == 0), "x") for i in range(200)] + [(300, None, "x"), (301, "", "x"), (None, "buy now", "x"), (0, "repeat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.resample(df, labels).collect()
    assert len(got) == len(rows) and sum(x.selected for x in got) == round(0.5 * len(rows))
    assert min(x.key for x in got if x.selected) > max(x.key for x in got if not x.selected)
    weight = {x.doc_id: x.log_weight for x in got}
    assert weight[300] == weight[301] == 0 and np.mean([weight[i] for i in range(2, 200, 2)]) > np.mean([weight[i] for i in range(1, 200, 2)])
    again = quality.resample(df.repartition(7), labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert quality.resample(df.limit(0), labels).count() == 0
    assert {x.log_weight for x in quality.resample(df, labels.limit(0)).collect()} == {0.0}


def test_quality_models_equal_a_count(spark):
    from tessera.llm.common import Hasher

    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c")], "doc_id long, text string")
    cfg = quality.ResampleConfig()
    raw, target = np.full(1 << cfg.bits, cfg.smooth), np.full(1 << cfg.bits, cfg.smooth)
    ids = {i: quality.buckets(Hasher(), t, cfg.bits) for i, t in ((1, "a b a"), (2, "b c"), (3, "c c c"))}
    for i, b in ids.items():
        np.add.at(raw, b, 1)
        if i == 1:
            np.add.at(target, b, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    got = {r.doc_id: r.log_weight for r in quality.resample(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), cfg).collect()}
    assert all(abs(got[i] - ratio[b].sum()) < 1e-9 for i, b in ids.items())


def test_held_out_is_by_crc(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_very_long_texts_are_read_whole(spark):
    """A word at the far end of a text of two million bytes counts, in each of the models."""
    from tessera.llm import decontaminate

    filler = "plain words go on " * 110_000
    item = "this passage of the benchmark stands at the very end of a long text"
    df = spark.createDataFrame([(1, filler), (2, filler + "awful dimwit"), (3, filler + item)], "doc_id long, text string")
    short = [(10 + i, "an awful dimwit said so" if i % 2 else "plain words go on") for i in range(80)]
    learn, labels = spark.createDataFrame(short, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in short], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(df, toxicity.fit(learn, labels)).collect()}
    assert score[2] > score[1] == score[3]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: r.items for r in decontaminate.benchmark_leaks(df, bench).collect()} == {1: [], 2: [], 3: [7]}
    good = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    weight = {r.doc_id: r.log_weight for r in quality.resample(df, good).collect()}
    assert len(set(weight.values())) == 3


def test_quality_ties_at_the_cut(spark):
    df = spark.range(40).selectExpr("id % 4 as doc_id", "'same words' as text")
    got = quality.resample(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 40 and sum(r.selected for r in got) == 20
