import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillsift.llm import language_id, quality, toxicity
from quillsift.llm.learning import fold, platt

ODD = [None, "", " \n", "7 ... !", "x", "word " * 40_000, "日本", "é"]


def check_scores(spark, score, column, docs):
    """Scores lie in 0..1, equal texts have equal ones, clashing columns are replaced, an empty table works."""
    got = score(docs).collect()
    assert len(got) == docs.count() and all(0 <= r[column] <= 1 for r in got)
    again = score(spark.createDataFrame([(None, t, "z", 5.0) for t in ODD] + [(1, t, "z", 5.0) for t in ODD], f"doc_id long, text string, lang string, {column} double")).collect()
    by = {}
    for r in again:
        by.setdefault(r.text, set()).add(r[column])
    assert all(len(v) == 1 for v in by.values()) and len(again) == 2 * len(ODD)
    assert score(docs.limit(0)).count() == 0


def held_out(scored, labels, label, own, column):
    rows = scored.join(labels, "doc_id").where(own & F.col(label).isNotNull()).select(label, column).collect()
    y, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return ((s >= 0.5) == (y == 1)).mean(), s[y == 1].mean(), s[y == 0].mean()


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own = fold(F.col("doc_id"), 5)
    model = toxicity.fit(docs, labels, own != 0)
    scored = toxicity.score(docs, model)
    accuracy, one, zero = held_out(scored, labels, "toxic", own == 0, "toxicity")
    assert accuracy > 0.93 and one > 0.5 > zero
    assert any(r.evidence and r.terms for r in scored.collect())
    check_scores(spark, lambda d: toxicity.score(d, model), "toxicity", docs)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("toxicity >= 0.5").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("toxicity is null").count() == 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    for n_terms, n in ((40, 700), (3000, 500), (5, 3)):
        rows, full = [], np.zeros((n, n_terms))
        for i in range(n):
            terms = np.unique((rng.random(rng.integers(1, 9)) ** 3 * n_terms).astype(int))
            weights = rng.random(len(terms)) ** 2 + 0.01
            rows.append((terms, weights / np.linalg.norm(weights)))
            full[i, terms] = rows[-1][1]
        index = toxicity.BlockMaxIndex(rows, n_terms)
        got = index.nearest(rows, 10)
        for i, near in enumerate(got):
            want = np.sort(full @ full[i])[::-1][:10]
            assert np.allclose([s for s, _ in near], want[want > 1e-300]) and all(abs(full[j] @ full[i] - s) < 1e-9 for s, j in near)
        for i, near in enumerate(index.nearest(rows[2:], 10, 2)):
            assert i + 2 not in {j for _, j in near} and len(near) == min(10, (full @ full[i + 2] > 0).sum() - 1)


def test_toxicity_equals_a_plain_dense_version(spark):
    """Whole scores against cosines of full matrices, with nothing left out."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    known = {}
    for r in docs.join(labels, "doc_id").where("text is not null and toxic is not null").select("text", "toxic").collect():
        known[r.text] = max(r.toxic, known.get(r.text, 0))
    names = sorted({w for t in known for w in words(t)})

    def tf(texts):
        out = np.zeros((len(texts), len(names)))
        for i, t in enumerate(texts):
            for w, c in Counter(words(t)).items():
                if w in place:
                    out[i, place[w]] = c
        return out

    place = {w: i for i, w in enumerate(names)}
    x, y = tf(known), np.array(list(known.values()))
    df, n1 = (x > 0).sum(axis=0), y.sum()
    p1, p0, p = (x[y == 1] > 0).mean(axis=0), (x[y == 0] > 0).mean(axis=0), df / len(y)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (len(y) - n1)))
    weight = (np.log((1 + len(y)) / (1 + df)) + 1) * np.maximum(z, 1)
    unit = lambda m: (v := np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * weight) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    share = labels.where("toxic is not null").groupBy().avg("toxic").first()[0]
    texts = [r.text for r in docs.limit(80).collect()] + [None, "", "nothing known here zzz"]
    cos = unit(tf(texts)) @ unit(x).T
    for row, (score, near, _) in zip(cos, model.score([t and t.encode() for t in texts])):
        want = np.sort(row[row > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([s for s, _ in near], want)
        if len(want) < toxicity.NEIGHBOURS or (np.abs(row - want[-1]) < 1e-9).sum() == 1:  # no tie at the last place
            at = np.argsort(-row, kind="stable")[: len(want)]
            vote = (row[at] @ y[at] + toxicity.PRIOR * share) / (row[at].sum() + toxicity.PRIOR)
            assert abs(score - 1 / (1 + np.exp(-(model.slope * vote + model.offset)))) < 1e-9


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = fold(F.col("doc_id"), 4)
    model = language_id.fit(docs, own != 2)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    got = language_id.predict(docs, model).where(own == 2).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    check_scores(spark, lambda d: language_id.predict(d, model), "lang_score", docs)
    odd = language_id.predict(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, True, True, False, False, False, False]
    empty = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs.limit(5), empty).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.predict(docs.where("lang = 'fr'").limit(5), one).collect()} == {"fr"}


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = ("Größe und Ängste, l'été. " * 300).encode()
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "_CHUNK", 1000)
    assert np.allclose(whole, language_id.features(text))


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own = fold(F.col("doc_id"), 3)
    model = quality.fit(docs, labels, own != 1)
    accuracy, one, zero = held_out(quality.score(docs, model), labels, "quality", own == 1, "quality_score")
    assert accuracy > 0.95 and one > 0.8 and zero < 0.2
    check_scores(spark, lambda d: quality.score(d, model), "quality_score", docs)
    none = quality.fit(docs, labels.where("quality = 1"))
    assert quality.score(docs, none).where("quality_score < 0.5").count() == 0


def test_densities_are_gaussian():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3))
    g = quality._Gauss(x, np.cov(x, rowvar=False), 0.2)
    cov = g.factor @ g.factor.T
    d = x[0] - g.mean
    want = -0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.log(np.linalg.det(cov))
    assert abs(g.log_density(x[:1])[0] - want) < 1e-8


def test_platt_restores_shares():
    rng = random.Random(2)
    s = np.array([rng.gauss(1, 1) for _ in range(500)] + [rng.gauss(-1, 1) for _ in range(500)])
    y = np.array([1] * 500 + [0] * 500)
    slope, offset = platt(s, y, np.ones(1000))
    p = 1 / (1 + np.exp(-(slope * s + offset)))
    assert slope > 1 and abs(p.mean() - 0.5) < 0.02
