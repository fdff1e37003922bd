"""Language identification and quality against plain versions: loops over characters, dense matrices, inverses."""

import math
from itertools import combinations

import numpy as np

from quillsift.llm import language_id, quality


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_trigrams(text):
    """A dictionary of hashed trigrams to the roots of their counts, as a unit vector."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    data += [32] * (3 - len(data))
    counts = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        place = ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> (32 - language_id.BITS)
        counts[place] = counts.get(place, 0) + 1
    counts.pop((0x202020 * 2654435761 & 0xFFFFFFFF) >> (32 - language_id.BITS), None)
    n = math.sqrt(sum(counts.values()))
    return {p: math.sqrt(c) / n for p, c in counts.items()}


def test_language_equals_a_plain_vote(spark):
    """Families by one-versus-rest shares, then all pairs of the family vote."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = language_id.predict(docs.where("text is not null").orderBy("doc_id").limit(150), model).collect()
    assert len({r.lang_pred for r in rows}) > 2
    for r in rows:
        x = plain_trigrams(r.text)
        chance = lambda i: sigmoid(model.scale[i][0] * sum(v * float(model.weights[p, i]) for p, v in x.items()) + model.scale[i][1])
        families = {f: chance(i) for f, i in model.rest.items()}
        best = max(families, key=families.get)
        votes = dict.fromkeys(model.families[best], 0.0)
        for a, b in combinations(model.families[best], 2):
            p = chance(model.pairs[a, b])
            votes[a], votes[b] = votes[a] + p, votes[b] + 1 - p
        lang = max(votes, key=votes.get)
        share = families[best] / sum(families.values()) * (votes[lang] / sum(votes.values()) if len(votes) > 1 else 1)
        assert abs(share - r.lang_score) < 1e-4
        assert lang == r.lang_pred


def test_svm_reaches_the_optimum():
    """The fitted weights' primal objective against a plain projected gradient on the dual."""
    rng = np.random.default_rng(5)
    n, d, c = 18, 6, 10.0  # too few rows for any to be held out
    x = rng.normal(size=(n, d)).astype(np.float32)
    y = np.where(x[:, 0] + 0.8 * rng.normal(size=n) > 0, 1, -1)
    m = language_id.Svm([(np.arange(d), v) for v in x], y, c, epochs=3000)
    full = np.hstack([x, np.ones((n, 1))])  # the offset is a weight like others
    primal = lambda w: 0.5 * w @ w + c * np.maximum(0, 1 - y * (full @ w)).sum()
    q = (y[:, None] * full) @ (y[:, None] * full).T
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, c)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    assert dual <= primal(np.append(m.w[:d], m.b)) * (1 + 1e-4) and primal(np.append(m.w[:d], m.b)) < dual * 1.01


def plain_statistics(text):
    """The same statistics, a character or word at a time."""
    data = text.encode()
    n = max(1, len(data))
    is_letter = lambda b: 97 <= (b | 32) <= 122 and b < 128
    digit = lambda b: 48 <= b <= 57
    count = lambda f: sum(1 for b in data if f(b))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    m, kinds = max(1, len(words)), {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    sd = math.sqrt(sum((v - mean) ** 2 for v in lengths) / len(lengths))
    bare = [w for w in kinds if not any(digit(b) or is_letter(b) or b >= 128 for b in w)]
    sizes = [math.log1p(len(data)), math.log1p(len(words)), math.log1p(mean), math.log1p(sd), math.log1p(len(kinds)) / math.log1p(m), math.log1p(len(lines)), math.log1p(m / max(1, len(lines)))]
    shares = [
        count(lambda b: 65 <= b <= 90) / max(1, count(is_letter)), count(digit) / n, count(lambda b: b in b".,;:?'\"-()") / n,
        count(lambda b: b in b"#$%&*+/<=>@[\\]^_`{|}~") / n, count(lambda b: b == 33) / n, count(lambda b: b in b" \t\n\r\x0b\x0c") / n, count(lambda b: b >= 128) / n,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / m, max(kinds.values(), default=0) / m, 1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), sum(w.isupper() for w in words) / m, len(bare) / max(1, len(kinds)), sum(v <= 3 for v in lengths) / len(lengths),
    ]
    return np.array(sizes + [math.sqrt(s) for s in shares])


def test_quality_equals_a_plain_discriminant(spark):
    """Whole scores from inverses and determinants of covariances that are formed afresh from all labelled texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    known = {}
    for r in docs.join(labels, "doc_id").where("text is not null and quality is not null").select("text", "quality").collect():
        known[r.text] = max(r.quality, known.get(r.text, 0))
    x, y = np.array([plain_statistics(t) for t in known]), np.array(list(known.values()))
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - center) / spread
    cov = lambda v: (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) / len(v)
    pooled = sum(cov(x[y == k]) * (y == k).sum() for k in (0, 1)) / len(y)
    texts = [r.text for r in docs.where("text is not null").limit(60).collect()] + ["", " \n", "7 ... !", "日本 É"]
    got = quality.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert len({round(r.quality_score, 6) for r in got}) > 20
    for r in got:
        v, density = (plain_statistics(r.text) - center) / spread, []
        for k in (0, 1):
            own = (1 - model.shrink) * cov(x[y == k]) + model.shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-6 * np.eye(len(pooled))
            off = v - x[y == k].mean(axis=0)
            density.append(-0.5 * off @ np.linalg.inv(own) @ off - 0.5 * np.linalg.slogdet(own)[1])
        d = density[1] - density[0]
        assert abs(sigmoid(max(-30, min(30, model.slope * math.copysign(math.log1p(abs(d)), d) + model.offset))) - r.quality_score) < 1e-6
