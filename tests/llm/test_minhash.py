import random

import numpy as np
import pytest

from quillsift.llm import minhash
from quillsift.llm.components import components
from quillsift.llm.shingles import MinHash, shingle_set

SCHEMA = "doc_id long, text string, kept int, component_id string"


def brute(pairs, k, num, den):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    sets = []
    for i, t in pairs:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {i: i for i, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                i, j = sorted((root(i), root(j)))
                parent[j] = i
    return sorted((i, len(s), root(i)) for i, s in sets)


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in pairs], SCHEMA)


def variants(rng, n, words=120):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    made = [base]
    while len(made) < n:
        x = list(rng.choice(made))
        for _ in range(rng.randrange(1, 5)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10_000)}"
        made.append(x)
    return [" ".join(x) for x in made]


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_against_brute_force(spark, sf_dir, k, num, den, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # so that blocks are cut and met
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += variants(rng, 60) + variants(rng, 25) + ["", None, " \n ", "One two", "one  TWO", "a b c", "A\tb c", "É b", "é b", "w " * 30_000, "w " * 40_000]
    pairs = list(enumerate(texts))
    got = minhash.near_dedup(rows(spark, pairs), k, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(pairs, k, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    got = minhash.near_dedup(rows(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, "A b c")]), 3, 85, 100).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 2, False)]
    assert minhash.near_dedup(rows(spark, []), 3, 85, 100).count() == 0
    left = minhash.drop_near_duplicates(rows(spark, [(2, "a b c"), (3, "A b c"), (4, None), (5, "")]), 3, 85, 100)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5] and left.columns == ["doc_id", "text", "kept", "component_id"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90} | {1000 + i: 1000 for i in range(300)}
    assert got == want


def test_blocks_find_what_stars_leave():
    a = shingle_set(b"a b c d e f g h i j k l m n o p q r s t u v w x y z", 3)
    sets = [a, a[:-1], a[:3]]
    plan = minhash.Plan(3, 85, 100)
    assert minhash.block_links(np.array([5, 6, 7]), np.array([5, 6, 7]), sets, plan) == [(5, 6)]
    assert minhash.block_links(np.array([5, 6, 7]), np.array([5, 5, 7]), sets, plan) == []


def test_pair_that_meets_in_late_bands_below_unlinked_smaller_ids(spark):
    rng, plan = random.Random(1), minhash.Plan(5, 4, 5)
    minima = MinHash(plan.size)

    def edited(x, n):
        x = list(x)
        for at in rng.sample(range(10, 190, 6), n):
            x[at] = f"e{rng.randrange(10**9)}"
        return x

    def of(x):
        values = shingle_set(" ".join(x).encode(), 5)
        return values, minima.bands(minima.signature(values), minhash.ROWS)

    a = [f"w{i}" for i in range(200)]
    b, agree = a, np.ones(plan.bands, bool)
    while agree[:6].any() or not agree.any():
        b = edited(a, 4)
        agree = of(a)[1] == of(b)[1]
    smaller, open_ = [], set(np.flatnonzero(agree).tolist())
    while open_:  # an unlinked document for each bucket that the pair shares
        c = edited(a, 7)
        here = open_ & set(np.flatnonzero(of(c)[1] == of(a)[1]).tolist())
        if here and not plan.linked(of(c)[0], of(a)[0]) and not plan.linked(of(c)[0], of(b)[0]):
            smaller.append(c)
            open_ -= here
    pairs = list(enumerate(" ".join(x) for x in [*smaller, a, b]))
    want = brute(pairs, 5, 4, 5)
    assert want[-1][2] == len(smaller) and {r[2] for r in want[:-1]} == set(range(len(smaller) + 1))
    got = minhash.near_dedup(rows(spark, pairs), 5, 4, 5).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_no_pair_is_lost_in_families_of_alike_but_unlinked_documents(spark, k, num, den):
    """A family is ten edits of one text, too far apart to be linked; the last two are a pair just above the threshold."""
    rng, plan, pairs, want = random.Random(9), minhash.Plan(k, num, den), [], {}

    def edited(x, n):
        x = list(x)
        for at in rng.sample(range(0, len(x), k + 1), n):
            x[at] = f"e{rng.randrange(10**9)}"
        return x

    of = lambda x: shingle_set(" ".join(x).encode(), k)
    few = max(n for n in range(1, 20) if plan.linked(of(range_words(200)), of(edited(range_words(200), n))))
    for family in range(150):
        base = [f"f{family}w{i}" for i in range(200)]
        members = [edited(base, few) for _ in range(9)]
        members.append(edited(members[-1], few))
        for x in members:
            pairs.append((len(pairs), " ".join(x)))
        want[len(pairs) - 1] = len(pairs) - 2
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(rows(spark, pairs), k, num, den).collect()}
    truth = {i: c for i, _, c in brute_in_families(pairs, k, num, den, 10)}
    assert all(truth[b] == a for b, a in want.items()) and got == truth


def range_words(n):
    return [f"w{i}" for i in range(n)]


def brute_in_families(pairs, k, num, den, size):
    return [x for at in range(0, len(pairs), size) for x in brute(pairs[at : at + size], k, num, den)]


def test_plans_split_hot_keys_and_leave_texts_where_they_are(spark, sf_dir):
    """No shuffle of whole rows stands above the scan of the documents that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = minhash.drop_near_duplicates(docs)
    clear = out._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1]
    first = clear.split("FileScan parquet [doc_id", 1)[0]
    assert "Exchange hashpartitioning(doc_id" not in first
