import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from test_minhash import SCHEMA, brute, rows, variants

from quillsift.llm import ngram_join as j
from quillsift.llm.shingles import shingle_set


def told(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def templates(rng, n, lines=12):
    """Documents put together from few lines, many of them alike and not linked."""
    known = [" ".join(f"t{i}x{w}" for w in range(9)) for i in range(lines)]
    return ["\n".join(rng.sample(known, rng.randrange(2, 9))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [(64, 4096), (3, 12), (1, 2), (0, 1)])
def test_against_brute_force(spark, sf_dir, frequent, monkeypatch):
    """Low bounds make most tokens frequent, so that links are found by pairs and triples of tokens."""
    monkeypatch.setattr(j, "FREQUENT", frequent)
    monkeypatch.setattr(j, "BLOCK", 8)  # so that blocks are cut and met
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += variants(rng, 60) + variants(rng, 40, 30) + templates(rng, 60) + ["", None, " \n ", "One two", "one  TWO", "a b c d e", "A\tb c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h", "a b c d e f g h i", "é", "w " * 30_000, "w " * 40_000]
    pairs = list(enumerate(texts))
    assert told(j.ngram_join(rows(spark, pairs))) == brute(pairs, 5, 4, 5)


@pytest.mark.parametrize("num,den", [(4, 5), (9, 10), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    """Any two linked sets of tokens whose kinds are drawn at random, at all sizes."""
    rng, join = np.random.default_rng(5), j.Join(5, num, den)
    kind_of = lambda t: (t >> 3) % 3 if t % 5 else 0
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 300]:
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 40, n))
            if rng.random() < 0.5:
                x = x - x % 5 + 1  # none is rare of itself
                x = np.unique(x)
            y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.12], rng.integers(0, 1 << 40, rng.integers(0, 1 + n // 8))]))
            if not len(y) or not join.linked(x.astype(np.uint64), y.astype(np.uint64)):
                continue
            kinds = [np.array([kind_of(int(t)) for t in s]) for s in (x, y)]
            one, two = (set(j.signatures_of(s, k, join)) for s, k in zip((x, y), kinds))
            assert one & two, (n, len(y))


def test_heads_never_rule_out_a_link():
    rng, join = random.Random(3), j.Join(5, 4, 5)
    sets = [shingle_set(t.encode(), 5) for t in variants(rng, 40) + templates(rng, 30)]
    heads = [j.least_hashes(s)[: join.head(len(s))] for s in sets]
    dropped = 0
    for a, b in combinations(range(len(sets)), 2):
        may = j.may_link(len(sets[a]), heads[a], len(sets[b]), heads[b], join)
        assert may or not join.linked(sets[a], sets[b])
        dropped += not may
    assert dropped > 500


def test_bitmaps_never_rule_out_a_link():
    rng, join = random.Random(6), j.Join(5, 4, 5)
    sets = [shingle_set(t.encode(), 5) for t in [*variants(rng, 30), *templates(rng, 20), *variants(rng, 8, 66), *variants(rng, 8, 700), *("w " * n + "end" for n in range(1, 9))]]
    bits = [j.bitmap(j.least_hashes(s)) for s in sets]
    ids, comps, side = np.arange(len(sets)) + 100, np.arange(len(sets)) % 7, np.arange(len(sets)) % 2
    sizes = np.array([len(s) for s in sets])
    for sides in (None, side):
        asked = [(a, b) for a, b in combinations(range(len(sets)), 2) if comps[a] != comps[b] and (sides is None or side[a] != side[b])]
        got = {tuple(x) for x in j.pairs_left(ids, comps, sizes, bits, join, sides).tolist()}
        linked = {(a + 100, b + 100) for a, b in asked if join.linked(sets[a], sets[b])}
        assert linked <= got <= {(a + 100, b + 100) for a, b in asked} and len(linked) > 20 and len(got) < len(asked) / 2


def test_rows_that_share_an_id_and_odd_rows(spark):
    base = [f"w{i}" for i in range(60)]
    one, other = " ".join(base), " ".join(f"v{i}" for i in range(60))
    near = " ".join([*base[:-1], "end"]), " ".join([*(f"v{i}" for i in range(59)), "end"])
    pairs = [(5, one), (5, other), (5, one), (6, near[0]), (7, near[1]), (None, one), (8, None), (9, "")]
    got = j.ngram_join(rows(spark, pairs)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8), (9, 9)]
    assert j.ngram_join(rows(spark, [])).count() == 0 and j.ngram_join(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "n_shingles", "component_id"]


def test_a_passage_of_very_many_documents_gathers_few(spark):
    """Documents with enough tokens of their own meet in none that is frequent, only in those at the end of few heads."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} " + " ".join(f"d{n}w{i}" for i in range(40)) for n in range(200)]
    docs = rows(spark, list(enumerate(texts)))
    join = j.Join(5, 4, 5)
    j.prepare(spark)
    signed = docs.select("doc_id", "text").mapInArrow(j._heads(join), "id long, n_shingles long, class binary, head array<long>, bits binary")
    held = j.signatures(docs, signed, join)
    assert held.groupBy("key").count().where(f"count > {j.FREQUENT[0]}").count() == 0
    assert held.select("id").distinct().count() == 200


def test_sizes_rule_pairs_out_before_sets_are_asked_for(spark, monkeypatch):
    """Sets that share signatures but are too different in size are no pairs whose heads move."""
    asked, verified = [], j._verified
    monkeypatch.setattr(j, "_verified", lambda docs, reps, pairs, join: (asked.append(pairs.count()), verified(docs, reps, pairs, join))[1])
    same = [f"s{i}" for i in range(24)]
    rows = [(i, " ".join(same + [f"w{i}x{n}" for n in range(20 * 2**i)])) for i in range(6)]
    got = j.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(asked) == 0 and all(r.component_id == r.doc_id for r in got)


def test_tokens_meet_in_no_join_and_only_pairs_move_bitmaps(spark, monkeypatch):
    """Kinds are looked up where a set is, so that whole sets never become rows of a join; sets that no pair asks for stay."""
    plans, written = [], j.written
    monkeypatch.setattr(j, "written", lambda df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, *more))[1])
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} end{n}" for n in range(90)] + [" ".join(f"d{n}w{i}" for i in range(20)) for n in range(900)]
    docs, join = rows(spark, list(enumerate(texts))), j.Join(5, 4, 5)
    j.prepare(spark)
    signed = docs.select("doc_id", "text").mapInArrow(j._heads(join), "id long, n_shingles long, class binary, head array<long>, bits binary")
    held = j.signatures(docs, signed, join)
    assert {r.id for r in held.join(held.where("id = 0").select("key"), "key").collect()} == set(range(90))  # poor, and linked
    assert len(plans) > 5 and not any(re.search(r"Join \[token", p) for p in plans)
    got = j._some(signed, spark.createDataFrame([(3,), (800,), (3,)], "id long")).collect()
    assert {3, 800} <= {r.id for r in got} and len(got) < 20


def test_bitmaps_of_tokens_and_of_pairs_err_on_one_side(spark):
    rng, join = np.random.default_rng(4), j.Join(5, 4, 5)
    tokens = j.least_hashes(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    bits = j._places(spark.createDataFrame([(int(t),) for t in tokens[:500]], "token long"), 64)
    assert j.placed(bits, tokens[:500]).all() and j.placed(bits, tokens[500:]).mean() < 0.1
    assert not j.placed(j._places(spark.createDataFrame([], "token long"), 64), tokens).any()
    drawn = random.Random(8)
    sets = [shingle_set(t.encode(), 5) for t in [*variants(drawn, 40), *templates(drawn, 30), *variants(drawn, 8, 66)]]
    packed = [np.packbits(j.bitmap(j.least_hashes(s))) for s in sets]
    dropped = 0
    for a, b in combinations(range(len(sets)), 2):
        may = j.bits_allow(len(sets[a]), packed[a], len(sets[b]), packed[b], join)
        assert may or not join.linked(sets[a], sets[b])
        dropped += not may
    assert dropped > 500


def test_members_of_a_block_meet_beside_the_next_one():
    """No block of several is dealt to a task of its own: its members are compared where it meets its neighbour."""
    tokens = j.least_hashes(shingle_set(" ".join(f"w{i}" for i in range(50)).encode(), 5))
    bits, n = np.packbits(j.bitmap(tokens)).tobytes(), 4
    for at, expected in (((0, 1), 6), ((0, 2), 4), ((0, 0), 6)):
        sides = np.repeat(at, 2)
        names = {"key": np.ones(n, int), "i": np.full(n, at[0]), "j": np.full(n, at[1]), "own": sides, "id": np.arange(n), "component": np.arange(n), "n_shingles": np.full(n, len(tokens))}
        batch = pa.record_batch([*(pa.array(x, pa.int64()) for x in names.values()), pa.array([bits] * n, pa.binary())], [*names, "bits"])
        assert sum(b.num_rows for b in j._blocks(j.Join(5, 4, 5))(iter([batch]))) == expected
