"""Co-occurrence and set similarity against brute force."""

import collections
import itertools
import random
import time
import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import cooccurrence as cc
from ledgerloom.llm import similar_sets as ss


def brute(rows, least):
    b = collections.defaultdict(lambda: collections.defaultdict(set))
    for k, x, i in rows:
        if None not in (k, x, i):
            b[k][x].add(i)
    out = {}
    for k, v in b.items():
        n = collections.Counter(i for s in v.values() for i in s)
        for p, c in collections.Counter(p for s in v.values() for p in itertools.combinations(sorted(s), 2)).items():
            if c >= least:
                out[(k, *p)] = (c, n[p[0]], n[p[1]], len(v))
    return out


@pytest.mark.parametrize("least", [1, 4])
def test_gram(spark, least):
    rng = random.Random(least)
    rows = [("a", f"x{rng.randrange(60)}", f"i{int(rng.paretovariate(0.7)) % 25}") for _ in range(900)] + [("b", f"x{rng.randrange(9)}", f"i{rng.randrange(5)}") for _ in range(80)]
    rows += [("a", "big", f"i{k}") for k in range(200)] + [("a", "big2", f"i{k}") for k in range(0, 200, 2)]  # long baskets take the dense way
    rows += rows[:200] + [(None, "x", "i"), ("a", None, "i1"), ("a", "x1", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, basket string, item string, n_ab int")
    got = {(r.kind, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in cc.pair_counts(spark, df, least).collect()}
    assert got == brute(rows, least)


def _product(row, item, width):
    got = collections.Counter()
    for codes, counts in cc._long(np.array(row), np.array(item), width):
        got.update(dict(zip(*(x.tolist() for x in (codes, counts))))) if len(set(codes.tolist())) == len(codes) else [got.update({c: n}) for c, n in zip(codes.tolist(), counts.tolist())]
    return {divmod(c, width): n for c, n in got.items()}


@pytest.mark.parametrize("share", [0.01, 0.4])
def test_long_baskets(share):
    """Thin rows go pair by pair, full blocks as tiles, and most rows have items of both."""
    rng = random.Random(3)
    rows = {r: sorted(rng.sample(range(1024), int(1024 * share) + 2) + rng.sample(range(1024, 50_000), 9)) for r in range(60)}
    want = collections.Counter(p for s in rows.values() for p in itertools.combinations(s, 2))
    got = _product([r for r, s in rows.items() for _ in s], [i for s in rows.values() for i in s], 50_000)
    assert got == want


def test_a_long_basket_over_many_blocks():
    """One basket of 70 items in as many as 1,000 blocks, then one of 20,000: in time, in memory, in parts."""
    item = np.arange(70) * 14_000
    assert len(np.unique(item // cc.BLOCK)) == 70
    tracemalloc.start()
    start = time.time()
    for items in (np.arange(70) * 14_000, np.arange(1000) * cc.BLOCK):
        n = sum(len(c) for c, _ in cc._long(np.zeros(len(items), np.int64), items, 1 << 20))
        assert n == len(items) * (len(items) - 1) // 2
    assert time.time() - start < 1 and tracemalloc.get_traced_memory()[1] < 200 << 20
    sizes = [len(c) for c, _ in cc._long(np.zeros(20_000, np.int64), np.arange(20_000), 1 << 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 20_000 * 19_999 // 2 and max(sizes) <= 1 << 20 and peak < 200 << 20


def test_gram_small(spark):
    empty = spark.createDataFrame([], "kind string, basket string, item string")
    assert cc.pair_counts(spark, empty).count() == 0
    one = spark.createDataFrame([("a", "x", "i"), ("a", "x", "j")], "kind string, basket string, item string")
    assert cc.at_least(cc.pair_counts(spark, one, 1), 1).count() == 1 and cc.at_least(cc.pair_counts(spark, one, 1), 2).count() == 0
    assert cc.lift(cc.pair_counts(spark, one, 1)).first().lift == 1.0


F1 = {"c": 0.75, "d": 0.5}


def similar(sets):
    f = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if f(sets[a][0], sets[b][0]) >= 0.75 and f(sets[a][1], sets[b][1]) >= 0.5}


def test_similar_sets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        size = rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12, 14, 18, 25])
        base = rng.sample(range(40), min(size, 40)) if i % 2 else rng.sample(range(size + 2), size)
        rows.append((f"p{i:03d}", [f"e{k}" for k in base], [f"d{k}" for k in rng.sample(range(4), rng.randrange(0, 4))]))
    rows += [("p000", None, None), ("p001", ["e1", "e1"], None), (None, ["e1"], ["d1"])]
    sets = {}
    for p, c, d in rows:
        if p:
            s = sets.setdefault(p, (set(), set()))
            s[0].update(c or [])
            s[1].update(d or [])
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, c array<string>, d array<string>, class_id string")
    want = similar(sets)
    got = [(r.id_a, r.id_b) for r in ss.similar_pairs(spark, df, "c", F1).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    links = collections.Counter(x for p in want for x in p)
    report = ss.class_report(spark, df, "c", F1).collect()
    assert {r.id: r.n_links for r in report} == {p: links[p] for p, s in sets.items() if s[0] and s[1]}


def test_similar_sets_empty(spark):
    df = spark.createDataFrame([], "id string, c array<string>, d array<string>")
    assert ss.similar_pairs(spark, df, "c", F1).count() == 0


@pytest.mark.parametrize("size", range(1, 30))
def test_every_similar_pair_shares_a_signature(size):
    """For the worst case of c common elements that stand last in both orders."""
    mine = dict(ss.subsets(size, 0.75))
    for other in range(1, 40):
        c = ss._needed(size, other, 0.75)
        if c > min(size, other):
            continue
        k = 1 if min(size, other) > ss.LARGE else min(3, c)
        theirs = dict(ss.subsets(other, 0.75))
        assert mine[k] >= size - c + k and theirs[k] >= other - c + k
