import heapq
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as mx

DOCS = "doc_id bigint, source string, n_tokens bigint, copies string"
TARGETS = "source string, target_share double, max_repeats int"


def sainte_lague(weights, caps, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        q = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if g < c]
        if not q:
            break
        got[min(q)[1]] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment(spark, seed):
    rng = random.Random(seed)
    n, seats = rng.randrange(2, 12), rng.randrange(5, 400)
    w = [rng.random() ** 2 for _ in range(n)]
    caps = [rng.randrange(1, seats) if seed % 2 else 10 * seats for _ in range(n)]
    rows = [("g", i, float(w[i]), caps[i], seats) for i in range(n)]
    got = mx.apportion(spark.createDataFrame(rows, "grp string, party int, weight double, cap bigint, seats int"), "grp", "party").orderBy("party").collect()
    assert [r.blocks for r in got] == sainte_lague(w, caps, seats)


@pytest.mark.parametrize("seats,cap", [(800, 10_000), (800, 450), (3, 10_000), (5000, 40)])
def test_one_large_party_among_many_small(spark, seats, cap):
    w, caps = [400.0] + [0.4] * 1000, [cap] + [30] * 1000
    rows = [("g", i, w[i], caps[i], seats) for i in range(1001)]
    got = mx.apportion(spark.createDataFrame(rows, "grp string, party int, weight double, cap bigint, seats int"), "grp", "party").orderBy("party").collect()
    heap, want = [(-x, i) for i, x in enumerate(w)], [0] * 1001
    heapq.heapify(heap)
    for _ in range(seats):  # seat by seat
        if not heap:
            break
        _, i = heapq.heappop(heap)
        want[i] += 1
        if want[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * want[i] + 1), i))
    assert [r.blocks for r in got] == want


def corpus(spark):
    rng = random.Random(1)
    rows = [(i, s, rng.randrange(20, 200), "x") for i, s in enumerate(["big"] * 3000 + ["mid"] * 800 + ["small"] * 60 + ["other"] * 50)]
    rows += [(9000, None, 50, "x"), (9001, "big", None, "x"), (9002, "big", 0, "x"), (None, "big", 5, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_shares(spark):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("nothing", 0.1, 4), (None, 0.1, 1)], TARGETS)
    mixed, report = mx.mix(spark, corpus(spark), targets, shard_tokens=50_000)
    r = {x.source: x for x in report.collect()}
    for s in ("big", "mid", "small"):
        assert abs(r[s].actual_share - r[s].wanted_share) < 0.01 and r[s].most_copies <= {"big": 1, "mid": 2, "small": 3}[s]
    assert r["nothing"].actual_share == 0 and set(r) == {"big", "mid", "small", "nothing"}
    assert r["small"].tokens_drawn == 3 * r["small"].tokens_available  # the scarcest source is used up
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    again, _ = mx.mix(spark, corpus(spark).repartition(7), targets, shard_tokens=50_000)
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0


@pytest.mark.parametrize("blocks,shard_tokens", [(20, 500), (20, 5_000), (20, 200_000), (2_000, 2_000), (100_000, 40_000_000)])
def test_shares_whatever_the_blocks(spark, blocks, shard_tokens):
    """A block of total / blocks would be a hundred times the shard in the first case, and far below it in the last."""
    targets = spark.createDataFrame([("big", 0.7, 1), ("mid", 0.3, 2)], TARGETS)
    _, report = mx.mix(spark, corpus(spark), targets, total_tokens=300_000, blocks=blocks, shard_tokens=shard_tokens)
    rows = report.collect()
    assert all(abs(r.actual_share - r.wanted_share) < 0.001 for r in rows)
    assert abs(sum(r.tokens_drawn for r in rows) - 300_000) <= 300


def test_total_beyond_a_cap(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], TARGETS)
    _, report = mx.mix(spark, corpus(spark), targets, total_tokens=100_000)
    r = {x.source: x for x in report.collect()}
    assert r["small"].tokens_drawn == r["small"].tokens_available and abs(r["big"].tokens_drawn + r["small"].tokens_drawn - 100_000) < 1500


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    mixed, report = mx.mix(spark, corpus(spark).limit(0), targets)
    assert mixed.count() == 0 and report.agg(F.sum("tokens_drawn")).first()[0] == 0
    mixed, report = mx.mix(spark, corpus(spark), targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0
