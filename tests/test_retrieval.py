from decimal import Decimal

import pytest

from ledgerloom.functions.calculator import evaluate
from ledgerloom.operators import resampling, retrieval

PAGES = [
    (1, "Tensor train", "a tensor train of rank two", "s1", "academic", "current"), (2, "Other", "the tensor and the train", "s1", "academic", "current"),
    (3, "Tensor", "tensor train tensor train", "s1", "academic", "deprecated"), (4, None, "nothing here", "s2", "academic", None), (5, "Tensor train", "a tensor train", "s2", "admin", "current"),
    (6, "x", "contensors trains", "s3", "academic", "current"), (7, "Tensor train", "tensor train", "s1", "academic", "current"), (8, "t", None, "s4", "academic", "current"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "id int, title string, text string, source string, domain string, status string")


def test_hybrid(spark):
    r, c = retrieval.hybrid(pages(spark), retrieval.Request("tensor train", domain="academic"))
    rows = r.orderBy("rank").collect()
    assert [x.id for x in rows] == [1, 7] and all(x.coverage == 1 and x.phrase == 1 and not x.evidence_read for x in rows)
    assert {x.channel: x.n_candidates for x in c.collect()} == {"lexical": 3, "title": 2}
    everything, _ = retrieval.hybrid(pages(spark), retrieval.Request("tensor train", include_deprecated="true"))
    assert {x.id for x in everything.collect()} == {1, 3, 5}
    none, c = retrieval.hybrid(pages(spark), retrieval.Request("zebra"))
    assert none.count() == 0 and {x.n_candidates for x in c.collect()} == {0}


def test_every_query_word_counts(spark):
    words = [f"word{i}" for i in range(12)]
    r, c = retrieval.hybrid(pages(spark), retrieval.Request(" ".join([*words, "nothing"])))
    assert [(x.id, round(x.coverage * 13)) for x in r.collect()] == [(4, 1)]
    assert {x.channel: x.n_candidates for x in c.collect()} == {"lexical": 1, "title": 0}


@pytest.mark.parametrize("bad", [{"query": " "}, {"query": "a", "topk": 21}, {"query": "a", "subjects": ("1", "2", "3", "4")}, {"query": "a", "intent": "x"}, {"query": "a", "include_deprecated": "no"}])
def test_requests(bad):
    with pytest.raises(ValueError):
        retrieval.Request(**bad)


@pytest.mark.parametrize("least", [0.6, 0.8, 0.95])
def test_ratio_top(spark, least):
    import random

    rng = random.Random(6)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 24))) for _ in range(40)]
    names = base + ["".join(c for c in b if rng.random() > 0.15) for b in base] + [None, ""]
    authority = ["".join(c if rng.random() > 0.1 else rng.choice("abcde") for c in b) for b in base] + [None, ""]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for n in {x for x in names if x}:
        best = min(((-(1 - edits(n, b) / max(len(n), len(b))), b) for b in authority if b))
        want[n] = (best[1], round(-best[0], 9)) if -best[0] >= least else (None, None)
    df = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    got = {r.name: (r.best, None if r.ratio is None else round(r.ratio, 9)) for r in retrieval.ratio_top(df(names), df(authority), least).collect()}
    assert got == want


@pytest.mark.parametrize("least", [0.9, 0.95])
def test_ratio_pairs_of_long_names(spark, least):
    import random

    rng = random.Random(9)

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "😀", "ab"])
        return "".join(text)

    base = ["".join(rng.choice("aab 😀é") for _ in range(rng.choice([1, 9, 19, 20, 39, 40, 41, 60, 61, 90]))) for _ in range(30)]
    names, authority = [edited(x, k) for x in base for k in range(7)], base + [edited(x, 1) for x in base]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in set(names) if a for b in set(authority) if b and 1 - edits(a, b) / max(len(a), len(b)) >= least}
    assert any(edits(a, b) >= 4 for a, b in want)
    df = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    pairs = retrieval.ratio_pairs(df(names), df(authority), least)
    assert {(r.name, r.best) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()  # no name meets every length of piece


def test_permutation(spark):
    members = spark.createDataFrame([(f"m{i}", "a" if i < 10 else "b", float(i)) for i in range(20)], "member string, stratum string, x double")
    whole = spark.createDataFrame([("g", f"m{i}") for i in range(20)] + [("one", "m1"), (None, "m1")], "grp string, member string")
    out = resampling.stratified_permutation(spark, members, whole, draws=8).collect()
    assert len(out) == 8 and all(abs(r.value - 9.5) < 1e-9 for r in out)  # all members: no permutation changes the mean
    part = spark.createDataFrame([("g", f"m{i}") for i in range(5)], "grp string, member string")
    values = [r.value for r in resampling.stratified_permutation(spark, members, part, draws=30).collect()]
    assert len(set(values)) > 5 and all(2 <= v <= 7 for v in values)  # within the stratum of 0..9
    with pytest.raises(ValueError):
        resampling.stratified_permutation(spark, members.union(spark.createDataFrame([("z", None, 1.0)], members.schema)), whole)


@pytest.mark.parametrize("width", ["wide", "narrow"])
def test_coherence_null(spark, width):
    import random

    from pyspark.sql import functions as F

    from ledgerloom.operators import aggregates

    rng = random.Random(8)
    words = [f"w{i}" for i in range(400 if width == "wide" else 5)]
    profiles = [(f"m{i}", 2000 + i % 3, rng.sample(words[:9], rng.randrange(0, 5)) if i % 4 else rng.sample(words, 3), [words[i % 5]]) for i in range(60)]
    p = spark.createDataFrame(profiles, "member string, stratum int, concepts array<string>, disciplines array<string>")
    links = [(f"g{g}", f"m{rng.randrange(66)}") for g in range(8) for _ in range(2 + 4 * g)] + [("one", "m1"), (None, "m1"), ("g3", None)]
    inc = spark.createDataFrame(links, "grp string, member string")
    rows = resampling.coherence_null(spark, p, inc, ["concepts", "disciplines"], draws=40, chunk=7).collect()
    assert len(rows) == 82
    by = {(r.draw, r.field): r.value for r in rows}
    for f in ("concepts", "disciplines"):
        seen = aggregates.coherence(inc, p.select("member", F.col(f).alias("items"))).agg(F.avg("coherence")).first()[0]
        assert by[0, f] == pytest.approx(seen, abs=1e-12)
        assert len({round(by[i, f], 12) for i in range(41)}) > 20
    again = resampling.coherence_null(spark, p, inc, ["concepts"], draws=40, chunk=41).collect()
    assert {r.draw: r.value for r in again} == {d: v for (d, f), v in by.items() if f == "concepts"}
    alone = p.withColumn("stratum", F.substring("member", 2, 9).cast("int"))  # one member a stratum: nothing moves
    assert len({r.value for r in resampling.coherence_null(spark, alone, inc, ["concepts"], draws=5).collect()}) == 1
    with pytest.raises(ValueError):
        resampling.coherence_null(spark, p.withColumn("stratum", F.lit(None).cast("int")), inc, ["concepts"])


def test_coherence_null_is_spread(spark):
    from pyspark.sql import functions as F

    from ledgerloom.operators import aggregates

    items = [[f"w{j}" for j in range(i % 7)] + [f"r{(i * k) % 997}" for k in range(1, i % 5)] for i in range(900)]
    p = spark.createDataFrame([(i, 2000 + i % 3, sorted(set(x)), [f"d{i % 4}"]) for i, x in enumerate(items)], "member int, stratum int, concepts array<string>, disciplines array<string>")
    inc = spark.createDataFrame([(f"g{g}", i) for g in range(4) for i in range(g, 900, g * g + 1)] + [("few", 3), ("few", 10), ("few", 11)], "grp string, member int")
    out = resampling.coherence_null(spark, p, inc, ["concepts", "disciplines"], draws=39)
    for f in ("concepts", "disciplines"):  # a group in tables with items too rare for them, and one in runs
        seen = aggregates.coherence(inc, p.select("member", F.col(f).alias("items"))).agg(F.avg("coherence")).first()[0]
        assert out.where((F.col("field") == f) & (F.col("draw") == 0)).first().value == pytest.approx(seen, abs=1e-12)
    sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    copies = 2 * spark.sparkContext.defaultParallelism
    assert sizes == [2 * 40 // copies] * copies  # all draws, as many in each task; the tables are sent no more often than that


def test_coherence_null_of_nothing(spark):
    p = spark.createDataFrame([(i, 2000, [], ["a"] if i == 5 else []) for i in range(6)], "member int, stratum int, concepts array<string>, disciplines array<string>")
    inc = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), ("h", 4), ("h", 5)], "grp string, member int")
    assert [r.value for r in resampling.coherence_null(spark, p, inc, ["concepts", "disciplines"], draws=3).collect()] == [0.0] * 8
    alone = resampling.coherence_null(spark, p, inc.where("member = 1"), ["concepts"], draws=3).collect()
    assert len(alone) == 4 and all(r.value is None for r in alone)  # no group of two


def test_permutation_query(spark, data):
    from ledgerloom.plans import core_queries

    rows = {r.field: r for r in core_queries.QUERIES["stat_permutation"](spark, data).collect()}
    for f in ("concepts", "disciplines"):
        seen = [r.coherence for r in core_queries.QUERIES[f"agg_hub_coherence_{f}"](spark, data).collect() if r.coherence is not None]
        assert rows[f].observed == pytest.approx(sum(seen) / len(seen), abs=1e-6)
        assert rows[f].q025 <= rows[f].null_mean <= rows[f].q975 and 0 < rows[f].p <= 1
        assert abs(rows[f].p * 10_001 - round(rows[f].p * 10_001)) < 1e-6


def test_controls(spark):
    p = spark.createDataFrame([(f"t{i}", "s", "d1" if i < 6 else "d2") for i in range(10)] + [("t99", "empty", "d1")], "trial string, stratum string, domain string")
    c = spark.createDataFrame([(f"c{i}", "s", "d1" if i < 3 else "d3") for i in range(8)], "control string, stratum string, domain string")
    out = {r.trial: (r.control, r.same_domain) for r in resampling.matched_controls(spark, p, c).collect()}
    used = [v[0] for v in out.values() if v[0]]
    assert len(out) == 11 and len(used) == len(set(used)) == 8
    assert sum(v[1] is True for v in out.values()) == 3 and out["t99"] == (None, None)


def test_calculator():
    assert evaluate("2 + 3 * 4") == 14 and evaluate("sqrt(16) - -1") == 5 and evaluate("sum([1, 2, 3.5])") == Decimal("6.5")
    assert evaluate("dot([1, 2], [3, 4]) / max(2, 4)") == Decimal("2.75") and len(str(evaluate("1 / 3"))) == 36
    for bad in ("__import__('os')", "1 / 0", "2 ** 5000", "a", "[1]", "1 +", "True", "'x'", "1" * 500):
        with pytest.raises(ValueError):
            evaluate(bad)
