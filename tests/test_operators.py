"""Operators without SQL against brute force, invariants, and plan shapes."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates, chains, documents, graph, tensor, vectors
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import last_before, rank_in_group, ranged


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(90):03d}", f"n{rng.randrange(90):03d}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)]
    df = spark.createDataFrame([(a, "p", b) for a, b in edges], "s string, p string, o string")
    got = {r.path: r.component for r in graph.components(spark, df).collect()}
    assert got == union_find(edges)


def test_components_empty(spark):
    assert graph.components(spark, spark.createDataFrame([], "s string, p string, o string")).count() == 0


def test_attach_common_titles(spark):
    nodes = [(f"p/{i:03d}", "Bolt", "entity") for i in range(300)] + [("p/x", "bOlt", "hub"), ("p/one", "Nut", "entity"), (None, "Nut", "entity"), ("p/y", None, "entity")]
    delta = [(1, "bolt", "entity"), (2, "BOLT", "hub"), (3, "nut", "entity"), (4, None, "entity"), (5, "pin", "entity"), (6, "nut", "entity"), (6, "NUT", "entity")]
    out = graph.attach(spark.createDataFrame(delta, "delta_id long, name string, type string"), spark.createDataFrame(nodes, "path string, title string, type string"))
    got = {r.delta_id: (r.n_matches, r.decision, r.path) for r in out.collect()}
    assert got == {1: (300, "abstain", None), 2: (1, "reuse", "p/x"), 3: (1, "reuse", "p/one"), 4: (0, "create", None), 5: (0, "create", None), 6: (2, "abstain", None)}
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert node.right().nodeName() == "Aggregate"  # a row for each title: the join makes no pairs


def test_chains(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 99), (5, 6), (6, 5), (7, 7)] + [(100 + i, 101 + i) for i in range(50)] + [(150, None)]
    got = {r.id: (r.current, r.hops) for r in chains.follow(spark, spark.createDataFrame(rows, "id bigint, next bigint")).collect()}
    assert got[1] == (3, 2) and got[3] == (3, 0) and got[4] == (99, 1) and got[100] == (150, 50)
    assert got[5] == got[6] == got[7] == (None, None)


def test_order_over_partitions(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", rng.randrange(50), i, rng.random() < 0.4) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t int, k int, m boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    o = ranged(Cuts(spark, "test"), df, "g", "t", "k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert o.select("pid").distinct().count() > 1
    got = rank_in_group(last_before(o, "g", {"prev": (F.col("m"), F.col("k"))}), "g", "place").collect()
    want = {}
    for g, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        last = None
        for i, r in enumerate(part):
            want[r[2]] = (last, i + 1)
            last = r[2] if r[3] else last
    assert {r.k: (r.prev, r.place) for r in got} == want


def test_running_sum_over_partitions(spark):
    from ledgerloom.plans.ordering import running_sum

    rng = random.Random(6)
    rows = [("hot" if i % 2 else None, rng.randrange(9), i, rng.randrange(1, 50)) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.k: (r.used, r.place) for r in running_sum(Cuts(spark, "t"), spark.createDataFrame(rows, "g string, t int, k int, n int"), ["g"], ["t", "k"], "n", "used", "place").collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for g in ("hot", None):
        used = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]), 1):
            used += r[3]
            assert got[r[2]] == (used, place)


def test_coherence_against_pairs(spark):
    rng = random.Random(9)
    sets = {f"m{i}": rng.sample("abcdefgh", rng.randrange(0, 5)) for i in range(40)}
    inc = [(f"g{rng.randrange(5)}", f"m{rng.randrange(45)}") for _ in range(120)] + [("one", "m1"), (None, "m1"), ("g1", None)]
    got = aggregates.coherence(spark.createDataFrame(inc, "grp string, member string"), spark.createDataFrame(list(sets.items()) + [("m1", None)], "member string, items array<string>")).collect()
    for r in got:
        ms = sorted({m for g, m in inc if g == r.grp and m in sets})
        f = [2 * len(set(sets[a]) & set(sets[b])) / (len(sets[a]) + len(sets[b])) if sets[a] or sets[b] else 0 for a, b in itertools.combinations(ms, 2)]
        assert r.n_members == len(ms) and r.n_pairs == len(f)
        assert (r.coherence is None) if not f else abs(r.coherence - sum(f) / len(f)) < 1e-9


def test_statistics_by_hand(spark):
    p = aggregates.kappa(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string"), ["a", "b"]).first()
    assert p.n == 4 and abs(p.agreement - 0.75) < 1e-12 and abs(p.kappa - 0.5) < 1e-12
    one = aggregates.kappa(spark.createDataFrame([("a", "a")], "x string, y string"), ["a", "b"]).first()
    assert one.kappa == 1
    s = aggregates.sign_flip(spark, spark.createDataFrame([(0.5,), (0.25,), (None,), (0.1,)], "value double")).first()
    assert s.n == 3 and abs(s.p - 1 / 8) < 1e-12
    with pytest.raises(ValueError):
        aggregates.sign_flip(spark, spark.range(30).select(F.col("id").cast("double").alias("value")))


def test_tensor_train(spark):
    rng = np.random.default_rng(1)
    cores = [rng.normal(size=s) for s in ((1, 2, 3, 2), (2, 3, 2, 4), (4, 2, 2, 1))]
    full, x, dy = tensor.dense(cores), rng.normal(size=(5, 12)), rng.normal(size=(5, 12))
    assert full.shape == (12, 12) and tensor.parameter_count(cores) == 12 + 48 + 16
    np.testing.assert_allclose(tensor.matvec(cores, x), x @ full.T)
    grads, dx = tensor.gradients(cores, x, dy)
    np.testing.assert_allclose(dx, dy @ full)
    for k, c in enumerate(cores):  # finite differences
        for at in [(0, 0, 0, 0), tuple(n - 1 for n in c.shape)]:
            up = [v.copy() for v in cores]
            up[k][at] += 1e-6
            slope = ((tensor.matvec(up, x) - tensor.matvec(cores, x)) * dy).sum() / 1e-6
            assert abs(slope - grads[k][at]) < 1e-3
    df = spark.createDataFrame([(1, [float(v) for v in x[0]]), (2, None)], "k int, v array<double>")
    got = {r.k: r.y for r in tensor.apply(df, "k", "v", cores).collect()}
    np.testing.assert_allclose(got[1], full @ x[0])
    assert got[2] is None
    with pytest.raises(ValueError):
        tensor.check([np.zeros((2, 1, 1, 1))])


def test_documents(spark):
    text = "# A\nx\n```\n# no\n```\n## B\ny\n# C\n" + "z" * 7000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Tensor x" + " " * 900 + "entropy tensor")], "k int, t string")
    heads = {(r.line, r.level, r.title, r.next_line) for r in documents.outline(df, "k", "t").where("k = 1").collect()}
    assert heads == {(1, 1, "A", 8), (6, 2, "B", 8), (8, 1, "C", None)}
    seg = [tuple(r)[2:] for r in documents.segments(df, "k", "t").where("k = 1").orderBy("segment").collect()]
    assert seg == [(1, 8, len(text) - 7000), (9, 9, 7001)]
    parts = documents.byte_windows(df, "k", "t", 100).orderBy("k", "part").collect()
    assert "".join(r.content for r in parts if r.k == 1) == text and all(len(r.content.encode()) <= 100 for r in parts)
    e = {r.k: r for r in documents.excerpt(df, "k", "t", ["tensor", "entropy"]).collect()}
    assert e[4].n_terms == 2 and e[4].excerpt.startswith("entropy") and e[3].n_terms == 0 and not e[3].truncated


def test_excerpts_against_all_windows(spark):
    rng = random.Random(7)
    wanted, most = ["a", "bb", "cabc", "dddd"], 12
    texts = ["".join(rng.choice("aabbccdd ") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: (r["first"], r.n_terms) for r in documents.excerpt(df, "k", "t", wanted, most).collect()}
    for k, t in enumerate(texts):
        windows = [(-sum(w in t[i : i + most] for w in wanted), i) for i in range(len(t)) if any(t.startswith(w, i) for w in wanted)]
        n, at = min(windows, default=(0, 0))
        assert got[k] == (at if n else 0, -n), (k, t)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)] + [(150, [0.0] * 8), (151, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = vectors.top_k(df, df.where("id % 50 = 0"), 5, rows_per_block=40).collect()
    m = np.array([r[1] for r in rows[:150]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = m @ m[q]
        s[q] = -9
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == list(np.argsort(-s)[:5])
    assert not [r for r in got if r.query_id == 150 or r.id in (150, 151)]


@pytest.mark.parametrize("rows_per_block", [40, 4096])
def test_pairs_between(spark, rows_per_block):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 8))
    m[100:] = m[0] + 0.01 * m[100:]  # near copies: more partners than any fixed number of neighbours
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(120, [0.0] * 8), (121, None)], "id bigint, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    got = {(r.a, r.b): r.score for r in vectors.pairs_between(df, 0.3, 0.9, rows_per_block).collect()}
    want = {(a, b): s[a, b] for a, b in itertools.combinations(range(120), 2) if 0.3 <= s[a, b] < 0.9}
    assert got == pytest.approx(want)
    assert vectors.pairs_between(df, 0.9, rows_per_block=rows_per_block).count() == sum(s[a, b] >= 0.9 for a, b in itertools.combinations(range(120), 2)) >= 210


def test_similar_pairs_cross_labels(spark, data):
    from ledgerloom.plans import core_queries

    label = {r.vec_id: r.label for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label").collect()}
    assert any(label[r.a] != label[r.b] for r in core_queries.QUERIES["id_similar_pairs"](spark, data).collect())


def test_new_groups(spark):
    from ledgerloom.plans.document_queries import _new_groups

    rng = np.random.default_rng(5)
    axes = np.eye(16)
    near = [axes[0] + 0.001 * rng.normal(size=16) for _ in range(30)]  # more than twenty near copies ...
    bridge = [axes[0] + 2 * axes[1], *(axes[1] + 0.001 * rng.normal(size=16) for _ in range(30))]  # ... and a weaker link to as many others
    loose = [axes[k] + axes[k + 1] for k in range(3, 9)]  # a chain
    m = [*near, *bridge, *loose, axes[12], axes[13], axes[13]]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<double>")
    got = _new_groups(spark, df, 0.3).collect()
    u = np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    groups = {}
    for r in got:
        groups.setdefault(r.component, []).append(r)
    assert sorted(len(x) for x in groups.values()) == [6, 61]  # pairs and single vectors are none
    for rows in groups.values():
        ids = [int(r.path) for r in rows]
        mean = np.mean([u[a] @ u[b] for a, b in itertools.combinations(ids, 2)])
        assert all(r.size == len(ids) and r.cohesion == pytest.approx(mean) and r.candidate == (mean >= 0.6) for r in rows)
    tight = _new_groups(spark, df, 0.9).collect()
    assert all(r.candidate for r in tight) and sorted({r["size"] for r in tight}) == [30]


def test_filter_stays_below_limit(spark, data):
    from ledgerloom.plans import core_queries

    plan = core_queries.QUERIES["proj_scope_before_limit"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Limit") < plan.index("Filter")


@pytest.mark.parametrize("name", ["graph_relations", "graph_junction", "join_as_of", "agg_hub_coherence_concepts", "led_reconcile"])
def test_no_cartesian(spark, data, name):
    from ledgerloom.plans import core_queries

    plan = core_queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_row_order_does_not_matter(spark, data):
    from ledgerloom.sources import graph_tables as g

    n, a = g.nodes(spark, data), g.aliases(spark, data)
    one = graph.search(n, a, "Brand#1").collect()
    assert one == graph.search(n.orderBy(F.rand(3)), a.repartition(7), "Brand#1").collect()


def test_search_limits(spark, data):
    from ledgerloom.sources import graph_tables as g

    n, a = g.nodes(spark, data), g.aliases(spark, data)
    assert graph.search(n, a, "order", limit=900).count() == 50
    with pytest.raises(ValueError):
        graph.search(n, a, "")


def test_csv_round_trip(spark, tmp_path):
    from ledgerloom.sources import files

    rows = [(1, ""), (2, None), (3, " a "), (4, 'q"uo"te, and\nline'), (5, "\\"), (6, "null"), (7, '""'), (8, "\\N"), (9, "é\t"), (10, ","), (11, "a\r\nb"), (12, "#x")]
    df = spark.createDataFrame(rows, "k int, t string")
    for compression in ("none", "gzip"):
        files.write_rows(df, str(tmp_path / compression), "csv", compression)
        assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / compression), "k int, t string").collect()) == rows
    (tmp_path / "other.csv").write_text('k,t\n1,\n2,""\n3,x\n')
    assert [r.t for r in files.read_csv(spark, str(tmp_path / "other.csv"), "k int, t string").orderBy("k").collect()] == [None, "", "x"]


def test_shared_folder():
    from ledgerloom.plans import materialise

    class Conf(dict):
        set = dict.__setitem__

    class Context:
        master, applicationId = "spark://x:7077", "a"

    class Other:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        materialise.shared_folder(Other())
    Other.conf["spark.checkpoint.dir"] = "/shared/x/"
    assert materialise.shared_folder(Other()) == "/shared/x/a"
    Other.conf.clear()
    Context.master = "local[2]"
    assert materialise.shared_folder(Other()).endswith("/a")


def test_sources(spark, tmp_path):
    from ledgerloom.sources import files

    (tmp_path / "a.md").write_text("---\ntitle: T\nstatus: current\n---\nbody\n")
    row = files.read_markdown(spark, str(tmp_path)).first()
    assert row.front == {"title": "T", "status": "current"} and row.body == "body\n"
    (tmp_path / "x.jsonl").write_text('{"_table": "n", "a": 1}\n\n{"_table": "m", "a": 2}\n')
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", tag="m").collect()] == [2]
    files.write_rows(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception):
        files.write_rows(spark.range(3), str(tmp_path / "out"))
