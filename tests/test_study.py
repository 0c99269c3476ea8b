"""Identity, memory, reading, trials, tools, stages and cursors on small fixtures."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import documents, graph, identity, resampling, retrieval
from ledgerloom.plans import tools
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import numbered
from ledgerloom.sources import files
from ledgerloom.streaming import events as st


def unit(*angles):
    """Pairs of two-dimensional views from two angles."""
    return [[float(np.cos(a)), float(np.sin(a))] for a in angles]


def test_identity_gate(spark):
    base = [(1, "a", *unit(0.0, 0.0)), (2, "b", *unit(1.0, 1.0)), (3, "c", *unit(2.0, 2.0)), (4, "d", *unit(2.05, 2.05)), (5, "e", *unit(4.0, 4.0)), (6, "f", None, [1.0, 0.0])]
    asked = [(1, "a", *unit(0.1, 0.1)), (2, "x", *unit(1.0, 1.0)), (3, "c", *unit(2.0, 2.0)), (5, "e", *unit(4.0, 4.6)), (7, "g", *unit(5.5, 5.5)), (8, "h", None, None)]
    schema = "id bigint, name string, v1 array<double>, v2 array<double>"
    got = {r.query_id: (r.id, r.decision) for r in identity.gate(spark.createDataFrame(asked, schema), spark.createDataFrame(base, schema)).collect()}
    assert got[1] == (1, "merge")
    assert got[2] == (2, "ambiguous")  # both scores are 1, but the name is no evidence
    assert got[3] == (3, "ambiguous")  # the second is too near
    assert got[5] == (5, "ambiguous")  # one view is not alike enough
    assert got[7][1] == "new" and 8 not in got


def test_bands(spark):
    base = spark.createDataFrame([(i, unit(a)[0]) for i, a in enumerate((0.0, 1.0, 1.1, 3.0))], "id bigint, v array<double>")
    asked = spark.createDataFrame([(0, unit(0.1)[0]), (1, unit(1.04)[0]), (2, unit(3.7)[0]), (3, unit(4.5)[0])], "id bigint, v array<double>")
    got = {r.query_id: (r.id, r.n_sure, r.band) for r in identity.bands(asked, base).collect()}
    assert got == {0: (0, 1, "alias"), 1: (1, 2, "ambiguous"), 2: (3, 0, "similar"), 3: (None, 0, "new")}


def test_split_plan(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.eye(4)[i % 2] + 0.01 * rng.normal(size=4)]) for i in range(20)]
    df = spark.createDataFrame(rows, "k bigint, v array<double>")
    got = identity.split_plan(df, "k", "v").collect()
    assert sorted(r["size"] for r in got) == [10, 10] and all(r.valid and len(r.representatives) == 5 for r in got)
    assert not any(r.valid for r in identity.split_plan(df.where("k < 8"), "k", "v").collect())  # four a side


def test_redistribute(spark):
    m = spark.createDataFrame([("big", f"w{i}") for i in range(5)] + [("s1", "w0"), ("s2", "w0"), ("s2", "x"), ("s1", "w1"), ("s1", "y")], "g string, m string")
    assert {tuple(r) for r in identity.redistribute(m, "g", "m", 3).collect()} == {("big", "w0", "s2"), ("big", "w1", "s1")}


def test_memory(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None), ("b", 2, None)], "subject string, at int, value string")
    assert {r.subject: (r["at"], r.value, r.n_superseded) for r in retrieval.recall(old).collect()} == {"a": (3, "y", 1), "b": (1, None, 0)}
    new = spark.createDataFrame([("a", 4, "y"), ("a", 5, "x"), ("c", 1, "z")], old.schema)
    both = retrieval.remember(old, new)
    assert both.count() == 7 and {r.subject: r.value for r in retrieval.recall(both).collect()} == {"a": "x", "b": None, "c": "z"}


def test_abbreviations(spark):
    texts = ["The Tensor Train (TT) and the full-width half maximum (FWHM).", "tensor-train (TT), Other Thing (QQ)", "Ring Exchange (RE) or Real Entropy (RE)", None, "(ABC) alone"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {tuple(r) for r in documents.abbreviations(df, "t").collect()} == {("TT", "Tensor Train"), ("FWHM", "full-width half maximum")}


def test_reading(spark):
    text = "# A\none\n## B c!\ntwo raw/x.md#L1-L2 raw/x.md#L1-L2\n# D\n" + "z" * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string").where("t is not null")
    got = {r.k: r for r in documents.read_section(docs, "k", "t", "b-c-").collect()}
    assert got[1].body == "two raw/x.md#L1-L2 raw/x.md#L1-L2" and got[1].citations == ["raw/x.md#L1-L2"] and got[3].state == "missing" and got[3].sections == ""
    assert documents.read_section(docs, "k", "t", "nope").where("k = 1").first().sections == "a,b-c-,d"
    sources = spark.createDataFrame([("s", "\n".join(f"line {i:02d}" for i in range(1, 31))), ("long", "x" * 500 + "\ny")], "source string, text string")
    asked = spark.createDataFrame([("s", 2, 3), ("s", 1, 99), ("s", 31, 40), ("s", 0, 2), ("s", 5, 4), ("none", 1, 1), ("s", 30, 99), ("long", 1, 2)], "source string, first_line int, last_line int")
    r = {(x.source, x.first_line, x.last_line): x for x in documents.read_raw(asked, sources, most=40, offered=3).collect()}
    assert r["s", 2, 3].body == "line 02\nline 03" and r["s", 30, 99].body == "line 30"
    assert {k: x.state for k, x in r.items() if x.state.startswith("no")} == {("s", 31, 40): "no lines", ("s", 0, 2): "no lines", ("s", 5, 4): "no lines", ("none", 1, 1): "no source"}
    parts = r["s", 1, 99].ranges
    assert r["s", 1, 99].body is None and [(x.first, x.last, x.rest) for x in parts] == [(1, 5, False), (6, 10, False), (11, 15, False), (16, 30, True)]
    assert [(x.first, x.last, x.rest) for x in r["long", 1, 2].ranges] == [(1, 1, False), (2, 2, False)]


def test_byte_windows_cut_no_character(spark):
    text = "é漢😀a\n" * 700 + "x" * 90
    for most in (5, 64, 2400):
        parts = documents.byte_windows(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", most).orderBy("part").collect()
        assert "".join(p.content for p in parts) == text and max(len(p.content.encode()) for p in parts) <= most


def test_graph_rules(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("d", "p", "e"), ("a", "p", "c"), ("x", "similar", "y"), ("z", "p", "z")], "s string, p string, o string")
    assert {tuple(r) for r in graph.ancestors(graph.shown(e), 3).where("node = 'a'").collect()} == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3)}
    assert graph.shown(e).count() == 6 and graph.shown(e, True).count() == 7
    pairs = spark.createDataFrame([("e", "a"), ("a", "x"), ("x", "y"), ("z", "z"), ("q", "q")], "a string, b string")
    assert {(r.a, r.b): r.exists for r in graph.connected(spark, e, pairs).collect()} == {("e", "a"): True, ("a", "x"): False, ("x", "y"): True, ("z", "z"): True, ("q", "q"): False}
    chain = spark.createDataFrame([(f"n{i:04d}", "p", f"n{i + 1:04d}") for i in range(120)], e.schema)
    assert {r.component for r in graph.components(spark, chain).collect()} == {"n0000"}
    assert graph.reachable(spark, chain, spark.createDataFrame([("n0060",)], "path string")).count() == 61  # however far


def test_numbered(spark):
    rows = [(None if i % 3 == 0 else "g", i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, h int, k int")
    got = {r.k: r.place for r in numbered(Cuts(spark, "t"), df, ["g"], ["h", "k"], "place").collect()}
    for g in (None, "g"):
        assert [got[k] for _, _, k in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])] == list(range(1, sum(r[0] == g for r in rows) + 1))


def test_trials(spark):
    rows = [(f"d{h % 2}/h{h}", f"p{p}", 2000 + p % 10) for h in range(6) for p in range(h, 60, h + 2)] + [("d0/h0", None, 2001), (None, "p1", 2001), ("d0/h0", "p2", None)]
    got = resampling.trials(spark, spark.createDataFrame(rows, "hub string, paper_id string, year int"), most=4).collect()
    has = {(h, p) for h, p, _ in rows}
    assert len(got) == 24 and {r.true_position for r in got} == {"A", "B"}
    for r in got:
        paper, control = (r.option_a, r.option_b) if r.true_position == "A" else (r.option_b, r.option_a)
        assert (r.hub, paper) in has and (control is None or (r.hub, control) not in has)
        assert control is None or int(control[1:]) % 10 // 5 == int(paper[1:]) % 10 // 5 or "p2" in (paper, control)
    assert sum(r.option_a is not None and r.option_b is not None for r in got) > 12


def test_controls_used_again(spark):
    p = spark.createDataFrame([(f"t{i}", "s", "d") for i in range(10)] + [("u", "empty", "d")], "trial string, stratum string, domain string")
    c = spark.createDataFrame([(f"c{i}", "s", "e") for i in range(4)], "control string, stratum string, domain string")
    got = {r.trial: r for r in resampling.matched_controls(spark, p, c, reuse=True).collect()}
    assert len(got) == 11 and got["u"].control is None and sum(r.reused for r in got.values()) == 6
    assert max(sum(r.control == f"c{i}" for r in got.values()) for i in range(4)) == 3


def test_tools(spark, data):
    box = tools.Toolbox(tools.STANDARD)
    assert len(box.call(spark, data, "graph_search", {"term": "Brand#1", "topk": 3}, rows=50)) == 3
    for name, bad in (("graph_search", {}), ("graph_search", {"term": ""}), ("graph_search", {"term": "x", "topk": 51}), ("graph_search", {"term": "x", "topk": True}), ("graph_search", {"term": "x", "more": 1}), ("graph_search", {"term": 3}), ("nothing", {})):
        with pytest.raises(tools.Refused):
            box.call(spark, data, name, bad)
    section = box.call(spark, data, "read_section", {"page": 1, "slug": "content"}, rows=1)
    assert section[0].state in ("found", "missing")
    seen = []
    box.hooks.pre.append(lambda tool, a: seen.append(tool.name))
    box.hooks.around.append(lambda tool, call: lambda: call().limit(2))
    box.hooks.post.append(lambda tool, result: [r.path for r in result])
    assert len(box.call(spark, data, "graph_search", {"term": "Brand#1"}, rows=50)) == 2 and seen == ["graph_search"]

    def deny(tool, arguments):
        raise tools.Refused("not now")

    box.hooks.pre.append(deny)
    with pytest.raises(tools.Refused):
        box.call(spark, data, "graph_search", {"term": "x"})
    with pytest.raises(ValueError):
        box.add(tools.STANDARD[0])


def test_deadline(spark):
    slow = F.udf(lambda i: __import__("time").sleep(0.2) or i, "bigint")
    with pytest.raises(tools.Overdue):
        tools.within(spark, 1.0, lambda: spark.range(0, 400, 1, 4).select(slow("id")).collect())
    assert tools.within(spark, 60.0, lambda: spark.range(3).count()) == 3


def test_stage(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    for want in (False, True):
        out, reused = files.stage(spark, str(tmp_path), "x", build)
        assert reused is want and out.count() == 5
    part = next(p for p in sorted(os.listdir(tmp_path / "x")) if p.endswith(".parquet"))
    os.remove(tmp_path / "x" / f".{part}.crc")
    with open(tmp_path / "x" / part, "ab") as f:
        f.write(b"!")
    assert files.stage(spark, str(tmp_path), "x", build)[1] is False  # a changed file
    os.remove(tmp_path / "x.hashes" / "_SUCCESS")
    assert files.stage(spark, str(tmp_path), "x", build)[1] is False and len(built) == 3  # a stage that broke off


def stream(spark, folder, files_per_batch=1):
    return spark.readStream.schema("user_id bigint, event_id bigint, ts timestamp, event_type string, value double").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    at = dt.datetime(2024, 1, 1)
    for k in range(3):  # three files, so three batches
        rows = [(i % 3, 10 * k + i, at + dt.timedelta(hours=k, minutes=5 * i), "buy" if i % 2 else "view", 4.0) for i in range(10)]
        spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_batches_of_a_stream(spark, batches):
    got = {(r.start.hour, r.event_type): r.n for r in st.run(st.tumbling(stream(spark, batches)), "update", ("start", "event_type")).collect()}
    assert got == {(h, e): 5 for h in range(3) for e in ("buy", "view")}
    seen = {r.user_id: r.n for r in st.run(st.observed(stream(spark, batches)), "update", ("user_id",)).collect()}
    assert seen == {0: 12, 1: 9, 2: 9}


def test_cursors(spark, batches):
    calls = []

    def handle(df, k):
        calls.append(k)
        return df.where("event_type = 'buy' and event_id >= 20").select("event_type").distinct()  # the last batch fails for one domain

    got = {r.domain: (r.cursor.hour, r.n) for r in st.cursors(stream(spark, batches), "event_type", "ts", handle).collect()}
    assert calls == [0, 1, 2] and got == {"view": (2, 15), "buy": (1, 10)}


def test_budget_stops_for_good(spark, batches):
    rows = st.run(st.budget(stream(spark, batches), 20.0), "append").collect()
    spent = {}
    for r in rows:
        spent.setdefault(r.user_id, []).append(r.spent)
    assert {u: (len(v), max(v)) for u, v in spent.items()} == {0: (5, 20.0), 1: (5, 20.0), 2: (5, 20.0)}


def test_table_functions(spark):
    from ledgerloom.functions import registered

    registered.register(spark)
    spark.createDataFrame([("# A\n```\n# no\n```\n## B ",), (None,)], "t string").createOrReplaceTempView("loom_texts")
    assert [tuple(r) for r in spark.sql("SELECT o.* FROM loom_texts, LATERAL loom_outline(t) o ORDER BY line").collect()] == [(1, 1, "A"), (5, 2, "B")]
    assert [tuple(r) for r in spark.sql("SELECT o.* FROM loom_texts, LATERAL loom_lines(t, 0, 2) o ORDER BY line").collect()] == [(1, "# A"), (2, "```")]
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string")
    assert abs(df.groupBy().agg(registered.loom_kappa("x", "y").alias("k")).first().k - 0.5) < 1e-12


def test_paged():
    from ledgerloom.sources import paged

    def fetch(request, cursor, size):
        at = int(cursor or 0)
        return [str(i) for i in range(at, min(int(request), at + size))], str(at + size) if at + size < int(request) else None

    get = lambda n, **limits: [(r[2], r[4]) for r in paged.fetch_all(fetch, str(n), **limits)]
    assert get(0) == [] and get(3) == [(0, False), (1, False), (2, False)]
    assert get(20, page=10, pages=2)[-1] == (19, False) and get(21, page=10, pages=2)[-1] == (19, True)
    assert get(25, page=10, rows=12)[-1] == (11, True) and len(get(25, page=10, rows=12)) == 12 and get(12, page=10, rows=12)[-1] == (11, False)
    with pytest.raises(ValueError):
        list(paged.fetch_all(lambda r, c, s: (["x"], "again"), "r"))
    with pytest.raises(ValueError):
        paged.read_paged(None, "x", fetch, [], page=201)


def test_raster(spark):
    from ledgerloom.operators import raster

    picture = ["##..#", "...#.", "#....", "....#", "#...#"]
    px = spark.createDataFrame([("a", x, y) for y, row in enumerate(picture) for x, c in enumerate(row) if c == "#"] + [("b", 0, 0), ("b", 0, 0), ("b", -1, -1)], "image string, x int, y int")
    got = {(r.image, r.n, r.first_x, r.last_x, r.first_y, r.last_y) for r in raster.regions(spark, px.where("image = 'a'")).collect()}
    assert got == {("a", 2, 0, 1, 0, 0), ("a", 2, 3, 4, 0, 1), ("a", 1, 0, 0, 2, 2), ("a", 1, 0, 0, 4, 4), ("a", 2, 4, 4, 3, 4)}
    bands = {(r.image, r.band, r["first"], r["last"], r.n) for r in raster.column_bands(px.where("image = 'a'")).collect()}
    assert bands == {("a", 0, 0, 1, 4), ("a", 1, 3, 4, 4)}
    c = spark.createDataFrame([(3.0, 4.0)], "r double, g double").select(raster.colour_distance([F.col("r"), F.col("g")], [0, 0]).alias("d"))
    assert c.first().d == 5.0


def test_navigation_and_more_channels(spark):
    pages = spark.createDataFrame([(1, "Tensor train", "x", "s1", "d", "current"), (2, "Train tensor", "x", "s2", "d", "current"), (3, "Other", "y", "s3", "d", "current"), (4, "Tensor train old", "x", "s4", "d", "deprecated")], "id bigint, title string, text string, source string, domain string, status string")
    aliases = spark.createDataFrame([("tensor train decomposition", 3)], "alias string, id bigint")
    edges = spark.createDataFrame([(2, 3), (3, 1), (3, 4)], "a bigint, b bigint")
    nav = lambda q: [(r.id, r.place, r.how) for r in retrieval.navigation(pages, aliases, edges, retrieval.Request(q)).orderBy("place").collect()]
    assert nav("tensor train") == [(1, 1, "name"), (3, 2, "name")]
    assert nav("train of something") == [(3, 1, "graph")]  # linked to the two pages with a word of it; the old page is out of scope
    lane = spark.createDataFrame([(3, 1), (4, 2)], "id bigint, place int")
    results, channels = retrieval.hybrid(pages, retrieval.Request("tensor train"), more={"vector": lane, "none": lane.limit(0)})
    assert {r.id for r in results.collect()} == {1, 2, 3} and {r.channel: r.n_candidates for r in channels.collect()} == {"lexical": 0, "title": 2, "vector": 1, "none": 0}


def test_stored_graph_and_context(spark, tmp_path):
    from ledgerloom.sources import graph_tables

    n = spark.createDataFrame([("a", "A", "page", "current")], "path string, title string, type string, status string")
    e = spark.createDataFrame([("a", "cites", "b", "traceable"), ("c", "in", "a", "traceable")], "s string, p string, o string, confidence string")
    al = spark.createDataFrame([("x", "a")], "alias string, node_path string")
    graph_tables.write_graph(str(tmp_path / "g"), n, e, al)
    back = graph_tables.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back["edges"].collect())) == sorted(map(tuple, e.collect())) and back["nodes"].count() == 1
    with pytest.raises(Exception):
        graph_tables.write_graph(str(tmp_path / "g"), n, e, al)
    found = graph.search(n, al, "x")
    assert {(r.direction, r.other) for r in graph.context(e, found, "h", "h").collect()} == {("out", "b"), ("in", "c")}
    with pytest.raises(ValueError):
        graph.context(e, found, "h", "i")
