"""Registered graph queries over the derived graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import graph, raster
from ledgerloom.plans.materialise import shared_folder
from ledgerloom.plans.registry import SQL, query
from ledgerloom.sources import files
from ledgerloom.sources import graph_tables as g
from ledgerloom.sources.tables import load

WITH = f"WITH {g.NODES_SQL}, {g.EDGES_SQL}"
FAMILY = "CASE WHEN split_part(o, '/', 1) IN ('nation', 'region') THEN 'aggregation' WHEN p IN ('cites') THEN 'evidence' WHEN p IN ('placed_by', 'supplied_by') THEN 'lineage' ELSE 'semantic' END"


def family():
    """Predicate family: a hub at the end makes it aggregation, else the predicate decides."""
    hub = F.split("o", "/")[0].isin("nation", "region")
    return F.when(hub, "aggregation").when(F.col("p") == "cites", "evidence").when(F.col("p").isin("placed_by", "supplied_by"), "lineage").otherwise("semantic")


@query(
    f"""WITH {g.NODES_SQL}, t AS (
  SELECT path, title AS text FROM nodes WHERE status <> 'deprecated'
  UNION ALL SELECT 'part/' || p_partkey, p_brand FROM part
  UNION ALL SELECT path, path FROM nodes WHERE status <> 'deprecated'),
 r AS (SELECT path, min(CASE WHEN lower(text) = 'brand#1' THEN 0 WHEN starts_with(lower(text), 'brand#1') THEN 1 WHEN contains(lower(text), 'brand#1') THEN 2 END) AS tier FROM t GROUP BY path)
 SELECT path, tier FROM r WHERE tier IS NOT NULL ORDER BY tier, path LIMIT 50"""
)
def graph_search(spark, d):
    """Literal search over titles, aliases and paths, ranked by tier."""
    return graph.search(g.nodes(spark, d), g.aliases(spark, d), "Brand#1")


@query(
    WITH + """, seeds AS (SELECT 'customer/' || c_custkey AS path FROM customer WHERE c_mktsegment = 'BUILDING')
 SELECT path AS node, 'out' AS direction, p, o AS other FROM edges JOIN seeds ON s = path
 UNION ALL SELECT path, 'in', p, s FROM edges JOIN seeds ON o = path"""
)
def graph_relations(spark, d):
    """In and out edges of a set of nodes."""
    seeds = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"))
    return graph.relations(g.edges(spark, d), seeds)


@query(WITH + f" SELECT {FAMILY} AS family, p, confidence, count(*) AS n FROM edges GROUP BY ALL")
def graph_families(spark, d):
    """Edges by predicate family, derived from predicate and end type."""
    return g.edges(spark, d).groupBy(family().alias("family"), "p", "confidence").agg(F.count("*").alias("n"))


@query(
    WITH + """, seeds AS (SELECT DISTINCT 'supplier/' || s_suppkey AS path FROM supplier WHERE s_acctbal < 0),
 both_ AS (SELECT s AS a, o AS b FROM edges UNION ALL SELECT o, s FROM edges),
 h1 AS (SELECT DISTINCT b AS path FROM both_ JOIN seeds ON a = path WHERE b NOT IN (SELECT path FROM seeds)),
 h2 AS (SELECT DISTINCT b AS path FROM both_ JOIN h1 ON a = path WHERE b NOT IN (SELECT path FROM seeds) AND b NOT IN (SELECT path FROM h1))
 SELECT path, 0 AS hop FROM seeds UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2"""
)
def graph_neighbours(spark, d):
    """Breadth-first neighbourhood of depth two, without budget."""
    seeds = load(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("path"))
    return graph.neighbours(spark, g.edges(spark, d), seeds, 2).select("path", "hop")


def _hop(k: int) -> str:
    seen = " UNION ALL ".join(f"SELECT path FROM h{i}" for i in range(k))
    return f"""f{k} AS (SELECT b AS path, count(*) AS links FROM both_ JOIN h{k - 1} ON a = h{k - 1}.path WHERE b NOT IN ({seen}) GROUP BY b),
 h{k} AS (SELECT path, (SELECT count(*) FROM f{k}) > 100 AS truncated FROM f{k} ORDER BY links DESC, path LIMIT 100)"""


@query(
    WITH + f""", h0 AS (SELECT DISTINCT 'supplier/' || s_suppkey AS path, false AS truncated FROM supplier WHERE s_acctbal < 0), both_ AS (SELECT s AS a, o AS b FROM edges UNION ALL SELECT o, s FROM edges),
 {_hop(1)}, {_hop(2)}, {_hop(3)} SELECT path, 0 AS hop, truncated FROM h0 UNION ALL SELECT path, 1, truncated FROM h1 UNION ALL SELECT path, 2, truncated FROM h2 UNION ALL SELECT path, 3, truncated FROM h3"""
)
def graph_neighbours_budget(spark, d):
    """The same with a node budget for each hop, and whether it cut something off."""
    seeds = load(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("path"))
    return graph.neighbours(spark, g.edges(spark, d), seeds, 3, budget=100)


@query(WITH + " SELECT n.path AS hub, e.p, count(*) AS n_members FROM edges e JOIN nodes n ON e.o = n.path WHERE n.type = 'hub' GROUP BY n.path, e.p")
def graph_hub_of(spark, d):
    """Hubs by the edges that lead to them."""
    hubs = g.nodes(spark, d).where("type = 'hub'").select("path")
    e = g.edges(spark, d)
    return e.join(hubs, e.o == hubs.path).groupBy(F.col("path").alias("hub"), "p").agg(F.count("*").alias("n_members"))


@query(
    WITH + """, r1 AS (SELECT DISTINCT o AS path FROM edges WHERE s IN (SELECT 'order/' || o_orderkey FROM orders WHERE o_orderstatus = 'P')),
 r2 AS (SELECT DISTINCT o AS path FROM edges JOIN r1 ON s = path), r3 AS (SELECT DISTINCT o AS path FROM edges JOIN r2 ON s = path), r4 AS (SELECT DISTINCT o AS path FROM edges JOIN r3 ON s = path)
 SELECT path FROM (SELECT 'order/' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'P' UNION SELECT path FROM r1 UNION SELECT path FROM r2 UNION SELECT path FROM r3 UNION SELECT path FROM r4) u"""
)
def graph_reachable(spark, d):
    """Everything that directed edges reach from the open orders."""
    seeds = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return graph.reachable(spark, g.edges(spark, d), seeds)


@query(f"WITH {g.FACTS_SQL} SELECT subject, object FROM facts WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_until IS NULL OR TIMESTAMP '1998-01-01' < valid_until)")
def graph_as_of(spark, d):
    """Facts valid at a time."""
    return graph.as_of(g.facts(spark, d), F.lit("1998-01-01").cast("timestamp")).select("subject", "object")


def components_sql(where: str) -> str:
    """path and component of the nodes of some edges: the smallest label of a neighbour is taken over until none is smaller."""
    return f"""WITH RECURSIVE {g.EDGES_SQL}, e AS (SELECT s, o FROM edges WHERE {where}), b AS MATERIALIZED (SELECT s AS a, o AS b FROM e UNION SELECT o, s FROM e UNION SELECT s, s FROM e UNION SELECT o, o FROM e),
 cc(path, component) USING KEY (path) AS (SELECT a, min(b) FROM b GROUP BY a UNION SELECT b.b, min(cc.component) FROM cc JOIN b ON b.a = cc.path JOIN recurring.cc AS r ON r.path = b.b WHERE cc.component < r.component GROUP BY b.b)"""


@query(components_sql("true") + " SELECT path, component FROM cc")
def graph_components(spark, d):
    """Connected components of the undirected graph (G9); checked against union-find in the tests."""
    return graph.components(spark, g.edges(spark, d))


@query(WITH + ", admitted AS (SELECT * FROM nodes WHERE status <> 'deprecated') SELECT DISTINCT s, p, o, m AS missing FROM (SELECT s, p, o, unnest([s, o]) AS m FROM edges) x WHERE m NOT IN (SELECT path FROM admitted)")
def graph_dangling(spark, d):
    """Edges whose end is not among the admitted nodes."""
    return graph.dangling(g.nodes(spark, d).where("status <> 'deprecated'"), g.edges(spark, d))


@query(
    WITH + """, e2 AS (SELECT s, p, o FROM edges UNION ALL SELECT o, 'contains', s FROM edges WHERE p = 'in' AND s LIKE 'nation/%')
 SELECT x.s, x.p, x.o FROM e2 x JOIN e2 y ON x.s = y.o AND x.o = y.s AND x.p = 'in' AND y.p = 'contains'"""
)
def graph_redundant(spark, d):
    """Edges stored together with their inverse."""
    e = g.edges(spark, d).select("s", "p", "o")
    back = e.where((F.col("p") == "in") & F.startswith("s", F.lit("nation/"))).select(F.col("o").alias("s"), F.lit("contains").alias("p"), F.col("s").alias("o"))
    return graph.redundant(e.unionByName(back), {"in": "contains"})


@query(
    WITH + """ SELECT 'ERROR' AS level, 'type' AS rule, path AS item FROM nodes WHERE type NOT IN ('entity', 'people', 'page', 'hub')
 UNION ALL SELECT 'ERROR', 'confidence', s || ' ' || o FROM edges WHERE confidence NOT IN ('traceable', 'inferred')
 UNION ALL SELECT 'WARN', 'title repeated', title FROM nodes WHERE type = 'entity' GROUP BY title HAVING count(*) > 1"""
)
def graph_validation(spark, d):
    """Schema rules, each a query for its violations."""
    n, e = g.nodes(spark, d), g.edges(spark, d)
    types = n.where(~F.col("type").isin("entity", "people", "page", "hub")).select(F.lit("ERROR").alias("level"), F.lit("type").alias("rule"), F.col("path").alias("item"))
    sure = e.where(~F.col("confidence").isin("traceable", "inferred")).select(F.lit("ERROR"), F.lit("confidence"), F.concat_ws(" ", "s", "o"))
    twice = n.where("type = 'entity'").groupBy("title").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("WARN"), F.lit("title repeated"), "title")
    return types.union(sure).union(twice)


@query(
    """WITH pairs AS (SELECT 'part/' || l_partkey AS a, 'supplier/' || l_suppkey AS b, count(*) AS score FROM lineitem GROUP BY ALL),
 ends AS (SELECT a, b, score, unnest([a, b]) AS e FROM pairs),
 r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, a, b) AS place FROM ends)
 SELECT a, b, score FROM r WHERE place <= 5 GROUP BY a, b, score HAVING count(*) = 2"""
)
def graph_degree_cap(spark, d):
    """Symmetric edges that are among the five best of both ends."""
    pairs = load(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("b")).agg(F.count("*").alias("score"))
    return graph.cap_degree(pairs, 5)


@query(
    WITH + """ SELECT c.s AS node, c.o AS parent, n.o AS grandparent FROM edges c LEFT JOIN edges n ON c.o = n.s AND n.p = 'in' WHERE c.p = 'in'"""
)
def graph_ancestors(spark, d):
    """Parents and grandparents; graph_blood has three generations."""
    up = g.edges(spark, d).where("p = 'in'").select("s", "o")
    return up.alias("c").join(up.alias("n"), F.col("c.o") == F.col("n.s"), "left").select(F.col("c.s").alias("node"), F.col("c.o").alias("parent"), F.col("n.o").alias("grandparent"))


@query(
    WITH + """, m AS (SELECT 'supplier/' || s_suppkey AS path, 'supplier/' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS into_ FROM supplier),
 e AS (SELECT coalesce(a.into_, s) AS s, p, coalesce(b.into_, o) AS o, s = o AS loop FROM edges LEFT JOIN m a ON s = a.path LEFT JOIN m b ON o = b.path)
 SELECT s, p, o, count(*) AS n_origins FROM e WHERE s <> o OR loop GROUP BY s, p, o"""
)
def graph_merge(spark, d):
    """Suppliers of a nation merged into one node, equal edges folded."""
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    mapping = load(spark, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("supplier/"), first.cast("string")).alias("into"))
    return graph.merge_nodes(g.edges(spark, d), mapping)


@query(
    """WITH e AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS edge_id FROM lineitem), o AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS edge_id, l_orderkey AS page FROM lineitem),
 gone AS (SELECT o_orderkey AS page FROM orders WHERE o_orderstatus <> 'O')
 SELECT edge_id FROM e WHERE edge_id IN (SELECT edge_id FROM o WHERE page NOT IN (SELECT page FROM gone)) OR edge_id NOT IN (SELECT edge_id FROM o)"""
)
def graph_retraction(spark, d):
    """Edges that survive when pages are retracted."""
    origins = load(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey").select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("edge_id"), F.col("l_orderkey").alias("page")).distinct()
    gone = load(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("page"))
    return graph.retract(origins.select("edge_id").distinct(), origins, gone)


@query(
    f"""WITH {g.NODES_SQL}, delta AS (SELECT p_partkey AS delta_id, upper(p_name) AS name, 'entity' AS type FROM part UNION ALL SELECT 1000000000 + s_suppkey, s_name, 'institution' FROM supplier UNION ALL SELECT 2000000000 + n_nationkey, n_name, 'entity' FROM nation),
 m AS (SELECT delta_id, count(path) AS n_matches, min(path) AS f FROM delta LEFT JOIN nodes n ON lower(name) = lower(title) AND delta.type = n.type GROUP BY delta_id)
 SELECT delta_id, n_matches, CASE WHEN n_matches = 1 THEN 'reuse' WHEN n_matches > 1 THEN 'abstain' ELSE 'create' END AS decision, CASE WHEN n_matches = 1 THEN f END AS path FROM m"""
)
def graph_attach(spark, d):
    """Plan for attaching a delta: reuse, abstain or create."""
    delta = load(spark, d, "part").select(F.col("p_partkey").alias("delta_id"), F.upper("p_name").alias("name"), F.lit("entity").alias("type"))
    delta = delta.union(load(spark, d, "supplier").select(F.col("s_suppkey") + F.lit(1000000000), "s_name", F.lit("institution")))
    delta = delta.union(load(spark, d, "nation").select((F.col("n_nationkey") + F.lit(2000000000).cast("bigint")), "n_name", F.lit("entity")))
    return graph.attach(delta, g.nodes(spark, d))


@query(
    WITH + """, deg AS (SELECT path, count(*) AS degree FROM (SELECT s AS path FROM edges UNION ALL SELECT o FROM edges) u GROUP BY path),
 top AS (SELECT path FROM deg ORDER BY degree DESC, path LIMIT 300)
 SELECT s, p, o FROM edges WHERE s IN (SELECT path FROM top) AND o IN (SELECT path FROM top)"""
)
def graph_overview(spark, d):
    """The subgraph of the nodes of highest degree, for display."""
    e = g.edges(spark, d)
    degree = e.select(F.explode(F.array("s", "o")).alias("path")).groupBy("path").agg(F.count("*").alias("degree"))
    top = degree.orderBy(F.desc("degree"), "path").limit(300).select("path")
    return e.join(top, e.s == top.path, "left_semi").join(top, F.col("o") == top.path, "left_semi").select("s", "p", "o")


@query(
    WITH + """, seeds AS (SELECT 'region/' || r_regionkey AS path FROM region WHERE r_name = 'ASIA'),
 d1 AS (SELECT DISTINCT s AS path FROM edges JOIN seeds ON o = path), d2 AS (SELECT DISTINCT s AS path FROM edges JOIN d1 ON o = path)
 SELECT path, 'direct' AS relation FROM d1 UNION ALL SELECT path, 'related' FROM d2 WHERE path NOT IN (SELECT path FROM d1)"""
)
def graph_impact(spark, d):
    """What depends on a changed node, directly or over one more step."""
    e = g.edges(spark, d)
    seeds = load(spark, d, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("path"))
    direct = e.join(seeds, e.o == seeds.path).select(F.col("s").alias("path")).distinct()
    more = e.join(direct, e.o == direct.path).select(F.col("s").alias("path")).distinct().join(direct, "path", "left_anti")
    return direct.withColumn("relation", F.lit("direct")).unionByName(more.withColumn("relation", F.lit("related")))


@query(
    WITH + """, i AS (SELECT o AS path, count(*) AS n FROM edges GROUP BY o), u AS (SELECT s AS path, count(*) AS n FROM edges GROUP BY s)
 SELECT nodes.path, coalesce(i.n, 0) AS n_in, coalesce(u.n, 0) AS n_out, coalesce(i.n, 0) = 0 AS orphan, coalesce(i.n, 0) + coalesce(u.n, 0) = 0 AS isolated FROM nodes LEFT JOIN i ON nodes.path = i.path LEFT JOIN u ON nodes.path = u.path"""
)
def graph_degrees(spark, d):
    """In and out degree, orphans and isolated nodes."""
    e = g.edges(spark, d)
    ends = e.select(F.col("s").alias("path"), F.lit(1).alias("o_"), F.lit(0).alias("i_")).union(e.select("o", F.lit(0), F.lit(1)))
    deg = ends.groupBy("path").agg(F.sum("i_").alias("n_in"), F.sum("o_").alias("n_out"))
    z = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = g.nodes(spark, d).select("path").join(deg, "path", "left").select("path", z("n_in").alias("n_in"), z("n_out").alias("n_out"))
    return out.withColumns({"orphan": F.col("n_in") == 0, "isolated": F.col("n_in") + F.col("n_out") == 0})


@query(
    f"WITH {g.EDGES_SQL} SELECT a.s AS first_node, b.s AS second_node, count(*) AS n_shared FROM edges a JOIN edges b ON a.o = b.o AND a.p = b.p AND a.s < b.s WHERE a.p = 'in' AND a.s LIKE 'supplier/%' AND b.s LIKE 'supplier/%' GROUP BY a.s, b.s"
)
def graph_junction(spark, d):
    """Pairs of suppliers that meet in a nation: a two-hop junction over a shared end."""
    e = g.edges(spark, d).where((F.col("p") == "in") & F.startswith("s", F.lit("supplier/"))).select("s", "o")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.s") < F.col("b.s"))).groupBy(F.col("a.s").alias("first_node"), F.col("b.s").alias("second_node")).agg(F.count("*").alias("n_shared"))


@query(WITH + " SELECT 'node' AS kind, path AS id, title AS label FROM nodes UNION ALL SELECT 'edge', s || ' ' || p || ' ' || o, confidence FROM edges")
def graph_snapshot(spark, d):
    """Nodes and edges as one tagged table, for export."""
    n = g.nodes(spark, d).select(F.lit("node").alias("kind"), F.col("path").alias("id"), F.col("title").alias("label"))
    return n.union(g.edges(spark, d).select(F.lit("edge"), F.concat_ws(" ", "s", "p", "o"), "confidence"))


SEARCH_SQL = SQL["graph_search"].removeprefix("WITH ")


@query(
    f"WITH {g.EDGES_SQL}, found AS (WITH {SEARCH_SQL}) SELECT path AS node, tier, direction, p, other FROM (SELECT path, tier, 'out' AS direction, p, o AS other FROM edges JOIN found ON s = path UNION ALL SELECT path, tier, 'in', p, s FROM edges JOIN found ON o = path) r ORDER BY tier, node, direction, p, other LIMIT 64"
)
def graph_context(spark, d):
    """Nodes found by name with their relations, fifty and sixty-four at most; refused where what they describe has changed."""
    found = graph.search(g.nodes(spark, d), g.aliases(spark, d), "Brand#1")
    return graph.context(g.edges(spark, d), found, described="v1", current="v1").select("node", "tier", "direction", "p", "other")


@query(WITH + " SELECT p, count(*) AS n, count(DISTINCT s) AS n_from FROM edges GROUP BY p")
def graph_stored(spark, d):
    """A graph kept as tables in a folder, read back without being changed."""
    folder = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex[:12]}"
    g.write_graph(folder, g.nodes(spark, d), g.edges(spark, d), g.aliases(spark, d))
    return g.read_graph(spark, folder)["edges"].groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_from"))


@query(SQL["graph_overview"])
def graph_inventory(spark, d):
    """The nodes and edges of a view as a list in JSON, in a folder of its own that is never written over."""
    folder = f"{shared_folder(spark)}/view-{uuid.uuid4().hex[:12]}"
    e = graph_overview(spark, d)
    files.write_rows(e.select(F.lit("edge").alias("_table"), "*"), folder)
    return files.read_jsonl(spark, folder, "s string, p string, o string", tag="edge")


@query()
def graph_regions(spark, d):
    """Regions of touching pixels and bands of columns in pictures of eight by eight made from vectors."""
    pixels = load(spark, d, "embeddings", F.col("vec_id").cast("string").alias("image"), F.posexplode("embedding").alias("at", "v"))
    pixels = pixels.select("image", (F.col("at") % 8).alias("x"), F.floor(F.col("at") / 8).cast("int").alias("y"), "v").where(raster.colour_distance([F.col("v").cast("double")], [0.3]) < 0.25)
    bands = raster.column_bands(pixels).groupBy("image").agg(F.count("*").alias("n_bands"))
    return raster.regions(spark, pixels).groupBy("image").agg(F.count("*").alias("n_regions"), F.max("n").alias("largest")).join(bands, "image")
