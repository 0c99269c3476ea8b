"""Property-graph operators over nodes (path, title, type, status) and edges (s, p, o, confidence, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts


def search(nodes: DataFrame, aliases: DataFrame, term: str, include_deprecated: bool = False, limit: int = 50) -> DataFrame:
    """Nodes whose title, alias or path contains the literal term; exact before prefix before substring, ties by path.

    Deprecated nodes are removed before the limit. ``limit`` is clamped to 1..50.
    """
    if not term:
        raise ValueError("a term is needed")
    low = term.lower()
    admitted = nodes if include_deprecated else nodes.where("status <> 'deprecated'")

    def tier(text: Column) -> Column:
        text = F.lower(text)
        return F.when(text == low, 0).when(F.startswith(text, F.lit(low)), 1).when(F.contains(text, F.lit(low)), 2)

    own = admitted.select("path", F.least(tier(F.col("title")), tier(F.col("path"))).alias("tier"))
    named = aliases.select("node_path", tier(F.col("alias")).alias("tier")).where("tier is not null")
    named = admitted.join(named, admitted.path == named.node_path).select("path", "tier")
    best = own.where("tier is not null").unionByName(named).groupBy("path").agg(F.min("tier").alias("tier"))
    return best.orderBy("tier", "path").limit(max(1, min(50, limit)))


def relations(edges: DataFrame, seeds: DataFrame, predicate: str = "") -> DataFrame:
    """Edges at either end of the seeds (path), each with its direction; an empty predicate is no filter."""
    e = edges.where(F.col("p") == predicate) if predicate else edges
    end = lambda node, direction, other: F.struct(F.col(node).alias("node"), F.lit(direction).alias("direction"), F.col(other).alias("other"))
    ends = e.select("p", F.inline(F.array(end("s", "out", "o"), end("o", "in", "s"))))
    return ends.join(seeds.select(F.col("path").alias("node")), "node").select("node", "direction", "p", "other")


def undirected(edges: DataFrame) -> DataFrame:
    end = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select(F.inline(F.array(end("s", "o"), end("o", "s"))))


def neighbours(spark, edges: DataFrame, seeds: DataFrame, depth: int = 2, budget: int | None = None) -> DataFrame:
    """path, hop, truncated: breadth-first from the seeds (path), one frontier join for each hop.

    ``budget`` limits the nodes a hop may add, by (number of links to the frontier, path); truncated tells that it did.
    """
    if not 0 <= depth <= 5:
        raise ValueError("depth is 0 to 5")
    cuts = Cuts(spark, "bfs")
    both = cuts.cut(undirected(edges))
    seen = seeds.select("path", F.lit(0).alias("hop"), F.lit(False).alias("truncated")).distinct()
    frontier = seen.select("path")
    for hop in range(1, depth + 1):
        found = both.join(frontier, both.a == frontier.path).groupBy(F.col("b").alias("path")).agg(F.count("*").alias("links"))
        found = found.join(seen.select("path"), "path", "left_anti")
        if budget is not None:
            top = found.orderBy(F.desc("links"), "path").limit(budget + 1)
            place = F.row_number().over(Window.orderBy(F.desc("links"), "path"))  # at most budget + 1 rows
            found = top.withColumn("place", place).withColumn("truncated", F.max("place").over(Window.partitionBy()) > budget).where(F.col("place") <= budget)
        else:
            found = found.withColumn("truncated", F.lit(False))
        new = cuts.cut(found.select("path", F.lit(hop).alias("hop"), "truncated"))
        seen = seen.unionByName(new)
        frontier = new.select("path")
    return seen


def _mixed(x: Column) -> Column:
    """Another number for each number, one to one, in no order that the numbers had (shifts and exclusive or)."""
    for shift in (lambda v: F.shiftleft(v, 13), lambda v: F.shiftrightunsigned(v, 7), lambda v: F.shiftleft(v, 17)):
        x = x.bitwiseXOR(shift(x))
    return x


def components(spark, edges: DataFrame) -> DataFrame:
    """path, component (smallest path): contraction until no edge is left.

    Nodes get numbers without order. In a round every node goes to the smallest number among itself and its neighbours, and
    the edges are those between the numbers that are left; about half of the nodes of a path, and all but a few of a star
    or a dense part, disappear. So the rounds are logarithmic, each edge is shuffled as two numbers, and finished
    components cost nothing. The rounds' steps are joined in the end.
    """
    cuts = Cuts(spark, "components")
    edges, names = cuts.write(edges.select("s", "o").where("s is not null and o is not null"))
    number = _mixed(F.monotonically_increasing_id() + 1)
    nodes = cuts.cut(edges.select(F.explode(F.array("s", "o")).alias("path")).distinct().select("path", number.alias("id")))
    of = lambda end: nodes.select(F.col("path").alias(end), F.col("id").alias(f"id_{end}"))
    a, b = F.least("id_s", "id_o").alias("a"), F.greatest("id_s", "id_o").alias("b")
    links = edges.where("s <> o").join(of("s"), "s").join(of("o"), "o").select(a, b).distinct()
    (links, old), seen = cuts.counted(links)
    cuts.drop(names)
    ends = nodes.select("path", F.col("id").alias("at"))
    while seen:
        both = links.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("x")), F.struct(F.col("b").alias("id"), F.col("a").alias("x")))))
        step = cuts.cut(both.groupBy("id").agg(F.min("x").alias("x")).select("id", F.least("id", "x").alias("to")).where("id <> to"))
        to = lambda end: step.select(F.col("id").alias(end), F.col("to").alias(f"to_{end}"))
        moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        (links, path), seen = cuts.counted(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        cuts.drop(old)
        old = path
        ends = ends.join(step, ends["at"] == step["id"], "left").select("path", F.coalesce("to", "at").alias("at"))
    ends = cuts.cut(ends)
    root = ends.groupBy("at").agg(F.min("path").alias("component"))
    return ends.join(root, "at").select("path", "component")


def reachable(spark, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that directed edges reach from any seed (path), seeds included, however far."""
    cuts = Cuts(spark, "reach")
    edges = cuts.cut(edges.select("s", "o"))
    seen = frontier = cuts.cut(seeds.select("path").distinct())
    found, hops = 1, 0
    while found:
        new = edges.join(frontier, edges.s == frontier.path, "left_semi").select(F.col("o").alias("path")).distinct()
        (new, _), found = cuts.counted(new.join(seen, "path", "left_anti"))
        seen, frontier, hops = seen.unionByName(new), new, hops + 1
        if hops % 16 == 0:  # one table in place of many small ones
            seen = cuts.cut(seen.coalesce(max(1, spark.sparkContext.defaultParallelism)))
    return seen


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts valid at a time: valid_from <= at, and valid_until open or later."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, with the missing end."""
    ends = edges.select("s", "p", "o", F.explode(F.array("s", "o")).alias("missing"))
    return ends.join(nodes, ends.missing == nodes.path, "left_anti").distinct()


def redundant(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Pairs of edges that say the same: an edge and its inverse, both stored."""
    name = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    a = edges.withColumn("inverse", F.try_element_at(name, F.col("p"))).where("inverse is not null").alias("x")
    return a.join(edges.alias("y"), (F.col("x.s") == F.col("y.o")) & (F.col("x.o") == F.col("y.s")) & (F.col("x.inverse") == F.col("y.p"))).select("x.s", "x.p", "x.o")


def cap_degree(pairs: DataFrame, most: int = 5) -> DataFrame:
    """Symmetric scored edges (a, b, score) that are among the best ``most`` of both ends."""
    ends = pairs.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
    place = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("score"), "a", "b"))
    return ends.withColumn("place", place).where(F.col("place") <= most).groupBy("a", "b").agg(F.first("score").alias("score"), F.count("*").alias("n")).where("n = 2").select("a", "b", "score")


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends (mapping: path, into): equal edges folded with their count, loops made by the merge dropped."""
    a = mapping.select(F.col("path").alias("s"), F.col("into").alias("s2"))
    b = mapping.select(F.col("path").alias("o"), F.col("into").alias("o2"))
    new = edges.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("s2", "s").alias("s"), "p", F.coalesce("o2", "o").alias("o"), (F.col("s") == F.col("o")).alias("loop"))
    return new.where((F.col("s") != F.col("o")) | F.col("loop")).groupBy("s", "p", "o").agg(F.count("*").alias("n_origins"))


def retract(edges: DataFrame, origins: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges (edge_id) that keep an origin (edge_id, page) after the pages are retracted; edges that never had one stay."""
    left = origins.join(pages, "page", "left_anti").select("edge_id").distinct()
    had = origins.select("edge_id").distinct()
    return edges.join(left, "edge_id", "left_semi").unionByName(edges.join(had, "edge_id", "left_anti"))


def attach(delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each delta node (delta_id, name, type): reuse the only node of that type and title, abstain if many, create if none."""
    n = nodes.select(F.lower("title").alias("key"), "type", "path").groupBy("key", "type").agg(F.count("path").alias("n"), F.min("path").alias("least"))  # a title may stand for any number of nodes
    hits = delta.withColumn("key", F.lower("name")).join(n, ["key", "type"], "left").groupBy("delta_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"), F.min("least").alias("first"))
    decision = F.when(F.col("n_matches") == 1, "reuse").when(F.col("n_matches") > 1, "abstain").otherwise("create")
    return hits.select("delta_id", "n_matches", decision.alias("decision"), F.when(F.col("n_matches") == 1, F.col("first")).alias("path"))


def shown(edges: DataFrame, similar: bool = False) -> DataFrame:
    """Edges as a view shows them: without those of mere similarity unless asked."""
    return edges if similar else edges.where(F.col("p") != "similar")


def ancestors(edges: DataFrame, generations: int = 3) -> DataFrame:
    """node, ancestor, generation: what edges lead to in 1 to ``generations`` steps, by the shortest way; cycles end there."""
    up = edges.select(F.col("s").alias("node"), F.col("o").alias("ancestor")).distinct()
    step = up.select(F.col("node").alias("_via"), F.col("ancestor").alias("_next"))
    every, last = up.withColumn("generation", F.lit(1)), up
    for k in range(2, generations + 1):
        last = last.join(step, F.col("ancestor") == F.col("_via")).select("node", F.col("_next").alias("ancestor")).distinct()
        every = every.unionByName(last.withColumn("generation", F.lit(k)))
    return every.groupBy("node", "ancestor").agg(F.min("generation").alias("generation"))


def connected(spark, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, exists for ``pairs`` (a, b): whether any path joins them, whatever its direction; a node joins itself if it has edges."""
    c = Cuts(spark, "connected").cut(components(spark, edges))
    end = lambda n: c.select(F.col("path").alias(n), F.col("component").alias(f"_{n}"))
    return pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("exists"))


def context(edges: DataFrame, found: DataFrame, described: str, current: str, nodes: int = 50, relations_: int = 64) -> DataFrame:
    """node, tier, direction, p, other: relations of the found nodes (path, tier), the first by tier, node and relation.

    ``described`` is the hash of what the graph was made from, ``current`` that of what is there now; if they differ the
    graph would describe something else, and nothing is returned but an error.
    """
    if described != current:
        raise ValueError("the graph is stale: what it describes has changed")
    top = found.orderBy("tier", "path").limit(nodes)
    rows = relations(edges, top.select("path")).join(top.withColumnRenamed("path", "node"), "node")
    return rows.orderBy("tier", "node", "direction", "p", "other").limit(relations_)
