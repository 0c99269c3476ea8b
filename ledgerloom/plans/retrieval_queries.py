"""Registered retrieval pipelines, resampling and catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import registered
from ledgerloom.operators import aggregates, resampling, retrieval, vectors
from ledgerloom.plans import registry, tools
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load

REQUEST = retrieval.Request("entropy profile of the tensor train", subjects=("error syndrome",), topk=10)


def _pages(spark, d):
    docs = load(spark, d, "documents", "doc_id", "path", "text", "source")
    title = F.regexp_extract("text", r"(?m)^#\s+(.*)$", 1)
    status = F.when(F.contains("text", F.lit("status: deprecated")), "deprecated").otherwise("current")
    return docs.where("text is not null").select(F.col("doc_id").alias("id"), title.alias("title"), "text", "source", F.split("path", "/")[0].alias("domain"), status.alias("status"))


def _links(spark, d):
    """Pages linked by the sources they cite: a cited name stands for the page of that stem with the smallest id."""
    docs = load(spark, d, "documents", "doc_id", "text", "path")
    stem = docs.where("path is not null").groupBy(F.regexp_extract("path", r"([a-z]+)-[a-z0-9]+\.md$", 1).alias("stem")).agg(F.min("doc_id").alias("b"))
    cited = docs.where("text is not null").select(F.col("doc_id").alias("a"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"raw/([a-z]+)-[a-z0-9]+\.md"), F.lit(1)))).alias("stem"))
    return cited.join(stem, "stem").select("a", "b")


def _names(spark, d):
    return load(spark, d, "documents", F.col("doc_id").alias("id"), F.regexp_extract("path", r"([a-z]+)-[a-z0-9]+\.md$", 1).alias("alias")).where("alias <> ''")


def _lanes(spark, d):
    """Navigation, and vectors: a page's vector is that of its number, the request's that of the first page it names."""
    nav = retrieval.navigation(_pages(spark, d), _names(spark, d), _links(spark, d), REQUEST)
    v = load(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = vectors.top_k(v, v.where("id = 1"), 50).select("id", F.col("rank").alias("place"))
    cuts = Cuts(spark, "lanes")
    return {"navigation": cuts.cut(nav), "vector": cuts.cut(near)}


@query()
def ret_hybrid(spark, d):
    """Fused recall over text, title, navigation and vector channels, typed candidates with how to read them."""
    return retrieval.hybrid(_pages(spark, d), REQUEST, more=_lanes(spark, d))[0]


@query()
def ret_channels(spark, d):
    """How many candidates each channel gave, and whether its window was full."""
    return retrieval.hybrid(_pages(spark, d), REQUEST, more=_lanes(spark, d))[1]


@query()
def ret_navigation(spark, d):
    """Pages by title and alias tiers, over the graph of citations where no name fits."""
    fallback = retrieval.Request("entropy lattice", topk=10)
    one = retrieval.navigation(_pages(spark, d), _names(spark, d), _links(spark, d), retrieval.Request("the", topk=10))
    two = retrieval.navigation(_pages(spark, d), _names(spark, d), _links(spark, d), fallback)
    return one.withColumn("request", F.lit("by name")).unionByName(two.withColumn("request", F.lit("no name")))


@query()
def led_speech_names(spark, d):
    """Names as written against an authority: exact, fuzzy by edit ratio with its best match, or unknown."""
    hubs = load(spark, d, "hub_paper_incidence", F.trim("hub_label").alias("name")).where("name <> ''").distinct()
    known = load(spark, d, "physh_gold_matched", F.explode("concepts").alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()
    near = retrieval.ratio_top(hubs, known, 0.75)
    return near.select("name", "best", F.when(F.col("name") == F.col("best"), "exact").when(F.col("best").isNotNull(), "fuzzy").otherwise("unknown").alias("state"))


@query()
def ret_name_candidates(spark, d):
    """The most similar concept name of each hub name, from a ratio of 0.75 (F27); against brute force in the tests."""
    hubs = load(spark, d, "hub_paper_incidence", "hub_label").select(F.lower(F.trim("hub_label")).alias("name")).distinct()
    concepts = load(spark, d, "physh_gold_matched", "concepts").select(F.explode("concepts").alias("name")).select(F.lower(F.trim("name")).alias("name")).distinct()
    return retrieval.ratio_top(hubs, concepts, 0.75)


@query()
def stat_permutation(spark, d):
    """Hub coherence of concepts and disciplines against 10,000 permutations of whole label profiles within years."""
    clean = lambda c: F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))))
    labels = load(spark, d, "physh_gold_matched", "work_id", "year", "concepts", "disciplines").where("work_id is not null")
    profiles = labels.groupBy(F.col("work_id").alias("member")).agg(F.min("year").alias("stratum"), clean("concepts").alias("concepts"), clean("disciplines").alias("disciplines"))
    inc = load(spark, d, "hub_paper_incidence", "hub_id", "work_id").select(F.trim("hub_id").alias("grp"), F.col("work_id").alias("member"))
    cuts = Cuts(spark, "permutation")
    values = cuts.cut(resampling.coherence_null(spark, cuts.cut(profiles), inc, ["concepts", "disciplines"]))
    out = []
    for field in ("concepts", "disciplines"):
        seen = values.where((F.col("field") == field) & (F.col("draw") == 0)).select(F.col("value").alias("obs"))
        nulls = values.where((F.col("field") == field) & (F.col("draw") > 0)).select("value").join(F.broadcast(seen))  # one row
        out.append(aggregates.null_summary(nulls, F.max("obs")).select(F.lit(field).alias("field"), "*"))
    return out[0].unionByName(out[1])


@query()
def stat_controls(spark, d):
    """Matched controls without reuse."""
    domain = F.split(F.trim("hub_id"), "/")[0]
    trials = load(spark, d, "trial_key", F.col("trial_id").alias("trial"), "hub_id", "task").select("trial", F.col("task").alias("stratum"), domain.alias("domain"))
    pool = load(spark, d, "hub_paper_incidence", "hub_id", "paper_id", "official_gold").where("hub_id is not null and paper_id is not null").groupBy(F.col("paper_id").alias("control")).agg(F.min(F.split(F.trim("hub_id"), "/")[0]).alias("domain"), F.max("official_gold").alias("gold"))
    pool = pool.select("control", F.when(F.col("gold") == 1, "membership").otherwise("set").alias("stratum"), "domain")
    return resampling.matched_controls(spark, trials, pool)


@query(
    """WITH e AS (SELECT step, entry_id, reuse_n, create_n FROM trajectory), f AS (SELECT entry_id, min(step) AS first, max(step) AS last, count(*) AS n FROM e GROUP BY entry_id)
 SELECT entry_id, first, last, n, CASE WHEN last - first + 1 = n THEN 'contiguous' ELSE 'gaps' END AS shape FROM f"""
)
def led_trace(spark, d):
    """Traces of entries: first and last step, and whether steps are missing between."""
    f = load(spark, d, "trajectory", "step", "entry_id").groupBy("entry_id").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count("*").alias("n"))
    return f.withColumn("shape", F.when(F.col("last") - F.col("first") + 1 == F.col("n"), "contiguous").otherwise("gaps"))


@query(
    """WITH h AS (SELECT trim(hub_id) AS hub, list(DISTINCT paper_id) AS papers FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1),
 i AS (SELECT DISTINCT trim(hub_id) AS hub, paper_id FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND paper_id IS NOT NULL), c AS (SELECT a.hub AS a, b.hub AS b, count(*) AS both_ FROM i a JOIN i b ON a.paper_id = b.paper_id AND a.hub < b.hub GROUP BY ALL)
 SELECT a, b, round(both_ / (len(x.papers) + len(y.papers) - both_)::DOUBLE, 6) AS jaccard FROM c JOIN h x ON a = x.hub JOIN h y ON b = y.hub WHERE both_ / (len(x.papers) + len(y.papers) - both_)::DOUBLE >= 0.02"""
)
def id_hub_overlap(spark, d):
    """Jaccard overlap of hubs by shared papers."""
    i = load(spark, d, "hub_paper_incidence", "hub_id", "paper_id").where("hub_id is not null and paper_id is not null").select(F.trim("hub_id").alias("hub"), "paper_id").distinct()
    n = i.groupBy("hub").agg(F.count("*").alias("n"))
    a, b = i.select(F.col("hub").alias("a"), "paper_id"), i.select(F.col("hub").alias("b"), "paper_id")
    c = a.join(b, "paper_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("m"))  # a paper lies in few hubs
    c = c.join(n.select(F.col("hub").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("hub").alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))
    return c.where(j >= 0.02).select("a", "b", F.round(j, 6).alias("jaccard"))


@query(
    """WITH o AS (SELECT work_id, paper_id, recorded_at, row_number() OVER (PARTITION BY work_id ORDER BY recorded_at, paper_id, hub_id, supporting_member_node_count) AS r FROM hub_paper_incidence WHERE work_id IS NOT NULL)
 SELECT work_id, count(*) AS n_events, max(r) FILTER (paper_id IS NOT NULL) AS last_known FROM o GROUP BY work_id"""
)
def led_log_projection(spark, d):
    """State projected from an append-only log."""
    w = Window.partitionBy("work_id").orderBy("recorded_at", "paper_id", "hub_id", "supporting_member_node_count")
    o = load(spark, d, "hub_paper_incidence", "work_id", "paper_id", "recorded_at", "hub_id", "supporting_member_node_count").where("work_id is not null")
    o = o.select("work_id", "paper_id", F.row_number().over(w).cast("bigint").alias("r"))
    return o.groupBy("work_id").agg(F.count("*").alias("n_events"), F.max(F.when(F.col("paper_id").isNotNull(), F.col("r"))).alias("last_known"))


@query()
def api_catalog(spark, d):
    """The registered queries."""
    return registry.catalog(spark)


@query()
def api_tools(spark, d):
    """The tools with the schemas of their arguments, their callers and states (V1, V3, V5)."""
    return tools.Toolbox(tools.STANDARD).catalogue(spark)


@query()
def api_call(spark, d):
    """A tool called through hooks that count and shorten, within a deadline."""
    box = tools.Toolbox(tools.STANDARD)
    box.hooks.pre.append(lambda tool, a: {**a, "topk": min(5, a["topk"])} if "topk" in a else None)
    box.hooks.post.append(lambda tool, result: result.withColumn("tool", F.lit(tool.name)))
    return box.call(spark, d, "graph_search", {"term": "Brand#1"}, deadline=300)


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, sum(regexp_matches(c, '^(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS fence FROM l)
 SELECT doc_id, line::INT AS line, length(regexp_extract(c, '^(#{1,6}) ', 1))::INT AS level, trim(regexp_replace(c, '^#{1,6} ', '')) AS title FROM f WHERE fence % 2 = 0 AND regexp_matches(c, '^#{1,6} ')"""
)
def api_table_function(spark, d):
    """Headings by a table function from SQL (V7)."""
    registered.register(spark)
    return spark.sql("SELECT d.doc_id, o.line, o.level, o.title FROM {docs} d, LATERAL loom_outline(d.text) o", docs=load(spark, d, "documents", "doc_id", "text").where("text is not null"))


@query(
    """WITH p AS (SELECT l_shipmode_ AS g, x, y FROM (SELECT l_returnflag AS l_shipmode_, l_linestatus AS x, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS y FROM lineitem) q WHERE x IS NOT NULL),
 t AS (SELECT g, avg((x = y)::INT) AS seen, avg((x = 'F')::INT) * avg((y = 'F')::INT) + avg((x = 'O')::INT) * avg((y = 'O')::INT) AS chance FROM p GROUP BY g) SELECT g, round(CASE WHEN chance = 1 THEN 1.0 ELSE (seen - chance) / (1 - chance) END, 9) AS kappa FROM t"""
)
def api_aggregate(spark, d):
    """Agreement by an aggregate of one's own from SQL (V7)."""
    registered.register(spark)
    rows = load(spark, d, "lineitem", F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("x"), F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("y"))
    return spark.sql("SELECT g, round(loom_kappa(x, y), 9) AS kappa FROM {rows} GROUP BY g", rows=rows)
