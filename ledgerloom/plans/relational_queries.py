"""Registered projections, joins, windows, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.operators import aggregates, chains
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import numbered
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load

# --- projections and filters


@query("SELECT sequence_index, 'D' || lpad(sequence_index::VARCHAR, 9, '0') AS record_id, entry_id FROM manifest WHERE decision = 'include' ORDER BY sequence_index")
def proj_decision(spark, d):
    """Decision filter, derived id, order by number."""
    m = load(spark, d, "manifest", "sequence_index", "entry_id", "decision").where("decision = 'include'")
    return m.select("sequence_index", F.concat(F.lit("D"), F.lpad(F.col("sequence_index").cast("string"), 9, "0")).alias("record_id"), "entry_id").orderBy("sequence_index")


@query("SELECT paper_id, CASE WHEN label_source IS NOT NULL AND len(coalesce(concepts, [])) > 0 THEN 'official' WHEN starts_with(doi, '10.99812') THEN 'publisher without labels' ELSE 'other' END AS branch, count(*) AS n FROM physh_gold_matched GROUP BY ALL")
def proj_branch(spark, d):
    """Multi-branch label with a prefix predicate."""
    p = load(spark, d, "physh_gold_matched", "paper_id", "label_source", "concepts", "doi")
    branch = F.when(F.col("label_source").isNotNull() & (F.coalesce(F.size("concepts"), F.lit(0)) > 0), "official").when(F.startswith("doi", F.lit("10.99812")), "publisher without labels").otherwise("other")
    return p.groupBy("paper_id", branch.alias("branch")).agg(F.count("*").alias("n"))


@query("SELECT sequence_index FROM manifest WHERE contains(lower(title), 'the') AND contains(lower(title), 'of') AND NOT contains(title, '%') AND role IN ('publication_candidate', 'preprint_version')")
def proj_literal_terms(spark, d):
    """All terms as literals, set membership, no pattern signs."""
    low = F.lower("title")
    return load(spark, d, "manifest", "sequence_index", "title", "role").where(F.contains(low, F.lit("the")) & F.contains(low, F.lit("of")) & ~F.contains("title", F.lit("%")) & F.col("role").isin("publication_candidate", "preprint_version")).select("sequence_index")


@query(
    "WITH a AS (SELECT split_part(path, '/', 1) AS domain, doc_id, n_chars FROM documents WHERE split_part(path, '/', 1) IN ('academic', 'computing', 'business') AND text IS NOT NULL) SELECT domain, doc_id, n_chars FROM a ORDER BY n_chars DESC, doc_id LIMIT 50"
)
def proj_scope_before_limit(spark, d):
    """Scope and lifecycle filters stand below the limit."""
    domain = F.split("path", "/")[0]
    docs = load(spark, d, "documents", "path", "doc_id", "n_chars", "text").where(domain.isin("academic", "computing", "business") & F.col("text").isNotNull())
    return docs.select(domain.alias("domain"), "doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) u GROUP BY k")
def proj_key_audit(spark, d):
    """Keys that occur in a JSON column, for an audit of private fields."""
    return load(spark, d, "events", "props").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT id, lower(trim(domain)) = 'academic' AS academic, CASE lower(trim(channel)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM retrieval_benchmark_real")
def proj_strict_boolean(spark, d):
    """Only the words true and false are truth values."""
    low = F.lower(F.trim("channel"))
    return load(spark, d, "retrieval_benchmark_real", "id", "domain", "channel").select("id", (F.lower(F.trim("domain")) == "academic").alias("academic"), F.when(low == "true", True).when(low == "false", False).alias("flag"))


# --- joins


@query("WITH g AS (SELECT lower(trim(doi)) AS doi, max_by(paper_id, (loaded_at, paper_id)) AS paper_id FROM physh_gold_matched WHERE doi IS NOT NULL GROUP BY 1) SELECT m.sequence_index, g.paper_id FROM manifest m JOIN g ON lower(trim(m.doi)) = g.doi")
def join_last_key_wins(spark, d):
    """Inner join on a normalised key of which the last row counts."""
    g = load(spark, d, "physh_gold_matched", "doi", "paper_id", "loaded_at").where("doi is not null").groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.max_by("paper_id", F.struct("loaded_at", "paper_id")).alias("paper_id"))
    return load(spark, d, "manifest", "sequence_index", F.lower(F.trim("doi")).alias("doi")).join(g, "doi").select("sequence_index", "paper_id")


@query("SELECT m.sequence_index, (g.paper_id IS NOT NULL)::INT AS official_gold FROM manifest m LEFT JOIN (SELECT DISTINCT paper_id FROM physh_gold_matched) g ON m.run_id = g.paper_id")
def join_coverage(spark, d):
    """Left join with a coverage flag."""
    g = load(spark, d, "physh_gold_matched", F.col("paper_id").alias("run_id")).distinct().withColumn("hit", F.lit(1))
    return load(spark, d, "manifest", "sequence_index", "run_id").join(g, "run_id", "left").select("sequence_index", F.coalesce("hit", F.lit(0)).alias("official_gold"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS n_missing FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def join_strict_key(spark, d):
    """Foreign keys that must exist: rows, and rows without."""
    o = load(spark, d, "orders", "o_orderkey")
    li = load(spark, d, "lineitem", "l_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("n_missing"))


@query("SELECT s_nationkey, l_orderkey, count(DISTINCT l_partkey) AS n_members FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def join_bridge(spark, d):
    """Many-to-many through a bridge, with member counts."""
    s = load(spark, d, "supplier", "s_suppkey", "s_nationkey")
    li = load(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "l_orderkey").agg(F.count_distinct("l_partkey").alias("n_members"))


@query("SELECT sequence_index FROM manifest WHERE entry_id IN (SELECT work_id FROM hub_paper_incidence WHERE work_id IS NOT NULL)")
def join_semi(spark, d):
    """Works that lie in a hub."""
    return load(spark, d, "manifest", "sequence_index", "entry_id").join(load(spark, d, "hub_paper_incidence", F.col("work_id").alias("entry_id")), "entry_id", "left_semi").select("sequence_index")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    """Customers without order."""
    c = load(spark, d, "customer", "c_custkey")
    o = load(spark, d, "orders", "o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("WITH s(lo, hi) AS (VALUES (2000, 2008), (2009, 2015), (2016, 2021), (2022, 2030)) SELECT lo || '-' || hi AS stratum, count(*) AS n FROM physh_gold_matched JOIN s ON year BETWEEN lo AND hi GROUP BY ALL")
def join_stratum(spark, d):
    """Point in interval: years to strata."""
    s = spark.createDataFrame([(2000, 2008), (2009, 2015), (2016, 2021), (2022, 2030)], "lo int, hi int")
    p = load(spark, d, "physh_gold_matched", "year")
    return p.join(F.broadcast(s), F.col("year").between(F.col("lo"), F.col("hi"))).groupBy(F.concat_ws("-", "lo", "hi").alias("stratum")).agg(F.count("*").alias("n"))  # four rows


@query(
    """SELECT event_id, o_orderkey FROM (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM events JOIN orders ON user_id = o_custkey AND o_orderdate <= ts) q WHERE r = 1"""
)
def join_as_of(spark, d):
    """Each event with its user's latest earlier order: one sort of both sides together, no range join."""
    e = load(spark, d, "events", "event_id", "user_id", "ts").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("bigint").alias("o_orderkey"))
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("bigint").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("k").orderBy("t", F.col("event_id").isNotNull(), "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w)).where("event_id is not null and o_orderkey is not null").select("event_id", "o_orderkey")


@query("SELECT coalesce(a.work_id, b.work_id) AS work_id, CASE WHEN a.work_id IS NULL THEN 'only in hubs' WHEN b.work_id IS NULL THEN 'only in labels' ELSE 'both' END AS side FROM (SELECT DISTINCT work_id FROM physh_gold_matched WHERE work_id IS NOT NULL) a FULL JOIN (SELECT DISTINCT work_id FROM hub_paper_incidence WHERE work_id IS NOT NULL) b ON a.work_id = b.work_id")
def join_reconcile(spark, d):
    """Full outer reconcile of two lists."""
    a = load(spark, d, "physh_gold_matched", "work_id").where("work_id is not null").distinct().withColumn("a", F.lit(1))
    b = load(spark, d, "hub_paper_incidence", "work_id").where("work_id is not null").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "only in hubs").when(F.col("b").isNull(), "only in labels").otherwise("both")
    return a.join(b, "work_id", "full").select("work_id", side.alias("side"))


@query(
    """WITH g AS (SELECT DISTINCT paper_id, lower(trim(doi)) AS doi, lower(trim(manifest_title)) AS title FROM physh_gold_matched), m AS (SELECT sequence_index, lower(trim(doi)) AS doi, lower(trim(title)) AS title FROM manifest),
 c AS (SELECT sequence_index, paper_id, 0 AS way FROM m JOIN g ON m.doi = g.doi WHERE m.doi <> '' UNION ALL
  SELECT sequence_index, paper_id, 1 FROM m JOIN g ON m.title = g.title WHERE m.title <> '' AND (m.doi IS NULL OR m.doi = '' OR g.doi IS NULL OR g.doi = '')),
 b AS (SELECT sequence_index, min((way, paper_id)) AS x FROM c GROUP BY sequence_index) SELECT sequence_index, x[2] AS paper_id, CASE x[1] WHEN 0 THEN 'doi' ELSE 'title' END AS matched_by FROM b"""
)
def join_exact_then_fallback(spark, d):
    """DOI first, then title; two different DOIs block the title."""
    tidy = lambda c: F.lower(F.trim(c))
    g = load(spark, d, "physh_gold_matched", "paper_id", tidy(F.col("doi")).alias("g_doi"), tidy(F.col("manifest_title")).alias("g_title")).distinct()
    m = load(spark, d, "manifest", "sequence_index", tidy(F.col("doi")).alias("doi"), tidy(F.col("title")).alias("title"))
    by_doi = m.where("doi <> ''").join(g, F.col("doi") == F.col("g_doi")).select("sequence_index", "paper_id", F.lit(0).alias("way"))
    open_ = F.coalesce(F.col("doi"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("g_doi"), F.lit("")).eqNullSafe("")
    by_title = m.where("title <> ''").join(g, (F.col("title") == F.col("g_title")) & open_).select("sequence_index", "paper_id", F.lit(1).alias("way"))
    best = by_doi.unionByName(by_title).groupBy("sequence_index").agg(F.min(F.struct("way", "paper_id")).alias("x"))
    return best.select("sequence_index", "x.paper_id", F.when(F.col("x.way") == 0, "doi").otherwise("title").alias("matched_by"))


CHAIN = "SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey, date_part('year', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS next FROM orders"


@query(f"WITH RECURSIVE c AS ({CHAIN}), r(id, place, hops) AS (SELECT id, id, 0 FROM c UNION ALL SELECT r.id, c.next, hops + 1 FROM r JOIN c ON r.place = c.id WHERE c.next IS NOT NULL) SELECT id, max_by(place, hops) AS current, max(hops)::BIGINT AS hops FROM r GROUP BY id")
def join_version_chain(spark, d):
    """Chains of superseded versions followed to the current one, by doubling."""
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    o = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("next"))
    return chains.follow(spark, o)


@query("WITH now_ AS (SELECT doc_id, max(updated_at) AS v, sha256(any_value(text)) AS h FROM documents GROUP BY doc_id) SELECT d.doc_id, CASE WHEN n.doc_id IS NULL THEN 'stale' ELSE 'bound' END AS binding FROM documents d LEFT JOIN now_ n ON d.doc_id = n.doc_id AND d.updated_at = n.v AND sha256(d.text) = n.h")
def join_snapshot(spark, d):
    """Binding by id, version and content hash; anything else is stale."""
    docs = load(spark, d, "documents", "doc_id", "updated_at", F.sha2("text", 256).alias("h"))
    now = docs.groupBy("doc_id").agg(F.max("updated_at").alias("updated_at"), F.any_value("h").alias("h")).withColumn("hit", F.lit(1))
    return docs.join(now, ["doc_id", "updated_at", "h"], "left").select("doc_id", F.when(F.col("hit").isNull(), "stale").otherwise("bound").alias("binding"))


@query(
    """WITH r AS (SELECT l_orderkey AS k, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT l.l_orderkey, l.l_linenumber, CASE WHEN r.k IS NOT NULL AND l.l_linenumber BETWEEN r.lo AND r.hi THEN 'verified' ELSE 'unverified' END AS state FROM lineitem l LEFT JOIN r ON l.l_orderkey = r.k"""
)
def join_containment(spark, d):
    """A citation is verified inside one read range of the same unit."""
    li = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    r = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    state = F.when(F.col("l_linenumber").between(F.col("lo"), F.col("hi")), "verified").otherwise("unverified")
    return li.join(r, "l_orderkey", "left").select("l_orderkey", "l_linenumber", state.alias("state"))


# --- windows and ranking


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s7|' || source || '|' || doc_id)) AS rank FROM documents WHERE source IS NOT NULL) q WHERE rank <= 3")
def win_hash_topk(spark, d):
    """Top rows of each group by a stable hash."""
    docs = load(spark, d, "documents", "source", "doc_id").where("source is not null")
    r = F.row_number().over(Window.partitionBy("source").orderBy(fn.stable_rank(F.lit("s7"), F.col("source"), F.col("doc_id"))))
    return docs.withColumn("rank", r.cast("bigint")).where("rank <= 3").select("source", "doc_id", "rank")


@query(
    """WITH k AS (SELECT trial_id, hub_id FROM trial_key), h AS (SELECT hub_id, list(DISTINCT paper_id ORDER BY paper_id) AS papers FROM hub_paper_incidence WHERE paper_id IS NOT NULL AND hub_id IS NOT NULL GROUP BY hub_id)
 SELECT trial_id, papers[((('0x' || substr(sha256('11|' || trial_id), 1, 8))::BIGINT) % len(papers)) + 1] AS control, CASE WHEN ('0x' || right(sha256('11|' || trial_id), 1))::INT % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM k JOIN h USING (hub_id)"""
)
def win_matched_control(spark, d):
    """A control paper of the trial's hub and a blinded side, both by hash (F5); stat_trials has the whole rule."""
    h = load(spark, d, "hub_paper_incidence", "hub_id", "paper_id").where("paper_id is not null and hub_id is not null").distinct()
    h = numbered(Cuts(spark, "control"), h, ["hub_id"], ["paper_id"], "place").withColumn("place", F.col("place") - 1)  # a hub may hold a tenth of all rows
    sizes = h.groupBy("hub_id").agg(F.count("*").alias("size"))
    digest = F.sha2(F.concat(F.lit("11|"), "trial_id"), 256)
    k = load(spark, d, "trial_key", "trial_id", "hub_id").join(sizes, "hub_id")
    k = k.withColumn("place", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("size")).cast("int"))
    side = F.when(F.conv(F.right(digest, F.lit(1)), 16, 10).cast("int") % 2 == 0, "A").otherwise("B")
    return k.join(h, ["hub_id", "place"]).select("trial_id", F.col("paper_id").alias("control"), side.alias("side"))


@query(
    """WITH s AS (SELECT l_partkey AS part, l_suppkey AS sup, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT part, sup, n, row_number() OVER (PARTITION BY part ORDER BY n DESC, sup) AS r FROM s)
 SELECT part, sup, n, CASE WHEN r = 1 THEN 'primary' ELSE 'secondary' END AS role FROM r WHERE r <= 3"""
)
def win_primary_secondary(spark, d):
    """Primary and secondary assignment by overlap."""
    s = load(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sup")).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "sup"))
    return s.withColumn("r", r).where("r <= 3").select("part", "sup", "n", F.when(F.col("r") == 1, "primary").otherwise("secondary").alias("role"))


@query(
    """WITH t AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small' THEN 0 WHEN starts_with(lower(p_name), 'small') THEN 1 WHEN contains(lower(p_name), 'small') THEN 2 WHEN contains(lower(p_type), 'small') THEN 3 END AS tier FROM part)
 SELECT p_partkey, tier, row_number() OVER (ORDER BY tier, p_name, p_partkey) AS place FROM t WHERE tier IS NOT NULL ORDER BY tier, p_name, p_partkey LIMIT 20"""
)
def win_literal_tiers(spark, d):
    """Literal tiers, then a total order; the place is that of the top rows."""
    low = F.lower("p_name")
    tier = F.when(low == "small", 0).when(F.startswith(low, F.lit("small")), 1).when(F.contains(low, F.lit("small")), 2).when(F.contains(F.lower("p_type"), F.lit("small")), 3)
    top = load(spark, d, "part", "p_partkey", "p_name", "p_type").withColumn("tier", tier).where("tier is not null").orderBy("tier", "p_name", "p_partkey").limit(20)
    return top.select("p_partkey", "tier", F.row_number().over(Window.orderBy("tier", "p_name", "p_partkey")).cast("bigint").alias("place"))  # twenty rows


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 100),
 b AS (SELECT doc_id, row_number() OVER (ORDER BY updated_at DESC, doc_id) AS r FROM documents WHERE updated_at IS NOT NULL ORDER BY updated_at DESC, doc_id LIMIT 100),
 u AS (SELECT doc_id, 1.0 / (60.0 + r) AS v FROM a UNION ALL SELECT doc_id, 0.5 / (60.0 + r) FROM b)
 SELECT doc_id, round(sum(v), 9) AS score FROM u GROUP BY doc_id ORDER BY sum(v) DESC, doc_id LIMIT 50"""
)
def win_rank_fusion(spark, d):
    """Weighted reciprocal-rank fusion of two channels of a hundred candidates."""
    docs = load(spark, d, "documents", "doc_id", "n_chars", "updated_at")

    def channel(order, weight):
        top = docs.where(F.col(order).isNotNull()).orderBy(F.desc(order), "doc_id").limit(100)
        r = F.row_number().over(Window.orderBy(F.desc(order), "doc_id"))  # a hundred rows
        return top.select("doc_id", fn.rrf(r, weight).alias("v"))

    fused = channel("n_chars", 1.0).unionByName(channel("updated_at", 0.5)).groupBy("doc_id").agg(F.sum("v").alias("s"))
    return fused.orderBy(F.desc("s"), "doc_id").limit(50).select("doc_id", F.round("s", 9).alias("score"))


@query(
    """WITH l AS (SELECT source AS lane, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL),
 f AS (SELECT r, lane, doc_id FROM l WHERE r <= 20) SELECT doc_id, lane, r AS rank_in_lane FROM f ORDER BY r, lane LIMIT 20"""
)
def win_round_robin(spark, d):
    """Lanes interleaved: first of each, then second of each."""
    docs = load(spark, d, "documents", "source", "doc_id", "n_chars").where("source is not null and n_chars is not null")
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return docs.withColumn("rank_in_lane", r.cast("bigint")).where("rank_in_lane <= 20").orderBy("rank_in_lane", "source").limit(20).select("doc_id", F.col("source").alias("lane"), "rank_in_lane")


@query(
    """WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY (lang IS NOT DISTINCT FROM 'en') DESC, n_chars DESC NULLS LAST, doc_id) AS r FROM documents WHERE source IS NOT NULL) SELECT source, doc_id, r AS slot FROM r WHERE r <= 2"""
)
def win_source_slots(spark, d):
    """Two slots for each source, preferred rows first."""
    docs = load(spark, d, "documents", "source", "doc_id", "n_chars", "lang").where("source is not null")
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.col("lang").eqNullSafe("en").desc(), F.desc_nulls_last("n_chars"), "doc_id"))
    return docs.withColumn("slot", r.cast("bigint")).where("slot <= 2").select("source", "doc_id", "slot")


@query("SELECT l_orderkey, max_by(l_linenumber, (l_extendedprice, -l_linenumber)) AS best_line, max(l_extendedprice) AS best FROM lineitem GROUP BY l_orderkey")
def win_best_window(spark, d):
    """Best part of each object."""
    return load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"))).alias("best_line"), F.max("l_extendedprice").alias("best"))


@query(
    """WITH m AS (SELECT user_id, ts, event_id, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 OR event_type = 'signup')::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
 SELECT user_id, run::BIGINT AS run, any_value(event_type) AS value, count(*) AS n, CASE WHEN count(*) >= 8 THEN 'stop' WHEN count(*) >= 5 THEN 'warn' WHEN count(*) >= 3 THEN 'remind' ELSE 'none' END AS reminder FROM r GROUP BY user_id, run"""
)
def win_runs(spark, d):
    """Runs of equal values with a reset, and what a reminder would say."""
    r = aggregates.runs(load(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "signup")
    n = F.col("n")
    return r.select("user_id", "run", "value", "n", F.when(n >= 8, "stop").when(n >= 5, "warn").when(n >= 3, "remind").otherwise("none").alias("reminder"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, max_by(event_type, (ts, event_id)) AS last_status FROM events GROUP BY user_id")
def win_first_last(spark, d):
    """First and last observation, latest status."""
    return load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"))


@query(
    """WITH r AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM events WHERE value IS NOT NULL)
 SELECT user_id, event_id, CASE WHEN used > 2000 THEN 'stop' WHEN used > 1400 THEN 'warn' ELSE 'go' END AS state FROM r"""
)
def win_running_budget(spark, d):
    """Running budget with warning and stop."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum("value").over(w)
    return load(spark, d, "events").where("value is not null").select("user_id", "event_id", F.when(used > 2000, "stop").when(used > 1400, "warn").otherwise("go").alias("state"))


@query("SELECT o_custkey, o_orderkey AS current FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) q WHERE r = 1")
def win_current_revision(spark, d):
    """Latest revision of each key."""
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("current"))


@query("WITH f AS (SELECT user_id, event_type, min(date_trunc('day', ts)) AS first_day FROM events GROUP BY ALL) SELECT first_day::DATE AS day, count(*) AS n_new FROM f GROUP BY 1")
def win_new_in_batch(spark, d):
    """Ids that no earlier batch had."""
    f = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("day"))
    return f.groupBy("day").agg(F.count("*").alias("n_new"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) AS b FROM orders GROUP BY 1) SELECT month, round(sum(a) OVER w / sum(b) OVER w, 9) AS cumulative, b - lag(b) OVER w AS change FROM m WINDOW w AS (ORDER BY month)")
def win_cumulative(spark, d):
    """Cumulative ratio over steps, and change from the step before."""
    m = load(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count("*").alias("b"))
    o = Window.orderBy("month")  # one row for each month
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    return m.select("month", F.round(F.try_divide(F.sum("a").over(w), F.sum("b").over(w)), 9).alias("cumulative"), (F.col("b") - F.lag("b").over(o)).alias("change"))


@query("WITH c AS (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50) SELECT o_orderkey, o_totalprice, total, total > 100 AS truncated FROM t, c")
def top_page(spark, d):
    """A page of a total order, with the total and whether more follows (L1, L2, L3)."""
    o = load(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'O'")
    total = o.agg(F.count("*").alias("total"))
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(50)
    return page.join(F.broadcast(total)).select("o_orderkey", "o_totalprice", "total", (F.col("total") > 100).alias("truncated"))  # one row


@query(
    """WITH t AS (SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50), u AS (SELECT *, (('0x' || substr(sha256('5|' || p_partkey), 1, 10))::BIGINT + 0.5::DOUBLE) / 1099511627776 AS u FROM t)
 SELECT p_partkey, p_retailprice FROM u ORDER BY p_retailprice / 100.0 - ln(-ln(u)) DESC, p_partkey LIMIT 5"""
)
def top_softmax_sample(spark, d):
    """Five of the fifty best by softmax sampling without replacement: Gumbel noise from a seeded hash."""
    top = load(spark, d, "part", "p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)
    u = (F.conv(F.substring(fn.stable_rank(F.lit(5), F.col("p_partkey")), 1, 10), 16, 10).cast("bigint") + F.lit(0.5)) / float(1 << 40)
    return top.withColumn("key", F.col("p_retailprice") / 100.0 - F.log(-F.log(u))).orderBy(F.desc("key"), "p_partkey").limit(5).select("p_partkey", "p_retailprice")


# --- set operations


@query("(SELECT DISTINCT 'missing' AS side, o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)) UNION ALL (SELECT DISTINCT 'extra', user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders))")
def set_difference(spark, d):
    """Difference in both directions."""
    a, b = load(spark, d, "orders", F.col("o_custkey").alias("k")), load(spark, d, "events", F.col("user_id").alias("k"))
    return a.exceptAll(a.limit(0)).select("k").subtract(b).select(F.lit("missing").alias("side"), "k").union(b.subtract(a).select(F.lit("extra"), "k"))


@query("SELECT k, count(*) AS n_batches, min(day) AS first_seen, max(day) AS last_seen FROM (SELECT DISTINCT user_id AS k, ts::DATE AS day FROM events) q GROUP BY k")
def set_batch_union(spark, d):
    """Historic union of batches with first and last seen."""
    return load(spark, d, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).distinct().groupBy("k").agg(F.count("*").alias("n_batches"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL) q GROUP BY user_id")
def set_ordered_distinct(spark, d):
    """Distinct values in the order of their first occurrence (U4)."""
    f = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return f.groupBy("user_id").agg(F.concat_ws(">", F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])).alias("kinds"))


@query(
    """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id"""
)
def set_changes(spark, d):
    """Added, removed, changed between two states."""
    e = load(spark, d, "events", "user_id", "ts")
    cut = F.lit("2024-01-16").cast("timestamp")
    a = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.count("*").alias("a"))
    b = e.where(F.col("ts") >= cut).groupBy("user_id").agg(F.count("*").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "user_id", "full").select("user_id", change.alias("change"))
