"""Registered queries of identity, memory, ledger gates, trials, graph rules and roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.operators import graph, identity, resampling, retrieval, vectors
from ledgerloom.plans.graph_queries import components_sql
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import numbered
from ledgerloom.plans.registry import query
from ledgerloom.sources import graph_tables as g
from ledgerloom.sources.tables import load

# --- identity: a hundredth of the vectors, each stretched a little, against all

STRETCH = "list_transform(embedding, lambda x, i: x::DOUBLE * (1 + 0.25 * (i % 3)))"
VIEWS_SQL = f"""q AS (SELECT vec_id AS query_id, label AS ql, ({STRETCH})[1:32] AS q1, ({STRETCH})[33:64] AS q2 FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS id, label AS bl, embedding[1:32]::DOUBLE[] AS b1, embedding[33:64]::DOUBLE[] AS b2 FROM embeddings)"""


def _views(spark, d):
    e = load(spark, d, "embeddings")
    double = F.transform("embedding", lambda x: x.cast("double"))
    stretched = F.transform("embedding", lambda x, i: x.cast("double") * (1 + 0.25 * ((i + 1) % 3)))
    half = lambda v, at: F.slice(v, at, 32)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("name"), half(stretched, 1).alias("v1"), half(stretched, 33).alias("v2"))
    return asked, e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("name"), half(double, 1).alias("v1"), half(double, 33).alias("v2"))


@query(
    f"""WITH {VIEWS_SQL}, s AS (SELECT query_id, id, ql = bl AS named, list_cosine_similarity(q1, b1) AS c1, list_cosine_similarity(q2, b2) AS c2 FROM q, b), r AS (SELECT *, (c1 + c2) / 2 AS c, row_number() OVER w AS place, lead((c1 + c2) / 2) OVER w AS second FROM s WINDOW w AS (PARTITION BY query_id ORDER BY (c1 + c2) / 2 DESC, id))
 SELECT query_id, id, round(c1, 6) AS label_score, round(c2, 6) AS semantic_score, CASE WHEN c < 0.72 THEN 'new' WHEN named AND c1 >= 0.92 AND c2 >= 0.90 AND c >= 0.91 AND c - second >= 0.04 THEN 'merge' ELSE 'ambiguous' END AS decision FROM r WHERE place = 1"""
)
def id_identity_gate(spark, d):
    """Two views of a node against the nodes there are: merged only with name evidence and both scores and a margin."""
    asked, base = _views(spark, d)
    return identity.gate(asked, base).select("query_id", "id", F.round("label_score", 6).alias("label_score"), F.round("semantic_score", 6).alias("semantic_score"), "decision")


@query(
    f"""WITH {VIEWS_SQL}, s AS (SELECT query_id, id, list_cosine_similarity(list_concat(q1, q2), list_concat(b1, b2)) AS c FROM q, b), r AS (SELECT query_id, max_by(id, (c, -id)) AS id, max(c) AS c, count(*) FILTER (c > 0.85) AS n_sure FROM s GROUP BY query_id)
 SELECT query_id, CASE WHEN c >= 0.72 THEN id END AS id, n_sure::BIGINT AS n_sure, CASE WHEN n_sure = 1 THEN 'alias' WHEN n_sure > 1 THEN 'ambiguous' WHEN c >= 0.72 THEN 'similar' ELSE 'new' END AS band FROM r"""
)
def id_three_bands(spark, d):
    """An alias above the upper bound if there is one candidate, a similar edge between the bounds, else a new node."""
    asked, base = _views(spark, d)
    whole = lambda x: x.select("id", F.concat("v1", "v2").alias("v"))
    return identity.bands(whole(asked), whole(base))


@query(
    """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE NOT (a.vec_id % 7 = b.vec_id % 7 AND b.vec_id - a.vec_id = 7)) SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.35"""
)
def id_unlinked_pairs(spark, d):
    """Similar pairs of all vectors that no link joins yet; here each vector is linked to the seventh after it."""
    e = load(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    linked = e.select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    return vectors.pairs_between(e, 0.35).join(linked, ["a", "b"], "left_anti").select("a", "b", F.round("score", 6).alias("score"))


@query()
def id_split_plan(spark, d):
    """Groups of six or more cut in two, whether the split counts, and the five members nearest to each centre."""
    return identity.split_plan(load(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


@query(
    """WITH m AS (SELECT DISTINCT trim(hub_id) AS hub, work_id FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND work_id IS NOT NULL), n AS (SELECT hub, count(*) AS n FROM m GROUP BY hub),
 o AS (SELECT a.hub, a.work_id, b.hub AS other, nb.n AS size FROM m a JOIN n na ON a.hub = na.hub AND na.n > 60 JOIN m b ON a.work_id = b.work_id AND a.hub <> b.hub JOIN n nb ON b.hub = nb.hub AND nb.n <= 60)
 SELECT hub, work_id, min_by(other, (size, other)) AS into_hub FROM o GROUP BY hub, work_id"""
)
def id_redistribute(spark, d):
    """Members of overloaded hubs that another of their hubs can take, to the least loaded one."""
    m = load(spark, d, "hub_paper_incidence", "hub_id", "work_id").where("hub_id is not null and work_id is not null").select(F.trim("hub_id").alias("hub"), "work_id").distinct()
    return identity.redistribute(m, "hub", "work_id", 60).withColumnRenamed("into", "into_hub")


@query(
    """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT id, label, v FROM e UNION ALL SELECT id + 1000000, label % 3, list_transform(v, lambda y, i: y * (1 + 0.25 * (i % 3))) FROM e WHERE id % 10 = 0)
 SELECT a.id AS a, b.id AS b, CASE WHEN a.label = b.label THEN 'same' ELSE 'relate' END AS decision FROM x a JOIN x b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9"""
)
def id_propositions(spark, d):
    """Statements of a cosine of 0.9 or more: with other words they are related, never merged."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", double.alias("v"))
    copies = e.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), (F.col("label") % 3).alias("label"), F.transform("v", lambda y, i: y * (1 + 0.25 * ((i + 1) % 3))).alias("v"))
    x = Cuts(spark, "propositions").cut(e.unionByName(copies))
    name = lambda s: x.select(F.col("id").alias(s), F.col("label").alias(f"{s}_l"))
    near = vectors.pairs_between(x.select("id", "v"), 0.9).join(name("a"), "a").join(name("b"), "b")
    return near.select("a", "b", F.when(F.col("a_l") == F.col("b_l"), "same").otherwise("relate").alias("decision"))


@query(
    """SELECT trim(hub_id) AS hub, count(DISTINCT work_id) AS n_works, count(DISTINCT paper_id) AS n_papers, min(recorded_at) AS first_seen, max(recorded_at) AS last_seen, max(supporting_member_node_count) AS most_support, count(DISTINCT work_id) FILTER (official_gold = 1) AS n_gold, count(DISTINCT work_id) > 30 AS overloaded
 FROM hub_paper_incidence WHERE hub_id IS NOT NULL GROUP BY 1"""
)
def id_hub_inspect(spark, d):
    """What a hub holds: works, papers, support, times, gold, and whether it is beyond its capacity."""
    h = load(spark, d, "hub_paper_incidence").where("hub_id is not null").withColumn("hub", F.trim("hub_id"))
    works = F.count_distinct("work_id")
    return h.groupBy("hub").agg(
        works.alias("n_works"), F.count_distinct("paper_id").alias("n_papers"), F.min("recorded_at").alias("first_seen"), F.max("recorded_at").alias("last_seen"),
        F.max("supporting_member_node_count").alias("most_support"), F.count_distinct(F.when(F.col("official_gold") == 1, F.col("work_id"))).alias("n_gold"), (works > 30).alias("overloaded"),
    )


# --- memory and retrieval


@query(
    """WITH u AS (SELECT paper_id, manifest_title, physh_title, doi, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC, sequence_index DESC) AS r FROM physh_gold_matched WHERE paper_id IS NOT NULL), m AS (SELECT run_id, min(doi) AS doi FROM manifest GROUP BY run_id)
 SELECT paper_id, array_to_string(list_filter([CASE WHEN m.run_id IS NULL THEN 'unbound' END, CASE WHEN u.doi IS DISTINCT FROM m.doi AND m.run_id IS NOT NULL THEN 'doi differs' END, CASE WHEN manifest_title IS DISTINCT FROM physh_title THEN 'title differs' END], lambda x: x IS NOT NULL), ',') AS warnings FROM u LEFT JOIN m ON u.paper_id = m.run_id WHERE r = 1"""
)
def ret_unit_read(spark, d):
    """The current revision of each unit, with warnings where it no longer fits what it is bound to."""
    w = Window.partitionBy("paper_id").orderBy(F.desc("loaded_at"), F.desc("sequence_index"))
    u = load(spark, d, "physh_gold_matched", "paper_id", "manifest_title", "physh_title", "doi", "loaded_at", "sequence_index").where("paper_id is not null").withColumn("r", F.row_number().over(w)).where("r = 1")
    m = load(spark, d, "manifest", "run_id", "doi").groupBy("run_id").agg(F.min("doi").alias("m_doi"))
    bound = F.col("run_id").isNotNull()
    warn = F.array_compact(F.array(F.when(~bound, "unbound"), F.when(bound & ~F.col("doi").eqNullSafe(F.col("m_doi")), "doi differs"), F.when(~F.col("manifest_title").eqNullSafe(F.col("physh_title")), "title differs")))
    return u.join(m, F.col("paper_id") == F.col("run_id"), "left").select("paper_id", F.array_join(warn, ",").alias("warnings"))


@query(
    """WITH t AS (SELECT work_id AS subject, step, publication_date AS value FROM trajectory WHERE work_id IS NOT NULL), c AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY subject ORDER BY step)), k AS (SELECT * FROM c WHERE r = 1 OR value IS DISTINCT FROM before)
 SELECT subject, max(step) AS step, max_by(coalesce(value, ''), step) AS value, count(*) - 1 AS n_superseded FROM k GROUP BY subject"""
)
def ret_memory(spark, d):
    """What is remembered of each subject: the last entry, and how many it superseded; repeats make none."""
    t = load(spark, d, "trajectory", F.col("work_id").alias("subject"), F.col("step").alias("at"), F.coalesce("publication_date", F.lit("")).alias("value")).where("subject is not null")
    return retrieval.recall(t).select("subject", F.col("at").alias("step"), "value", "n_superseded")


@query(
    r"""WITH h AS (SELECT trim(hub_id) AS exp, split_part(trim(hub_id), '/', 1) AS event, list_distinct(regexp_extract_all(lower(max(hub_label)), '[a-z]{5,}')) AS triggers FROM hub_paper_incidence WHERE hub_id IS NOT NULL GROUP BY trim(hub_id)),
 q AS (SELECT id, domain, list_distinct(regexp_extract_all(lower(query), '[a-z]{5,}')) AS words FROM retrieval_benchmark_real WHERE query IS NOT NULL AND top_k < 10),
 s AS (SELECT id, exp, len(list_intersect(triggers, words)) AS hits FROM q JOIN h ON q.domain = h.event WHERE len(list_intersect(triggers, words)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, exp) AS place FROM s)
 SELECT id, exp, hits::INT AS hits, place FROM r WHERE place <= 3"""
)
def ret_experience(spark, d):
    """Experiences whose trigger words and event fit a request, three at most; none for requests that a playbook serves."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{5,})"), F.lit(1)))
    h = load(spark, d, "hub_paper_incidence", "hub_id", "hub_label").where("hub_id is not null").groupBy(F.trim("hub_id").alias("exp")).agg(F.max("hub_label").alias("label"))
    h = h.select("exp", F.split("exp", "/")[0].alias("event"), F.explode(words("label")).alias("word"))
    q = load(spark, d, "retrieval_benchmark_real", "id", "domain", "query", "top_k").where("query is not null and top_k < 10").select("id", F.col("domain").alias("event"), F.explode(words("query")).alias("word"))
    hits = q.join(h, ["event", "word"]).groupBy("id", "exp").agg(F.count("*").cast("int").alias("hits"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hits"), "exp"))
    return hits.withColumn("place", place.cast("bigint")).where("place <= 3").select("id", "exp", "hits", "place")


@query(
    r"""WITH a AS (SELECT doc_id, lower(coalesce(path, '')) AS name, lower(coalesce(regexp_extract(text, '(?m)^#\s+(.*)$', 1), '')) AS purpose, lower(coalesce(source, '')) AS tags FROM documents),
 s AS (SELECT doc_id, (SELECT sum(contains(name, w)::INT + contains(purpose, w)::INT + contains(tags, w)::INT) FROM (SELECT unnest(['lattice', 'wiki', 'note', 'graph']) AS w) k) AS hits FROM a) SELECT doc_id, hits::INT AS hits FROM s WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 30"""
)
def ret_assets(spark, d):
    """Assets by their hits in name, purpose and tags, thirty at most."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    a = load(spark, d, "documents", "doc_id", "path", "text", "source").select("doc_id", low(F.col("path")).alias("name"), low(F.regexp_extract("text", r"(?m)^#\s+(.*)$", 1)).alias("purpose"), low(F.col("source")).alias("tags"))
    hits = sum((F.contains(F.col(c), F.lit(w)).cast("int") for c in ("name", "purpose", "tags") for w in ("lattice", "wiki", "note", "graph")), F.lit(0))
    return a.select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(30)


@query(
    """WITH m AS (SELECT work_id, max(supporting_member_node_count) * 0.5 + max(official_gold) * 0.3 + (count(DISTINCT trim(hub_id)) >= 2)::INT * 0.2 AS score FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND work_id IS NOT NULL GROUP BY work_id)
 SELECT work_id, round(score::DOUBLE, 6) AS score FROM m ORDER BY coalesce(round(score::DOUBLE, 6), -1) DESC, work_id LIMIT 50 OFFSET 50"""
)
def ret_citing_page(spark, d):
    """The second page of citing works, ranked by their best levels and a clue of type."""
    m = load(spark, d, "hub_paper_incidence").where("hub_id is not null and work_id is not null").groupBy("work_id").agg(F.round(F.max("supporting_member_node_count") * 0.5 + F.max("official_gold") * 0.3 + (F.count_distinct(F.trim("hub_id")) >= 2).cast("int") * 0.2, 6).alias("score"))
    return m.orderBy(F.desc(F.coalesce("score", F.lit(-1.0))), "work_id").offset(50).limit(50)


@query(
    """SELECT sequence_index, CASE WHEN trim(coalesce(title, '')) <> '' AND trim(coalesce(doi, '')) <> '' AND trim(coalesce(canonical_pdf_sha256, '')) <> '' AND publication_evidence IS NOT NULL AND role IN ('publication_candidate', 'report') THEN 'admitted' ELSE 'other' END AS evidence FROM manifest"""
)
def ret_evidence(spark, d):
    """What a report may cite: complete, attributed and of an admitted kind; all else is other."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    good = there("title") & there("doi") & there("canonical_pdf_sha256") & F.col("publication_evidence").isNotNull() & F.coalesce(F.col("role").isin("publication_candidate", "report"), F.lit(False))
    return load(spark, d, "manifest").select("sequence_index", F.when(good, "admitted").otherwise("other").alias("evidence"))


# --- ledger gates


@query()
def led_near_titles(spark, d):
    """Titles that differ from another by less than a twentieth: candidates of versions, for a decision."""
    titles = lambda t, c: load(spark, d, t, F.lower(F.trim(c)).alias("name")).where("name <> ''").distinct()
    near = retrieval.ratio_pairs(titles("manifest", "title"), titles("physh_gold_matched", "physh_title"), 0.95).where("name <> best and ratio > 0.95")
    return near.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "best")).alias("t")).select("name", "t.best", F.round(-F.col("t.r"), 9).alias("ratio"))


@query(
    r"""WITH c AS (SELECT doc_id, updated_at, unnest(list_distinct(regexp_extract_all(text, 'raw/([a-z]+)-[a-z0-9]+\.md', 1))) AS stem FROM documents WHERE text IS NOT NULL AND updated_at IS NOT NULL),
 s AS (SELECT regexp_extract(path, '([a-z]+)-[a-z0-9]+\.md$', 1) AS stem, max(updated_at) AS changed FROM documents WHERE path IS NOT NULL GROUP BY 1)
 SELECT doc_id, count(*) AS n_anchors, count(*) FILTER (changed > updated_at) AS n_changed, CASE WHEN count(*) FILTER (changed > updated_at) > 0 THEN 'possibly_stale' ELSE 'fresh' END AS state FROM c JOIN s USING (stem) GROUP BY doc_id"""
)
def led_stale(spark, d):
    """Texts whose cited sources changed after them."""
    docs = load(spark, d, "documents", "doc_id", "text", "updated_at", "path")
    c = docs.where("text is not null and updated_at is not null").select("doc_id", "updated_at", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"raw/([a-z]+)-[a-z0-9]+\.md"), F.lit(1)))).alias("stem"))
    s = docs.where("path is not null").groupBy(F.regexp_extract("path", r"([a-z]+)-[a-z0-9]+\.md$", 1).alias("stem")).agg(F.max("updated_at").alias("changed"))
    n = F.count_if(F.col("changed") > F.col("updated_at"))
    return c.join(s, "stem").groupBy("doc_id").agg(F.count("*").alias("n_anchors"), n.alias("n_changed"), F.when(n > 0, "possibly_stale").otherwise("fresh").alias("state"))


@query(
    """WITH e AS (SELECT session_id, lower(trim(type)) AS kind, CASE WHEN json_valid(data) THEN data END AS data FROM session_event WHERE session_id IS NOT NULL),
 s AS (SELECT session_id, count(DISTINCT try_cast(json_extract_string(data, '$.turn') AS INT)) FILTER (kind = 'turn/start') AS actual, max(try_cast(json_extract_string(data, '$.turn') AS INT)) FILTER (kind = 'turn/start') + 1 AS declared, max(try_cast(json_extract_string(data, '$.round') AS INT)) FILTER (kind = 'step/start') AS loops FROM e GROUP BY session_id)
 SELECT session_id, CASE WHEN declared IS NULL THEN 'no turns' WHEN loops > 3 THEN 'too many loops' WHEN declared <> actual THEN 'profile differs' ELSE 'sound' END AS finding FROM s"""
)
def led_trace_audit(spark, d):
    """Traces with more than three loops, or whose turns aren't those declared."""
    number = lambda k: F.get_json_object("data", f"$.{k}").try_cast("int")
    e = load(spark, d, "session_event", "session_id", F.lower(F.trim("type")).alias("kind"), "data").where("session_id is not null")
    turn, loop = F.when(F.col("kind") == "turn/start", number("turn")), F.when(F.col("kind") == "step/start", number("round"))
    s = e.groupBy("session_id").agg(F.count_distinct(turn).alias("actual"), (F.max(turn) + 1).alias("declared"), F.max(loop).alias("loops"))
    return s.select("session_id", F.when(F.col("declared").isNull(), "no turns").when(F.col("loops") > 3, "too many loops").when(F.col("declared") != F.col("actual"), "profile differs").otherwise("sound").alias("finding"))


#: What an entry in a state must have.
REQUIRED = {"include": ("title", "publication_year"), "related": ("related_to",), "exclude": ("adjudication_note",), "review": ("review_reasons",)}
RULES_SQL = " UNION ALL ".join(f"SELECT sequence_index, decision AS state, '{c}' AS lacks FROM manifest WHERE decision = '{s}' AND ({c} IS NULL OR trim({c}::VARCHAR) = '')" for s, cs in REQUIRED.items() for c in cs)


@query(RULES_SQL)
def led_state_gates(spark, d):
    """Entries that lack what their state requires, a row for each field."""
    m = load(spark, d, "manifest")
    lacks = lambda s, c: F.when((F.col("decision") == s) & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""), c)
    return m.select("sequence_index", F.col("decision").alias("state"), F.explode(F.array_compact(F.array(*[lacks(s, c) for s, cs in REQUIRED.items() for c in cs]))).alias("lacks"))


@query(
    """WITH r AS (SELECT hub_index, count(DISTINCT lower(trim(judge_id))) AS judges, bool_and(coalesce(length(prompt_sha256) = 64, false)) AS hashed, bool_or(response.membership IS NOT NULL) AS membership, bool_or(response.set_coherence IS NOT NULL) AS coherence FROM judge_output WHERE hub_index IS NOT NULL GROUP BY hub_index)
 SELECT hub_index, judges >= 3 AND hashed AND membership AND coherence AS qualified, array_to_string(list_filter([CASE WHEN judges < 3 THEN 'judges' END, CASE WHEN NOT hashed THEN 'hash' END, CASE WHEN NOT membership THEN 'membership' END, CASE WHEN NOT coherence THEN 'coherence' END], lambda x: x IS NOT NULL), ',') AS lacks FROM r"""
)
def led_run_gate(spark, d):
    """Runs that have all roles, hashes and parts that acceptance requires, and what the others lack."""
    r = load(spark, d, "judge_output", "hub_index", "judge_id", "prompt_sha256", "response").where("hub_index is not null").groupBy("hub_index").agg(
        F.count_distinct(F.lower(F.trim("judge_id"))).alias("judges"), F.bool_and(F.coalesce(F.length("prompt_sha256") == 64, F.lit(False))).alias("hashed"),
        F.bool_or(F.col("response.membership").isNotNull()).alias("membership"), F.bool_or(F.col("response.set_coherence").isNotNull()).alias("coherence"),
    )
    lacks = F.array_compact(F.array(F.when(F.col("judges") < 3, "judges"), F.when(~F.col("hashed"), "hash"), F.when(~F.col("membership"), "membership"), F.when(~F.col("coherence"), "coherence")))
    return r.select("hub_index", (F.size(lacks) == 0).alias("qualified"), F.array_join(lacks, ",").alias("lacks"))


# --- trials


@query()
def stat_trials(spark, d):
    """Blinded trials: papers of a hub beside controls of their time that the hub doesn't have, domain first, reused only when none is left; with the key."""
    i = load(spark, d, "hub_paper_incidence", "hub_id", "paper_id", "year").where("hub_id is not null and paper_id is not null").select(F.trim("hub_id").alias("hub"), "paper_id", "year")
    return resampling.trials(spark, i, most=6)


@query(
    """WITH v AS (SELECT DISTINCT lower(trim(judge_id)) AS judge, r.trial_id AS trial, lower(trim(r.choice)) AS choice FROM (SELECT judge_id, unnest(response.membership) AS r FROM judge_output) u),
 k AS (SELECT trial_id AS trial, hub_id AS hub, lower(true_position) AS y FROM trial_key WHERE true_position IS NOT NULL AND hub_id IS NOT NULL),
 j AS (SELECT judge, hub, choice, (choice = y)::INT AS hit FROM v JOIN k USING (trial) WHERE judge IS NOT NULL AND choice IN ('a', 'b', 'tie')),
 h AS (SELECT hub, avg(hit) - 0.5 AS d FROM j GROUP BY hub), z AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS z FROM h),
 p AS (SELECT judge, avg(hit) AS agree, avg((choice = 'a')::INT) AS a_share, count(DISTINCT hub) AS n_hubs FROM j GROUP BY judge), n AS (SELECT count(DISTINCT hub) AS n FROM k),
 g AS (SELECT any_value(z) > 1.645 AS primary_, bool_and(agree > 0.5) AS direction, bool_and(abs(a_share - 0.5) <= 0.1) AS position, bool_and(n_hubs = n) AS coverage FROM p, z, n) SELECT primary_, direction, position, coverage, primary_ AND direction AND position AND coverage AS passed FROM g"""
)
def stat_gate(spark, d):
    """A confirmatory gate of four conditions: judges beat chance over hubs (one-sided 5 %), every judge does, none leans to a side, every judge saw every hub."""
    votes = load(spark, d, "judge_output", F.lower(F.trim("judge_id")).alias("judge"), F.explode("response.membership").alias("r"))
    votes = votes.select("judge", F.col("r.trial_id").alias("trial"), F.lower(F.trim("r.choice")).alias("choice")).distinct()
    key = load(spark, d, "trial_key", F.col("trial_id").alias("trial"), F.col("hub_id").alias("hub"), F.lower("true_position").alias("y")).where("y is not null and hub is not null")
    j = votes.join(key, "trial").where(F.col("judge").isNotNull() & F.col("choice").isin("a", "b", "tie")).withColumn("hit", (F.col("choice") == F.col("y")).cast("int"))
    h = j.groupBy("hub").agg((F.avg("hit") - 0.5).alias("d")).agg((F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("z"))
    p = j.groupBy("judge").agg(F.avg("hit").alias("agree"), F.avg((F.col("choice") == "a").cast("int")).alias("a_share"), F.count_distinct("hub").alias("n_hubs"))
    rows = p.join(F.broadcast(h)).join(F.broadcast(key.agg(F.count_distinct("hub").alias("n"))))  # one row each
    gate = rows.agg(F.any_value(F.col("z") > 1.645).alias("primary_"), F.bool_and(F.col("agree") > 0.5).alias("direction"), F.bool_and(F.abs(F.col("a_share") - 0.5) <= 0.1).alias("position"), F.bool_and(F.col("n_hubs") == F.col("n")).alias("coverage"))
    return gate.withColumn("passed", F.col("primary_") & F.col("direction") & F.col("position") & F.col("coverage"))


# --- graph


@query(
    f"WITH {g.EDGES_SQL}, e2 AS (SELECT s, p, o FROM edges UNION ALL SELECT 'part/' || p_partkey, 'similar', 'part/' || (p_partkey + 1) FROM part WHERE p_partkey % 2 = 0) SELECT p, count(*) AS n FROM e2 WHERE p <> 'similar' GROUP BY p"
)
def graph_without_similar(spark, d):
    """Edges without those of mere similarity, as views show them unless asked."""
    e = g.edges(spark, d).select("s", "p", "o")
    alike = load(spark, d, "part", "p_partkey").where("p_partkey % 2 = 0").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("s"), F.lit("similar").alias("p"), F.concat(F.lit("part/"), (F.col("p_partkey") + 1).cast("string")).alias("o"))
    return graph.shown(e.unionByName(alike)).groupBy("p").agg(F.count("*").alias("n"))


UP_SQL = f"WITH {g.EDGES_SQL}, up AS (SELECT s, o FROM edges WHERE p IN ('placed_by', 'in'))"


@query(
    UP_SQL + """, a AS (SELECT s AS node, o AS ancestor, 1 AS generation FROM up UNION ALL SELECT x.s, y.o, 2 FROM up x JOIN up y ON x.o = y.s UNION ALL SELECT x.s, z.o, 3 FROM up x JOIN up y ON x.o = y.s JOIN up z ON y.o = z.s)
 SELECT node, ancestor, min(generation)::INT AS generation FROM a GROUP BY ALL"""
)
def graph_blood(spark, d):
    """Ancestors of three generations: nodes that have one another among them are never merged."""
    return graph.ancestors(g.edges(spark, d).where(F.col("p").isin("placed_by", "in")), 3)


@query(
    components_sql("p IN ('placed_by', 'cites')") + " SELECT a, b, coalesce(x.component = y.component, false) AS exists FROM (SELECT 'customer/' || c_custkey AS a, 'part/' || c_custkey AS b FROM customer) p LEFT JOIN cc x ON x.path = a LEFT JOIN cc y ON y.path = b"
)
def graph_path_exists(spark, d):
    """Whether two nodes are connected at all: customers and the parts of their number, over lines and suppliers."""
    e = g.edges(spark, d).where(F.col("p").isin("placed_by", "cites"))
    pairs = load(spark, d, "customer", "c_custkey").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("part/"), F.col("c_custkey").cast("string")).alias("b"))
    return graph.connected(spark, e, pairs)


# --- roll-ups


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, 'cube' AS kind FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, l_linestatus, count(*), sum(l_quantity)::DOUBLE, 'rollup' FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def agg_cube_rollup(spark, d):
    """Cube and rollup."""
    l = load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    cells = lambda x, kind: x.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity")).withColumn("kind", F.lit(kind))
    return cells(l.cube("l_returnflag", "l_linestatus"), "cube").unionByName(cells(l.rollup("l_returnflag", "l_linestatus"), "rollup"))


@query("SELECT l_returnflag, true AS within FROM lineitem GROUP BY 1")
def agg_approx_distinct(spark, d):
    """Approximate distinct counts, and that they lie within a tenth of the exact ones."""
    l = load(spark, d, "lineitem", "l_returnflag", "l_partkey").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.count_distinct("l_partkey").alias("exact"))
    return l.select("l_returnflag", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within"))
