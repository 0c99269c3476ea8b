"""Registered queries of the subpackage, with SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import consensus, conversations, cooccurrence, duplicates, mixing, similar_sets, tokens, toxicity
from ledgerloom.plans import stamp_sql
from ledgerloom.sources.tables import load

P1_FIELDS = {"title": False, "doi": True, "canonical_pdf_sha256": False}


def _records(spark: SparkSession, d: str) -> DataFrame:
    names = ["sequence_index", *P1_FIELDS]
    typed = load(spark, d, "manifest", *names)
    raw = duplicates.from_json_payload(load(spark, d, "manifest_raw", "sequence_index", "payload"), "payload", list(P1_FIELDS)).select(*names)
    return typed.unionByName(raw)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that are copies of an earlier one."""
    rows = duplicates.copies(_records(spark, d), "sequence_index", P1_FIELDS)
    return rows.select(F.col("keeper").cast("bigint").alias("sequence_index_a"), F.col("id").cast("bigint").alias("sequence_index_b"))


def p1_works(spark: SparkSession, d: str) -> DataFrame:
    """One record for each work, with its number of copies."""
    groups = duplicates.collapse(_records(spark, d), "sequence_index", P1_FIELDS)
    return groups.select(F.col("keeper").cast("bigint").alias("sequence_index"), F.col("n_copies").cast("bigint").alias("n_copies"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    out = load(spark, d, "judge_output", "judge_id", "response", "submitted_at")
    pick = lambda x: F.struct(x["trial_id"].alias("item"), x["choice"].alias("label"))
    single = F.when(F.col("response.set_coherence").isNotNull(), F.array(pick(F.col("response.set_coherence")))).otherwise(F.array().cast("array<struct<item:string,label:string>>"))
    many = F.coalesce(F.transform("response.membership", pick), F.array().cast("array<struct<item:string,label:string>>"))
    return out.select(F.col("judge_id").alias("judge"), F.explode(F.concat(many, single)).alias("v"), F.col("submitted_at").alias("at")).select("judge", "v.item", "v.label", "at")


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(spark, _votes(spark, d), load(spark, d, "trial_key", F.col("trial_id").alias("item")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus choice of each trial."""
    decided = consensus.decide(spark, _votes(spark, d), load(spark, d, "trial_key", F.col("trial_id").alias("item")))[0]
    return decided.select(F.col("item").alias("trial_id"), "choice")


def p2_trials(spark: SparkSession, d: str) -> DataFrame:
    """Consensus with its certainty and the agreement of the votes with it."""
    return _consensus(spark, d)[0].select(F.col("item").alias("trial_id"), F.col("label").alias("choice"), "certainty", "agreement", "n_votes")


def p2_judges(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of each judge."""
    return _consensus(spark, d)[1].select(F.col("judge").alias("judge_id"), "skill", "accuracy", "n_votes")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "session_event", "event_id", "session_id", "host", "ts", "type", "data")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The sessions to drop."""
    return conversations.rebuild(spark, _events(spark, d), load(spark, d, "clock_zone"))[0].where("dropped").select("session_id")


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The kept sessions as ordered messages with speakers."""
    events = _events(spark, d)
    return conversations.ordered_messages(*conversations.rebuild(spark, events, load(spark, d, "clock_zone")), events)


def _label(c):
    return F.lower(F.regexp_replace(F.btrim(c, F.lit(" \t\n\r 　")), r"[\s\p{Z}]+", " "))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    papers = load(spark, d, "physh_gold_matched", "paper_id", "concepts")
    concepts = papers.select(F.lit("concept").alias("kind"), F.col("paper_id").alias("basket"), F.explode("concepts").alias("item")).withColumn("item", _label(F.col("item"))).where("item <> ''")
    hubs = load(spark, d, "hub_paper_incidence", "hub_id", "work_id").select(F.lit("hub").alias("kind"), F.col("work_id").alias("basket"), F.btrim("hub_id", F.lit(" \t\n\r 　")).alias("item"))
    return concepts.unionByName(hubs)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concepts or hubs that occur together ten times or more, and three times as often as by chance."""
    pairs = cooccurrence.pair_counts(spark, _baskets(spark, d), least=10)
    return cooccurrence.at_least(pairs, 3).select("kind", "item_a", "item_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs that occur together ten times or more, with counts and lift."""
    return cooccurrence.lift(cooccurrence.pair_counts(spark, _baskets(spark, d), least=10))


P6_F1 = {"concepts": 0.75, "disciplines": 0.5}


def _paper_sets(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.filter(F.transform(c, _label), lambda x: x.isNotNull() & (x != ""))
    return load(spark, d, "physh_gold_matched", "paper_id", "concepts", "disciplines").select(F.col("paper_id").alias("id"), clean("concepts").alias("concepts"), clean("disciplines").alias("disciplines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of papers with similar concepts and disciplines."""
    pairs = similar_sets.similar_pairs(spark, _paper_sets(spark, d), "concepts", P6_F1)
    return pairs.select(F.col("id_a").alias("paper_id_a"), F.col("id_b").alias("paper_id_b"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Each paper with the class of papers of equal sets and its number of similar papers."""
    return similar_sets.class_report(spark, _paper_sets(spark, d), "concepts", P6_F1).select(F.col("id").alias("paper_id"), "class_id", "n_links")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every text as ids of the 50k byte-level vocabulary."""
    return tokens.encode(load(spark, d, "documents", "doc_id", "text"), "text").select("doc_id", "ids")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = tokens.count(load(spark, d, "documents", "doc_id", "source", "text"), "text").select("doc_id", "source", "n_tokens")
    return mixing.mix(spark, docs, load(spark, d, "mix_target"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each source."""
    return _mix(spark, d)[1]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(load(spark, d, "documents", "doc_id", "source", "text"), load(spark, d, "doc_review", "doc_id", "flagged"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an offending passage."""
    return _scores(spark, d).where("offending").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and offending spans of every document."""
    return _scores(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of offending documents per source."""
    hit = F.col("offending").cast("bigint")
    return _scores(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_offending"), F.avg(hit.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_works, p2_found, p2_trials, p2_judges, p3_found, p3_conversations, p5_found, p5_pairs,
        p6_found, p6_links, p7_ids, p8_mix, p8_shares, p9_found, p9_scores, p9_rates,
    )
}

# --- SQL of those that it can express over whole tables


def _canonical(c: str, resolver: bool = False) -> str:
    bare = f"nfc_normalize({c})"
    if resolver:
        bare = f"regexp_replace(regexp_replace(lower({bare}), '{duplicates.RESOLVER_SQL}', ''), '{duplicates.RESOLVER_SQL}', '')"
    kept = rf"lower(upper(regexp_replace({bare}, '[^\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}]+|[\x{{FE00}}-\x{{FE0F}}]', '', 'g')))"
    return rf"CASE WHEN {c} IS NULL OR regexp_matches({c}, '^[\s\p{{Z}}]*$') THEN ' ' ELSE {kept} END"


def _pick(field: str) -> str:
    return f"json_extract_string(j, '$.\"' || list_filter(json_keys(j), lambda k: lower(k) = '{field}')[1] || '\"') AS {field}"


WORKS_SQL = f"""WITH p AS (SELECT sequence_index, payload::JSON AS j FROM (SELECT * FROM manifest_raw WHERE payload IS NOT NULL AND json_valid(payload)) q WHERE starts_with(trim(payload, ' \t\n\r'), '{{')),
 r AS (SELECT sequence_index, title, doi, canonical_pdf_sha256 FROM manifest UNION ALL SELECT sequence_index, {", ".join(_pick(f) for f in P1_FIELDS)} FROM p),
 c AS (SELECT sequence_index AS id, {", ".join(f"{_canonical(f, resolver)} AS c{i}" for i, (f, resolver) in enumerate(P1_FIELDS.items()))} FROM r)"""
SPACE = " \t\n\r\u00a0\u3000"
_clean_sql = lambda x: f"lower(regexp_replace(trim({x}, '{SPACE}'), '[\\s\\p{{Z}}]+', ' ', 'g'))"
PAIRS_SQL = f"""WITH i AS (SELECT DISTINCT kind, basket, item FROM (SELECT 'concept' AS kind, paper_id AS basket, {_clean_sql("x")} AS item FROM (SELECT paper_id, unnest(concepts) AS x FROM physh_gold_matched) u
  UNION ALL SELECT 'hub', work_id, trim(hub_id, '{SPACE}') FROM hub_paper_incidence) v WHERE basket IS NOT NULL AND item IS NOT NULL AND NOT (kind = 'concept' AND item = '')),
 n AS (SELECT kind, item, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT kind, count(DISTINCT basket) AS n_baskets FROM i GROUP BY kind),
 c AS (SELECT a.kind, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM i a JOIN i b ON a.kind = b.kind AND a.basket = b.basket AND a.item < b.item GROUP BY ALL HAVING count(*) >= 10),
 f AS (SELECT c.kind, item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, n_baskets FROM c JOIN n x ON x.kind = c.kind AND x.item = item_a JOIN n y ON y.kind = c.kind AND y.item = item_b JOIN t ON t.kind = c.kind)"""
SIMILAR_SQL = f"""WITH o AS (SELECT paper_id AS id, 'c' AS f, {_clean_sql("x")} AS item FROM (SELECT paper_id, unnest(concepts) AS x FROM physh_gold_matched) u UNION SELECT paper_id, 'd', {_clean_sql("x")} FROM (SELECT paper_id, unnest(disciplines) AS x FROM physh_gold_matched) u),
 i AS (SELECT * FROM o WHERE id IS NOT NULL AND item <> ''), n AS (SELECT id, f, count(*) AS n FROM i GROUP BY ALL), w AS (SELECT id FROM n GROUP BY id HAVING count(*) = 2),
 c AS (SELECT a.id AS a, b.id AS b, a.f, count(*) AS both_ FROM i a JOIN i b ON a.f = b.f AND a.item = b.item AND a.id < b.id GROUP BY ALL),
 g AS (SELECT c.a, c.b FROM c JOIN n x ON x.id = c.a AND x.f = c.f JOIN n y ON y.id = c.b AND y.f = c.f WHERE 2.0 * both_ / (x.n + y.n) >= CASE c.f WHEN 'c' THEN 0.75 ELSE 0.5 END - 1e-9 GROUP BY ALL HAVING count(*) = 2)"""
TALK_SQL = f"""WITH {stamp_sql.STAMPS},
 e AS (SELECT session_id, utc_us, lower(trim(type, {stamp_sql.BLANK})) AS kind, data, min(event_id) AS event_id FROM session_event JOIN u ON tab = 'session_event' AND record_key = event_id::VARCHAR WHERE session_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT session_id, NULL, lower(trim(type, {stamp_sql.BLANK})), data, min(event_id) FROM session_event WHERE session_id IS NOT NULL AND ts IS NULL GROUP BY ALL),
 k AS (SELECT *, CASE kind WHEN 'user/message' THEN 'user' WHEN 'plugin/message' THEN 'user' WHEN 'assistant/message' THEN 'assistant' WHEN 'tool/result' THEN 'tool' END AS speaker, coalesce(json_valid(data) AND starts_with(trim(data, ' ' || chr(9) || chr(10) || chr(13)), '{{'), false) AS whole FROM e),
 j AS (SELECT *, CASE WHEN whole THEN json_extract_string(data, '$.content') END AS content, CASE WHEN whole THEN json_extract_string(data, '$.call_id') END AS call_id FROM k),
 m AS (SELECT session_id, event_id, utc_us, kind, speaker, content, row_number() OVER (PARTITION BY session_id ORDER BY utc_us, event_id) AS position FROM j WHERE speaker IS NOT NULL AND utc_us IS NOT NULL AND content IS NOT NULL AND NOT regexp_matches(content, '^[\\s\\p{{Z}}]*$')),
 asked AS (SELECT session_id FROM (SELECT session_id, kind, lead(kind) OVER (PARTITION BY session_id ORDER BY position) AS next FROM m WHERE kind IN ('user/message', 'assistant/message')) q WHERE kind = 'user/message' AND next IS DISTINCT FROM 'assistant/message'),
 called AS (SELECT session_id, call_id, min(utc_us) AS at FROM j WHERE kind = 'tool/call' AND call_id IS NOT NULL AND utc_us IS NOT NULL GROUP BY ALL),
 dropped AS (SELECT DISTINCT session_id FROM j WHERE session_id NOT IN (SELECT session_id FROM m) UNION SELECT session_id FROM j WHERE speaker IS NOT NULL AND (utc_us IS NULL OR NOT whole) UNION SELECT session_id FROM m WHERE position = 1 AND kind <> 'user/message'
  UNION SELECT j.session_id FROM j LEFT JOIN called c ON c.session_id = j.session_id AND c.call_id = j.call_id WHERE kind = 'tool/result' AND (c.at IS NULL OR c.at >= j.utc_us) UNION SELECT session_id FROM asked)"""
SQL: dict[str, str] = {
    "p3_found": TALK_SQL + " SELECT session_id FROM dropped",
    "p3_conversations": TALK_SQL + " SELECT session_id, position, speaker, utc_us, content FROM m WHERE session_id NOT IN (SELECT session_id FROM dropped)",
    "p1_found": WORKS_SQL + " SELECT keeper::BIGINT AS sequence_index_a, id::BIGINT AS sequence_index_b FROM (SELECT id, min(id) OVER (PARTITION BY c0, c1, c2) AS keeper FROM c) k WHERE id <> keeper",
    "p1_works": WORKS_SQL + " SELECT min(id)::BIGINT AS sequence_index, count(*) AS n_copies FROM c GROUP BY c0, c1, c2",
    "p5_found": PAIRS_SQL + " SELECT kind, item_a, item_b FROM f WHERE n_ab::HUGEINT * n_baskets >= 3 * n_a::HUGEINT * n_b",
    "p5_pairs": PAIRS_SQL + " SELECT kind, item_a, item_b, n_ab, n_a, n_b, n_baskets, n_ab * n_baskets::DOUBLE / (n_a::DOUBLE * n_b) AS lift FROM f",
    "p6_found": SIMILAR_SQL + " SELECT a AS paper_id_a, b AS paper_id_b FROM g",
    "p6_links": SIMILAR_SQL + """, s AS (SELECT id, string_agg(f || item, chr(1) ORDER BY f, item) AS sets FROM i JOIN w USING (id) GROUP BY id), d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM g UNION ALL SELECT b FROM g) e GROUP BY id)
 SELECT s.id AS paper_id, min(s.id) OVER (PARTITION BY sets) AS class_id, coalesce(n, 0) AS n_links FROM s LEFT JOIN d ON s.id = d.id""",
}
