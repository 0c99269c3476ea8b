"""Registered functions, document, retrieval, identity and ledger queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.operators import documents as docs_
from ledgerloom.operators import graph, tensor, vectors
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import running_sum
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


DOI = _strip("CASE {pick} ELSE x END".format(pick=" ".join(f"WHEN starts_with(x, '{p}') THEN substr(x, {len(p) + 1})" for p in ("https://doi.org/", "http://doi.org/", "http://dx.doi.org/", "doi:"))))


@query(f"SELECT {DOI} AS doi, count(*) AS n FROM (SELECT {_strip('lower(doi)')} AS x FROM manifest WHERE doi IS NOT NULL) m GROUP BY 1")
def fn_doi(spark, d):
    """Normalised DOI (F1)."""
    return load(spark, d, "manifest", "doi").where("doi is not null").groupBy(fn.normal_doi(F.col("doi")).alias("doi")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS digest, ('0x' || substr(sha256('42:' || doc_id), 1, 16))::UBIGINT::VARCHAR AS seed, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def fn_hashes(spark, d):
    """Digest, derived seed, token estimate."""
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), fn.seed_of(F.lit("42"), F.col("doc_id").cast("string")).cast("string").alias("seed"), fn.token_estimate(F.col("text")).alias("tokens"))


def _clean(c: str) -> str:
    """The definition in SQL: drop images, then whole lines of structure, then marks inside the lines."""
    seen = rf"regexp_replace({c}, '!\[[^\]]*\]\([^)]*\)|[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"
    kept = rf"list_filter(string_split({seen}, chr(10)), lambda l: NOT regexp_matches(l, '^(#{{1,6}}{SPACE}|(?i:doi){SPACE}*:)'))"
    bare = f"array_to_string(list_transform({kept}, lambda l: regexp_replace(l, '<sup>.*?</sup>', '', 'gi')), chr(10))"
    return _strip(f"regexp_replace(regexp_replace({bare}, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g')")


def _count(c: str, english: str, han: str) -> str:
    """Whole English words and Han words; separators are doubled, so that neighbours don't share one."""
    doubled = rf"regexp_replace({c}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    return rf"(len(regexp_extract_all({doubled}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{english})(?:$|[^\p{{L}}\p{{N}}_])')) + len(regexp_extract_all({c}, '{han}')))"


FRONT = "(?i)copyright|exclusive license|no claim to original|university|institute|department|laboratory|corresponding author|distributed under|creative commons"
SCIENCE = ("we|this  (?:work|paper|study)|propose|present|investigat|demonstrat|results?|model|method|algorithm|quantum|physics|phase|network|learning|simulation|theory", "本文|本研究|提出|研究|结果|模型|方法|算法|量子|物理")
ACTION = ("we|this  (?:work|paper|study)|propose|present|investigat|demonstrat|results?|model|method|algorithm|show|find|develop|study|analy[sz]", "本文|本研究|提出|研究|结果|模型|方法|算法|发现|表明")
SCORED = f"least(length(b), 3000) + 300 * {_count('b', *SCIENCE)} - CASE WHEN contains(b, '@') OR regexp_matches(b, '{FRONT}') THEN 1000 ELSE 0 END"
#: Text to blocks: at blank lines.
BLOCKS = rf"regexp_replace(text, '\n\s*\n', chr(1), 'g')"


@query(f"SELECT doc_id, sha256({_clean('text')}) AS cleaned FROM documents WHERE text IS NOT NULL")
def fn_clean_markdown(spark, d):
    """Cleaned Markdown, as a digest."""
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2(fn.clean_markdown(F.col("text")), 256).alias("cleaned"))


@query(
    f"""WITH b AS (SELECT doc_id, unnest(string_split({BLOCKS}, chr(1))) AS raw, generate_subscripts(string_split({BLOCKS}, chr(1)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(1))),
 c AS (SELECT doc_id, pos, {_clean('raw')} AS b FROM b), s AS (SELECT doc_id, pos, b, {SCORED} AS score FROM c WHERE length(b) >= 120), k AS (SELECT doc_id, max_by(b, (score, -pos)) AS b, max(score) AS score FROM s GROUP BY doc_id)
 SELECT d.doc_id, coalesce(score, 0)::INT AS score, sha256(coalesce(b, {_clean('text')})) AS chosen FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id WHERE text IS NOT NULL AND NOT contains(text, chr(1))"""
)
def fn_best_block(spark, d):
    """The cleaned block that looks most like an abstract, the earliest of equals; the whole text if none has 120 characters."""
    t = load(spark, d, "documents", "doc_id", "text").where("text is not null").where(~F.contains("text", F.lit("\x01")))
    return fn_blocks(t, "doc_id", "text").select("doc_id", "score", F.sha2("chosen", 256).alias("chosen"))


def fn_blocks(t, key, text):
    """key, score, chosen: the best block of each text."""
    b = t.select(key, F.posexplode(F.split(text, r"\n\s*\n", -1)).alias("pos", "raw")).select(key, "pos", fn.clean_markdown(F.col("raw")).alias("b")).where(F.length("b") >= 120)
    best = b.withColumn("score", fn.block_score(F.col("b"))).groupBy(key).agg(F.max_by("b", F.struct(F.col("score"), -F.col("pos"))).alias("b"), F.max("score").alias("score"))
    return t.join(best, key, "left").select(key, F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("b", fn.clean_markdown(F.col(text))).alias("chosen"))


@query(f"SELECT doc_id, {_count('b', *SCIENCE)} >= 2 AND (NOT regexp_matches(b, '{FRONT}') OR {_count('b', *ACTION)} >= 2) AS evidence FROM (SELECT doc_id, {_clean('text')} AS b FROM documents WHERE text IS NOT NULL) c")
def fn_evidence(spark, d):
    """Whether a cleaned text is scientific prose that can stand as evidence (F8)."""
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", fn.is_evidence(fn.clean_markdown(F.col("text"))).alias("evidence"))


@query(
    r"""WITH t AS (SELECT sequence_index, list_distinct(regexp_extract_all(lower(manifest_title), '([\p{L}\p{N}]+)')) AS a, list_distinct(regexp_extract_all(lower(physh_title), '([\p{L}\p{N}]+)')) AS b FROM physh_gold_matched WHERE manifest_title IS NOT NULL AND physh_title IS NOT NULL)
 SELECT sequence_index, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 6) AS overlap, CASE WHEN len(a) > 0 AND len(list_intersect(a, b)) / len(a)::DOUBLE >= 0.6 THEN true ELSE false END AS same_heading FROM t"""
)
def fn_title_overlap(spark, d):
    """Token overlap of two titles and the 0.6 gate."""
    t = load(spark, d, "physh_gold_matched", "sequence_index", "manifest_title", "physh_title").where("manifest_title is not null and physh_title is not null")
    a, b = F.array_distinct(fn.words(F.col("manifest_title"))), F.array_distinct(fn.words(F.col("physh_title")))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))
    return t.select("sequence_index", F.round(share, 6).alias("overlap"), (share >= 0.6).alias("same_heading"))


@query(
    f"""WITH h AS (SELECT doc_id, text, substr(text, 1, 200) AS head, length(regexp_extract(substr(text, 1, 200), '^((?s:.*)(?:\\. |。))', 1)) AS upto FROM documents WHERE text IS NOT NULL),
 c AS (SELECT *, upto - CASE WHEN upto > 0 AND substr(head, upto, 1) = ' ' THEN 1 ELSE 0 END AS kept FROM h)
 SELECT doc_id, {_strip("CASE WHEN length(text) <= 200 THEN text WHEN kept - 1 >= 130 THEN substr(head, 1, kept) ELSE head END")} AS cut FROM c"""
)
def fn_sentence_cut(spark, d):
    """Truncation at a sentence's end."""
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", fn.sentence_cut(F.col("text"), 200).alias("cut"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)'), lambda x: NOT regexp_matches(x, '[一-鿿]')) AS a, regexp_extract_all(text, '([一-鿿]+)') AS r FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, list_distinct(list_concat(a, flatten(list_transform(r, lambda x: list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))))) AS t FROM w) SELECT doc_id, len(t)::INT AS n_terms FROM b"""
)
def fn_terms(spark, d):
    """Distinct index terms: words and bigrams of Han text."""
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.size(fn.terms(F.col("text"))).alias("n_terms"))


#: Kinds of failures with the words that tell them; the first kind that fits counts.
FAILURES = [
    ("api_timeout", ["timeout", "timed out", "timeoutexpired", "connection timeout", "read timeout", "api timeout"]),
    ("code_defect", ["traceback", "nameerror", "brokenpipeerror", "ingest transition receipt mismatch", "illegal persisted ingest transition"]),
    ("semantic_failed", ["bibliographic", "书目", "预审", "semantic", "slot", "wiki validation", "wiki 校验", "agent_required", "handoff"]),
    ("graph_failed", ["graph", "sqlite", "edge", "keyword", "hub"]),
    ("extraction_failed", ["extract failed", "extraction failed", "提取失败", "mineru failed", "ocr failed", "empty content", "no extracted text", "no text extracted", "scanned document"]),
]
KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{kind}'" for kind, words in FAILURES) + " ELSE 'unknown' END"


@query(f"SELECT {KIND} AS kind, count(*) AS n FROM documents GROUP BY 1")
def fn_classify(spark, d):
    """Texts by the kind of failure their words tell."""
    return load(spark, d, "documents", "text").groupBy(fn.classify(F.col("text"), FAILURES, "unknown").alias("kind")).agg(F.count("*").alias("n"))


@query(
    r"""WITH h AS (SELECT DISTINCT trim(hub_label) AS label FROM hub_paper_incidence WHERE hub_label IS NOT NULL)
 SELECT label, regexp_extract(label, '([一-鿿]+)', 1) AS han, trim(regexp_replace(label, '[^A-Za-z -]', '', 'g')) AS latin, regexp_matches(label, '^[0-9]{4};[0-9]+:[0-9]+') OR regexp_matches(label, '^[A-Z]{1,3}-[0-9]{4}$') AS fragment FROM h"""
)
def fn_aliases(spark, d):
    """Names taken apart into scripts; citation fragments flagged (F26, of F24 the parts)."""
    h = load(spark, d, "hub_paper_incidence", "hub_label").where("hub_label is not null").select(F.trim("hub_label").alias("label")).distinct()
    return h.select("label", F.regexp_extract("label", "([一-鿿]+)", 1).alias("han"), F.trim(F.regexp_replace("label", "[^A-Za-z -]", "")).alias("latin"), fn.is_citation_fragment(F.col("label")).alias("fragment"))


@query("SELECT type, count(*) AS n, count(*) FILTER (data IS NOT NULL AND json_valid(data) AND starts_with(data, '{')) AS n_valid FROM (SELECT lower(trim(type, ' \t\n')) AS type, trim(data, ' \t\n') AS data FROM session_event) s GROUP BY type")
def fn_json_valid(spark, d):
    """Rows whose data is a complete JSON object, by type."""
    t = load(spark, d, "session_event", F.lower(F.btrim("type", F.lit(" \t\n"))).alias("type"), F.btrim("data", F.lit(" \t\n")).alias("data"))
    return t.groupBy("type").agg(F.count("*").alias("n"), F.count_if(fn.json_object(F.col("data")).isNotNull()).alias("n_valid"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def fn_axis_fit(spark, d):
    """Affine fit of an axis."""
    return load(spark, d, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"))


def _cores():
    rng = np.random.default_rng(5)
    return [rng.normal(size=s) for s in ((1, 4, 4, 3), (3, 4, 4, 3), (3, 4, 4, 1))]


@query()
def fn_tensor_train(spark, d):
    """Every vector times a tensor-train matrix (F35); checked against the dense matrix in the tests."""
    return tensor.apply(load(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _cores())


# --- documents


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, sum(regexp_matches(c, '^(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS fence FROM l),
 h AS (SELECT doc_id, line, length(regexp_extract(c, '^(#{1,6}) ', 1)) AS level, trim(regexp_replace(c, '^#{1,6} ', '')) AS title FROM f WHERE fence % 2 = 0 AND regexp_matches(c, '^#{1,6} '))
 SELECT h.doc_id, h.line::INT AS line, h.level::INT AS level, h.title, min(x.line)::INT AS next_line FROM h LEFT JOIN h x ON x.doc_id = h.doc_id AND x.line > h.line AND x.level <= h.level GROUP BY ALL"""
)
def doc_outline(spark, d):
    """Headings outside fences and where their sections end."""
    return docs_.outline(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(r"WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(raw/[a-z0-9-]+\.md#L[0-9]+-L[0-9]+)')) AS l FROM documents) SELECT doc_id, regexp_extract(l, '^(.*)#', 1) AS source, regexp_extract(l, '#L([0-9]+)', 1)::INT AS first_line, regexp_extract(l, '-L([0-9]+)$', 1)::INT AS last_line FROM l")
def doc_locators(spark, d):
    """Line locators cited in texts; doc_read_raw reads them."""
    return docs_.locators(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x) + 1)) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
 r AS (SELECT doc_id, line, n, 1 AS n_lines, n AS chars, 0 AS segment FROM l WHERE line = 1
  UNION ALL SELECT l.doc_id, l.line, l.n, CASE WHEN n_lines >= 32 OR chars + l.n > 6000 THEN 1 ELSE n_lines + 1 END, CASE WHEN n_lines >= 32 OR chars + l.n > 6000 THEN l.n ELSE chars + l.n END, segment + (n_lines >= 32 OR chars + l.n > 6000)::INT FROM r JOIN l ON l.doc_id = r.doc_id AND l.line = r.line + 1)
 SELECT doc_id, segment, min(line)::INT AS first_line, max(line)::INT AS last_line, sum(n)::INT AS n_chars FROM r GROUP BY doc_id, segment"""
)
def doc_segments(spark, d):
    """Greedy segments of whole lines."""
    return docs_.segments(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, text, strlen(text) AS total FROM documents WHERE length(text) > 0),
 k AS (SELECT doc_id, i, substr(text, i::INT, 1) AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM d) q),
 e AS MATERIALIZED (SELECT doc_id, i, c = chr(10) AS nl, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS ends FROM k),
 r AS (SELECT doc_id, -1 AS part, 0::BIGINT AS since, 0::BIGINT AS upto, total FROM d
  UNION ALL SELECT doc_id, part + 1, upto, CASE WHEN total - upto <= 2400 THEN total WHEN coalesce(line, 0) - upto > (last - upto) // 2 THEN line ELSE last END, total
   FROM (SELECT r.doc_id, part, upto, total, max(ends) AS last, max(ends) FILTER (nl) AS line FROM r JOIN e ON e.doc_id = r.doc_id AND ends > upto AND ends <= upto + 2400 WHERE upto < total GROUP BY ALL) n)
 SELECT r.doc_id, part::INT AS part, string_agg(substr(text, i::INT, 1), '' ORDER BY i) AS content FROM r JOIN e ON e.doc_id = r.doc_id AND ends > since AND ends <= upto JOIN d ON d.doc_id = r.doc_id WHERE part >= 0 GROUP BY r.doc_id, part"""
)
def doc_windows(spark, d):
    """Windows of at most 2400 bytes (F16)."""
    return docs_.byte_windows(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(
    """WITH t AS (SELECT doc_id, text, CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE text END AS low FROM documents WHERE text IS NOT NULL), w AS (SELECT unnest(['tensor train', 'entropy', 'threshold']) AS w),
 p AS (SELECT doc_id, low, w, unnest(range(1, length(low) - length(w) + 2)) AS i FROM t, w WHERE contains(low, w)), h AS (SELECT doc_id, w, i - 1 AS pos, length(w) AS n FROM p WHERE substr(low, i::INT, length(w)) = w),
 s AS (SELECT a.doc_id, a.pos, count(DISTINCT b.w) AS k FROM (SELECT DISTINCT doc_id, pos FROM h) a JOIN h b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos + b.n <= a.pos + 700 GROUP BY ALL), best AS (SELECT doc_id, max(k) AS k, max_by(pos, (k, -pos)) AS pos FROM s GROUP BY doc_id),
 f AS (SELECT t.doc_id, text, coalesce(pos, 0) AS a, least(length(text), coalesce(pos, 0) + 700) AS z, coalesce(k, 0) AS k FROM t LEFT JOIN best ON t.doc_id = best.doc_id)
 SELECT doc_id, a::INT AS first, z::INT AS "end", k::INT AS n_terms, a > 0 OR z < length(text) AS truncated, substr(text, a::INT + 1, 700) AS excerpt FROM f"""
)
def doc_excerpts(spark, d):
    """Match-centred excerpts."""
    return docs_.excerpt(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text", ["tensor train", "entropy", "threshold"])


# --- retrieval

WANTED = ["tensor", "train", "entropy", "profile"]
HIT = " + ".join(rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}]){w}([^\p{{L}}\p{{N}}]|$)')::INT" for w in WANTED)


@query(
    f"""WITH s AS (SELECT doc_id, source, {HIT} AS cover, contains(lower(text), 'tensor train')::INT AS phrase FROM documents WHERE text IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cover DESC, phrase DESC, doc_id) AS slot FROM s WHERE cover > 0)
 SELECT doc_id, source, cover, phrase FROM r WHERE slot <= 2 ORDER BY cover DESC, phrase DESC, doc_id LIMIT 20"""
)
def ret_lexical(spark, d):
    """Coverage ranking of whole words, phrase next, two slots for each source."""
    t = load(spark, d, "documents", "doc_id", "source", "text").where("text is not null")
    cover = sum((docs_.whole_word(F.col("text"), w).cast("int") for w in WANTED), F.lit(0))
    s = t.select("doc_id", "source", cover.alias("cover"), F.contains(F.lower("text"), F.lit("tensor train")).cast("int").alias("phrase")).where("cover > 0")
    slot = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("cover"), F.desc("phrase"), "doc_id"))
    return s.withColumn("slot", slot).where("slot <= 2").orderBy(F.desc("cover"), F.desc("phrase"), "doc_id").limit(20).drop("slot")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(v::DOUBLE[], embedding::DOUBLE[]) AS cosine FROM q, embeddings WHERE query_id <> vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM s) SELECT query_id, id, round(cosine, 6) AS cosine, rank::INT AS rank FROM r WHERE rank <= 10"""
)
def ret_semantic(spark, d):
    """Exact cosine search in blocks: every hundredth row against all."""
    e = load(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.top_k(e, e.where("id % 100 = 0"), 10).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    """WITH e AS (SELECT id, domain, unnest(list_distinct(expected)) AS page FROM retrieval_benchmark_real WHERE expected IS NOT NULL), w AS (SELECT DISTINCT work_id FROM hub_paper_incidence),
 h AS (SELECT id, domain, count(*) AS n, count(w.work_id) AS hits FROM e LEFT JOIN w ON split_part(page, '/', 4) = w.work_id GROUP BY ALL)
 SELECT domain, count(*) AS n_queries, count(*) FILTER (hits > 0) AS n_any, count(*) FILTER (hits = n) AS n_all, round(avg(hits / n::DOUBLE), 6) AS macro_recall, sum(hits)::BIGINT AS slots FROM h GROUP BY domain"""
)
def ret_benchmark(spark, d):
    """Recall of expected targets: any, all, macro, slots."""
    e = load(spark, d, "retrieval_benchmark_real", "id", "domain", "expected").select("id", "domain", F.explode(F.array_distinct("expected")).alias("page"))
    w = load(spark, d, "hub_paper_incidence", "work_id").distinct()
    h = e.withColumn("key", F.get(F.split("page", "/"), F.lit(3))).join(w, F.col("key") == F.col("work_id"), "left").groupBy("id", "domain").agg(F.count("*").alias("n"), F.count("work_id").alias("hits"))
    return h.groupBy("domain").agg(F.count("*").alias("n_queries"), F.count_if(F.col("hits") > 0).alias("n_any"), F.count_if(F.col("hits") == F.col("n")).alias("n_all"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("macro_recall"), F.sum("hits").alias("slots"))


@query(
    """WITH m AS (SELECT trim(hub_id) AS hub, work_id, max(supporting_member_node_count) AS level, max(official_gold) AS gold, count(*) AS n FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND work_id IS NOT NULL GROUP BY ALL)
 SELECT work_id, round((max(level) * 0.5 + max(gold) * 0.3 + count(*) * 0.2)::DOUBLE, 6) AS score, CASE WHEN max(gold) = 1 AND count(*) >= 2 THEN 'admitted' ELSE 'other' END AS evidence FROM m GROUP BY work_id"""
)
def ret_weighted_rank(spark, d):
    """Weighted maxima for each work (R19), and whether it is gold in two hubs."""
    m = load(spark, d, "hub_paper_incidence").where("hub_id is not null and work_id is not null").groupBy(F.trim("hub_id").alias("hub"), "work_id").agg(F.max("supporting_member_node_count").alias("level"), F.max("official_gold").alias("gold"))
    score = F.max("level") * 0.5 + F.max("gold") * 0.3 + F.count("*") * 0.2
    return m.groupBy("work_id").agg(F.round(score, 6).alias("score"), F.when((F.max("gold") == 1) & (F.count("*") >= 2), "admitted").otherwise("other").alias("evidence"))


@query(
    """WITH p AS (SELECT paper_id, list_distinct(flatten(list(list_filter(coalesce(disciplines, []), lambda x: x IS NOT NULL AND x <> '')))) AS have FROM physh_gold_matched GROUP BY paper_id)
 SELECT paper_id, 3 - len(list_intersect(have, ['Networks', 'Optics', 'Materials Science']))::INT AS n_missing, CASE WHEN len(list_intersect(have, ['Networks', 'Optics', 'Materials Science'])) = 3 THEN 'FINAL' WHEN len(have) >= 3 THEN 'BOUNDED' ELSE 'CONTINUE' END AS decision FROM p"""
)
def ret_slots(spark, d):
    """Declared slots less covered ones, and the reason to stop."""
    want = F.array(F.lit("Networks"), F.lit("Optics"), F.lit("Materials Science"))
    clean = F.filter(F.coalesce("disciplines", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    p = load(spark, d, "physh_gold_matched", "paper_id", "disciplines").groupBy("paper_id").agg(F.array_distinct(F.flatten(F.collect_list(clean))).alias("have"))
    missing = F.size(F.array_except(want, F.col("have")))
    return p.select("paper_id", missing.alias("n_missing"), F.when(missing == 0, "FINAL").when(F.size("have") >= 3, "BOUNDED").otherwise("CONTINUE").alias("decision"))


@query(
    """WITH a AS (SELECT workspace_id, session_id, max(received_at) AS last, count(*) AS n FROM session_event WHERE session_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY last DESC, session_id) AS slot FROM a)
 SELECT workspace_id, session_id, n, slot FROM r WHERE slot <= 3"""
)
def ret_context(spark, d):
    """Three latest items for each workspace."""
    a = load(spark, d, "session_event", "workspace_id", "session_id", "received_at").where("session_id is not null").groupBy("workspace_id", "session_id").agg(F.max("received_at").alias("last"), F.count("*").alias("n"))
    slot = F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.desc("last"), "session_id"))
    return a.withColumn("slot", slot.cast("bigint")).where("slot <= 3").select("workspace_id", "session_id", "n", "slot")


@query(
    """WITH t AS (SELECT trim(hub_id) AS hub, lower(unnest(regexp_extract_all(any_value(hub_label), '([A-Za-z]{5,})'))) AS term FROM (SELECT hub_id, max(hub_label) AS hub_label FROM hub_paper_incidence WHERE hub_id IS NOT NULL GROUP BY hub_id) h GROUP BY hub_id),
 u AS (SELECT trim(hub) AS hub, term FROM t GROUP BY ALL) SELECT a.hub AS hub_a, b.hub AS hub_b, count(*) AS n_shared FROM u a JOIN u b ON a.term = b.term AND a.hub < b.hub GROUP BY ALL HAVING count(*) >= 2"""
)
def ret_related(spark, d):
    """Hubs related by two shared terms or more."""
    h = load(spark, d, "hub_paper_incidence", "hub_id", "hub_label").where("hub_id is not null").groupBy("hub_id").agg(F.max("hub_label").alias("label"))
    u = h.select(F.trim("hub_id").alias("hub"), F.explode(F.regexp_extract_all(F.lower("label"), F.lit("([a-z]{5,})"), F.lit(1))).alias("term")).distinct()
    a, b = u.select(F.col("hub").alias("hub_a"), "term"), u.select(F.col("hub").alias("hub_b"), "term")
    return a.join(b, "term").where("hub_a < hub_b").groupBy("hub_a", "hub_b").agg(F.count("*").alias("n_shared")).where("n_shared >= 2")


# --- identity

PROTO = """p AS (SELECT label AS grp, list(x ORDER BY pos) AS v, max(n) AS n FROM (SELECT label, pos, avg(x::DOUBLE) AS x, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) u GROUP BY ALL) q GROUP BY label)"""
SCORES = f"WITH {PROTO}, s AS (SELECT vec_id, label, grp, list_cosine_similarity(embedding::DOUBLE[], v) AS c FROM embeddings, p), r AS (SELECT vec_id, label, grp, c, row_number() OVER w AS r, lead(c) OVER w AS second FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY c DESC, grp))"


def _affinity(spark, d):
    e = load(spark, d, "embeddings")
    p = vectors.prototypes(e.select(F.col("label").alias("grp"), F.col("embedding").alias("v")))
    p = p.select("grp", "v")
    pairs = e.join(F.broadcast(p) if p.count() <= 4096 else p)  # every row meets every prototype; only a short list of them is broadcast
    return pairs.select("vec_id", "label", "grp", fn.cosine(F.col("embedding"), F.col("v")).alias("c"))


@query(SCORES + " SELECT vec_id, grp AS best, round(c, 6) AS score, CASE WHEN c >= 0.3 AND c - second >= 0.04 THEN 'resolved' WHEN c >= 0.15 THEN 'ambiguous' ELSE 'unmatched' END AS decision FROM r WHERE r = 1")
def id_route(spark, d):
    """Best prototype with floor and margin: resolved, ambiguous, unmatched."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("c"), "grp")
    r = _affinity(spark, d).select("vec_id", "grp", "c", F.row_number().over(w).alias("r"), F.lead("c").over(w).alias("second")).where("r = 1")
    decision = F.when((F.col("c") >= 0.3) & (F.col("c") - F.col("second") >= 0.04), "resolved").when(F.col("c") >= 0.15, "ambiguous").otherwise("unmatched")
    return r.select("vec_id", F.col("grp").alias("best"), F.round("c", 6).alias("score"), decision.alias("decision"))


@query(SCORES + ", t AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (c >= threshold AND grp = label) AS tp, count(*) FILTER (c >= threshold AND grp <> label) AS fp, count(*) FILTER (c < threshold AND grp = label) AS fn FROM s, t GROUP BY threshold")
def id_calibration(spark, d):
    """True and false positives at each threshold, for precision and recall."""
    s = _affinity(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)])))
    same, up = F.col("grp") == F.col("label"), F.col("c") >= F.col("threshold")
    return s.groupBy("threshold").agg(F.count_if(up & same).alias("tp"), F.count_if(up & ~same).alias("fp"), F.count_if(~up & same).alias("fn"))


@query(SCORES + ", m AS (SELECT vec_id, grp, c, grp = label AS was FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, grp) AS place FROM m WHERE c >= CASE WHEN was THEN 0.1 ELSE 0.2 END) SELECT vec_id, grp, CASE WHEN was THEN 'retained' ELSE 'entered' END AS how FROM k WHERE place <= 3")
def id_membership(spark, d):
    """Overlapping membership with hysteresis: a higher bar to enter than to stay, three at most (C4)."""
    was = F.col("grp") == F.col("label")
    m = _affinity(spark, d).where(F.col("c") >= F.when(was, 0.1).otherwise(0.2))
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("c"), "grp"))
    return m.withColumn("place", place).where("place <= 3").select("vec_id", "grp", F.when(was, "retained").otherwise("entered").alias("how"))


@query(f"WITH {PROTO} SELECT grp, n, round(list_sum(v), 6) AS mass, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length FROM p")
def id_prototypes(spark, d):
    """Mean vectors of groups."""
    p = vectors.prototypes(load(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("embedding").alias("v")))
    add = lambda f: F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x))
    return p.select("grp", "n", F.round(add(lambda x: x), 6).alias("mass"), F.round(F.sqrt(add(lambda x: x * x)), 6).alias("length"))


@query(f"WITH {PROTO} SELECT a.grp AS a, b.grp AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, list_cosine_similarity(a.v, b.v) >= 0.1 AS candidate FROM p a JOIN p b ON a.grp < b.grp")
def id_merge_candidates(spark, d):
    """Prototypes alike enough to merge."""
    p = vectors.prototypes(load(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("embedding").alias("v")))
    x, y = p.alias("x"), p.alias("y")
    c = fn.cosine(F.col("x.v"), F.col("y.v"))
    return x.join(y, F.col("x.grp") < F.col("y.grp")).select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b"), F.round(c, 6).alias("cosine"), (c >= 0.1).alias("candidate"))


@query("SELECT trim(hub_id) AS hub, count(DISTINCT work_id) AS n_members, CASE WHEN count(DISTINCT work_id) > 30 AND contains(trim(hub_id), 'cross-domain') THEN 'redistribute' WHEN count(DISTINCT work_id) > 30 THEN 'split' ELSE 'fits' END AS plan FROM hub_paper_incidence WHERE hub_id IS NOT NULL GROUP BY 1")
def id_overload(spark, d):
    """Hubs beyond their capacity."""
    h = load(spark, d, "hub_paper_incidence", "hub_id", "work_id").where("hub_id is not null").groupBy(F.trim("hub_id").alias("hub")).agg(F.count_distinct("work_id").alias("n_members"))
    full = F.col("n_members") > 30
    return h.withColumn("plan", F.when(full & F.contains("hub", F.lit("cross-domain")), "redistribute").when(full, "split").otherwise("fits"))


@query(
    """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), k AS (SELECT * FROM s WHERE score >= 0.25 AND score < 0.9),
 e AS (SELECT *, unnest([a, b]) AS x FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, a, b) AS p FROM e) SELECT a, b, round(any_value(score), 6) AS score FROM r WHERE p <= 5 GROUP BY a, b HAVING count(*) = 2"""
)
def id_similar_sweep(spark, d):
    """Pairs of one label in a band of similarity, five for each end (G14); id_similar_pairs has those of all vectors."""
    e = load(spark, d, "embeddings")
    near = vectors.pairs_between(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.25, 0.9)
    label = lambda end: e.select(F.col("vec_id").alias(end), F.col("label").alias(f"label_{end}"))
    s = near.join(label("a"), "a").join(label("b"), "b").where("label_a = label_b").select("a", "b", "score")
    return graph.cap_degree(s, 5).select("a", "b", F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), k AS (SELECT * FROM s WHERE score >= 0.25 AND score < 0.9),
 e AS (SELECT *, unnest([a, b]) AS x FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, a, b) AS p FROM e) SELECT a, b, round(any_value(score), 6) AS score FROM r WHERE p <= 5 GROUP BY a, b HAVING count(*) = 2"""
)
def id_similar_pairs(spark, d):
    """Pairs of all vectors in a band of similarity, five for each end (C11, J12, G14); the table holds no links to leave out."""
    e = load(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.cap_degree(vectors.pairs_between(e, 0.25, 0.9), 5).select("a", "b", F.round("score", 6).alias("score"))


@query()
def id_new_groups(spark, d):
    """Groups of four or more vectors: components of all links of 0.3 or more, candidates from a cohesion of 0.6.

    Cohesion is the mean cosine of a group's pairs. The table has no hub assignments, so all vectors count as unassigned.
    """
    e = load(spark, d, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return _new_groups(spark, e, 0.3)


def _new_groups(spark, e, floor):
    cuts = Cuts(spark, "groups")
    near = cuts.cut(vectors.pairs_between(e, floor).select(F.col("a").cast("string").alias("s"), F.lit("similar").alias("p"), F.col("b").cast("string").alias("o")))
    c = cuts.cut(graph.components(spark, near))
    c = c.join(c.groupBy("component").agg(F.count("*").alias("size")).where("size >= 4"), "component")
    how = vectors.cohesion(e.withColumn("id", F.col("id").cast("string")), c.select(F.col("component").alias("grp"), F.col("path").alias("id")))
    return c.join(how, c.component == how.grp).select("path", "component", "size", "cohesion", (F.col("cohesion") >= 0.6).alias("candidate"))


@query()
def id_split(spark, d):
    """Two-way split of all vectors and whether it counts."""
    rows, cosine, valid = vectors.split_in_two(load(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return rows.select("vec_id", "side", F.lit(round(cosine, 6)).alias("cosine"), F.lit(valid).alias("valid"))


# --- ledger


@query("SELECT sha256(text) AS edition, count(*) AS n_origins, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY 1")
def led_editions(spark, d):
    """Byte-identical texts are one edition with several origins."""
    return load(spark, d, "documents", "doc_id", "text", "source").where("text is not null").groupBy(F.sha2("text", 256).alias("edition")).agg(F.count("*").alias("n_origins"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("n_sources"))


@query(
    """WITH old AS (SELECT path, max(n_chars) AS size, max(updated_at) AS t FROM documents WHERE path IS NOT NULL AND updated_at < TIMESTAMP '2026-01-01' GROUP BY path), new AS (SELECT path, max(n_chars) AS size, max(updated_at) AS t FROM documents WHERE path IS NOT NULL GROUP BY path)
 SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'purge' WHEN o.size IS DISTINCT FROM n.size OR o.t IS DISTINCT FROM n.t THEN 'rehash' ELSE 'skip' END AS action FROM old o FULL JOIN new n ON o.path = n.path"""
)
def led_reconcile(spark, d):
    """Incremental reconcile by path, size and time."""
    docs = load(spark, d, "documents", "path", "n_chars", "updated_at").where("path is not null")
    state = lambda x, p: x.groupBy("path").agg(F.max("n_chars").alias(p + "size"), F.max("updated_at").alias(p + "t")).withColumn(p + "in", F.lit(True))
    old, new = state(docs.where(F.col("updated_at") < F.lit("2026-01-01").cast("timestamp")), "o_"), state(docs, "n_")
    changed = ~F.col("o_size").eqNullSafe(F.col("n_size")) | ~F.col("o_t").eqNullSafe(F.col("n_t"))
    return old.join(new, "path", "full").select("path", F.when(F.col("o_in").isNull(), "new").when(F.col("n_in").isNull(), "purge").when(changed, "rehash").otherwise("skip").alias("action"))


@query(r"SELECT regexp_replace(path, '-[0-9]+\.md$', '') AS base, max_by(doc_id, (updated_at, doc_id)) AS newest, count(*) AS n_versions FROM documents WHERE path IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1")
def led_versions(spark, d):
    """Versions grouped by base name, the newest wins."""
    t = load(spark, d, "documents", "path", "doc_id", "updated_at").where("path is not null and updated_at is not null")
    return t.groupBy(F.regexp_replace("path", r"-[0-9]+\.md$", "").alias("base")).agg(F.max_by("doc_id", F.struct("updated_at", "doc_id")).alias("newest"), F.count("*").alias("n_versions"))


@query(
    """WITH g AS (SELECT paper_id, loaded_at, list_sort(list_distinct(list_filter(coalesce(concepts, []), lambda x: x IS NOT NULL))) AS c FROM physh_gold_matched), o AS (SELECT *, lag(c) OVER (PARTITION BY paper_id ORDER BY loaded_at, c::VARCHAR) AS before, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at, c::VARCHAR) AS r FROM g)
 SELECT paper_id, count(*) AS n_deliveries, count(*) FILTER (r = 1 OR before <> c) AS n_revisions FROM o GROUP BY paper_id"""
)
def led_revisions(spark, d):
    """A delivery with the same set makes no revision, whatever its order and repeats."""
    g = load(spark, d, "physh_gold_matched", "paper_id", "loaded_at", F.array_sort(F.array_distinct(F.filter(F.coalesce("concepts", F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("c"))
    w = Window.partitionBy("paper_id").orderBy("loaded_at", "c")
    g = g.select("paper_id", "c", F.lag("c").over(w).alias("before"), F.row_number().over(w).alias("r"))
    return g.groupBy("paper_id").agg(F.count("*").alias("n_deliveries"), F.count_if((F.col("r") == 1) | (F.col("before") != F.col("c"))).alias("n_revisions"))


@query("SELECT prompt_sha256 AS op, count(*) AS n, count(DISTINCT sha256(coalesce(judge_id, '') || '|' || hub_index)) AS n_contents, count(DISTINCT sha256(coalesce(judge_id, '') || '|' || hub_index)) > 1 AS conflict FROM judge_output GROUP BY 1")
def led_idempotent(spark, d):
    """Replays of an operation; one with other content is rejected."""
    digest = F.sha2(F.concat_ws("|", F.coalesce("judge_id", F.lit("")), F.coalesce(F.col("hub_index").cast("string"), F.lit(""))), 256)
    return load(spark, d, "judge_output", "prompt_sha256", "judge_id", "hub_index").groupBy(F.col("prompt_sha256").alias("op")).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("n_contents"), (F.count_distinct(digest) > 1).alias("conflict"))


@query(
    """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE source IS NOT NULL AND n_chars > 0)
 SELECT source, doc_id, place FROM r WHERE used <= 2000"""
)
def led_packing(spark, d):
    """Items packed whole, in order, under a budget."""
    t = load(spark, d, "documents", "source", "doc_id", "n_chars").where("source is not null and n_chars > 0")
    t = running_sum(Cuts(spark, "packing"), t, ["source"], ["n_chars", "doc_id"], "n_chars", "used", "place")  # a source may hold a tenth of all rows
    return t.where("used <= 2000").select("source", "doc_id", "place")


@query(
    """WITH m AS (SELECT entry_id, max(publication_year) AS y, bool_or(formal_publication_signal) AS formal, count(*) AS n FROM manifest GROUP BY entry_id)
 SELECT 'repeated entry' AS rule, entry_id AS item FROM m WHERE n > 1 UNION ALL SELECT 'no year', entry_id FROM m WHERE y IS NULL UNION ALL SELECT 'older than ten years', entry_id FROM m WHERE y < 2016 UNION ALL SELECT 'not formal', entry_id FROM m WHERE NOT coalesce(formal, false)"""
)
def led_lint(spark, d):
    """Structural checks as a union of violation queries, one pass."""
    m = load(spark, d, "manifest", "entry_id", "publication_year", "formal_publication_signal").groupBy("entry_id").agg(F.max("publication_year").alias("y"), F.bool_or("formal_publication_signal").alias("formal"), F.count("*").alias("n"))
    rule = lambda c, name: F.when(c, F.lit(name))
    broken = F.array(rule(F.col("n") > 1, "repeated entry"), rule(F.col("y").isNull(), "no year"), rule(F.col("y") < 2016, "older than ten years"), rule(~F.coalesce("formal", F.lit(False)), "not formal"))
    return m.select(F.explode(F.array_compact(broken)).alias("rule"), F.col("entry_id").alias("item"))


@query("SELECT sequence_index, CASE WHEN manifest_title IS NULL OR physh_title IS NULL THEN 'unknown' WHEN manifest_title = physh_title THEN 'exact' WHEN lower(trim(manifest_title)) = lower(trim(physh_title)) THEN 'fuzzy' ELSE 'unknown' END AS state FROM physh_gold_matched")
def led_name_check(spark, d):
    """Titles of a row against each other: exact, equal but for case and outer space (fuzzy), else unknown; ret_name_candidates has edit ratios."""
    t = load(spark, d, "physh_gold_matched", "sequence_index", "manifest_title", "physh_title")
    a, b = F.col("manifest_title"), F.col("physh_title")
    return t.select("sequence_index", F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "exact").when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "fuzzy").otherwise("unknown").alias("state"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, trim(split_part(l, '|', 2)) AS a, trim(split_part(l, '|', 3)) AS b, trim(split_part(l, '|', 4)) AS c FROM l WHERE regexp_matches(l, '^\|[^|$]*\|[^|$]*\|[^|$]*\|$')")
def led_triples(spark, d):
    """Lines of three columns, repeats dropped."""
    l = load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")).where(F.col("l").rlike(r"^\|[^|$]*\|[^|$]*\|[^|$]*\|$"))
    part = lambda k: F.trim(F.split("l", r"\|")[k])
    return l.select("doc_id", part(1).alias("a"), part(2).alias("b"), part(3).alias("c")).distinct()
