"""Registered text queries: abstracts, names, canonical forms, reading by section and locator, citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.functions.calculator import evaluate
from ledgerloom.operators import documents as docs_
from ledgerloom.operators import tensor
from ledgerloom.plans.document_queries import ACTION, FRONT, SCIENCE, SCORED, _clean, _cores, _count, _strip, fn_blocks
from ledgerloom.plans.registry import SQL, query
from ledgerloom.sources import files
from ledgerloom.sources.tables import load

FRONT_SQL = r"regexp_extract(text, '^---\n((?s:.*?))\n---\n', 1)"


def _texts(spark, d, *more):
    return load(spark, d, "documents", "doc_id", "text", *more).where("text is not null")


@query(
    rf"""WITH h AS (SELECT doc_id, unnest(list_filter(string_split({FRONT_SQL}, chr(10)), lambda l: regexp_matches(l, '^[A-Za-z_]+:'))) AS l, generate_subscripts(list_filter(string_split({FRONT_SQL}, chr(10)), lambda l: regexp_matches(l, '^[A-Za-z_]+:')), 1) AS i FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, regexp_extract(l, '^([A-Za-z_]+):', 1) AS field, min_by(trim(regexp_replace(l, '^[A-Za-z_]+:', '')), i) AS value FROM h GROUP BY ALL"""
)
def doc_front_matter(spark, d):
    """Fields of the front matter of Markdown texts."""
    front, _ = files.front_matter(F.col("text"))
    return _texts(spark, d).select("doc_id", F.explode(front).alias("field", "value"))


# --- abstracts


@query(
    rf"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_distinct(regexp_extract_all(lower(regexp_extract({FRONT_SQL}, '(?m)^title: (.*)$', 1)), '[a-z0-9]+')) AS want FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, ls, want, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
 h AS (SELECT doc_id, i, ls, round(len(list_intersect(want, list_distinct(regexp_extract_all(lower(regexp_extract(trim(line), '^#\s+(.+)$', 1)), '[a-z0-9]+')))) / greatest(len(want), 1)::DOUBLE, 9) AS overlap FROM l WHERE regexp_matches(trim(line), '^#\s+.+$')),
 s AS (SELECT doc_id, any_value(ls) AS ls, max_by(i, (overlap, -i)) AS start_line, max(overlap) AS overlap FROM h WHERE overlap >= 0.6 GROUP BY doc_id),
 e AS (SELECT s.doc_id, min(l.i) AS stop FROM s JOIN l ON s.doc_id = l.doc_id AND l.i > start_line AND l.i < start_line + 80 AND regexp_matches(trim(line), '(?i)^##\s+(?:\d+[.\s]+)?(?:introduction|引言)(?:$|[^\p{{L}}\p{{N}}_])') GROUP BY s.doc_id)
 SELECT s.doc_id, start_line::INT AS start_line, coalesce(stop, least(start_line + 80, len(ls) + 1))::INT AS stop_line, overlap FROM s LEFT JOIN e ON s.doc_id = e.doc_id"""
)
def doc_abstract_span(spark, d):
    """Where an abstract can stand: from the first-level heading most like the title (0.6 of its words) to the introduction, 80 lines at most."""
    front, _ = files.front_matter(F.col("text"))
    t = _texts(spark, d).select("doc_id", "text", F.try_element_at(front, F.lit("title")).alias("title"))
    return docs_.abstract_span(t, "doc_id", "text", F.coalesce("title", F.lit(""))).drop("text")


def _cut(c: str, limit: int) -> str:
    """The first characters of a text, up to the last end of a sentence if that keeps more than 65 % of them."""
    head = f"substr({c}, 1, {limit})"
    upto = f"length(regexp_extract({head}, '^((?s:.*)(?:\\. |。))', 1))"
    kept = f"({upto} - CASE WHEN {upto} > 0 AND substr({head}, {upto}, 1) = ' ' THEN 1 ELSE 0 END)"
    return _strip(f"CASE WHEN length({c}) <= {limit} THEN {c} WHEN {kept} > {int(limit * 0.65)} THEN substr({c}, 1, {kept}) ELSE {head} END")


@query(
    f"""WITH sp AS ({SQL["doc_abstract_span"]}), y AS (SELECT d.doc_id, array_to_string(string_split(text, chr(10))[start_line + 1 : stop_line - 1], chr(10)) AS body FROM sp JOIN documents d ON d.doc_id = sp.doc_id),
 x AS (SELECT doc_id, unnest(string_split_regex(body, '\\n\\s*\\n')) AS raw, generate_subscripts(string_split_regex(body, '\\n\\s*\\n'), 1) - 1 AS pos FROM y),
 c AS (SELECT doc_id, pos, {_clean("raw")} AS b FROM x), s AS (SELECT doc_id, pos, b, {SCORED} AS score FROM c WHERE length(b) >= 120), k AS (SELECT doc_id, max_by(b, (score, -pos)) AS best FROM s GROUP BY doc_id),
 f AS (SELECT y.doc_id, coalesce(best, {_clean("body")}) AS t FROM y LEFT JOIN k ON y.doc_id = k.doc_id), a AS (SELECT doc_id, {_cut("t", 1200)} AS b FROM f)
 SELECT doc_id, b AS abstract, {_count("b", *SCIENCE)} >= 2 AND (NOT regexp_matches(b, '{FRONT}') OR {_count("b", *ACTION)} >= 2) AS evidence FROM a"""
)
def doc_abstract(spark, d):
    """The abstract below the title: best block, cut at a sentence, and whether it can stand as evidence."""
    front, _ = files.front_matter(F.col("text"))
    t = _texts(spark, d).select("doc_id", "text", F.try_element_at(front, F.lit("title")).alias("title"))
    spans = docs_.abstract_span(t, "doc_id", "text", F.coalesce("title", F.lit("")))
    body = F.array_join(F.slice(F.split("text", "\n", -1), F.col("start_line") + 1, F.col("stop_line") - F.col("start_line") - 1), "\n")
    chosen = fn_blocks(spans.select("doc_id", body.alias("text")), "doc_id", "text")
    return chosen.select("doc_id", fn.sentence_cut(F.col("chosen"), 1200).alias("abstract")).withColumn("evidence", fn.is_evidence(F.col("abstract")))


# --- names


@query(
    r"""WITH h AS (SELECT DISTINCT hub_label AS name FROM hub_paper_incidence WHERE hub_label IS NOT NULL UNION SELECT DISTINCT unnest(concepts) FROM physh_gold_matched),
 p AS (SELECT DISTINCT name, trim(alias) AS alias, part FROM (SELECT name, unnest(regexp_extract_all(name, '[一-鿿]+')) AS alias, 'han' AS part FROM h
  UNION ALL SELECT name, unnest(regexp_extract_all(regexp_replace(name, '[(（][^)）]*[)）]', '', 'g'), '[A-Za-z][A-Za-z0-9 -]*')), 'latin' FROM h UNION ALL SELECT name, unnest(regexp_extract_all(name, '[(（]([A-Z][A-Z0-9-]{1,9})[)）]', 1)), 'short' FROM h) u)
 SELECT name, alias, part FROM p WHERE alias <> '' AND alias <> name"""
)
def fn_name_aliases(spark, d):
    """Aliases of a name: its Han, Latin and bracketed short parts."""
    hubs = load(spark, d, "hub_paper_incidence", F.col("hub_label").alias("name"))
    names = hubs.union(load(spark, d, "physh_gold_matched", F.explode("concepts"))).where("name is not null").distinct()
    return names.select("name", F.inline(fn.name_aliases(F.col("name")))).where("alias <> '' and alias <> name").distinct()


@query(
    r"""WITH h AS (SELECT DISTINCT hub_label AS name FROM hub_paper_incidence WHERE hub_label IS NOT NULL),
 w AS (SELECT name, list_filter(string_split(replace(name, '-', ' '), ' '), lambda x: x <> '') AS words FROM h),
 s AS (SELECT name, words, upper(array_to_string(list_transform(words, lambda x: substr(x, 1, 1)), '')) AS short FROM w WHERE len(words) BETWEEN 2 AND 8)
 SELECT short, min(name) AS full_name FROM s WHERE regexp_matches(short, '^[A-Z]{2,8}$') GROUP BY short HAVING count(DISTINCT lower(replace(name, '-', ' '))) = 1"""
)
def fn_abbreviations(spark, d):
    """Abbreviations that texts of the form Full Name (FN) define; the initials must agree, and one with several names is left out."""
    names = load(spark, d, "hub_paper_incidence", "hub_label").where("hub_label is not null").distinct()
    initials = F.upper(F.array_join(F.transform(F.filter(F.split(F.replace("hub_label", F.lit("-"), F.lit(" ")), " "), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), ""))
    return docs_.abbreviations(names.select(F.concat(F.lit("We study "), "hub_label", F.lit(" ("), initials, F.lit(").")).alias("text"), F.col("hub_label").alias("name")), "text", "name")


# --- canonical forms, numbers, dates


KEYS = "list_sort(json_keys(j))"
VALUE = "CASE WHEN json_type(j, '$.\"' || k || '\"') = 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys(j -> k)), lambda m: '\"' || m || '\":' || json_extract(j -> k, '$.\"' || m || '\"')::VARCHAR), ',') || '}}' ELSE json_extract(j, '$.\"' || k || '\"')::VARCHAR END"


@query(
    f"WITH e AS (SELECT event_id, trim(data, ' \t\n\r') AS t FROM session_event WHERE data IS NOT NULL), v AS (SELECT event_id, t::JSON AS j FROM e WHERE json_valid(t) AND starts_with(t, '{{') AND NOT contains(t, chr(92))), c AS (SELECT event_id, '{{' || array_to_string(list_transform({KEYS}, lambda k: '\"' || k || '\":' || {VALUE.replace('{{', '{').replace('}}', '}')}), ',') || '}}' AS text FROM v) SELECT event_id, sha256(text) AS canonical FROM c".replace("'{{'", "'{'").replace("'}}'", "'}'")
)
def fn_canonical_json(spark, d):
    """JSON objects with their keys in order at every depth, as a digest; equal objects are equal however they were written."""
    e = load(spark, d, "session_event", "event_id", "data").where(~F.contains("data", F.lit("\\")))
    c = e.select("event_id", fn.canonical_json(F.col("data")).alias("text")).where("text is not null")
    return c.select("event_id", F.sha2("text", 256).alias("canonical"))


@query("SELECT p_partkey, round((p_size * 2 + p_retailprice / 4)::DOUBLE, 6) AS value FROM part")
def fn_calculator(spark, d):
    """Arithmetic expressions in text, evaluated with 34 digits."""

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: float(evaluate(t)))

    text = F.concat(F.lit("sum(["), F.col("p_size").cast("string"), F.lit(", "), F.col("p_size").cast("string"), F.lit("]) + "), F.col("p_retailprice").cast("decimal(18,4)").cast("string"), F.lit(" / sqrt(16)"))
    return load(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.round(value(text), 6).alias("value"))


@query(
    """WITH f AS (SELECT 'customer/' || o_custkey AS subject, 'order/' || o_orderkey AS object, o_orderdate AS a, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
 SELECT object, CASE WHEN TIMESTAMP '1997-01-01' < a THEN 'before' WHEN b IS NULL OR TIMESTAMP '1997-01-01' < b THEN 'valid' ELSE 'after' END AS state, a < TIMESTAMP '1994-01-01' AS review FROM f"""
)
def fn_date_state(spark, d):
    """Facts before, within or after their validity, and those to review after three years (F32)."""
    from ledgerloom.sources import graph_tables

    at = F.lit("1997-01-01").cast("timestamp")
    f = graph_tables.facts(spark, d)
    return f.select("object", fn.date_state(at, F.col("valid_from"), F.col("valid_until")).alias("state"), (F.col("valid_from") < F.add_months(at.cast("date"), -36)).alias("review"))


@query(
    """WITH s AS (SELECT sequence_index, list_distinct(list_filter(coalesce(concepts, []), lambda x: x IS NOT NULL)) AS a, list_distinct(list_filter(coalesce(disciplines, []), lambda x: x IS NOT NULL)) AS b FROM physh_gold_matched)
 SELECT sequence_index, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS f1 FROM s"""
)
def fn_set_f1(spark, d):
    """Set-F1 of two label sets of a row."""
    clean = lambda c: F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))
    return load(spark, d, "physh_gold_matched", "sequence_index", "concepts", "disciplines").select("sequence_index", F.round(fn.set_f1(clean("concepts"), clean("disciplines")), 9).alias("f1"))


@query()
def fn_gradient_check(spark, d):
    """Gradients of a tensor train by reverse mode against finite differences, for every vector."""
    return tensor.gradient_check(load(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _cores())


@query(
    r"""SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')), '^$', '')) AS body, len(regexp_extract_all(text, '(?i)<a\s[^>]*href="[^"]*"'))::INT AS n_links
 FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?i)<html')"""
)
def doc_html_text(spark, d):
    """Text and links of pages in HTML."""
    t = _texts(spark, d).where(F.col("text").rlike("(?i)<html"))
    return t.select("doc_id", F.sha2(fn.html_text(F.col("text")), 256).alias("body"), F.size(fn.html_links(F.col("text"))).alias("n_links"))


#: Words of a request that tell who takes it; the first rule that fits counts, words of the second list forbid it.
INTENTS = [
    ("query", ["query", "查询", "查", "问", "找", "research", "研究"], ["ingest", "摄入", "inbox", "文档摄入"]),
    ("ingest", ["ingest", "摄入", "inbox", "论文 pdf", "会议纪要", "文档摄入"], []),
]
INTENT_SQL = "CASE " + " ".join(
    "WHEN (" + " OR ".join(f"contains(q, '{w}')" for w in yes) + ")" + "".join(f" AND NOT contains(q, '{w}')" for w in no) + f" THEN '{name}'" for name, yes, no in INTENTS
) + " ELSE 'query' END"


@query(f"SELECT id, {INTENT_SQL} AS handler FROM (SELECT id, coalesce(lower(trim(query)), '') AS q FROM retrieval_benchmark_real) r")
def fn_dispatch(spark, d):
    """Requests to handlers by ordered rules of words, some with words that forbid them."""
    return load(spark, d, "retrieval_benchmark_real", "id", "query").select("id", fn.dispatch(F.coalesce(F.lower(F.trim("query")), F.lit("")), INTENTS, "query").alias("handler"))


# --- reading


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, sum(regexp_matches(c, '^(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS fence FROM l),
 h AS (SELECT doc_id, line, length(regexp_extract(c, '^(#{1,6}) ', 1)) AS level, lower(regexp_replace(trim(regexp_replace(c, '^#{1,6} ', '')), '[^\p{L}\p{N}]+', '-', 'g')) AS slug FROM f WHERE fence % 2 = 0 AND regexp_matches(c, '^#{1,6} ')),
 k AS (SELECT h.doc_id, h.line, h.slug, min(x.line) AS next_line FROM h LEFT JOIN h x ON x.doc_id = h.doc_id AND x.line > h.line AND x.level <= h.level GROUP BY ALL),
 one AS (SELECT doc_id, min(line) AS line, min_by(next_line, line) AS next_line FROM (SELECT doc_id, line, coalesce(next_line, 1000000000) AS next_line FROM k WHERE slug = 'content') q GROUP BY doc_id),
 b AS (SELECT one.doc_id, string_agg(c, chr(10) ORDER BY l.line) AS body FROM one JOIN l ON l.doc_id = one.doc_id AND l.line > one.line AND l.line < one.next_line GROUP BY one.doc_id),
 a AS (SELECT doc_id, string_agg(slug, ',' ORDER BY line) AS slugs FROM h GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN one.doc_id IS NULL THEN 'missing' ELSE 'found' END AS state, sha256(coalesce(b.body, '')) AS body, len(list_distinct(regexp_extract_all(coalesce(b.body, ''), 'raw/[a-z0-9-]+\.md#L[0-9]+-L[0-9]+')))::INT AS n_citations, CASE WHEN one.doc_id IS NULL THEN coalesce(a.slugs, '') END AS sections
 FROM documents d LEFT JOIN one ON d.doc_id = one.doc_id LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id WHERE d.text IS NOT NULL"""
)
def doc_read_section(spark, d):
    """A section's text with the citations in it; where it is missing, the sections there are."""
    s = docs_.read_section(_texts(spark, d), "doc_id", "text", "content")
    return s.select("doc_id", "state", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body"), F.size("citations").alias("n_citations"), "sections")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'raw/[a-z0-9-]+\.md#L[0-9]+-L[0-9]+'))) AS loc FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, loc, regexp_extract(loc, '#L([0-9]+)', 1)::INT AS a, regexp_extract(loc, '-L([0-9]+)$', 1)::INT AS z, regexp_extract(loc, '^raw/([a-z]+)-', 1) AS name FROM l),
 s AS (SELECT regexp_extract(path, '([a-z]+)-[a-z0-9]+\.md$', 1) AS name, min_by(text, doc_id) AS text FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY 1)
 SELECT p.doc_id, loc, CASE WHEN s.name IS NULL THEN 'no source' WHEN a < 1 OR z < a OR a > len(string_split(text, chr(10))) THEN 'no lines' WHEN length(array_to_string(string_split(text, chr(10))[a:z], chr(10))) > 500 THEN 'too long' ELSE 'read' END AS state,
 CASE WHEN s.name IS NOT NULL AND a >= 1 AND z >= a AND a <= len(string_split(text, chr(10))) AND length(array_to_string(string_split(text, chr(10))[a:z], chr(10))) <= 500 THEN array_to_string(string_split(text, chr(10))[a:z], chr(10)) END AS body FROM p LEFT JOIN s ON p.name = s.name"""
)
def doc_read_raw(spark, d):
    """Exact slices by line locators, of the first page of the cited stem; what is too long is refused."""
    found = docs_.locators(_texts(spark, d), "doc_id", "text").distinct().withColumnRenamed("source", "file").withColumn("source", F.regexp_extract("file", "^raw/([a-z]+)-", 1))
    sources = load(spark, d, "documents", "doc_id", "text", "path").where("path is not null and text is not null")
    sources = sources.groupBy(F.regexp_extract("path", r"([a-z]+)-[a-z0-9]+\.md$", 1).alias("source")).agg(F.min_by("text", "doc_id").alias("text"))
    s = docs_.read_raw(found, sources, most=500)
    return s.select("doc_id", F.concat("file", F.lit("#L"), "first_line", F.lit("-L"), "last_line").alias("loc"), "state", "body")


@query(
    """WITH RECURSIVE w AS (SELECT doc_id, text FROM documents WHERE length(text) > 1500), l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM w),
 r AS (SELECT doc_id, line, n AS size, 0 AS place FROM l WHERE line = 1
  UNION ALL SELECT l.doc_id, l.line, CASE WHEN size + l.n + 1 > 1500 THEN l.n ELSE size + l.n + 1 END, place + (size + l.n + 1 > 1500)::INT FROM r JOIN l ON l.doc_id = r.doc_id AND l.line = r.line + 1),
 g AS (SELECT doc_id, least(place, 8) AS place, min(line) AS a, max(line) AS z FROM r GROUP BY ALL) SELECT doc_id, place::INT AS place, a::INT AS first, z::INT AS last, place = 8 AS rest FROM g"""
)
def doc_read_ranges(spark, d):
    """Ranges offered in place of slices that are too long: eight at most, and what is left."""
    docs = _texts(spark, d).withColumn("source", F.col("doc_id").cast("string"))
    asked = docs.select("doc_id", "source", F.lit(1).alias("first_line"), F.size(F.split("text", "\n", -1)).alias("last_line"))
    r = docs_.read_raw(asked, docs.select("source", "text"), most=1500).where("state = 'too long'")
    return r.select("doc_id", F.posexplode("ranges").alias("place", "r")).select("doc_id", "place", "r.*")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
 f AS (SELECT *, sum(regexp_matches(c, '^(```|~~~)')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS fence FROM l),
 h AS (SELECT doc_id, line, length(regexp_extract(c, '^(#{1,6}) ', 1)) AS level, trim(regexp_replace(c, '^#{1,6} ', '')) AS title FROM f WHERE fence % 2 = 0 AND regexp_matches(c, '^#{1,6} ')),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM h WHERE line >= 5 AND contains(lower(title), 'a'))
 SELECT doc_id, line::INT AS line, level::INT AS level, title, n > 2 AS more FROM r WHERE place <= 2"""
)
def doc_outline_window(spark, d):
    """An outline from a line on, of the headings that have a word, a few at a time (R2)."""
    return docs_.outline_window(docs_.outline(_texts(spark, d), "doc_id", "text"), "doc_id", query="a", start_line=5, limit=2)


@query(
    r"""WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'raw/[a-z0-9-]+\.md'))) AS cited FROM documents WHERE text IS NOT NULL),
 r AS (SELECT DISTINCT 'raw/' || regexp_extract(path, '([^/]+)$', 1) AS seen FROM documents WHERE path IS NOT NULL AND updated_at >= TIMESTAMP '2025-01-01'),
 k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (seen IS NULL) AS bad FROM c LEFT JOIN r ON cited = seen GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_citations, coalesce(bad, 0)::BIGINT AS n_unverified, CASE WHEN n IS NULL THEN 'no_citations' WHEN bad > 0 THEN 'unverified' ELSE 'verified' END AS status FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id WHERE d.text IS NOT NULL"""
)
def ret_citation_check(spark, d):
    """Texts by their citations: verified if all sources were read, unverified, or without any."""
    t = _texts(spark, d)
    cited = t.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(raw/[a-z0-9-]+\.md)"), F.lit(1)))).alias("cited"))
    seen = load(spark, d, "documents", "path", "updated_at").where(F.col("path").isNotNull() & (F.col("updated_at") >= F.lit("2025-01-01").cast("timestamp"))).select(F.concat(F.lit("raw/"), F.regexp_extract("path", r"([^/]+)$", 1)).alias("seen")).distinct()
    per = cited.join(seen, F.col("cited") == F.col("seen"), "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("seen").isNull()).alias("bad"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    status = F.when(F.col("n").isNull(), "no_citations").when(F.col("bad") > 0, "unverified").otherwise("verified")
    return t.select("doc_id").join(per, "doc_id", "left").select("doc_id", zero("n").alias("n_citations"), zero("bad").alias("n_unverified"), status.alias("status"))
