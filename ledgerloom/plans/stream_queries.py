"""Registered streaming and connector queries; the SQL is that of the batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.plans.materialise import shared_folder
from ledgerloom.plans.registry import query
from ledgerloom.sources import files, paged
from ledgerloom.sources.tables import load
from ledgerloom.streaming import events as st


def _plain(df):
    """Times without zone, as the batch twin has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    """Tumbling windows with watermark."""
    out = _plain(st.run(st.tumbling(st.read(spark, d, "events")), "update", ("start", "event_type")))
    return out.withColumn("total", F.round("total", 6))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) w GROUP BY ALL")
def stream_sliding(spark, d):
    """Sliding windows."""
    return _plain(st.run(st.sliding(st.read(spark, d, "events")), "update", ("start", "event_type")))


@query(
    """WITH m AS (SELECT user_id, ts, (ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR row_number() OVER w = 1)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark, d):
    """Session windows."""
    return _plain(st.run(st.sessions(st.read(spark, d, "events")), "complete"))


@query("SELECT DISTINCT event_id FROM events")
def stream_once(spark, d):
    """Rows processed once, whatever is replayed."""
    return st.run(st.once(st.read(spark, d, "events"), "event_id").select("event_id"), "append")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def stream_observed(spark, d):
    """First and last observation, kept up to date."""
    return _plain(st.run(st.observed(st.read(spark, d, "events")), "update", ("user_id",)))


@query(
    """WITH m AS (SELECT user_id, ts, event_id, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 OR event_type = 'signup')::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m), k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r)
 SELECT user_id, event_id, event_type, n FROM k WHERE n IN (3, 5, 8)"""
)
def stream_repeats(spark, d):
    """Runs of equal events noticed as they grow, with state per user (T4)."""
    return st.run(st.repeats(st.read(spark, d, "events")), "append")


@query("SELECT event_type AS domain, max(ts) AS cursor, count(*) AS n FROM events GROUP BY 1")
def stream_cursors(spark, d):
    """A pointer for each kind of event, which advances only when a batch is done for it."""
    return _plain(st.cursors(st.read(spark, d, "events"), "event_type", "ts", lambda df, k: None))


@query(
    """WITH r AS (SELECT user_id, event_id, sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent, coalesce(value, 0) AS value FROM events)
 SELECT user_id, event_id, round(spent, 3) AS spent FROM r WHERE spent - value < 200"""
)
def stream_budget(spark, d):
    """Events of a user until a budget is spent, with a hard stop (T5)."""
    return st.run(st.budget(st.read(spark, d, "events"), 200.0), "append").select("user_id", "event_id", F.round("spent", 3).alias("spent"))


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"


@query("SELECT sequence_index, title, doi FROM manifest WHERE title IS NOT NULL")
def src_csv_gzip(spark, d):
    """Compressed CSV written and read back with a schema."""
    path = _fresh(spark)
    files.write_rows(load(spark, d, "manifest", "sequence_index", "title", "doi").where("title is not null"), path, "csv", "gzip")
    return files.read_csv(spark, path, "sequence_index int, title string, doi string")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src_tagged_jsonl(spark, d):
    """Tagged JSON lines of several tables, one of them read back."""
    path = _fresh(spark)
    orders = load(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(F.to_json(F.struct(F.lit("orders").alias("_table"), "*")).alias("value"))
    other = load(spark, d, "nation").select(F.to_json(F.struct(F.lit("nation").alias("_table"), "*")).alias("value"))
    orders.unionByName(other).write.text(path)
    return files.read_jsonl(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string", tag="orders")


@query("SELECT doc_id::VARCHAR AS path, CASE WHEN updated_at >= TIMESTAMP '2026-01-01' THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE text IS NOT NULL AND (updated_at >= TIMESTAMP '2026-01-01' OR lang IS NULL)")
def src_checksums(spark, d):
    """A checksum list against what is there: missing and changed."""
    t = load(spark, d, "documents", F.col("doc_id").cast("string").alias("path"), "text", "updated_at", "lang").where("text is not null")
    listed = t.select("path", F.sha2("text", 256).alias("sha256"))
    there = t.where(F.col("updated_at") < F.lit("2026-01-01").cast("timestamp")).select("path", F.sha2(F.when(F.col("lang").isNull(), F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return files.verify_manifest(listed, there)


@query("SELECT CASE WHEN title IS NULL AND doi IS NULL THEN 'missing title,doi' WHEN title IS NULL THEN 'missing title' WHEN doi IS NULL THEN 'missing doi' END AS reason, count(*) AS n FROM manifest WHERE title IS NULL OR doi IS NULL GROUP BY 1")
def src_import(spark, d):
    """Rows that an import rejects, by reason."""
    _, bad = files.checked_import(load(spark, d, "manifest", "sequence_index", "title", "doi"), ["title", "doi"], "sequence_index")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def src_json_document(spark, d):
    """One JSON document over several lines, read back as rows."""
    path = _fresh(spark)
    n = load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))  # 25 rows
    r = load(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", "r_name", "nations")
    whole = r.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("regions")), {"pretty": "true"}).alias("value"))
    whole.write.text(path)
    doc = files.read_json(spark, path, "regions array<struct<r_regionkey:int,r_name:string,nations:array<struct<n_nationkey:int,n_name:string>>>>")
    return doc.select(F.explode("regions").alias("r")).select("r.r_regionkey", "r.r_name", F.inline("r.nations"))


@query("SELECT source, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes FROM documents WHERE source IS NOT NULL GROUP BY source")
def src_folder(spark, d):
    """Files of a folder with their sizes, listed without being read."""
    path = _fresh(spark)
    load(spark, d, "documents", "source", "text").where("source is not null").write.partitionBy("source").text(path)
    found = files.list_files(spark, path)
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


@query("SELECT n_nationkey, n_name, false AS first_reused, true AS then_reused FROM nation")
def src_stage(spark, d):
    """A stage that is computed once and, while its files are as they were, read the next time."""
    path = _fresh(spark)
    build = lambda: load(spark, d, "nation", "n_nationkey", "n_name")
    _, first = files.stage(spark, path, "nations", build)
    out, then = files.stage(spark, path, "nations", build)
    return out.select("*", F.lit(first).alias("first_reused"), F.lit(then).alias("then_reused"))


@query("SELECT 'nation/' || n_nationkey AS request, count(*) AS n, bool_or(r = 29) AS partial FROM (SELECT n_nationkey, unnest(range(least(30, 5 + n_nationkey * 3))) AS r FROM nation) q GROUP BY n_nationkey")
def src_paged(spark, d):
    """Records of a paged source within a budget of pages; a request that was cut short says so."""

    def fetch(request: str, cursor, size: int):
        total, at = 5 + 3 * int(request.split("/")[1]), int(cursor or 0)
        return [f"{request}#{i}" for i in range(at, min(total, at + size))], str(at + size) if at + size < total else None

    requests = [f"nation/{r.n_nationkey}" for r in load(spark, d, "nation", "n_nationkey").collect()]  # 25 rows
    rows = paged.read_paged(spark, "ledgerloom_pages", fetch, requests, page=10, pages=3)
    return rows.groupBy("request").agg(F.count("*").alias("n"), F.bool_or("partial").alias("partial"))
