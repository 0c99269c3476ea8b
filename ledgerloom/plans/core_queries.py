"""Registered queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import timestamps
from ledgerloom.plans import aggregate_queries, document_queries, graph_queries, registry, relational_queries, retrieval_queries, stamp_sql, stream_queries, study_queries, text_queries  # noqa: F401
from ledgerloom.sources.tables import load


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every stamp that can be read, as one UTC instant; origins without a declared zone stay out, as defined."""
    stamps = timestamps.all_stamps(load(spark, d, "session_event"), load(spark, d, "retrieval_benchmark_real"), load(spark, d, "trajectory"), load(spark, d, "clock_zone"))
    return stamps.where(F.col("utc_us").isNotNull()).select("tab", "record_key", timestamps.utc_text(F.col("utc_us")).alias("utc"))


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """For each origin of session_event, the zone estimated from ingestion times beside the declared one."""
    zones = load(spark, d, "clock_zone")
    parsed = timestamps.parse_stamps(load(spark, d, "session_event", "ts", "host", "received_at"), "ts")
    stamps = parsed.select(F.col("host").alias("origin"), F.unix_micros("received_at").alias("received_us"), "_p_zone", "_p_local_us")
    found = timestamps.estimate_zones(stamps, timestamps.zone_names(zones))
    declared = zones.groupBy("origin").agg(F.min("zone_name").alias("declared_zone"))
    return found.join(declared, "origin", "left").select("origin", "zone_name", "declared_zone", "stamps", "violations")


registry.query(stamp_sql.SQL)(p4_found)
registry.query()(p4_zones)
QUERIES, SQL = registry.QUERIES, registry.SQL
