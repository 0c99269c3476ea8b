import datetime as dt

import pytest

from ledgerloom.operators import timestamps as ts

ZONES = [("berlin", "Europe/Berlin"), ("ny", "America/New_York"), ("cn", "Asia/Shanghai"), ("bad", "Nowhere/City"), ("berlin", "Europe/Berlin")]
CASES = [
    ("2025-03-30T02:30:00", "berlin", "2025-03-30T01:30:00.000000Z"),  # skipped: the offset before the change
    ("2025-10-26T02:30:00", "berlin", "2025-10-26T00:30:00.000000Z"),  # twice: the first
    ("2025-10-26 02:30:00 CET", "berlin", "2025-10-26T01:30:00.000000Z"),
    ("2025-11-05 09:30:34 CST", "cn", "2025-11-05T01:30:34.000000Z"),
    ("2025-11-05 09:30:34 EST", "cn", None),
    ("2025-11-05 09:30:34 UTC", None, "2025-11-05T09:30:34.000000Z"),
    ("\t2026-05-11 17:07:12.0099999-04 \n", None, "2026-05-11T21:07:12.009999Z"),
    ("2025年5月1日 20:46:12", "cn", "2025-05-01T12:46:12.000000Z"),
    ("20260529T183817Z", None, "2026-05-29T18:38:17.000000Z"),
    ("1737412239", None, "2025-01-20T22:30:39.000000Z"),
    ("1764424789.304309", None, "2025-11-29T13:59:49.304309Z"),
    ("1766810824452", None, "2025-12-27T04:47:04.452000Z"),
    ("1735468810563249", None, "2024-12-29T10:40:10.563249Z"),
    ("1750544020603718859", None, "2025-06-21T22:13:40.603718Z"),
    ("Fri, 04 Sep 2026 02:47:49 +0800", None, "2026-09-03T18:47:49.000000Z"),
    ("15-Jul-2025 13:07:08", "ny", "2025-07-15T17:07:08.000000Z"),
    ("May 17, 2025 12:48:13 AM", "ny", "2025-05-17T04:48:13.000000Z"),
    ("26.10.2025 01:43", "cn", "2025-10-25T17:43:00.000000Z"),
    ("2026/09/19", "cn", "2026-09-18T16:00:00.000000Z"),
    ("18 January 2026", "ny", "2026-01-18T05:00:00.000000Z"),
    ("2026-02-16t22:28:32z", None, "2026-02-16T22:28:32.000000Z"),
    ("2025-05-19T01:33:17", None, None), ("2025-05-19T01:33:17", "unknown", None), ("2025-05-19T01:33:17", "bad", None),
    ("2025-13-07 09:00:00", "cn", None), ("2026-04-31 08:15:00+02:00", None, None), ("2025-06-18T25:10:00Z", None, None),
    ("2025-06-18T23:59:60Z", None, None), ("13:45:07", "cn", None), ("last week", "cn", None), ("", "cn", None), ("  ", "cn", None), (None, "cn", None),
    ("13:00 PM", "cn", None), ("May 17, 2025 13:48:13 PM", "ny", None), ("a|b|c|d|e|f|g|h|i|j", "cn", None), ("2" * 5000, None, None),
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, "origin string, zone_name string")


def read(spark, zones, rows, **more):
    df = spark.createDataFrame(rows, "k int, stamp string, host string, utc_us string")  # utc_us clashes with the result
    out = ts.normalise(df.drop("utc_us"), "stamp", zones, "host", **more)
    return {r.k: r.u for r in out.select("k", ts.utc_text(out.utc_us).alias("u")).collect()}


def test_cases(spark, zones):
    got = read(spark, zones, [(i, s, h, "x") for i, (s, h, _) in enumerate(CASES)])
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == [(c[0], c[2]) for c in CASES]


def test_session_zone_does_not_matter(spark, zones):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = read(spark, zones, [(0, "2025-03-30T02:30:00", "berlin", "x"), (1, "1737412239", None, "x")])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {0: "2025-03-30T01:30:00.000000Z", 1: "2025-01-20T22:30:39.000000Z"}


def test_empty_tables(spark, zones):
    assert read(spark, zones, []) == {}
    assert read(spark, zones.limit(0), [(0, "2025-05-19T01:33:17Z", "ny", "x")]) == {0: "2025-05-19T01:33:17.000000Z"}


def test_estimate(spark, zones):
    """A host without entry, whose clock runs in New York over a change of the clocks."""
    from zoneinfo import ZoneInfo

    rows = []
    for i in range(200):
        utc = dt.datetime(2025, 2, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=9 * i)
        rows.append((i, utc.astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%d %H:%M:%S"), "stray", utc + dt.timedelta(seconds=40)))
    df = spark.createDataFrame(rows, "k int, stamp string, host string, received timestamp")
    out = ts.normalise(df, "stamp", zones, "host", "received", estimate=True)
    assert {r.zone_source for r in out.collect()} == {"estimated"}
    names = ts.zone_names(zones)
    p = ts.parse_stamps(df, "stamp")
    from pyspark.sql import functions as F

    found = ts.estimate_zones(p.select(F.col("host").alias("origin"), F.unix_micros("received").alias("received_us"), "_p_zone", "_p_local_us"), names).collect()
    assert [(r.origin, r.zone_name, r.violations) for r in found] == [("stray", "America/New_York", 0)]


@pytest.mark.parametrize("zone", ["Australia/Lord_Howe", "Asia/Kathmandu", "America/St_Johns", "Pacific/Chatham"])
def test_estimate_of_a_zone_that_the_table_lacks(spark, zones, zone):
    """Half and quarter hours, and a change of the clocks in the south; the offsets found are those of the zone throughout."""
    from zoneinfo import ZoneInfo

    rows = []
    for i in range(300):
        utc = dt.datetime(2024, 8, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=29 * i)
        rows.append((i, utc.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), "stray", utc + dt.timedelta(seconds=40 + i % 90)))
    df = spark.createDataFrame(rows, "k int, stamp string, host string, received timestamp")
    out = {r.k: r.u for r in ts.normalise(df, "stamp", zones, "host", "received", estimate=True).select("k", ts.utc_text("utc_us").alias("u")).collect()}
    assert out == {i: (dt.datetime(2024, 8, 1) + dt.timedelta(hours=29 * i)).strftime("%Y-%m-%dT%H:%M:%S.000000Z") for i in range(300)}
