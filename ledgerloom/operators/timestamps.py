"""Stamps in mixed formats and zones, brought to one UTC instant.

``parse_stamps`` reads the wall-clock fields and the zone mark of a stamp with JVM expressions only. ``normalise`` turns
them into an instant: by the stamp's own offset or abbreviation, else by the declared zone of its origin, else (on
request) by the zone that ``estimate_zones`` finds from the ingestion times.

Defined results: null, blank, unknown words, a time without date, and dates or times that do not exist give a null
``utc_us``. A local time that occurs twice means the first; one that was skipped is read with the offset before the
change. Fractions beyond a microsecond are cut off. Duplicate origins in the zone table count once (smallest name).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts

SPACE = " \t\n\r\x0b\x0c    ​　﻿"
MONTHS = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
ZONE = r"((?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|[a-z]{1,5})?"
CLOCK = r"(?:,?[t\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]m)?\s*" + ZONE + ")?"
#: Pattern, and the groups of year, month, day, hour, minute, second, fraction, am/pm, zone; 0 where the form has none.
FORMS = (
    (r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})" + CLOCK, (1, 3, 4, 5, 6, 7, 8, 9, 10)),
    (r"(\d{4})年(\d{1,2})月(?:(\d{1,2})日" + CLOCK + ")?", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (r"(\d{4})(\d{2})(\d{2})(?:[t\s](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*" + ZONE + ")?", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (DAY + r"(\d{1,2})[\s-]+" + MONTHS + r"\.?[\s,-]+(\d{4})" + CLOCK, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (DAY + MONTHS + r"\.?\s+(\d{1,2}),?\s+(\d{4})" + CLOCK, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})" + CLOCK, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (r"(\d{4})[-/](\d{1,2})", (1, 2, 0, 0, 0, 0, 0, 0, 0)),
    (MONTHS + r"\.?,?\s+(\d{4})", (2, 1, 0, 0, 0, 0, 0, 0, 0)),
    (r"(\d{4})", (1, 0, 0, 0, 0, 0, 0, 0, 0)),
)
UNIX = r"^(\d{10,20})(?:\.(\d+))?$"
UTC_NAMES = ("Z", "UTC", "GMT")


def _fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` behind a generator of one row.

    A generator is a fence for the optimiser: what stands above reads the columns, where else their expressions would be
    copied into every use, and into filters pushed below them.
    """
    row = F.explode(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))).alias("_fence")
    return df.select("*", row).select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[F.col(f"_fence.{n}").alias(n) for n in columns])


def _fields(text: Column) -> Column:
    """The nine fields of the first form that matches, as strings ('' for absent); null if none does.

    Each form rewrites a text that it matches whole into a mark and the fields, which no later form matches.
    """
    out = text
    for pattern, groups in FORMS:
        out = F.regexp_replace(out, f"(?i)^{pattern}$", "|" + "|".join(f"${g}" if g else "" for g in groups))
    return F.split(out, r"\|")


def parse_stamps(df: DataFrame, stamp: str, prefix: str = "_p_") -> DataFrame:
    """Add ``{prefix}unix_us`` (absolute stamps), ``{prefix}local_us`` (wall clock as if in UTC) and ``{prefix}zone``.

    ``{prefix}zone`` is upper case, '' without a mark. Both numbers are null for what cannot be read.
    """
    c = lambda n: F.col(prefix + n)
    text = F.btrim(F.col(stamp).cast("string"), F.lit(SPACE))
    is_unix = text.rlike(UNIX)
    df = _fenced(
        df,
        {
            prefix + "u": F.when(is_unix, F.split(text, r"\.")),
            prefix + "f": _fields(F.when(~is_unix & ~F.contains(text, F.lit("|")), text)),
        },
    )
    whole, part = F.get(c("u"), F.lit(0)), F.coalesce(F.get(c("u"), F.lit(1)), F.lit(""))
    size = F.length(whole)
    digits = (
        F.when(size <= 11, F.concat(whole, F.substring(F.rpad(part, 6, "0"), 1, 6)))
        .when(size <= 14, F.concat(whole, F.substring(F.rpad(part, 3, "0"), 1, 3)))
        .when(size <= 17, whole)
        .otherwise(whole.substr(F.lit(1), size - 3))
    )
    f = {k: F.when(F.size(c("f")) == 10, F.get(c("f"), F.lit(k + 1))) for k in range(9)}
    month = f[1]
    number = F.when(month == "", "1").when(month.rlike("^[0-9]"), month).otherwise(
        ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(month, 1, 3))) + 2) / 3).cast("int").cast("string")
    )
    zero = lambda x, least="0": F.when(x == "", least).otherwise(x).cast("int")
    hour, half = zero(f[3]), F.lower(f[7])
    df = _fenced(
        df,
        {
            prefix + "unix_us": digits.try_cast("bigint"),
            prefix + "y": f[0].cast("int"),
            prefix + "mo": number.cast("int"),
            prefix + "d": zero(f[2], "1"),
            prefix + "h": F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)),
            prefix + "mi": zero(f[4]),
            prefix + "s": zero(f[5]),
            prefix + "us": F.substring(F.rpad(f[6], 6, "0"), 1, 6).cast("bigint"),
            prefix + "zone": F.coalesce(F.upper(f[8]), F.lit("")),
        },
    )
    p = prefix
    second = F.expr(f"unix_micros(try_make_timestamp({p}y, {p}mo, {p}d, {p}h, {p}mi, cast(if({p}s < 60, {p}s, null) as decimal(16,6)), 'UTC'))")
    df = _fenced(df, {prefix + "local_us": second + c("us")})
    return df.drop(*[prefix + n for n in ("u", "f", "y", "mo", "d", "h", "mi", "s", "us")])


def known_zones(spark) -> list[str]:
    """IANA names that both sides of the engine know, about 600."""
    return sorted(available_timezones() & set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()))


def zone_names(zones: DataFrame, column: str = "zone_name") -> list[str]:
    """The valid IANA names in a zone table: at most as many as IANA has (about 600), however long the table is."""
    known = F.split(F.lit(",".join(known_zones(zones.sparkSession))), ",")
    rows = zones.select(F.col(column).alias("z")).where(F.array_contains(known, F.col("z"))).distinct().collect()
    return sorted(r.z for r in rows)


def abbreviations(names: list[str], first: int = 1970, last: int = 2037) -> dict[str, int]:
    """'zone|ABBR' -> offset in seconds, for every abbreviation a zone used between two years."""
    out: dict[str, int] = {}
    for name in names:
        zone = ZoneInfo(name)
        at = datetime(first, 1, 1, tzinfo=timezone.utc)
        while at.year <= last:
            local = at.astimezone(zone)
            mark = (local.tzname() or "").upper()
            if mark.isalpha():
                out[f"{name}|{mark}"] = int(local.utcoffset().total_seconds())  # the latest use counts
            at += timedelta(days=28)
    return out


def _literal_map(items: dict[str, int]) -> Column:
    text = ",".join(f"{k}={v}" for k, v in sorted(items.items()))
    return F.str_to_map(F.lit(text), F.lit(","), F.lit("="))


def to_utc_us(local_us: Column, zone: Column) -> Column:
    """Wall-clock microseconds in an IANA zone -> UTC microseconds (first of two, offset before a gap)."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def estimate_zones(
    stamps: DataFrame, preferred: list[str], candidates: list[str] | None = None, longest_s: int = 6 * 3600, prefix: str = "_p_"
) -> DataFrame:
    """The zone of each origin whose history of offsets fits the ingestion times best, among all IANA zones or ``candidates``.

    ``stamps`` has origin, received_us and the columns of ``parse_stamps``. A stamp read in a zone should lie before its
    ingestion, and not long before: a negative delay is a violation and costs 1, a delay costs its share of
    ``longest_s`` (1 from there on). Stamps are first counted by origin, wall-clock hour and quarter hour of
    (local - received), which is exact as all offsets since 1970 in use are quarter hours. Days on which no zone changes
    its clocks are then counted whole, others by the hour, and costs are taken for every offset in use at such a time; so
    zones meet times, and offsets bins, but never rows. Ties go to ``preferred`` zones, then to the first name (zones that were alike throughout
    can't be told apart, nor need they be). Result: origin, zone_name, cost, stamps, violations. Origins without zone-less
    stamps or ingestion times have no row.
    """
    quarter, hour_us = 900_000_000, 3_600_000_000
    c = lambda n: F.col(prefix + n)
    bins = (
        stamps.where((c("zone") == "") & c("local_us").isNotNull() & F.col("received_us").isNotNull() & F.col("origin").isNotNull())
        .groupBy("origin", F.floor(c("local_us") / F.lit(hour_us)).alias("hour"), F.floor((c("local_us") - F.col("received_us")) / F.lit(quarter)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    cuts = Cuts(stamps.sparkSession, "zones")
    bins = cuts.cut(bins)
    names = sorted(set(candidates if candidates is not None else known_zones(stamps.sparkSession)) | set(preferred))
    second = F.array_contains(F.split(F.lit(",".join(preferred)), ","), F.col("zone_name"))
    order = ("cost", F.when(second, 0).otherwise(1).alias("other"), "zone_name")

    def offsets(times: DataFrame, hour: Column, name: str) -> DataFrame:
        local = hour.cast("bigint") * F.lit(hour_us)
        return times.withColumn(name, ((local - to_utc_us(local, F.col("zone_name"))) / 1_000_000).cast("int"))

    day = F.floor(F.col("hour") / 24)
    zoned = lambda times: times.distinct().withColumn("zone_name", F.explode(F.split(F.lit(",".join(names)), ",")))
    ends = offsets(offsets(zoned(bins.select(day.alias("day"))), F.col("day") * 24, "first"), F.col("day") * 24 + 23, "last")
    changes = ends.groupBy("day").agg(F.max(F.col("first") != F.col("last")).alias("changes"))
    cells = bins.withColumn("day", day).join(changes, "day").withColumn("at", F.when(F.col("changes"), F.col("hour")).otherwise(F.col("day") * 24 + 12))
    cells = cuts.cut(cells.groupBy("origin", "at", "bin").agg(F.sum("n").alias("n")))
    times = cuts.cut(offsets(zoned(cells.select("at")), F.col("at"), "offset_s"))
    early = F.col("bin") * 900 >= F.col("offset_s")
    cost = F.when(early, 1.0).otherwise(F.least((F.col("offset_s") - F.col("bin") * 900 - 450) / longest_s, F.lit(1.0)))
    tried = cells.join(times.select("at", "offset_s").distinct(), "at").groupBy("origin", "at", "offset_s")
    tried = tried.agg(F.sum(cost * F.col("n")).alias("cost"), F.sum("n").alias("stamps"), F.sum(F.when(early, F.col("n")).otherwise(0)).alias("violations"))
    fit = times.join(tried, ["at", "offset_s"]).groupBy("origin", "zone_name").agg(F.round(F.sum("cost"), 6).alias("cost"), F.sum("stamps").alias("stamps"), F.sum("violations").alias("violations"))
    best = fit.groupBy("origin").agg(F.min(F.struct(*order, "stamps", "violations")).alias("b"))
    return best.select("origin", "b.zone_name", "b.cost", "b.stamps", "b.violations")


def normalise(
    df: DataFrame, stamp: str, zones: DataFrame, origin: str, received: str | None = None, estimate: bool = False, fixed: str | None = None
) -> DataFrame:
    """Add utc_us (BIGINT, null if unreadable) and zone_source to ``df``.

    ``zones`` has origin and zone_name; ``fixed`` names a column with a zone that overrides it where not null (only UTC
    or zones of the table). zone_source is one of absolute, offset, abbreviation, declared, estimated, none. With
    ``estimate``, origins missing from ``zones`` get the zone of ``estimate_zones``, for which ``received`` (a
    timestamp) is needed; all IANA zones are candidates, those of the table come first where several fit alike.
    """
    names = zone_names(zones)
    valid = F.array_contains(F.split(F.lit(",".join(names)), ","), F.col("zone_name"))
    table = zones.where(valid).groupBy(F.col("origin").alias("_p_origin")).agg(F.min("zone_name").alias("_p_table"))
    df = parse_stamps(df, stamp).join(table, F.col(origin) == F.col("_p_origin"), "left").drop("_p_origin")
    df = df.withColumn("_p_declared", F.coalesce(F.col(fixed), F.col("_p_table")) if fixed else F.col("_p_table")).drop("_p_table")
    if estimate and names:
        if received is None:
            raise ValueError("an estimate needs the ingestion times")
        open_ = df.where(F.col("_p_declared").isNull()).select(F.col(origin).alias("origin"), F.unix_micros(received).alias("received_us"), "_p_zone", "_p_local_us")
        found = estimate_zones(open_, names).select(F.col("origin").alias("_p_o"), F.col("zone_name").alias("_p_estimated"))
        df = df.join(found, F.col(origin) == F.col("_p_o"), "left").drop("_p_o")
    else:
        df = df.withColumn("_p_estimated", F.lit(None).cast("string"))
    mark = F.regexp_replace("_p_zone", "^(UTC|GMT)(?=[+-])", "")
    df = df.withColumn("_p_mark", mark)
    m = F.col("_p_mark")
    hours, minutes = F.substring(m, 2, 2).try_cast("int"), F.coalesce(F.regexp_extract(m, r"^[+-]\d\d:?(\d\d)$", 1).try_cast("int"), F.lit(0))
    numeric = F.when(m.rlike(r"^[+-]") & (hours <= 18) & (minutes < 60), (hours * 3600 + minutes * 60) * F.when(m.startswith("-"), -1).otherwise(1))
    known = F.coalesce(F.col("_p_declared"), F.col("_p_estimated"))
    by_name = F.try_element_at(_literal_map(abbreviations(names)), F.concat_ws("|", known, m)).cast("int")
    marked = F.when(m.isin(*UTC_NAMES), 0).when(m.rlike("^[+-]"), numeric).when(m != "", by_name)
    df = df.withColumns({"_p_marked": marked, "_p_known": known})
    local = F.col("_p_local_us")
    utc = F.coalesce(
        F.col("_p_unix_us"),
        F.when(m != "", local - F.col("_p_marked").cast("bigint") * 1_000_000).when(F.col("_p_known") == "UTC", local).otherwise(to_utc_us(local, F.col("_p_known"))),
    )
    source = (
        F.when(F.col("_p_unix_us").isNotNull(), "absolute")
        .when(m.isin(*UTC_NAMES) | m.rlike("^[+-]"), "offset")
        .when(m != "", "abbreviation")
        .when(F.col("_p_declared").isNotNull(), "declared")
        .when(F.col("_p_estimated").isNotNull(), "estimated")
        .otherwise("none")
    )
    source = F.when((m != "") & ~m.isin(*UTC_NAMES) & ~m.rlike("^[+-]") & F.col("_p_declared").isNull() & F.col("_p_estimated").isNotNull(), "estimated").otherwise(source)
    df = _fenced(df, {"utc_us": utc, "zone_source": source})
    df = df.withColumn("zone_source", F.when(F.col("utc_us").isNull(), "none").otherwise(F.col("zone_source")))
    return df.drop(*[c for c in df.columns if c.startswith("_p_")])


def utc_text(us: Column) -> Column:
    """UTC microseconds as yyyy-MM-ddTHH:mm:ss.SSSSSSZ, whatever the session's zone."""
    at = F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def all_stamps(events: DataFrame, probes: DataFrame, steps: DataFrame, zones: DataFrame, estimate: bool = False) -> DataFrame:
    """tab, record_key, utc_us, zone_source for the stamps of session_event, retrieval_benchmark_real and trajectory."""
    none, key = F.lit(None), lambda c: F.col(c).cast("string").alias("record_key")
    rows = (
        events.select(F.lit("session_event").alias("tab"), key("event_id"), "ts", F.col("host").alias("origin"), "received_at", none.cast("string").alias("fixed"))
        .unionByName(probes.select(F.lit("retrieval_benchmark_real").alias("tab"), key("id"), F.col("source.ts").alias("ts"), F.col("source.log").alias("origin"), none.cast("timestamp").alias("received_at"), none.cast("string").alias("fixed")))
        .unionByName(steps.select(F.lit("trajectory").alias("tab"), key("step"), F.col("publication_date").alias("ts"), none.cast("string").alias("origin"), none.cast("timestamp").alias("received_at"), F.lit("UTC").alias("fixed")))
    )
    return normalise(rows, "ts", zones, "origin", "received_at", estimate, "fixed").select("tab", "record_key", "utc_us", "zone_source")
