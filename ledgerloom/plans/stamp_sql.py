"""The instants of all stamps in SQL, from the definition: one pattern for each way of writing, read by its groups."""

from __future__ import annotations

DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
MONTH = "(jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december)"
ZONE = r"((?:utc|gmt)?[+-]\d{2}(?::?\d{2})?|[a-z]{1,5})?"
TIME = r"(?:,?[t\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]m)?\s*" + ZONE + ")?"
#: Pattern, and which group is year, month, day, hour, minute, second, fraction, half of the day, zone (0: none).
WAYS = [(rf"(\d{{4}}){s}(\d{{1,2}}){s}(\d{{1,2}})" + TIME, (1, 2, 3, 4, 5, 6, 7, 8, 9)) for s in ("-", "/")] + [
    (r"(\d{4})年(\d{1,2})月(?:(\d{1,2})日" + TIME + ")?", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (r"(\d{4})(\d{2})(\d{2})(?:[t\s](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?\s*" + ZONE + ")?", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (DAY + r"(\d{1,2})[\s-]+" + MONTH + r"\.?[\s,-]+(\d{4})" + TIME, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (DAY + MONTH + r"\.?\s+(\d{1,2}),?\s+(\d{4})" + TIME, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})" + TIME, (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (r"(\d{4})[-/](\d{1,2})", (1, 2, 0, 0, 0, 0, 0, 0, 0)),
    (MONTH + r"\.?,?\s+(\d{4})", (2, 1, 0, 0, 0, 0, 0, 0, 0)),
    (r"(\d{4})", (1, 0, 0, 0, 0, 0, 0, 0, 0)),
]
#: Offsets in minutes of the abbreviations that the zones of the table use.
SHORT = {
    "Asia/Shanghai": {"cst": 480, "cdt": 540}, "Asia/Kolkata": {"ist": 330}, "Australia/Sydney": {"aest": 600, "aedt": 660}, "Europe/Berlin": {"cet": 60, "cest": 120, "cemt": 180},
    "America/New_York": {"est": -300, "edt": -240}, "America/Los_Angeles": {"pst": -480, "pdt": -420}, "UTC": {},
}
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(8203) || chr(12288) || chr(65279)"
NAMED = " ".join(f"WHEN zone = '{z}' AND mark = '{m}' THEN {o}" for z, ms in SHORT.items() for m, o in ms.items())


def _list(pattern: str, groups: tuple[int, ...]) -> str:
    return "[" + ", ".join(f"regexp_extract(t, '^{pattern}$', {g})" if g else "''" for g in groups) + "]"


FIELDS = "CASE " + " ".join(f"WHEN regexp_full_match(t, '{p}') THEN {_list(p, g)}" for p, g in WAYS) + " END"
#: Local time in a zone: of a time that occurs twice the engine takes the last, so the one before is looked at.
ZONED = "CASE WHEN timezone(zone, timezone(zone, wall) - INTERVAL 1 HOUR) = wall THEN epoch_us(timezone(zone, wall) - INTERVAL 1 HOUR) ELSE epoch_us(timezone(zone, wall)) END"
STAMPS = f"""z AS (SELECT origin, min(zone_name) AS zone FROM clock_zone GROUP BY origin),
 s AS (SELECT 'session_event' AS tab, event_id::VARCHAR AS record_key, ts, host AS origin, NULL AS fixed FROM session_event UNION ALL SELECT 'retrieval_benchmark_real', id, source.ts, source.log, NULL FROM retrieval_benchmark_real UNION ALL SELECT 'trajectory', step::VARCHAR, publication_date, NULL, 'UTC' FROM trajectory),
 t AS (SELECT tab, record_key, lower(trim(ts, {BLANK})) AS t, coalesce(fixed, zone) AS zone FROM s LEFT JOIN z ON s.origin = z.origin WHERE ts IS NOT NULL),
 f AS (SELECT tab, record_key, zone, t, CASE WHEN NOT regexp_full_match(t, '\\d{{10,20}}(\\.\\d+)?') THEN {FIELDS} END AS f FROM t),
 n AS (SELECT tab, record_key, zone, t, f IS NULL AND regexp_full_match(t, '\\d{{10,20}}(\\.\\d+)?') AS bare, f[1]::INT AS y, CASE WHEN f[2] = '' THEN 1 WHEN regexp_matches(f[2], '^[0-9]') THEN f[2]::INT ELSE (position(f[2][1:3] IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 END AS mo,
  CASE WHEN f[3] = '' THEN 1 ELSE f[3]::INT END AS d, CASE WHEN f[4] = '' THEN 0 ELSE f[4]::INT END AS h, CASE WHEN f[5] = '' THEN 0 ELSE f[5]::INT END AS mi, CASE WHEN f[6] = '' THEN 0 ELSE f[6]::INT END AS sec, rpad(f[7], 6, '0')[1:6]::BIGINT AS us, f[8] AS half, regexp_replace(f[9], '^(utc|gmt)([+-])', '\\2') AS mark FROM f),
 w AS (SELECT *, try_cast(CASE WHEN y > 0 AND mi < 60 AND sec < 60 AND CASE WHEN half = '' THEN h < 24 ELSE h BETWEEN 1 AND 12 END THEN printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, CASE WHEN half = '' THEN h ELSE h % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END END, mi, sec) END AS TIMESTAMP) AS wall,
  split_part(t, '.', 1) AS whole, split_part(t, '.', 2) AS part,
  CASE WHEN mark IN ('z', 'utc', 'gmt') THEN 0 WHEN regexp_matches(mark, '^[+-]') THEN CASE WHEN mark[2:3]::INT <= 18 AND coalesce(nullif(replace(mark[4:], ':', ''), ''), '0')::INT < 60 THEN (mark[2:3]::INT * 60 + coalesce(nullif(replace(mark[4:], ':', ''), ''), '0')::INT) * CASE WHEN mark[1] = '-' THEN -1 ELSE 1 END END {NAMED} END AS shift FROM n),
 u AS (SELECT tab, record_key, CASE WHEN bare THEN try_cast(CASE WHEN length(whole) <= 11 THEN whole || rpad(part, 6, '0')[1:6] WHEN length(whole) <= 14 THEN whole || rpad(part, 3, '0')[1:3] WHEN length(whole) <= 17 THEN whole ELSE whole[1:length(whole) - 3] END AS BIGINT)
  WHEN mark <> '' THEN epoch_us(wall) + us - shift::BIGINT * 60000000 ELSE {ZONED} + us END AS utc_us FROM w)"""
SQL = f"WITH {STAMPS} SELECT tab, record_key, strftime(make_timestamp(utc_us), '%Y-%m-%dT%H:%M:%S.%fZ') AS utc FROM u WHERE utc_us IS NOT NULL"
