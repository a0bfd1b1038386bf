"""Queries on event sessions; the events table's users stand for libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import events as ev
from shelfmark.session import read_table

KEYS = ["user_id"]


def moments(spark, sf_dir: str):
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "user_id",
        F.format_string("%010d", "event_id").alias("display_path"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("taken_at"),
        F.when(k % 3 != 0, 40 + (k % 7) * 0.01).alias("lat"),
        F.when(k % 3 != 0, 70 + (k % 5) * 0.02).alias("lon"),
        F.element_at(F.array(*map(F.lit, ("exif", "sidecar", "filename", "mtime"))), (F.col("event_id") % 4).cast("int") + 1).alias("time_source"),
        "event_type",
    )


def event_boundaries(spark, sf_dir):
    rows = ev.boundaries(moments(spark, sf_dir), KEYS)
    return rows.where("is_boundary").groupBy("rule").agg(F.count("*").alias("n"))


def event_sessions(spark, sf_dir):
    return ev.sessions(moments(spark, sf_dir), KEYS).select("user_id", "display_path", "event_no")


def _events(spark, sf_dir):
    return ev.event_summary(ev.sessions(moments(spark, sf_dir), KEYS), KEYS)


def event_summary(spark, sf_dir):
    r = _events(spark, sf_dir)
    return r.select("user_id", "event_no", "size", "start_at", "end_at", "anchor", "geo_known", F.round("centre_lat", 6).alias("centre_lat"), F.round("centre_lon", 6).alias("centre_lon"), F.round("radius_m", 3).alias("radius_m"), "confidence")


def event_trips(spark, sf_dir):
    return ev.trips(_events(spark, sf_dir), KEYS).groupBy("user_id").agg(F.max("trip_no").alias("n_trips"), F.count("*").alias("n_events"))


def event_library(spark, sf_dir):
    rows = ev.cluster_events(moments(spark, sf_dir), ev.EventThresholds(gap_s=600, place_gap_s=120), block_s=86400)
    return rows.groupBy("event_no").agg(F.count("*").alias("n"), F.min("display_path").alias("first_path"))


def session_top_k(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.desc("size"), "user_id", "event_no").limit(20).select("user_id", "event_no", "size")


def gap_sensitivity(spark, sf_dir):
    return ev.gap_sensitivity(moments(spark, sf_dir), KEYS, [7200, 32400, 86400])


def gap_histogram(spark, sf_dir):
    return ev.gap_histogram(moments(spark, sf_dir), KEYS, [60, 600, 3600, 21600, 86400])


def event_totals(spark, sf_dir):
    return ev.clustering_summary(_events(spark, sf_dir))


_M = """m AS (SELECT user_id, printf('%010d', event_id) AS display_path, floor(epoch(ts))::DOUBLE AS taken_at, event_id,
  (json_extract_string(props, '$.k'))::INT AS k FROM events),
p AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 40 + (k % 7) * 0.01::DOUBLE END AS lat, CASE WHEN k % 3 <> 0 THEN 70 + (k % 5) * 0.02::DOUBLE END AS lon,
  (['exif', 'sidecar', 'filename', 'mtime'])[(event_id % 4 + 1)::INT] AS time_source FROM m)"""


def _hav(a, b, c, d):
    return f"CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))) END"


def _sessions(part: str, gap: int, place_gap: int) -> str:
    part = f"PARTITION BY {part} " if part else ""
    return f"""WITH {_M}, l AS (SELECT *, lag(taken_at) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM p WINDOW w AS ({part}ORDER BY taken_at, display_path)),
d0 AS (SELECT *, taken_at - pt AS gap, {_hav("pla", "plo", "lat", "lon")} AS d FROM l),
d AS (SELECT * EXCLUDE (d), CASE WHEN gap > 0 AND d / 1000 / (gap / 3600) > 1200 THEN NULL ELSE d END AS d FROM d0),
b AS (SELECT *, CASE WHEN pt IS NULL THEN 'first' WHEN gap >= {gap} AND NOT coalesce(d <= 1000 AND floor(pt / 86400) = floor(taken_at / 86400), false) THEN 'time_gap'
  WHEN gap < {gap} AND gap >= {place_gap} AND d >= 3000 THEN 'place_change' END AS rule FROM d),
s AS (SELECT *, sum(CASE WHEN rule IS NOT NULL THEN 1 ELSE 0 END) OVER ({part}ORDER BY taken_at, display_path ROWS UNBOUNDED PRECEDING)::BIGINT AS event_no FROM b)"""


_S = _sessions("user_id", 32400, 1800)
_E = f"""{_S}, h AS (SELECT user_id, event_no, count(*) AS size, min(taken_at) AS start_at, max(taken_at) AS end_at, arg_min(display_path, display_path) AS anchor0,
  count(lat) AS geo_known, avg(lat) AS centre_lat, avg(lon) AS centre_lon,
  CASE WHEN count(*) FILTER (time_source = 'exif') / count(*)::DOUBLE >= 0.5 THEN 'high' WHEN count(*) FILTER (time_source IN ('exif', 'sidecar', 'filename')) / count(*)::DOUBLE >= 0.5 THEN 'medium' ELSE 'low' END AS confidence
  FROM s GROUP BY ALL),
a AS (SELECT user_id, event_no, display_path AS anchor FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_no ORDER BY taken_at, display_path) = 1),
e AS (SELECT h.*, a.anchor, (SELECT max({_hav("h.centre_lat", "h.centre_lon", "s.lat", "s.lon")}) FROM s WHERE s.user_id = h.user_id AND s.event_no = h.event_no) AS radius_m FROM h JOIN a USING (user_id, event_no))"""
_GAPS = f"WITH {_M}, g AS (SELECT taken_at - lag(taken_at) OVER (PARTITION BY user_id ORDER BY taken_at, display_path) AS gap FROM p)"

QUERIES = {f.__name__: f for f in (event_boundaries, event_sessions, event_summary, event_trips, event_library, session_top_k, gap_sensitivity, gap_histogram, event_totals)}
ORACLE_SQL = {
    "event_boundaries": f"{_S} SELECT rule, count(*) AS n FROM s WHERE rule IS NOT NULL GROUP BY rule",
    "event_sessions": f"{_S} SELECT user_id, display_path, event_no FROM s",
    "event_summary": f"{_E} SELECT user_id, event_no, size, start_at, end_at, anchor, geo_known, round(centre_lat, 6) AS centre_lat, round(centre_lon, 6) AS centre_lon, round(radius_m, 3) AS radius_m, confidence FROM e",
    "event_trips": f"""{_E}, t AS (SELECT *, lag(end_at) OVER w AS pe, lag(centre_lat) OVER w AS a, lag(centre_lon) OVER w AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start_at, event_no)),
n AS (SELECT *, CASE WHEN coalesce(start_at - pe <= 108000 AND {_hav("a", "o", "centre_lat", "centre_lon")} <= 50000, false) THEN 0 ELSE 1 END AS new FROM t)
SELECT user_id, sum(new)::BIGINT AS n_trips, count(*) AS n_events FROM n GROUP BY user_id""",
    "event_library": f"{_sessions('', 600, 120)} SELECT event_no, count(*) AS n, min(display_path) AS first_path FROM s GROUP BY event_no",
    "session_top_k": f"{_E} SELECT user_id, event_no, size FROM e ORDER BY size DESC, user_id, event_no LIMIT 20",
    "gap_sensitivity": f"{_GAPS} SELECT t.gap_s::BIGINT AS gap_s, count(*) FILTER (gap IS NULL OR gap >= t.gap_s) AS n_events FROM g, (VALUES (7200), (32400), (86400)) t(gap_s) GROUP BY t.gap_s",
    "gap_histogram": f"{_GAPS} SELECT ((gap >= 60)::INT + (gap >= 600)::INT + (gap >= 3600)::INT + (gap >= 21600)::INT + (gap >= 86400)::INT) AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "event_totals": f"{_E} SELECT count(*) AS n_events, sum(size)::BIGINT AS n_photos, max(size) AS largest, count(*) FILTER (size = 1)::BIGINT AS singletons, list_sort(list(size))[(count(*) // 2 + 1)::INT] AS median_size FROM e",
}
