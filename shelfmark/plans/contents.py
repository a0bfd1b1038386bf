"""Queries on near duplicates, quality, origins, places, persons and archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import measures as ms
from shelfmark.functions import paths as pt
from shelfmark.functions import times as tm
from shelfmark.operators import archives as ar
from shelfmark.operators import best_copy as bc
from shelfmark.operators import geocode as gc
from shelfmark.operators import origin as og
from shelfmark.operators import persons as ps
from shelfmark.operators import similar as sm
from shelfmark.session import read_table

WIDE = sm.SimilarThresholds(distance=16)


def _entries(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("%08d", "vec_id").alias("content_hash"), ms.perceptual_bits(F.col("embedding")).alias("bits"), F.lit(0.0).alias("aspect"))


def phash_bits(spark, sf_dir):
    return _entries(spark, sf_dir).select("content_hash", "bits")


def hamming_pairs(spark, sf_dir):
    return sm.hamming_pairs(_entries(spark, sf_dir), WIDE)


def similar_groups(spark, sf_dir):
    return sm.similar_groups(_entries(spark, sf_dir), WIDE)


def similar_spread(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return sm.group_spread(sm.similar_groups(e, WIDE), e, WIDE.distance)


def distance_sensitivity(spark, sf_dir):
    return sm.distance_sensitivity(_entries(spark, sf_dir), [8, 12, 16])


def _candidates(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        (key % 400).alias("group_id"), F.format_string("%08d", key).alias("content_hash"), (key * 37 % 1000 + 1).alias("size"), F.when(key % 11 != 0, 400 + F.col("p_size") % 5 * 300).alias("width"),
        (300 + F.col("p_size") % 5 * 200).alias("height"), (F.col("p_retailprice") % 50).alias("sharpness"), ((key % 10) / 10).alias("recompression"),
        F.when(key % 13 != 0, F.when(F.col("p_partkey") % 400 % 3 == 0, "jpeg_tables").otherwise(F.when(key % 2 == 0, "jpeg_tables").otherwise("bits_per_pixel"))).alias("recompression_basis"),
        (50 + key % 40).cast("int").alias("jpeg_quality"),
    )


def best_copy(spark, sf_dir):
    return bc.best_copies(_candidates(spark, sf_dir)).select("group_id", "content_hash", "copy_rank", "deciding_level")


def contested_copies(spark, sf_dir):
    return bc.contested(bc.best_copies(_candidates(spark, sf_dir))).select("group_id", "content_hash", "wins_by")


def album_queue(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    photos = p.select(
        (key % 50).alias("album"), F.format_string("%08d", key).alias("content_hash"), (1000 + F.col("p_size") * 60).alias("width"), (800 + F.col("p_size") * 50).alias("height"),
        F.when(key % 6 != 0, (key % 97).cast("double")).alias("sharpness"), F.when(key % 7 != 0, (key % 10) / 10).alias("recompression"), (key % 3).alias("faces"),
    )
    return bc.album_queue(photos).select("album", "content_hash", "mp", "print_size", "tier", "queue_rank")


def print_needs(spark, sf_dir):
    return spark.createDataFrame([(k, ms.print_need(k)) for k in ms.PRINT_FORMATS], "print_size string, megapixels double")


def segment_kinds(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    names = F.element_at(F.array(*map(F.lit, ("Photos", "2019-07 July", "12 мая 2020", "Новая папка (3)", "Мая", "Lake 2020", " ", "New Folder", "2021_09", "trip"))), (F.col("p_partkey") % 10).cast("int") + 1)
    return p.select(names.alias("name")).groupBy("name", pt.segment_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


def page_paths(spark, sf_dir):
    u = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", pt.basename_of(u).alias("base"), pt.folder_of(u).alias("folder"), pt.volume_of(u).alias("volume"), pt.sanitize_component(u).alias("component"), F.size(pt.path_segments(u)).alias("n_segments"))


_NAMES = ("IMG_20200101_120000.jpg", "IMG-20210315-WA0007.jpg", "Screenshot_20190122-181354.jpg", "DSC_1234.JPG", "download (3).jpg", "scan_12.pdf", "photo_5@10-11-2019_1.jpg", "holiday.webp", "2019-06-15 at 10.11.12.jpg", "Снимок экрана 2024-12-29 182756.png")
_DIRS = ("D:/Photos/Trip/", "D:/Telegram Desktop/", "D:/Screenshots/", "D:/Documents/", "D:/Lake/", "C:/Users/Downloads/", "/mnt/a/")


def _named(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("i"))
    pick = lambda items, c: F.element_at(F.array(*map(F.lit, items)), c + 1)
    size = pick(("1080x2400", "1920x1080", "4000x3000", "1240x1754", "1080x4000"), F.col("i") % 5)
    return e.select(
        F.concat(pick(_DIRS, F.col("i") % 7), pick(_NAMES, (F.col("i") / 7).cast("int") % 10)).alias("display_path"), F.split(size, "x")[0].cast("int").alias("width"), F.split(size, "x")[1].cast("int").alias("height"),
        F.when(F.col("i") % 9 == 0, "Canon").when(F.col("i") % 31 == 0, "CanoScan").alias("exif_make"), (F.col("i") % 17 == 0).alias("has_gps"),
    )


def origin_classes(spark, sf_dir):
    return og.origin_breakdown(og.classify_origin(_named(spark, sf_dir))).select("origin_class", "origin_confidence", "n")


def filename_times(spark, sf_dir):
    t = tm.filename_time(F.col("display_path"))
    return _named(spark, sf_dir).select(t.alias("t")).groupBy("t.taken_at", "t.time_source").agg(F.count("*").alias("n"))


def _places(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_name").alias("name"), (k * 0.31 + 40).alias("latitude"), (k * 0.47 % 5 + 177).alias("lon0"), (k.cast("long") * k * 9000).alias("population"), F.col("n_regionkey").cast("string").alias("country")).withColumn(
        "longitude", F.when(F.col("lon0") >= 180, F.col("lon0") - 360).otherwise(F.col("lon0"))
    )


def geo_lookup(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    lon = F.col("c_custkey") * 0.37 % 6 + 176.5
    points = c.select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 0.113 % 9 + 39.5).alias("lat"), F.when(lon >= 180, lon - 360).otherwise(lon).alias("lon"))
    return gc.geo_lookup(points, _places(spark, sf_dir).drop("lon0")).select("point_id", "place", F.round("distance_m", 2).alias("distance_m"), "inside")


def place_names(spark, sf_dir):
    rows = [("Almaty", ["Алматы", "Алма-Ата", "Алмаато", "Almaty"]), ("Paris", ["Париж", "Парис", "Париж", "Парыж"]), ("Oslo", ["Oslo"]), ("Moscow", ["Москва", "Москва", "Москох", "Масква"])]
    return gc.preferred_names(spark.createDataFrame(rows, "name string, alternates array<string>")).select("name", "shown_name")


def name_consensus(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return gc.modal_value(e, ["user_id"], "event_type", "event_id").select("user_id", "event_type", "n", F.round("share", 6).alias("share"))


def centroids(spark, sf_dir):
    c = ps.centroids(read_table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", 64), 6).alias("last"), "n")


def leader_clusters(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("face_id"), (F.col("vec_id") % 13).cast("double").alias("quality"), "embedding")
    return ps.leader_clusters(e, "label").groupBy("label", "cluster").agg(F.count("*").alias("n"), F.min("face_id").alias("first_face"))


def person_stats(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    faces = e.select(F.col("label").alias("person_id"), (F.col("vec_id") % 40).cast("string").alias("content_hash"))
    persons = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("person_id"))
    return ps.person_stats(persons, faces)


def archive_verdicts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    loose = F.col("source") == "src0"
    files = d.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("display_path"), F.when(~loose, F.col("source")).alias("archive_path"), F.col("doc_id").cast("string").alias("member_name"),
        (~loose).alias("is_archive_member"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("full_hash"),
    )
    stats = d.where(~loose).groupBy(F.col("source").alias("archive_path")).agg(F.lit(True).alias("opened"), F.count("*").alias("members_total"), F.sum((F.col("source") == "src5").cast("long")).alias("members_unreadable"))
    return ar.archive_verdicts(stats, ar.member_twins(files))


_LIST = lambda items: "(['" + "', '".join(items) + "'])"
_BITS = """e AS (SELECT printf('%08d', vec_id) AS content_hash, embedding[1:63] AS c, list_sort(embedding[1:63])[32] AS med FROM embeddings),
b AS (SELECT content_hash, list_sum([CASE WHEN c[i] > med THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END FOR i IN range(1, 64)])::BIGINT AS bits FROM e)"""
_PAIRS = f"{_BITS}, p AS (SELECT a.content_hash AS a, b.content_hash AS b, bit_count(xor(a.bits, b.bits))::INT AS distance FROM b a JOIN b b ON a.content_hash < b.content_hash WHERE bit_count(xor(a.bits, b.bits)) <= 16)"
_GROUPS = f"{_PAIRS}, s AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r AS (SELECT x AS content_hash, x AS m FROM s UNION SELECT r.content_hash, s.y FROM r JOIN s ON r.m = s.x), g AS (SELECT content_hash, min(m) AS group_id FROM r GROUP BY 1)"
_CAND = """c AS (SELECT p_partkey % 400 AS group_id, printf('%08d', p_partkey) AS content_hash, p_partkey * 37 % 1000 + 1 AS size, 400 + p_size % 5 * 300 AS width, 300 + p_size % 5 * 200 AS height,
  p_retailprice % 50 AS sharpness, (p_partkey % 10) / 10.0::DOUBLE AS recompression, CASE WHEN p_partkey % 400 % 3 = 0 OR p_partkey % 2 = 0 THEN 'jpeg_tables' ELSE 'bits_per_pixel' END AS basis, 50 + p_partkey % 40 AS q
  FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
o AS (SELECT *, min(basis) OVER (PARTITION BY group_id) = max(basis) OVER (PARTITION BY group_id) AS one FROM c),
k AS (SELECT *, -(width * height) AS k1, CASE WHEN one THEN recompression ELSE 0 END AS k2, CASE WHEN one AND basis = 'jpeg_tables' THEN -q ELSE 0 END AS k3, -sharpness AS k4, -size AS k5 FROM o),
r AS (SELECT *, row_number() OVER w AS copy_rank, lead(k1) OVER w AS n1, lead(k2) OVER w AS n2, lead(k3) OVER w AS n3, lead(k4) OVER w AS n4, lead(k5) OVER w AS n5, lead(content_hash) OVER w AS n6,
  first_value(recompression) OVER w AS br, first_value(sharpness) OVER w AS bs, first_value(basis) OVER w AS bb FROM k WINDOW w AS (PARTITION BY group_id ORDER BY k1, k2, k3, k4, k5, content_hash))"""
_NM = f"n AS (SELECT event_id AS i, {_LIST(_DIRS)}[(event_id % 7 + 1)::INT] || {_LIST(_NAMES)}[(event_id // 7 % 10 + 1)::INT] AS path FROM events)"

QUERIES = {
    f.__name__: f
    for f in (
        phash_bits, hamming_pairs, similar_groups, similar_spread, distance_sensitivity, best_copy, contested_copies, album_queue, print_needs, segment_kinds, page_paths,
        origin_classes, filename_times, geo_lookup, place_names, name_consensus, centroids, leader_clusters, person_stats, archive_verdicts,
    )
}
ORACLE_SQL = {
    "phash_bits": f"WITH {_BITS} SELECT * FROM b",
    "hamming_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "similar_groups": f"WITH RECURSIVE {_GROUPS} SELECT * FROM g",
    "similar_spread": f"WITH RECURSIVE {_GROUPS} SELECT x.group_id, count(DISTINCT x.content_hash) AS size, max(bit_count(xor(bx.bits, by_.bits)))::INT AS spread, CASE WHEN max(bit_count(xor(bx.bits, by_.bits))) <= 16 THEN 'copies' ELSE 'scene' END AS kind FROM g x JOIN g y ON x.group_id = y.group_id JOIN b bx ON bx.content_hash = x.content_hash JOIN b by_ ON by_.content_hash = y.content_hash GROUP BY x.group_id",
    "distance_sensitivity": f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT unnest([8, 12, 16])::INT AS d), ends AS (SELECT d, a, b FROM t JOIN p ON distance <= d UNION ALL SELECT d, b, a FROM t JOIN p ON distance <= d),
reach AS (SELECT d, a AS n, a AS m FROM ends UNION SELECT reach.d, ends.b, reach.m FROM reach JOIN ends ON ends.d = reach.d AND ends.a = reach.n), found AS (SELECT d, n, min(m) AS g FROM reach GROUP BY 1, 2)
SELECT t.d AS distance, (SELECT count(*) FROM p WHERE distance <= t.d) AS n_pairs, (SELECT count(DISTINCT g) FROM found WHERE found.d = t.d) AS n_groups, (SELECT count(*) FROM found WHERE found.d = t.d) AS n_contents FROM t""",
    "best_copy": f"WITH {_CAND} SELECT group_id, content_hash, copy_rank::INT AS copy_rank, CASE WHEN copy_rank > 1 OR n6 IS NULL THEN NULL WHEN k1 <> n1 THEN 'resolution' WHEN k2 <> n2 THEN 'recompression' WHEN k3 <> n3 THEN 'jpeg_quality' WHEN k4 <> n4 THEN 'sharpness' WHEN k5 <> n5 THEN 'size' ELSE 'hash' END AS deciding_level FROM r",
    "contested_copies": f"WITH {_CAND} SELECT group_id, content_hash, CASE WHEN basis = bb AND br - recompression >= 0.10 THEN 'compression' ELSE 'sharpness' END AS wins_by FROM r WHERE copy_rank > 1 AND ((basis = bb AND br - recompression >= 0.10) OR (bs > 0 AND sharpness >= 1.25 * bs AND NOT (basis = bb AND recompression - br >= 0.10)))",
    "album_queue": """WITH p AS (SELECT p_partkey % 50 AS album, printf('%08d', p_partkey) AS content_hash, round_even((1000 + p_size * 60)::DOUBLE * (800 + p_size * 50) / 1e6, 2) AS mp,
  CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 97)::DOUBLE END AS sharpness, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS rec, p_partkey % 3 AS faces FROM part),
m AS (SELECT album, CASE WHEN count(*) >= 3 THEN median(sharpness) END AS med FROM p WHERE sharpness IS NOT NULL AND rec IS NOT NULL GROUP BY album),
t AS (SELECT p.*, CASE WHEN mp >= 8.70 THEN 'A4' WHEN mp >= 4.34 THEN 'A5' WHEN mp >= 2.09 THEN '10x15' END AS print_size, med FROM p LEFT JOIN m USING (album)),
u AS (SELECT *, CASE WHEN print_size IS NULL THEN 9 WHEN sharpness IS NULL OR rec IS NULL THEN 3 WHEN rec > 0.5 OR sharpness * 1.25 < coalesce(med, 0) THEN 2 WHEN faces > 0 THEN 0 ELSE 1 END AS tier FROM t)
SELECT album, content_hash, mp, print_size, tier, row_number() OVER (PARTITION BY album ORDER BY tier, mp DESC NULLS LAST, rec NULLS LAST, sharpness DESC NULLS LAST, content_hash)::INT AS queue_rank FROM u""",
    "print_needs": "SELECT * FROM (VALUES ('A4', 8.70::DOUBLE), ('A5', 4.34), ('10x15', 2.09)) t(print_size, megapixels)",
    "segment_kinds": "SELECT t.name, t.kind, count(*) AS n FROM part JOIN (VALUES (0, 'Photos', 0), (1, '2019-07 July', 1), (2, '12 мая 2020', 1), (3, 'Новая папка (3)', 0), (4, 'Мая', 2), (5, 'Lake 2020', 2), (6, ' ', 0), (7, 'New Folder', 0), (8, '2021_09', 1), (9, 'trip', 2)) t(i, name, kind) ON p_partkey % 10 = t.i GROUP BY ALL",
    "page_paths": r"""SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$', 0) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, CASE WHEN regexp_matches(url, '^[A-Za-z]:') THEN upper(url[1]) || ':' ELSE '/' END AS volume,
  CASE WHEN length(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g')) > 120 THEN regexp_replace(left(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g'), 120), '[ .]+$', '') ELSE regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g'), '[ .]+$', '') END AS component,
  (len(list_filter(string_split(url, '/'), lambda p: p <> '')) - 1)::INT AS n_segments FROM pages""",
    "filename_times": f"""WITH {_NM} SELECT CASE event_id_name WHEN 0 THEN epoch(TIMESTAMP '2020-01-01 12:00:00') WHEN 1 THEN epoch(TIMESTAMP '2021-03-15 12:00:00') WHEN 2 THEN epoch(TIMESTAMP '2019-01-22 18:13:54') WHEN 6 THEN epoch(TIMESTAMP '2019-11-10 12:00:00')
  WHEN 8 THEN epoch(TIMESTAMP '2019-06-15 10:11:12') WHEN 9 THEN epoch(TIMESTAMP '2024-12-29 18:27:56') END AS taken_at, CASE WHEN event_id_name IN (0, 2, 8, 9) THEN 'filename' WHEN event_id_name IN (1, 6) THEN 'filename_date' ELSE 'none' END AS time_source, count(*) AS n
  FROM (SELECT i // 7 % 10 AS event_id_name FROM n) GROUP BY 1, 2""",
    "geo_lookup": """WITH pl AS (SELECT n_name AS name, n_nationkey * 0.31::DOUBLE + 40 AS la, n_nationkey * 0.47::DOUBLE % 5 + 177 AS lo, n_nationkey::BIGINT * n_nationkey * 9000 AS pop FROM nation),
pt AS (SELECT c_custkey AS point_id, c_custkey * 0.113::DOUBLE % 9 + 39.5 AS lat, c_custkey * 0.37::DOUBLE % 6 + 176.5 AS lon FROM customer),
m AS (SELECT point_id, name, pop, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2)))) AS d, greatest(2000, least(40000, 10 * sqrt(pop))) AS reach FROM pt, pl),
r AS (SELECT *, d <= reach AS inside, row_number() OVER (PARTITION BY point_id ORDER BY d > reach, CASE WHEN d <= reach THEN round_even(d / reach / 0.25, 0) ELSE 1e9 END, CASE WHEN d <= reach THEN -pop ELSE d END, name) AS rn FROM m WHERE d <= reach OR d <= 30000)
SELECT point_id, name AS place, round(d, 2) AS distance_m, inside FROM r WHERE rn = 1""",
    "name_consensus": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1) SELECT user_id, event_type, n, round(n / total::DOUBLE, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) JOIN t USING (user_id) WHERE rn = 1",
    "centroids": "WITH s AS (SELECT label, i, sum(embedding[i]::DOUBLE) AS s, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY ALL), z AS (SELECT label, sqrt(sum(s * s)) AS l, max(n) AS n FROM s GROUP BY 1) SELECT z.label, round(a.s / l, 6) AS first, round(b.s / l, 6) AS last, z.n FROM z JOIN s a ON a.label = z.label AND a.i = 1 JOIN s b ON b.label = z.label AND b.i = 64",
    "person_stats": "SELECT n_nationkey AS person_id, count(vec_id) AS face_count, count(DISTINCT vec_id % 40) AS photo_count FROM nation LEFT JOIN embeddings ON label = n_nationkey GROUP BY 1",
    "archive_verdicts": """WITH f AS (SELECT *, octet_length(encode(text))::BIGINT AS size FROM documents), l AS (SELECT DISTINCT text FROM f WHERE source = 'src0'),
m AS (SELECT source, count(*) AS total, count(*) FILTER (text IN (SELECT text FROM l)) AS red, coalesce(sum(size) FILTER (text IN (SELECT text FROM l)), 0)::BIGINT AS bytes FROM f WHERE source <> 'src0' GROUP BY 1)
SELECT source AS archive_path, CASE WHEN source = 'src5' THEN 'unread' WHEN red >= total THEN 'fully_redundant' WHEN red > 0 THEN 'partially_redundant' ELSE 'unique' END AS verdict, red AS redundant_members, total AS members_total, bytes AS redundant_bytes FROM m""",
}
