"""Queries on lookups, attachments and summaries of the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import catalog as ct
from shelfmark.operators import similar as sm
from shelfmark.plans.contents import _PAIRS, _entries
from shelfmark.plans.library import _P, ROOT, plan_moves
from shelfmark.session import read_table


def _media(spark, sf_dir):
    p, k = read_table(spark, sf_dir, "part"), F.col("p_partkey")
    kinds, origins = F.array(*map(F.lit, ("image", "video", "other"))), F.array(*map(F.lit, ("camera", "screenshot_phone", "document_scan", "messenger", "screenshot_desktop")))
    return p.select(
        F.concat(F.lit("p/"), k.cast("string"), F.lit(".jpg")).alias("display_path"), F.element_at(kinds, (k % 3).cast("int") + 1).alias("media_kind"), (k % 11 == 0).alias("is_archive_member"),
        F.when(k % 6 != 0, F.element_at(origins, (k % 5).cast("int") + 1)).alias("origin_class"), (k % 600).cast("string").alias("full_hash"), F.col("p_size").cast("long").alias("size"),
    )


def _faces(spark, sf_dir):
    e, k = read_table(spark, sf_dir, "embeddings"), F.col("vec_id")
    one = e.select((k % 150).cast("string").alias("content_hash"), F.floor(k / 150).cast("int").alias("face_index"), (k % 90 + 10).alias("width"), (k % 70 + 20).alias("height"), F.element_at("embedding", 1).cast("double").alias("embedding"), "label")
    return one.where("cast(content_hash as int) % 4 <> 3")


def _face_scans(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").where("vec_id < 120").select(F.col("vec_id").cast("string").alias("content_hash"), (F.col("vec_id") % 5 * 200).alias("detect_long_side"))


def _library(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.concat_ws("/", F.lit("L"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("destination"), (F.col("o_orderkey") % 1000).cast("string").alias("content_hash"), (F.col("o_orderkey") % 90).alias("size"))


def _states(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select((F.col("doc_id") % 1000).cast("string").alias("content_hash"), F.when(F.col("toxic") == 1, "drop").otherwise("keep").alias("album_state"), F.when(F.col("doc_id") % 3 == 0, 1.0).alias("album_applied_at"))


def _archives(spark, sf_dir):
    s, k = read_table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("unread", "unique", "fully_redundant", "partially_redundant")))
    return s.select(F.concat(F.lit("a/"), k.cast("string"), F.lit(".zip")).alias("path"), (k * 10).alias("size"), F.element_at(kinds, (k % 4).cast("int") + 1).alias("verdict"), (k % 9).alias("members"), (k % 3).alias("redundant"), (k % 8 == 0).alias("was_skipped"))


def album_media(spark, sf_dir):
    return ct.album_media(_media(spark, sf_dir)).select("display_path")


def path_lookup(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("p/"), (F.col("c_custkey") * 3).cast("string"), F.lit(".jpg")).alias("display_path"))
    return ct.found_rows(_media(spark, sf_dir), wanted, "display_path").select("display_path", "size")


def content_existence(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 40).cast("string").alias("full_hash"))
    return ct.existence(_media(spark, sf_dir), wanted, "full_hash")


def face_counts(spark, sf_dir):
    contents = _media(spark, sf_dir).select(F.col("full_hash").alias("content_hash"))
    return ct.face_counts(contents, _face_scans(spark, sf_dir), _faces(spark, sf_dir))


def scan_faces(spark, sf_dir):
    return ct.scan_faces(_faces(spark, sf_dir), _media(spark, sf_dir).where("size < 20")).select("content_hash", "face_index")


def person_embeddings(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    assigned = faces.where("face_index = 0").select(F.col("label").alias("person_id"), "content_hash", "face_index")
    return ct.person_embeddings(faces, assigned).groupBy("person_id").agg(F.count("*").alias("n"), F.round(F.sum("embedding"), 4).alias("total"))


def persons_labelled(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    persons = n.select(F.col("n_nationkey").cast("long").alias("person_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("label"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"))
    labels = n.where("n_nationkey % 3 = 0").select((F.col("n_nationkey") + 3).cast("long").alias("person_id"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("label"))
    return ct.label_persons(persons, labels, 9.0)


def prominent_faces(spark, sf_dir):
    return ct.prominent_faces(_faces(spark, sf_dir), _face_scans(spark, sf_dir))


def pending_drops(spark, sf_dir):
    return ct.pending_drops(_states(spark, sf_dir), _library(spark, sf_dir))


def pending_drops_of_album(spark, sf_dir):
    return ct.pending_drops(_states(spark, sf_dir), _library(spark, sf_dir), "L/1-URGENT")


def skipped_archives(spark, sf_dir):
    a = _archives(spark, sf_dir)
    skipped = a.where("was_skipped").select("path", "size", F.lit("excluded_by_mode").alias("reason"))
    return ct.bytes_by(ct.skipped_archives(skipped, a), "reason")


def archive_listing(spark, sf_dir):
    return ct.archive_listing(_archives(spark, sf_dir))


def archives_with_media(spark, sf_dir):
    return ct.archives_with_media(_media(spark, sf_dir).select(F.concat(F.lit("a/"), (F.col("size") % 40).cast("string")).alias("archive_path"), F.when(F.col("size") % 4 == 0, F.col("media_kind")).otherwise("other").alias("media_kind")))


def groups_with_metrics(spark, sf_dir):
    groups = _media(spark, sf_dir).groupBy("full_hash").agg(F.min("media_kind").alias("media_kind"))
    quality = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("content_hash"), F.when(F.col("vec_id") % 2 == 0, 1.0).alias("sharpness"))
    return ct.groups_with_metrics(groups, quality)


def similar_summary(spark, sf_dir):
    t = sm.SimilarThresholds(16)
    k = F.col("content_hash").cast("long")
    e = _entries(spark, sf_dir).withColumns({"bits": F.when(k % 50 != 7, F.col("bits")), "aspect": F.when(k % 3 == 0, 1.5).when(k % 3 == 1, 0.7).otherwise(0.0)})
    return ct.similar_summary(e, sm.similar_groups(e, t), t)


def photos_by_folder(spark, sf_dir):
    m = _media(spark, sf_dir)
    return ct.photos_by_folder(m, F.col("origin_class"))


def queue_summary(spark, sf_dir):
    o, k = read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tiers, states = F.array(*map(F.lit, (0, 1, 2, 3, 9))), F.array(*map(F.lit, ("keep", "print", "drop")))
    cards = o.select(F.col("o_orderpriority").alias("folder"), F.element_at(tiers, (k % 5).cast("int") + 1).alias("tier"), F.when(k % 4 != 0, F.element_at(states, (k % 3).cast("int") + 1)).alias("state"), F.when(k % 7 == 0, 1.0).alias("applied_at"), (k % 6 != 0).alias("measured"))
    return ct.queue_summary(cards)


def outcome_bytes(spark, sf_dir):
    li, k = read_table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    return ct.outcome_bytes(li.select(F.when(k % 5 == 0, "failed").otherwise("done").alias("outcome"), F.when(k % 2 == 0, "copy").otherwise("rename").alias("transfer"), F.col("l_partkey").alias("size")))


def sidecar_of(spark, sf_dir):
    m, k = _media(spark, sf_dir), F.col("size")
    path = F.col("display_path")
    sidecars = m.where(k % 3 == 0).select(F.concat(path, F.lit(".supplemental-metadata.json")).alias("path")).unionAll(m.where(k % 4 == 0).select(F.concat(F.regexp_replace(path, "[.]jpg$", ""), F.lit(".json")).alias("path")))
    return ct.sidecar_of(m, sidecars.unionAll(m.where(k % 10 == 0).select(F.concat(path, F.lit(".json")).alias("path"))))


def plan_filter(spark, sf_dir):
    moves = plan_moves(spark, sf_dir)
    return ct.bytes_by(ct.plan_rows(moves, "copy", f"{ROOT}/2020").unionAll(ct.plan_rows(moves, "rename")), "transfer")


def shown_sizes(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    n = F.col("p_partkey") * F.col("p_partkey") * 37
    return p.select("p_partkey", ct.shown_bytes(n).alias("bytes"), ct.shown_duration(F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey") * 13)).alias("took"))


_M = """m AS (SELECT p_partkey AS k, 'p/' || p_partkey || '.jpg' AS display_path, (['image', 'video', 'other'])[(p_partkey % 3 + 1)::INT] AS media_kind,
CASE WHEN p_partkey % 6 <> 0 THEN (['camera', 'screenshot_phone', 'document_scan', 'messenger', 'screenshot_desktop'])[(p_partkey % 5 + 1)::INT] END AS origin_class, (p_partkey % 600)::VARCHAR AS full_hash, p_size::BIGINT AS size FROM part)"""
_FA = """fa AS (SELECT (vec_id % 150)::VARCHAR AS content_hash, (vec_id // 150)::INT AS face_index, vec_id % 90 + 10 AS width, vec_id % 70 + 20 AS height, embedding[1]::DOUBLE AS x, label FROM embeddings WHERE vec_id % 150 % 4 <> 3),
fs AS (SELECT vec_id::VARCHAR AS content_hash, vec_id % 5 * 200 AS side FROM embeddings WHERE vec_id < 120)"""
_L = """l AS (SELECT 'L/' || o_orderpriority || '/' || o_orderkey AS destination, (o_orderkey % 1000)::VARCHAR AS content_hash, o_orderkey % 90 AS size, o_orderpriority FROM orders),
d AS (SELECT DISTINCT (doc_id % 1000)::VARCHAR AS content_hash FROM labels WHERE toxic = 1 AND doc_id % 3 <> 0)"""
_A = "a AS (SELECT s_suppkey AS k, s_suppkey * 10 AS size, (['unread', 'unique', 'fully_redundant', 'partially_redundant'])[(s_suppkey % 4 + 1)::INT] AS verdict FROM supplier)"

QUERIES = {
    f.__name__: f
    for f in (
        album_media, path_lookup, content_existence, face_counts, scan_faces, person_embeddings, persons_labelled, prominent_faces, pending_drops, pending_drops_of_album, skipped_archives, archive_listing,
        archives_with_media, groups_with_metrics, similar_summary, photos_by_folder, queue_summary, outcome_bytes, sidecar_of, plan_filter, shown_sizes,
    )
}
ORACLE_SQL = {
    "album_media": f"WITH {_M} SELECT display_path FROM m WHERE k % 3 < 2 AND k % 11 <> 0 AND (origin_class IS NULL OR origin_class IN ('camera', 'messenger'))",
    "path_lookup": f"WITH {_M} SELECT display_path, size FROM m WHERE k % 3 = 0 AND k // 3 IN (SELECT c_custkey FROM customer)",
    "content_existence": f"WITH {_M} SELECT (s_suppkey * 40)::VARCHAR AS full_hash, (s_suppkey * 40)::VARCHAR IN (SELECT full_hash FROM m) AS present FROM supplier",
    "face_counts": f"WITH {_M}, {_FA} SELECT c.full_hash AS content_hash, c.full_hash IN (SELECT content_hash FROM fs) AS scanned, CASE WHEN c.full_hash IN (SELECT content_hash FROM fs) THEN (SELECT count(*) FROM fa WHERE fa.content_hash = c.full_hash) END AS n_faces FROM (SELECT DISTINCT full_hash FROM m) c",
    "scan_faces": f"WITH {_M}, {_FA} SELECT content_hash, face_index FROM fa WHERE content_hash IN (SELECT full_hash FROM m WHERE size < 20)",
    "person_embeddings": f"WITH {_FA} SELECT label AS person_id, count(*) AS n, round(sum(x), 4) AS total FROM fa WHERE face_index = 0 GROUP BY 1",
    "persons_labelled": """WITH p AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS label FROM nation), t AS (SELECT n_nationkey::BIGINT + 3 AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS label FROM nation WHERE n_nationkey % 3 = 0)
SELECT coalesce(p.id, t.id) AS person_id, CASE WHEN t.id IS NULL THEN p.label ELSE t.label END AS label, CASE WHEN p.id IS NULL THEN 9.0::DOUBLE ELSE 1.0 END AS created_at, CASE WHEN t.id IS NULL THEN 1.0::DOUBLE ELSE 9.0 END AS updated_at FROM p FULL JOIN t ON p.id = t.id""",
    "prominent_faces": f"WITH {_FA} SELECT content_hash, count(*) AS n_faces, count(*) FILTER (side > 0 AND greatest(width, height) >= side * 0.08) AS n_prominent FROM fa JOIN fs USING (content_hash) GROUP BY 1",
    "pending_drops": f"WITH {_L} SELECT destination, content_hash, size FROM l WHERE content_hash IN (SELECT content_hash FROM d)",
    "pending_drops_of_album": f"WITH {_L} SELECT destination, content_hash, size FROM l WHERE content_hash IN (SELECT content_hash FROM d) AND o_orderpriority = '1-URGENT'",
    "skipped_archives": f"WITH {_A} SELECT CASE WHEN k % 8 = 0 THEN 'excluded_by_mode' ELSE 'unreadable_members' END AS reason, count(*) AS n, sum(size)::BIGINT AS bytes FROM a WHERE k % 8 = 0 OR verdict = 'unread' GROUP BY 1",
    "archive_listing": f"WITH {_A} SELECT verdict, count(*) AS n, sum(k % 9)::BIGINT AS members, sum(k % 3)::BIGINT AS redundant, sum(size)::BIGINT AS bytes, CASE WHEN verdict = 'fully_redundant' THEN sum(size)::BIGINT ELSE 0 END AS freed_bytes FROM a GROUP BY 1",
    "archives_with_media": f"WITH {_M} SELECT 'a/' || size % 40 AS archive_path, bool_or(size % 4 = 0 AND k % 3 < 2) AS has_media FROM m GROUP BY 1",
    "groups_with_metrics": f"WITH {_M}, g AS (SELECT full_hash, min(media_kind) AS kind FROM m GROUP BY 1) SELECT count(*) AS n_groups, count(*) FILTER (full_hash IN (SELECT vec_id::VARCHAR FROM embeddings WHERE vec_id % 2 = 0)) AS n_measured FROM g WHERE kind = 'image'",
    "photos_by_folder": f"WITH {_M} SELECT origin_class AS folder, count(*) AS n FROM m WHERE origin_class IS NOT NULL GROUP BY 1",
    "queue_summary": """WITH c AS (SELECT o_orderpriority AS folder, o_orderkey % 5 AS t, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 3 END AS s, o_orderkey AS k FROM orders)
SELECT folder, count(*) AS photos, count(*) FILTER (t < 4) AS queue, count(*) FILTER (t = 4) AS unfit, count(s) AS reviewed, count(*) FILTER (s = 2 AND k % 7 <> 0) AS drop_pending, count(*) FILTER (k % 6 <> 0) AS measured,
count(*) FILTER (s = 0) AS state_keep, count(*) FILTER (s = 1) AS state_print, count(*) FILTER (s = 2) AS state_drop, count(*) FILTER (s IS NULL) AS state_none,
count(*) FILTER (t = 0) AS tier_0, count(*) FILTER (t = 1) AS tier_1, count(*) FILTER (t = 2) AS tier_2, count(*) FILTER (t = 3) AS tier_3 FROM c GROUP BY 1""",
    "outcome_bytes": "SELECT count(*) AS moved, sum(l_partkey)::BIGINT AS moved_bytes, sum(l_partkey) FILTER (l_orderkey % 2 = 0)::BIGINT AS freed_bytes FROM lineitem WHERE l_orderkey % 5 <> 0",
    "sidecar_of": f"WITH {_M} SELECT display_path, CASE WHEN size % 10 = 0 THEN display_path || '.json' WHEN size % 3 = 0 THEN display_path || '.supplemental-metadata.json' WHEN size % 4 = 0 THEN 'p/' || k || '.json' END AS sidecar_path FROM m",
    "plan_filter": f"WITH {_P} SELECT transfer, count(*) AS n, sum(size)::BIGINT AS bytes FROM m WHERE destination LIKE '{ROOT}/2020/%' OR transfer = 'rename' GROUP BY 1",
    "similar_summary": f"""WITH RECURSIVE {_PAIRS}, near AS (SELECT a, b, abs(a::INT % 3 - b::INT % 3) = 1 AND a::INT % 3 + b::INT % 3 = 1 AS refused FROM p WHERE a::INT % 50 <> 7 AND b::INT % 50 <> 7),
ends AS (SELECT a, b FROM near WHERE NOT refused UNION ALL SELECT b, a FROM near WHERE NOT refused), reach AS (SELECT a AS n, a AS m FROM ends UNION SELECT ends.b, reach.m FROM reach JOIN ends ON ends.a = reach.n),
found AS (SELECT n, min(m) AS g FROM reach GROUP BY 1), sizes AS (SELECT g, count(*) AS k FROM found GROUP BY 1)
SELECT (SELECT count(*) FROM sizes) AS groups, (SELECT coalesce(sum(k), 0)::BIGINT FROM sizes) AS contents_in_groups, (SELECT coalesce(max(k), 0) FROM sizes) AS largest_group,
count(*) FILTER (vec_id % 50 <> 7) AS entries_considered, count(*) FILTER (vec_id % 50 = 7) AS entries_without_hash, (SELECT count(*) FROM near WHERE NOT refused) AS pairs_joined, (SELECT count(*) FROM near WHERE refused) AS pairs_rejected_by_aspect FROM embeddings""",
    "shown_sizes": """WITH p AS (SELECT p_partkey, p_partkey * p_partkey * 37 AS n, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey * 13 END AS s FROM part), u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1024 ** 2 THEN 1 WHEN n < 1024 ** 3 THEN 2 WHEN n < 1024 ** 4 THEN 3 ELSE 4 END AS e FROM p)
SELECT p_partkey, printf('%.1f', n / 1024.0 ** e) || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[e + 1] AS bytes, CASE WHEN s IS NULL THEN '-' WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN (s // 60) || ' min ' || (s % 60) || ' s' ELSE (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' END AS took FROM u""",
}
