"""Queries on work lists, lookups and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import events as ev
from shelfmark.operators import funnel as fn
from shelfmark.operators import keeper as kp
from shelfmark.operators import lookups as lk
from shelfmark.operators import review as rv
from shelfmark.operators import similar as sm
from shelfmark.plans import sessions as ss
from shelfmark.plans.contents import _GROUPS, WIDE, _entries
from shelfmark.plans.duplicates import _RANKED, files
from shelfmark.session import read_table


def _files(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stamp = F.when(k % 9 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long")
    return p.select(
        F.concat(F.lit("p/"), k.cast("string")).alias("display_path"), F.col("p_size").cast("long").alias("size"), F.when(k % 5 != 0, "image").otherwise("video").alias("media_kind"),
        F.when(k % 7 != 0, (k % 600).cast("string")).alias("full_hash"), F.lit(1).cast("long").alias("source_size"), F.lit(1.0).alias("source_mtime"), stamp.alias("hashed_source_size"), F.lit(1.0).alias("hashed_source_mtime"),
    )


def _phashes(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    return e.select(k.cast("string").alias("content_hash"), F.when(k % 4 == 0, "old").otherwise("dct").alias("algo"), F.when(k % 6 != 0, k * 31).alias("bits"), F.when(k % 3 != 0, "jpeg_tables").alias("recompression_basis"), (k / 7).alias("sharpness"), (k % 10 / 9).alias("recompression"))


def _scans(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("content_hash"))


def _assigned(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 3 = 0").select(F.col("label").alias("person_id"), F.col("vec_id").cast("string").alias("content_hash"), F.lit(0).alias("face_index"))


def needs_faces(spark, sf_dir):
    return lk.needs_faces(_files(spark, sf_dir), _scans(spark, sf_dir)).select("display_path")


def needs_phash(spark, sf_dir):
    return lk.needs_phash(_files(spark, sf_dir), _phashes(spark, sf_dir), "dct", True).select("display_path")


def phash_rows(spark, sf_dir):
    return lk.phash_rows(_files(spark, sf_dir), _phashes(spark, sf_dir), "dct")


def phash_stats(spark, sf_dir):
    return lk.phash_stats(_files(spark, sf_dir), _phashes(spark, sf_dir), "dct")


def unclustered_faces(spark, sf_dir):
    faces = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("content_hash"), F.lit(0).alias("face_index"))
    return lk.unclustered_faces(faces, _files(spark, sf_dir), _assigned(spark, sf_dir)).select("content_hash")


def person_sample_paths(spark, sf_dir):
    return lk.person_sample_paths(_files(spark, sf_dir), _assigned(spark, sf_dir))


def quality_by_content(spark, sf_dir):
    previews = _phashes(spark, sf_dir).where("content_hash % 5 = 0").withColumn("sharpness", F.col("sharpness") + 1)
    return lk.quality_by_content(previews, _phashes(spark, sf_dir))


def quarantine_routes(spark, sf_dir):
    hashed = fn.funnel(files(spark, sf_dir))
    groups = fn.disposition(fn.duplicate_groups(hashed), F.lit(True))
    ranked = kp.rank_keepers(fn.repeated(hashed, "full_hash"))
    return rv.unique_targets(rv.quarantine_routes(ranked, groups))


def similar_review(spark, sf_dir):
    e = _entries(spark, sf_dir)
    k = F.col("content_hash").cast("long")
    contents = e.select("content_hash", "bits", (k % 90 + 10).alias("size"), (k % 5 + 1).alias("width"), F.lit(1).alias("height"), (k % 8 * 10).cast("double").alias("taken_at"))
    return rv.similar_review(sm.similar_groups(e, WIDE), contents, 12).select("group_id", "content_hash", "is_reference", "distance", F.array_join("labels", "+").alias("labels"))


def wrong_cuts(spark, sf_dir):
    return rv.wrong_cuts(ev.boundaries(ss.moments(spark, sf_dir), ss.KEYS), ss.KEYS, "event_type")


def mixed_events(spark, sf_dir):
    return rv.mixed_events(ev.sessions(ss.moments(spark, sf_dir), ss.KEYS), ss.KEYS, "event_type")


def gap_percentiles(spark, sf_dir):
    gaps = ev.boundaries(ss.moments(spark, sf_dir), ss.KEYS)
    return rv.index_percentiles(gaps, "gap_s", [0.1, 0.5, 0.9, 0.99])


_F = """f AS (SELECT 'p/' || p_partkey AS display_path, p_size::BIGINT AS size, p_partkey % 5 <> 0 AS image, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 600)::VARCHAR END AS h, p_partkey % 9 <> 0 AS fresh FROM part),
p AS (SELECT vec_id::VARCHAR AS h, CASE WHEN vec_id % 4 = 0 THEN 'old' ELSE 'dct' END AS algo, CASE WHEN vec_id % 6 <> 0 THEN vec_id * 31 END AS bits, CASE WHEN vec_id % 3 <> 0 THEN 'jpeg_tables' END AS basis, vec_id / 7.0::DOUBLE AS sharpness, vec_id % 10 / 9.0::DOUBLE AS rec, vec_id, label FROM embeddings)"""

QUERIES = {f.__name__: f for f in (needs_faces, needs_phash, phash_rows, phash_stats, unclustered_faces, person_sample_paths, quality_by_content, quarantine_routes, similar_review, wrong_cuts, mixed_events, gap_percentiles)}
ORACLE_SQL = {
    "needs_faces": f"WITH {_F} SELECT display_path FROM f WHERE image AND (h IS NULL OR NOT fresh OR h NOT IN (SELECT h FROM p WHERE vec_id % 2 = 0))",
    "needs_phash": f"WITH {_F} SELECT display_path FROM f LEFT JOIN p ON p.h = f.h AND algo = 'dct' WHERE image AND (p.h IS NULL OR NOT fresh OR basis IS NULL)",
    "phash_rows": f"WITH {_F}, g AS (SELECT h, count(*) AS n_paths, min(display_path) AS first_path, arg_min(size, display_path) AS size FROM f WHERE h IS NOT NULL GROUP BY h) SELECT g.h AS content_hash, n_paths, first_path, size, bits FROM g JOIN p ON p.h = g.h AND algo = 'dct'",
    "phash_stats": f"WITH {_F} SELECT count(*) AS n_images, count(p.h) AS n_with_phash, count(*) FILTER (p.h IS NOT NULL AND bits IS NULL) AS n_flat FROM f LEFT JOIN p ON p.h = f.h AND algo = 'dct' WHERE image",
    "unclustered_faces": f"WITH {_F} SELECT h AS content_hash FROM p WHERE h IN (SELECT h FROM f WHERE h IS NOT NULL) AND vec_id % 3 <> 0",
    "person_sample_paths": f"WITH {_F}, d AS (SELECT DISTINCT label AS person_id, display_path FROM p JOIN f ON f.h = p.h WHERE vec_id % 3 = 0) SELECT person_id, display_path FROM d QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY display_path) <= 3",
    "quality_by_content": f"WITH {_F} SELECT h AS content_hash, round_even(sharpness + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END, 2) AS sharpness, round_even(rec, 3) AS recompression, basis FROM p WHERE basis IS NOT NULL",
    "quarantine_routes": f"{_RANKED} SELECT full_hash, display_path, CASE WHEN keeper_rank = 1 THEN 'keep' ELSE 'move' END AS route, CASE WHEN keeper_rank > 1 THEN 'quarantine/D/' || display_path[4:] END AS target FROM r",
    "similar_review": f"""WITH RECURSIVE {_GROUPS}, m AS (SELECT group_id, g.content_hash, bits, g.content_hash::BIGINT % 90 + 10 AS size, g.content_hash::BIGINT % 5 + 1 AS px, g.content_hash::BIGINT % 8 * 10 AS t FROM g JOIN b ON b.content_hash = g.content_hash),
ref AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY size DESC, content_hash DESC) = 1),
j AS (SELECT m.*, ref.content_hash AS rh, bit_count(xor(m.bits, ref.bits))::INT AS d, ref.size / m.size::DOUBLE AS ratio, ref.px AS rpx, abs(m.t - ref.t) AS dt FROM m JOIN ref USING (group_id)),
l AS (SELECT *, concat_ws('+', CASE WHEN d > 12 THEN 'beyond_threshold' END, CASE WHEN dt <= 10 THEN 'burst' END, CASE WHEN px < rpx THEN 'downscaled' WHEN ratio >= 1.6 THEN 'recompressed' END) AS labels FROM j)
SELECT group_id, content_hash, content_hash = rh AS is_reference, d AS distance, CASE WHEN labels = '' AND abs(ratio - 1) <= 0.05 THEN 'same_frame' ELSE labels END AS labels FROM l""",
    "wrong_cuts": f"{ss._S}, t AS (SELECT s.*, e.event_type AS ty FROM s JOIN events e ON e.event_id = s.event_id), q AS (SELECT rule, ty = lag(ty) OVER (PARTITION BY user_id ORDER BY taken_at, display_path) AS same FROM t) SELECT count(*) AS n_pairs, count(rule) AS n_wrong FROM q WHERE same",
    "mixed_events": f"{ss._S}, t AS (SELECT DISTINCT s.user_id, event_no, e.event_type AS ty FROM s JOIN events e ON e.event_id = s.event_id), ea AS (SELECT count(*) AS n FROM t GROUP BY user_id, event_no), fb AS (SELECT count(*) AS n FROM t GROUP BY user_id, ty) SELECT (SELECT count(*) FROM ea) AS n_events, (SELECT count(*) FROM ea WHERE n > 1) AS n_mixed, (SELECT count(*) FROM fb WHERE n > 1) AS folders_split",
    "gap_percentiles": f"{ss._S}, v AS (SELECT list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g FROM s) SELECT x.share::DOUBLE AS share, g[(floor(x.share * (len(g) - 1)) + 1)::INT] AS value FROM v, (VALUES (0.1), (0.5), (0.9), (0.99)) x(share)",
}
