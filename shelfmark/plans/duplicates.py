"""Queries on exact duplicates and keepers; documents stand for files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import funnel as fn
from shelfmark.operators import keeper as kp
from shelfmark.session import read_table

FOLDERS = "element_at(array('Photos', 'Summer at the lake', '2019-07 July', 'New folder (2)', 'Camera Roll'), cast(doc_id % 5 as int) + 1)"
SQL_FOLDERS = "(['Photos', 'Summer at the lake', '2019-07 July', 'New folder (2)', 'Camera Roll'])[(doc_id % 5 + 1)::INT]"
KIND_SQL = "CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 0 END"


def files(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat(F.lit("D:/"), F.col("source"), F.lit("/"), F.expr(FOLDERS), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    content = F.encode("text", "UTF-8")
    return docs.select(
        path.alias("display_path"), path.alias("real_path"), F.octet_length("text").cast("long").alias("size"), content.alias("content"),
        F.lit(False).alias("is_archive_member"), F.lit(None).cast("string").alias("member_name"), (F.col("doc_id") % 7).cast("double").alias("mtime"), F.lit("image").alias("media_kind"), "source",
    )


_FILES = f"""f AS (SELECT 'D:/' || source || '/' || {SQL_FOLDERS} || '/' || doc_id || '.jpg' AS display_path,
  octet_length(encode(text))::BIGINT AS size, text, source, (doc_id % 7)::DOUBLE AS mtime, doc_id, {KIND_SQL} AS kind FROM documents)"""
_QUICK = """q AS (SELECT *, md5(CASE WHEN size <= 65536 THEN encode(size::VARCHAR || text) END) AS quick_hash FROM f)"""


def dup_same_size(spark, sf_dir):
    return fn.needs_quick_hash(files(spark, sf_dir)).select("display_path", "size")


def dup_groups(spark, sf_dir):
    return fn.duplicate_groups(fn.funnel(files(spark, sf_dir)))


def dup_disposition(spark, sf_dir):
    return fn.disposition(dup_groups(spark, sf_dir)).groupBy("disposition").agg(F.count("*").alias("n_groups"), F.sum("wasted_bytes").alias("wasted_bytes"))


def dup_totals(spark, sf_dir):
    hashed = fn.funnel(files(spark, sf_dir))
    groups = fn.duplicate_groups(hashed)
    return groups.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_files"), F.sum("wasted_bytes").alias("wasted_bytes"), F.max("n").alias("largest"))


def dup_verify(spark, sf_dir):
    hashed = fn.funnel(files(spark, sf_dir))
    groups = fn.duplicate_groups(hashed).select("full_hash")
    stored = hashed.join(groups, "full_hash", "left_semi").select("full_hash", "display_path")
    fresh = files(spark, sf_dir).select("display_path", fn.full_hash(F.col("content")).alias("full_hash"))
    return fn.verify_groups(stored, fresh)


def _group_rows(spark, sf_dir):
    hashed = fn.funnel(files(spark, sf_dir))
    return fn.repeated(hashed, "full_hash")


def keeper_paths(spark, sf_dir):
    return kp.keepers(_group_rows(spark, sf_dir))


def keeper_rank(spark, sf_dir):
    return kp.rank_keepers(_group_rows(spark, sf_dir)).select("full_hash", "display_path", "keeper_rank", "keeper_reason")


_G = f"WITH {_FILES}, g AS (SELECT *, sha256(text) AS full_hash, count(*) OVER (PARTITION BY text) AS n FROM f WHERE size > 0)"
# Sources are named src0, ...: one named segment each, so a path's named count is one or two.
_KEY = "-2, CASE WHEN kind = 0 THEN 1 ELSE 0 END, CASE WHEN kind = 2 THEN -2 ELSE -1 END, length(display_path), mtime, display_path"
_RANKED = f"""{_G}, k AS (SELECT *, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS k1, CASE WHEN kind = 2 THEN -2 ELSE -1 END AS k2, length(display_path) AS k3 FROM g WHERE n > 1),
r AS (SELECT *, row_number() OVER w AS keeper_rank, lead(k1) OVER w AS n1, lead(k2) OVER w AS n2, lead(k3) OVER w AS n3, lead(mtime) OVER w AS n4, lead(display_path) OVER w AS n5
  FROM k WINDOW w AS (PARTITION BY full_hash ORDER BY k1, k2, k3, mtime, display_path))"""

QUERIES = {
    "dup_same_size": dup_same_size,
    "duplicate_groups": dup_groups,
    "dup_disposition": dup_disposition,
    "dup_totals": dup_totals,
    "dup_verify": dup_verify,
    "keeper_paths": keeper_paths,
    "keeper_rank": keeper_rank,
}
ORACLE_SQL = {
    "dup_same_size": f"WITH {_FILES} SELECT display_path, size FROM f WHERE size > 0 AND size IN (SELECT size FROM f GROUP BY size HAVING count(*) > 1)",
    "duplicate_groups": f"{_G} SELECT full_hash, max(size) AS size, count(*) AS n, min(display_path) AS first_path, true AS is_media, false AS only_archive_members, false AS has_archive_members, (max(size) * (count(*) - 1))::BIGINT AS wasted_bytes FROM g WHERE n > 1 GROUP BY full_hash",
    "dup_disposition": f"{_G} SELECT 'awaits_confirmation' AS disposition, count(*) AS n_groups, sum(w)::BIGINT AS wasted_bytes FROM (SELECT full_hash, max(size) * (count(*) - 1) AS w FROM g WHERE n > 1 GROUP BY full_hash) HAVING count(*) > 0",
    "dup_totals": f"{_G} SELECT count(*) AS n_groups, sum(m)::BIGINT AS n_files, sum(w)::BIGINT AS wasted_bytes, max(m) AS largest FROM (SELECT full_hash, count(*) AS m, max(size) * (count(*) - 1) AS w FROM g WHERE n > 1 GROUP BY full_hash)",
    "dup_verify": f"{_G} SELECT full_hash, count(*) AS n_ok, count(*) AS n, true AS ok FROM g WHERE n > 1 GROUP BY full_hash",
    "keeper_paths": f"{_RANKED} SELECT full_hash, display_path AS keeper_path, n FROM r WHERE keeper_rank = 1",
    "keeper_rank": f"""{_RANKED} SELECT full_hash, display_path, keeper_rank::INT AS keeper_rank, CASE WHEN keeper_rank > 1 OR n5 IS NULL THEN NULL WHEN k1 <> n1 THEN 'fewer_generic_folders' WHEN k2 <> n2 THEN 'more_named_folders'
  WHEN k3 <> n3 THEN 'shorter_path' WHEN mtime <> n4 THEN 'older' ELSE 'path_order' END AS keeper_reason FROM r""",
}
