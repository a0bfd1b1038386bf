"""Queries on the index, journals, album names and library plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import albums as al
from shelfmark.operators import index as ix
from shelfmark.operators import journal as jn
from shelfmark.operators import library as lb
from shelfmark.plans.duplicates import SQL_FOLDERS, files
from shelfmark.plans.sessions import KEYS, moments
from shelfmark.operators import events as ev
from shelfmark.session import read_table

ROOT = "/mnt/library"


def _index(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        F.concat_ws("/", "source", k.cast("string")).alias("display_path"), F.octet_length("text").cast("long").alias("size"), F.octet_length("text").cast("long").alias("source_size"), (k % 5).cast("double").alias("source_mtime"),
        F.md5("text").alias("quick_hash"), F.when(k % 3 != 0, F.sha2("text", 256)).alias("full_hash"), F.octet_length("text").cast("long").alias("hashed_source_size"), (k % 5).cast("double").alias("hashed_source_mtime"),
        F.lit("s1").alias("last_scan_id"), F.lit(1.0).alias("seen_at"), (k % 4 == 0).alias("is_archive_member"), F.when(k % 2 == 0, "image").otherwise("other").alias("media_kind"),
    )


def _scanned(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("doc_id % 10 <> 9")
    k = F.col("doc_id")
    return d.select(F.concat_ws("/", "source", k.cast("string")).alias("display_path"), F.octet_length("text").cast("long").alias("size"), F.octet_length("text").cast("long").alias("source_size"), F.when(k % 7 == 0, 9.0).otherwise((k % 5).cast("double")).alias("source_mtime"))


def index_upsert(spark, sf_dir):
    rows = ix.upsert_files(_index(spark, sf_dir), _scanned(spark, sf_dir), "s2", 2.0)
    return rows.select("display_path", "source_mtime", "full_hash", "last_scan_id")


def index_needs(spark, sf_dir):
    rows = ix.upsert_files(_index(spark, sf_dir), _scanned(spark, sf_dir), "s2", 2.0)
    return ix.needs(rows, "full_hash", "hash").select("display_path")


def index_stats(spark, sf_dir):
    return ix.scan_stats(_index(spark, sf_dir))


def index_prune(spark, sf_dir):
    return ix.prune_missing(_index(spark, sf_dir), _scanned(spark, sf_dir), "display_path").select("display_path")


def decisions_upsert(spark, sf_dir):
    l = read_table(spark, sf_dir, "labels")  # noqa: E741
    table = l.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("content_hash"), F.lit("keep").alias("action"), F.lit(1.0).alias("applied_at"), F.when(F.col("quality") == 1, "print").alias("album_state"), F.lit(1.0).alias("album_applied_at"))
    changes = l.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("content_hash"), F.when(F.col("toxic") == 1, "quarantine").otherwise("keep").alias("action"))
    return ix.record_decisions(table, changes)


def lru_evict(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    previews = o.select(F.col("o_orderkey").cast("string").alias("content_hash"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("accessed_at"), (F.col("o_orderkey") % 1000 + 1).alias("bytes"))
    return ix.lru_evict(previews, 4_000_000)


def latest_moves(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    moves = o.select(F.col("o_custkey").cast("string").alias("destination"), F.col("o_orderkey").alias("op_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("moved_at"), F.when(F.col("o_orderstatus") == "F", 1.0).alias("rolled_back_at"), (F.col("o_orderkey") % 100).cast("string").alias("content_hash"))
    sizes = read_table(spark, sf_dir, "part").select((F.col("p_partkey") % 90).cast("string").alias("full_hash"), F.col("p_partkey").alias("size"))
    return ix.library_contents(moves, sizes).select("destination", "op_id", "content_hash", "size")


def album_states(spark, sf_dir):
    l = read_table(spark, sf_dir, "labels")  # noqa: E741
    photos = read_table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("content_hash"))
    states = l.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, "drop").when(F.col("quality") == 1, "print").otherwise("keep")).alias("album_state"))
    return ix.album_states(photos, states.withColumn("content_hash", F.col("doc_id").cast("string")))


def moment_coverage(spark, sf_dir):
    return ix.coverage(moments(spark, sf_dir).withColumn("time_source", F.when(F.col("time_source") != "mtime", F.col("time_source"))), "time_source")


def _journal(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, ("move_pending", "move_done", "move_failed", "restored", "restore_failed", "move_pending")))
    op = (F.col("event_id") % 3000).alias("op_id")
    return e.select(
        op, F.element_at(kinds, (F.floor(F.col("event_id") / 7) % 6).cast("int") + 1).alias("event"), F.col("event_id").alias("ts"),
        F.concat(F.lit("D:/a/"), op.cast("string")).alias("original"), F.concat(F.lit("D:/q/"), op.cast("string")).alias("quarantined"), (op % 500).alias("size"),
    )


def journal_status(spark, sf_dir):
    return jn.operations(_journal(spark, sf_dir)).select("op_id", "status", "first_at", "last_at", "size")


def journal_summary(spark, sf_dir):
    return jn.summary(_journal(spark, sf_dir))


def restore_decisions(spark, sf_dir):
    ops = jn.operations(_journal(spark, sf_dir))
    existing = ops.where("op_id % 3 <> 0").select(F.col("quarantined").alias("path")).unionAll(ops.where("op_id % 4 = 0").select(F.col("original").alias("path")))
    return jn.restore_decisions(ops, existing).groupBy("decision").agg(F.count("*").alias("n"))


def album_names(spark, sf_dir):
    rows = ev.sessions(moments(spark, sf_dir), KEYS).withColumns({"content_hash": F.lit(None).cast("string"), "place": F.when(F.col("lat").isNotNull(), F.col("event_type")), "person": F.lit(None).cast("string"), "folder": F.col("time_source")})
    named = al.suggest_names(rows, ["user_id", "event_no"])
    return named.select("user_id", "event_no", "anchor", "name", F.size("candidates").alias("n_candidates"))


def _plan(spark, sf_dir):
    rows = files(spark, sf_dir).withColumns({"full_hash": F.sha2("content", 256), "folder": F.concat(F.lit("2020/"), F.col("source"))}).drop("content")
    existing = read_table(spark, sf_dir, "documents").where("doc_id % 50 = 1").select(F.concat(F.lit(f"{ROOT}/2020/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("path"))
    return lb.plan_library(rows, lb.LibraryLayout(ROOT), existing)


def plan_moves(spark, sf_dir):
    return _plan(spark, sf_dir)[0]


def plan_redundant(spark, sf_dir):
    return _plan(spark, sf_dir)[1].groupBy("content_key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def plan_fingerprint(spark, sf_dir):
    return lb.plan_fingerprint(_plan(spark, sf_dir)[0])


def plan_summary(spark, sf_dir):
    return lb.plan_summary(_plan(spark, sf_dir)[0])


_IX = """i AS (SELECT *, source || '/' || doc_id AS display_path, octet_length(encode(text))::BIGINT AS sz, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS full_hash FROM documents),
u AS (SELECT display_path, CASE WHEN doc_id % 10 <> 9 AND doc_id % 7 = 0 THEN 9.0::DOUBLE ELSE (doc_id % 5)::DOUBLE END AS source_mtime, CASE WHEN doc_id % 10 <> 9 AND doc_id % 7 = 0 THEN NULL ELSE full_hash END AS full_hash,
  CASE WHEN doc_id % 10 <> 9 THEN 's2' ELSE 's1' END AS last_scan_id, doc_id FROM i)"""
_J = """j AS (SELECT event_id % 3000 AS op_id, (['move_pending', 'move_done', 'move_failed', 'restored', 'restore_failed', 'move_pending'])[(event_id // 7 % 6 + 1)::INT] AS event, event_id AS ts FROM events),
s AS (SELECT op_id, list(DISTINCT event) AS seen, min(ts) AS first_at, max(ts) AS last_at, op_id % 500 AS size FROM j GROUP BY op_id),
o AS (SELECT op_id, CASE WHEN list_contains(seen, 'restored') THEN 'restored' WHEN list_contains(seen, 'move_failed') THEN 'failed' WHEN list_contains(seen, 'move_done') THEN 'moved' ELSE 'pending' END AS status, first_at, last_at, size FROM s WHERE list_contains(seen, 'move_pending'))"""
_P = f"""f AS (SELECT 'D:/' || source || '/' || {SQL_FOLDERS} || '/' || doc_id || '.jpg' AS source_path, source, doc_id, sha256(text) AS content_key, octet_length(encode(text))::BIGINT AS size, (doc_id % 7)::DOUBLE AS mtime,
  CASE WHEN doc_id % 5 IN (0, 3, 4) THEN 1 ELSE 0 END AS k1, CASE WHEN doc_id % 5 = 1 THEN -2 ELSE -1 END AS k2 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY k1, k2, length(source_path), mtime, source_path) AS rn FROM f),
m AS (SELECT content_key, source_path AS source, '{ROOT}/2020/' || source || '/' || doc_id || CASE WHEN doc_id % 50 = 1 THEN '__1' ELSE '' END || '.jpg' AS destination, size, 'copy' AS transfer FROM r WHERE rn = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        index_upsert, index_needs, index_stats, index_prune, decisions_upsert, lru_evict, latest_moves, album_states, moment_coverage, journal_status, journal_summary,
        restore_decisions, album_names, plan_moves, plan_redundant, plan_fingerprint, plan_summary,
    )
}
ORACLE_SQL = {
    "index_upsert": f"WITH {_IX} SELECT display_path, source_mtime, full_hash, last_scan_id FROM u",
    "index_needs": f"WITH {_IX} SELECT display_path FROM u WHERE full_hash IS NULL",
    "index_stats": f"WITH {_IX} SELECT count(*) AS n_files, sum(sz)::BIGINT AS total_bytes, count(full_hash) AS n_hashed, count(*) FILTER (doc_id % 4 = 0) AS n_members, count(*) FILTER (doc_id % 2 = 0) AS n_media FROM i",
    "index_prune": f"WITH {_IX} SELECT display_path FROM i WHERE doc_id % 10 <> 9",
    "decisions_upsert": """WITH t AS (SELECT doc_id, 'keep' AS action, 1.0::DOUBLE AS applied_at, CASE WHEN quality = 1 THEN 'print' END AS album_state, 1.0::DOUBLE AS album_applied_at FROM labels WHERE doc_id % 2 = 0),
c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'quarantine' ELSE 'keep' END AS action FROM labels WHERE doc_id % 3 = 0)
SELECT coalesce(t.doc_id, c.doc_id)::VARCHAR AS content_hash, coalesce(c.action, t.action) AS action, CASE WHEN c.doc_id IS NULL THEN t.applied_at END AS applied_at, album_state, album_applied_at FROM t FULL JOIN c ON t.doc_id = c.doc_id""",
    "lru_evict": """WITH p AS (SELECT o_orderkey::VARCHAR AS content_hash, epoch(o_orderdate) AS seen, o_orderkey % 1000 + 1 AS bytes FROM orders), r AS (SELECT *, sum(bytes) OVER (ORDER BY seen, content_hash ROWS UNBOUNDED PRECEDING) - bytes AS upto, sum(bytes) OVER () AS total FROM p)
SELECT content_hash FROM r WHERE total > 4000000 AND upto < total - 3600000""",
    "latest_moves": "WITH s AS (SELECT (p_partkey % 90)::VARCHAR AS h, min(p_partkey) AS size FROM part GROUP BY 1) SELECT o_custkey::VARCHAR AS destination, o_orderkey AS op_id, (o_orderkey % 100)::VARCHAR AS content_hash, size FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'F') LEFT JOIN s ON h = (o_orderkey % 100)::VARCHAR WHERE rn = 1",
    "album_states": "WITH l AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'print' ELSE 'keep' END) AS s FROM labels GROUP BY 1) SELECT source AS folder, count(*) FILTER (s = 'keep') AS keep, count(*) FILTER (s = 'print') AS print, count(*) FILTER (s = 'drop') AS drop, count(*) FILTER (s IS NULL) AS none FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1",
    "moment_coverage": "SELECT (['exif', 'sidecar', 'filename', 'unknown'])[(event_id % 4 + 1)::INT] AS time_source, count(*) AS n FROM events GROUP BY 1",
    "journal_status": f"WITH {_J} SELECT op_id, status, first_at, last_at, size FROM o",
    "journal_summary": f"WITH {_J} SELECT status, count(*) AS n, sum(size)::BIGINT AS bytes FROM o GROUP BY 1",
    "restore_decisions": f"WITH {_J} SELECT CASE WHEN status = 'restored' THEN 'nothing_to_do' WHEN op_id % 3 = 0 AND op_id % 4 = 0 THEN 'skip_never_completed' WHEN op_id % 3 = 0 THEN 'manual_both_missing' WHEN op_id % 4 = 0 THEN 'skip_original_occupied' ELSE 'restore' END AS decision, count(*) AS n FROM o GROUP BY 1",
    "plan_moves": f"WITH {_P} SELECT * FROM m",
    "plan_redundant": f"WITH {_P} SELECT content_key, count(*) AS n, sum(size)::BIGINT AS bytes FROM r WHERE rn > 1 GROUP BY 1",
    "plan_fingerprint": f"WITH {_P} SELECT left(sha256(string_agg(source || chr(0) || destination || chr(10), '' ORDER BY source || chr(0) || destination)), 16) AS fingerprint FROM m",
    "plan_summary": f"WITH {_P} SELECT transfer, count(*) AS n, sum(size)::BIGINT AS bytes FROM m GROUP BY 1",
}
