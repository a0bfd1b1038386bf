"""Work lists and lookups over the index: what is still to be measured, and what is known about a content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.operators.index import fresh


def content_by_path(files: DataFrame) -> DataFrame:
    """display_path, content_hash of files whose full hash is fresh: the bridge from paths to contents."""
    return files.where(F.col("full_hash").isNotNull() & F.coalesce(fresh("hash"), F.lit(False))).select("display_path", F.col("full_hash").alias("content_hash"))


def needs_faces(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Images not hashed freshly, or whose content has no face scan. A scan that found nothing is a scan."""
    images = files.where("media_kind = 'image'").withColumn("__fresh", F.coalesce(fresh("hash"), F.lit(False)) & F.col("full_hash").isNotNull())
    stale = images.where("not __fresh")
    unscanned = images.where("__fresh").join(scans.select(F.col("content_hash").alias("full_hash")).distinct(), "full_hash", "left_anti").select(*stale.columns)
    return stale.unionByName(unscanned).drop("__fresh")


def needs_phash(files: DataFrame, phashes: DataFrame, algo: str, with_quality: bool = False) -> DataFrame:
    """Images without a fingerprint of this algorithm, or (on request) without its quality measures, or hashed stale."""
    images = files.where("media_kind = 'image'")
    known = phashes.where(F.col("algo") == algo).select(F.col("content_hash").alias("full_hash"), F.lit(True).alias("__known"), F.col("recompression_basis").isNotNull().alias("__measured"))
    rows = images.join(known, "full_hash", "left").select(*images.columns, "__known", "__measured")
    missing = F.col("__known").isNull() | ~F.coalesce(fresh("hash"), F.lit(False))
    return rows.where(missing | ~F.col("__measured") if with_quality else missing).drop("__known", "__measured")


def phash_rows(files: DataFrame, phashes: DataFrame, algo: str) -> DataFrame:
    """One row per content: content_hash, bits, n_paths, first_path, size. Null bits (flat pictures) stay null."""
    bits = phashes.where(F.col("algo") == algo).select("content_hash", "bits")
    paths = files.where(F.col("full_hash").isNotNull()).groupBy(F.col("full_hash").alias("content_hash")).agg(F.count("*").alias("n_paths"), F.min("display_path").alias("first_path"), F.min_by("size", "display_path").alias("size"))
    return paths.join(bits, "content_hash")


def phash_stats(files: DataFrame, phashes: DataFrame, algo: str) -> DataFrame:
    """n_images, n_with_phash, n_flat; counts files, not contents."""
    rows = files.where("media_kind = 'image'").join(phashes.where(F.col("algo") == algo).select(F.col("content_hash").alias("full_hash"), "bits", F.lit(True).alias("__k")), "full_hash", "left")
    known = F.col("__k").isNotNull()
    return rows.agg(F.count("*").alias("n_images"), F.count_if(known).alias("n_with_phash"), F.count_if(known & F.col("bits").isNull()).alias("n_flat"))


def unclustered_faces(faces: DataFrame, files: DataFrame, assigned: DataFrame) -> DataFrame:
    """Faces of contents in the scan that no person has."""
    here = faces.join(files.select(F.col("full_hash").alias("content_hash")).distinct(), "content_hash", "left_semi")
    return here.join(assigned.select("content_hash", "face_index").distinct(), ["content_hash", "face_index"], "left_anti")


def person_sample_paths(files: DataFrame, assigned: DataFrame, k: int = 3) -> DataFrame:
    """person_id, display_path: the first k paths of each person, kept small in each task by a bounded array."""
    paths = assigned.select("person_id", "content_hash").distinct().join(files.select(F.col("full_hash").alias("content_hash"), "display_path"), "content_hash").select("person_id", "display_path").distinct()
    w = Window.partitionBy("person_id").orderBy("display_path")
    return paths.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def persons_by_content(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("content_hash").agg(F.sort_array(F.collect_set("person_id")).alias("persons"))


def face_stats(scans: DataFrame, faces: DataFrame) -> DataFrame:
    """n_scanned, n_with_faces, n_faces, embedding_bytes."""
    a = scans.agg(F.count("*").alias("n_scanned"))
    b = faces.agg(F.countDistinct("content_hash").alias("n_with_faces"), F.count("*").alias("n_faces"), F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)).cast("long").alias("embedding_bytes"))
    return a.crossJoin(b)  # two scalars


def quality_by_content(previews: DataFrame, phashes: DataFrame) -> DataFrame:
    """content_hash, sharpness (2 digits), recompression (3), basis: a preview's measures, else a fingerprint's; never both mixed."""
    pick = lambda t, k: t.where("recompression_basis is not null").select("content_hash", F.struct(F.bround("sharpness", 2).alias("sharpness"), F.bround("recompression", 3).alias("recompression"), F.col("recompression_basis").alias("basis")).alias(k))
    rows = pick(previews, "__p").join(pick(phashes, "__h"), "content_hash", "full_outer").select("content_hash", F.coalesce("__p", "__h").alias("q"))
    return rows.select("content_hash", "q.*")


def earliest_time(members: DataFrame, moments: DataFrame) -> DataFrame:
    """content_hash, taken_at: the earliest capture time among a content's copies; null where none is known."""
    return members.join(moments.select("display_path", "taken_at"), "display_path", "left").groupBy("content_hash").agg(F.min("taken_at").alias("taken_at"))


def progress_measures(log: DataFrame) -> DataFrame:
    """Adds percent (by bytes, else by files), rate, eta_s and stalled to rows of a progress log.

    Needs bytes_done, bytes_total, files_done, files_total, elapsed_s and idle_s.
    """
    percent = F.when(F.col("bytes_total") > 0, F.col("bytes_done") / F.col("bytes_total")).when(F.col("files_total") > 0, F.col("files_done") / F.col("files_total"))
    rate = F.when(F.col("elapsed_s") > 0, F.col("bytes_done") / F.col("elapsed_s"))
    return log.withColumns(
        {
            "percent": F.least(F.lit(100.0), 100 * percent),
            "rate": rate,
            "eta_s": F.when(rate > 0, F.greatest(F.lit(0.0), (F.col("bytes_total") - F.col("bytes_done")) / rate)),
            "stalled": F.col("idle_s") > 30,
        }
    )
