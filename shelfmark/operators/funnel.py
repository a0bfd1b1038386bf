"""Staged exact-duplicate funnel: size, then a quick hash of head and tail, then a full hash.

A file row has at least path, size and content (or hashes already). Cheap predicates come first: contents are hashed
only for rows whose size, then whose quick hash, occurs more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 64 * 1024


def quick_hash(content: Column, size: Column) -> Column:
    """MD5 of the size, the first 64 KiB, and the last 64 KiB where there is more than the first."""
    head = F.substring(content, 1, SAMPLE_BYTES)
    tail = F.when(size > SAMPLE_BYTES, F.substring(content, -SAMPLE_BYTES, SAMPLE_BYTES)).otherwise(F.lit(b""))
    return F.md5(F.concat(F.encode(size.cast("string"), "UTF-8"), head, tail))


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs more than once. Counts are partial sums before the shuffle, so a hot key is no hot task;
    the rows themselves are only semi-joined, which AQE splits where a key is skewed."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys)
    return rows.join(many.hint("merge"), list(keys), "left_semi")


def needs_quick_hash(files: DataFrame) -> DataFrame:
    """Non-empty files that share their size with another."""
    return repeated(files.where("size > 0"), "size")


def needs_full_hash(files: DataFrame) -> DataFrame:
    """Of those with a quick hash, files that share size and quick hash with another."""
    return repeated(files.where("size > 0 and quick_hash is not null"), "size", "quick_hash")


def funnel(files: DataFrame, content: str = "content") -> DataFrame:
    """Rows of all stages that survive the funnel, with quick_hash and full_hash; content is dropped."""
    sized = needs_quick_hash(files)
    quick = needs_full_hash(sized.withColumn("quick_hash", quick_hash(F.col(content), F.col("size"))))
    return quick.withColumn("full_hash", full_hash(F.col(content))).drop(content)


def duplicate_groups(hashed: DataFrame, *, path: str = "display_path") -> DataFrame:
    """One row per full hash with two files or more: full_hash, size, n, wasted_bytes, first_path, and what kinds it has."""
    members = F.col("is_archive_member") if "is_archive_member" in hashed.columns else F.lit(False)
    media = F.col("media_kind").isin("image", "video") if "media_kind" in hashed.columns else F.lit(False)
    grouped = hashed.groupBy("full_hash").agg(
        F.max("size").alias("size"),
        F.count("*").alias("n"),
        F.min(path).alias("first_path"),
        F.bool_or(media).alias("is_media"),
        F.bool_and(members).alias("only_archive_members"),
        F.bool_or(members).alias("has_archive_members"),
    )
    return grouped.where("n > 1").withColumn("wasted_bytes", F.col("size") * (F.col("n") - 1))


def verify_groups(stored: DataFrame, fresh: DataFrame, key: str = "display_path") -> DataFrame:
    """Re-verification: full_hash, n_ok, n, ok. A copy is confirmed if its fresh hash is the stored one; two must be."""
    again = fresh.select(key, F.col("full_hash").alias("__fresh"))
    joined = stored.join(again, key, "left")
    same = F.coalesce(F.col("full_hash") == F.col("__fresh"), F.lit(False))
    return joined.groupBy("full_hash").agg(F.count_if(same).alias("n_ok"), F.count("*").alias("n")).withColumn("ok", F.col("n_ok") >= 2)


def disposition(groups: DataFrame, media_confirmed: Column | None = None) -> DataFrame:
    """What a plan may do with a group: report it, wait for a person, or keep one copy and move the others."""
    confirmed = F.lit(False) if media_confirmed is None else media_confirmed
    return groups.withColumn(
        "disposition",
        F.when(F.col("only_archive_members"), "report_only").when(F.col("is_media") & ~confirmed, "awaits_confirmation").otherwise("keep_one_move_rest"),
    )
