"""Lookups, attachments and summaries over the index, its archives, persons and albums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.measures import aspect_log_ratio
from shelfmark.operators.origin import EXCLUDED_FROM_ALBUMS
from shelfmark.operators.similar import SimilarThresholds, hamming_pairs

#: A face is prominent from this share of the long side that it was detected at.
PROMINENT_SHARE = 0.08
REVIEW_STATES = ("keep", "print", "drop")


def found_rows(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose key is wanted; repeated wanted keys count once."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def existence(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, present: is there a row for each wanted key? A null key has none."""
    there = table.select(key).distinct().withColumn("present", F.lit(True))
    return wanted.select(key).distinct().join(there, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def album_media(files: DataFrame, exclude: tuple[str, ...] = EXCLUDED_FROM_ALBUMS) -> DataFrame:
    """Photos and videos that are no archive members and whose origin is not excluded; an unknown origin stays."""
    media = files.where(F.col("media_kind").isin("image", "video") & ~F.coalesce("is_archive_member", F.lit(False)))
    return media.where(F.col("origin_class").isNull() | ~F.col("origin_class").isin(*exclude))


def face_counts(contents: DataFrame, scans: DataFrame, faces: DataFrame) -> DataFrame:
    """content_hash, scanned, n_faces: null faces where no scan looked, zero where one found none."""
    counts = faces.groupBy("content_hash").agg(F.countDistinct("face_index").alias("n"))
    looked = scans.select("content_hash").distinct().withColumn("scanned", F.lit(True))
    rows = contents.select("content_hash").distinct().join(looked, "content_hash", "left").join(counts, "content_hash", "left")
    scanned = F.coalesce("scanned", F.lit(False))
    return rows.select("content_hash", scanned.alias("scanned"), F.when(scanned, F.coalesce("n", F.lit(0))).alias("n_faces"))


def scan_faces(faces: DataFrame, files: DataFrame) -> DataFrame:
    """The faces of contents that the files have, once each however many copies there are."""
    return faces.join(files.select(F.col("full_hash").alias("content_hash")).where("content_hash is not null").distinct(), "content_hash", "left_semi").dropDuplicates(["content_hash", "face_index"])


def person_embeddings(faces: DataFrame, assigned: DataFrame) -> DataFrame:
    """person_id, content_hash, face_index, embedding of every face that backs a person."""
    return assigned.select("person_id", "content_hash", "face_index").distinct().join(faces.select("content_hash", "face_index", "embedding"), ["content_hash", "face_index"])


def label_persons(persons: DataFrame, labels: DataFrame, now: float) -> DataFrame:
    """persons with the labels of ``labels`` (person_id, label; null takes a label back); unknown persons are created.

    Labelled rows get updated_at, new ones created_at as well; all others stay as they are.
    """
    told = labels.groupBy("person_id").agg(F.first("label").alias("__label")).withColumn("__told", F.lit(True))
    rows = persons.join(told, "person_id", "full")
    touched = F.col("__told").isNotNull()
    return rows.select(
        "person_id",
        F.when(touched, F.col("__label")).otherwise(F.col("label")).alias("label"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(touched, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def prominent_faces(faces: DataFrame, scans: DataFrame) -> DataFrame:
    """content_hash, n_faces, n_prominent: faces whose long side is PROMINENT_SHARE of the side they were detected at."""
    sides = scans.groupBy("content_hash").agg(F.max("detect_long_side").alias("__side"))
    rows = faces.join(sides, "content_hash")
    large = (F.col("__side") > 0) & (F.greatest("width", "height") >= F.col("__side") * PROMINENT_SHARE)
    return rows.groupBy("content_hash").agg(F.count("*").alias("n_faces"), F.count_if(large).alias("n_prominent"))


def pending_drops(states: DataFrame, library: DataFrame, folder: str | None = None) -> DataFrame:
    """destination, content_hash, size of what lies in the library (in one album), is to be dropped and was not moved yet."""
    queued = states.where("album_state = 'drop' and album_applied_at is null").select("content_hash").distinct()
    here = library if folder is None else library.where(F.regexp_replace("destination", "/[^/]*$", "") == folder)
    return here.join(queued, "content_hash", "left_semi").select("destination", "content_hash", "size")


def skipped_archives(skipped: DataFrame, verdicts: DataFrame) -> DataFrame:
    """path, size, reason: the archives that did not open, and those whose members could not be read, each path once."""
    unread = verdicts.where("verdict = 'unread'").join(skipped.select("path"), "path", "left_anti")
    return skipped.select("path", "size", "reason").unionByName(unread.select("path", "size", F.lit("unreadable_members").alias("reason")))


def bytes_by(rows: DataFrame, column: str, size: str = "size") -> DataFrame:
    """column, n, bytes."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def archive_listing(verdicts: DataFrame) -> DataFrame:
    """verdict, n, members, redundant, bytes, freed_bytes: what deleting the fully redundant archives would free."""
    return verdicts.groupBy("verdict").agg(
        F.count("*").alias("n"), F.sum("members").alias("members"), F.sum("redundant").alias("redundant"), F.sum("size").alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("verdict") == "fully_redundant", F.col("size"))), F.lit(0)).alias("freed_bytes"),
    )


def archives_with_media(members: DataFrame) -> DataFrame:
    """archive_path, has_media: is any member a photo or a video?"""
    return members.groupBy("archive_path").agg(F.bool_or(F.coalesce(F.col("media_kind").isin("image", "video"), F.lit(False))).alias("has_media"))


def groups_with_metrics(groups: DataFrame, quality: DataFrame) -> DataFrame:
    """n_groups, n_measured: photo groups, and those whose content has quality measures."""
    known = quality.where("sharpness is not null").select(F.col("content_hash").alias("full_hash")).distinct().withColumn("__known", F.lit(True))
    return groups.where("media_kind = 'image'").join(known, "full_hash", "left").agg(F.count("*").alias("n_groups"), F.count("__known").alias("n_measured"))


def similar_summary(entries: DataFrame, members: DataFrame, t: SimilarThresholds = SimilarThresholds()) -> DataFrame:
    """groups, contents_in_groups, largest_group, entries_considered, entries_without_hash, pairs_joined, pairs_rejected_by_aspect.

    Rejected pairs are within the distance and refused by the aspect alone, each counted once.
    """
    near = hamming_pairs(entries, SimilarThresholds(t.distance, float("inf")))
    aspects = entries.select("content_hash", "aspect")
    told = near.join(aspects.withColumnsRenamed({"content_hash": "a", "aspect": "aa"}), "a").join(aspects.withColumnsRenamed({"content_hash": "b", "aspect": "ba"}), "b")
    close = aspect_log_ratio(F.col("aa"), F.col("ba")) <= t.aspect
    pairs = told.agg(F.count_if(close).alias("pairs_joined"), F.count_if(~close).alias("pairs_rejected_by_aspect"))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    groups = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("contents_in_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"))
    counts = entries.agg(F.count("bits").alias("entries_considered"), F.count_if(F.col("bits").isNull()).alias("entries_without_hash"))
    return groups.crossJoin(counts).crossJoin(pairs)  # three rows of totals


def photos_by_folder(moments: DataFrame, folder: Column) -> DataFrame:
    """folder, n of photos under each folder that was named by hand; photos under none are left out."""
    return moments.select(folder.alias("folder")).where("folder is not null").groupBy("folder").agg(F.count("*").alias("n"))


def queue_summary(cards: DataFrame) -> DataFrame:
    """folder, photos, queue, unfit, reviewed, drop_pending, measured, and the photos of each state and tier.

    Needs folder, tier, state, applied_at, measured; tier 9 is unfit.
    """
    state = F.coalesce("state", F.lit("none"))
    return cards.groupBy("folder").agg(
        F.count("*").alias("photos"), F.count_if(F.col("tier") != 9).alias("queue"), F.count_if(F.col("tier") == 9).alias("unfit"), F.count("state").alias("reviewed"),
        F.count_if((state == "drop") & F.col("applied_at").isNull()).alias("drop_pending"), F.count_if("measured").alias("measured"),
        *[F.count_if(state == s).alias(f"state_{s}") for s in (*REVIEW_STATES, "none")], *[F.count_if(F.col("tier") == k).alias(f"tier_{k}") for k in (0, 1, 2, 3)],
    )


def outcome_bytes(outcomes: DataFrame) -> DataFrame:
    """moved, moved_bytes, freed_bytes of an executed plan: a move over a volume's border frees the source, others move a name."""
    done = F.col("outcome") == "done"
    return outcomes.agg(
        F.count_if(done).alias("moved"), F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("moved_bytes"),
        F.coalesce(F.sum(F.when(done & (F.col("transfer") == "copy"), F.col("size"))), F.lit(0)).alias("freed_bytes"),
    )


def sidecar_of(photos: DataFrame, sidecars: DataFrame) -> DataFrame:
    """display_path, sidecar_path: the first of a photo's three candidate names that was read; null where none was.

    ``sidecars``: path of those that parsed. Candidates: name.ext.json, name.ext.supplemental-metadata.json, name.json.
    """
    path = F.col("display_path")
    names = F.array(F.concat(path, F.lit(".json")), F.concat(path, F.lit(".supplemental-metadata.json")), F.concat(F.regexp_replace(path, r"(?<=[^/\\])\.[^./\\]*$", ""), F.lit(".json")))
    wanted = photos.select("display_path").distinct().select("display_path", F.posexplode(names).alias("rank", "path"))
    met = wanted.join(sidecars.select("path").distinct(), "path").groupBy("display_path").agg(F.min_by("path", "rank").alias("sidecar_path"))
    return photos.select("display_path").join(met, "display_path", "left")


def plan_rows(moves: DataFrame, transfer: str | None = None, under: str | None = None) -> DataFrame:
    """A plan's moves of one kind of transfer, or under one destination folder."""
    rows = moves if transfer is None else moves.where(F.col("transfer") == transfer)
    return rows if under is None else rows.where(F.col("destination").startswith(under.rstrip("/") + "/"))


def as_json(rows: DataFrame, *order: str) -> DataFrame:
    """json: a row as one object with its fields in the order of the columns; nulls are written."""
    return rows.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def shown_bytes(n: Column) -> Column:
    """A size with one decimal (halves to the even digit) in B, KB, MB, GB, TB or PB of 1 024."""
    out, value = None, n.cast("double")
    for unit in ("B", "KB", "MB", "GB", "TB"):
        text = F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(f" {unit}"))
        out = F.when(F.abs(value) < 1024, text) if out is None else out.when(F.abs(value) < 1024, text)
        value = value / 1024
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(" PB")))


def shown_duration(seconds: Column) -> Column:
    """Whole seconds, minutes and seconds, or hours and minutes; a dash where unknown."""
    s = seconds.cast("long")
    return (
        F.when(seconds.isNull(), "-")
        .when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(" h "), F.floor(s % 3600 / 60).cast("string"), F.lit(" min")))
    )
