"""A reviewable library plan: where each content goes, which copies are redundant, and what needs a person."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import basename_of, join_path, sanitize_component, season_of, volume_of
from shelfmark.operators.keeper import rank_keepers

MONTHS = ("Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь")  # fixed values
MAX_PATH = 260


@dataclass(frozen=True)
class LibraryLayout:
    root: str
    by: str = "event"  # or "year"
    min_photos: int = 20
    season: bool = False


def album_folders(events: DataFrame, layout: LibraryLayout) -> DataFrame:
    """Adds folder to events: event_id, start_at (wall seconds), size, subject (null without a name), confirmed.

    Event layout: small events without a confirmed name go to their month (or season); events without a subject go to
    their day; others to their date and subject, and of several events that claim one name the later ones get a number
    and needs_human. Year layout: year and subject.
    """
    t = F.timestamp_seconds("start_at")
    year, month = F.date_format(t, "yyyy"), F.month(t)
    month_name = F.element_at(F.array(*map(F.lit, MONTHS)), month)
    small_label = F.concat_ws(" ", year, season_of(month)) if layout.season else F.concat_ws(" ", F.date_format(t, "yyyy-MM"), month_name)
    small = (F.col("size") < layout.min_photos) & ~F.coalesce("confirmed", F.lit(False))
    subject = sanitize_component(F.col("subject"))
    if layout.by == "year":
        name = F.when(F.col("subject").isNull() | small, small_label).otherwise(F.concat_ws(" ", year, subject))
        rows = events.withColumns({"folder": F.concat_ws("/", year, name), "needs_human": F.lit(False)})
    else:
        day = F.date_format(t, "yyyy-MM-dd")
        rows = events.withColumn("__base", F.concat_ws("/", year, F.when(small, small_label).when(F.col("subject").isNull(), day).otherwise(F.concat_ws(" ", day, subject))))
        claims = rows.where(~small & F.col("subject").isNotNull()).groupBy("__base").agg(F.sort_array(F.collect_list(F.struct("start_at", "event_id"))).alias("__c"))
        # One folder's claimants are the events of one day with one name: a handful.
        order = claims.select("__base", F.posexplode("__c").alias("__pos", "__e")).select("__base", "__pos", F.col("__e.event_id").alias("event_id"))
        rows = rows.join(order, ["__base", "event_id"], "left")
        again = F.coalesce(F.col("__pos") > 0, F.lit(False))
        rows = rows.withColumns({"folder": F.when(again, F.concat("__base", F.lit(" ("), F.col("__pos") + 1, F.lit(")"))).otherwise(F.col("__base")), "needs_human": again})
        rows = rows.drop("__base", "__pos")
    return rows


def special_folder(origin: Column, taken_at: Column) -> Column:
    """Folder of what is filed outside events: captures, documents, and what has no date."""
    year = F.coalesce(F.date_format(F.timestamp_seconds(taken_at), "yyyy"), F.lit("_undated"))
    return (
        F.when(origin.isin("screenshot_phone", "screenshot_desktop"), F.concat(F.lit("_screenshots/"), year))
        .when(origin == "document_scan", "_documents")
        .when(taken_at.isNull(), "_unsorted")
    )


def name_family(name: Column) -> Column:
    """What all names that can come of one another share: lower case, without the numbers that a claim appends to a stem."""
    low = F.lower(name)
    stem = F.coalesce(F.nullif(F.regexp_extract(low, r"(?s)^(.+)\.[^.]*$", 1), F.lit("")), low)
    return F.concat(F.regexp_replace(stem, r"(__[0-9]+)+$", ""), F.substring(low, F.length(stem) + 1, F.length(low)))


def claim_names(movers: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds final_name: in each folder, by (basename, path), names are claimed without regard to case.

    A taken name gets ``stem__n.ext``. Claims are sequential, but a claim meets names of its own family only, so a group is
    a family of a folder, and a family of one file with nothing there needs no group. A file already in place keeps its name.
    """
    key = ["folder", "__family"]
    rows = movers.withColumn("__family", name_family(F.col("basename")))
    taken = existing.withColumn("__family", name_family(F.col("name"))).groupBy(*key).agg(F.collect_set(F.lower("name")).alias("__taken"))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    rows = rows.join(sizes.join(taken, key, "left"), key, "left")
    contested = F.coalesce((F.col("__n") > 1) | F.col("__taken").isNotNull(), F.lit(True))

    def claim(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["basename", "source"], kind="stable")
        used = set(part["__taken"].iloc[0]) if part["__taken"].iloc[0] is not None else set()
        used |= {n.lower() for n in part.loc[part["in_place"], "basename"]}
        tried: dict[str, int] = {}  # names are only ever taken, so a stem's search goes on where it ended
        out = []
        for name, here in zip(part["basename"], part["in_place"], strict=True):
            final = name
            if not here:
                stem, dot, ext = name.rpartition(".")
                stem, tail = (stem, dot + ext) if stem else (name, "")
                k = tried.get(name.lower(), 0)
                while (final.lower() if k == 0 else f"{stem}__{k}{tail}".lower()) in used:
                    k += 1
                tried[name.lower()] = k
                final = f"{stem}__{k}{tail}" if k else name
            used.add(final.lower())
            out.append(final)
        return part.assign(final_name=out).drop(columns=["__taken", "__n", "__family"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in movers.dtypes)
    claimed = rows.where(contested).groupBy(*key).applyInPandas(claim, f"{kinds}, final_name string")
    return rows.where(~contested).withColumn("final_name", F.col("basename")).select(*claimed.columns).unionByName(claimed)


def plan_library(files: DataFrame, layout: LibraryLayout, existing: DataFrame, busy: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(moves, redundant, problems).

    files: display_path, real_path, member_name, is_archive_member, mtime, size, full_hash, folder (its home). One file
    per content moves, the one that the keeper order puts first; others are redundant. ``existing``: path.
    """
    keyed = files.withColumn("content_key", F.coalesce("full_hash", "display_path"))
    ranked = rank_keepers(keyed, "content_key")
    movers = ranked.where("keeper_rank = 1").select("content_key", F.col("display_path").alias("source"), "size", "folder", basename_of(F.col("display_path")).alias("basename"))
    movers = movers.withColumn("in_place", F.col("source") == join_path(F.lit(layout.root), F.col("folder"), F.col("basename")))
    there = existing.select(F.regexp_replace("path", r"[/\\][^/\\]*$", "").alias("__dir"), basename_of(F.col("path")).alias("name"))
    there = there.join(movers.select("folder").distinct().withColumn("__dir", join_path(F.lit(layout.root), F.col("folder"))), "__dir").select("folder", "name")
    named = claim_names(movers, there).withColumn("destination", join_path(F.lit(layout.root), F.col("folder"), F.col("final_name")))
    named = named.withColumn("transfer", F.when(volume_of(F.col("source")) == volume_of(F.col("destination")), "rename").otherwise("copy"))
    blocked = F.lit(False)
    if busy is not None:
        named = named.join(busy.select(F.col("path").alias("source"), F.lit(True).alias("__busy")).distinct(), "source", "left")
        blocked = F.coalesce("__busy", F.lit(False))
    problem = F.when(F.length("destination") > MAX_PATH, "path_too_long").when(F.col("in_place"), "already_in_place").when(blocked, "busy")
    named = named.withColumn("problem", problem).drop("__busy")
    moves = named.where("problem is null or problem = 'busy'").select("content_key", "source", "destination", "size", "transfer")
    redundant = ranked.where("keeper_rank > 1").select("content_key", F.col("display_path").alias("path"), "size").join(named.select("content_key", "destination"), "content_key")
    renamed = named.where(F.col("final_name") != F.col("basename")).select("source", F.lit("name_taken").alias("problem"))
    problems = named.where("problem is not null").select("source", "problem").unionByName(renamed)
    return moves, redundant, problems


def plan_fingerprint(moves: DataFrame) -> DataFrame:
    """The plan's 16 hex digits: SHA-256 over the sorted lines ``source NUL destination newline``.

    The digest is over one text, so its lines pass through one task. It sorts them, spilling where it must, and holds a
    batch of them at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = hashlib.sha256()
        for batch in batches:
            whole.update("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_pydict({"fingerprint": [whole.hexdigest()[:16]]})

    lines = moves.select(F.concat_ws("\0", "source", "destination").alias("line")).repartition(1).sortWithinPartitions("line")
    nothing = hashlib.sha256().hexdigest()[:16]
    return lines.mapInArrow(digest, "fingerprint string").agg(F.coalesce(F.first("fingerprint"), F.lit(nothing)).alias("fingerprint"))


def plan_summary(moves: DataFrame) -> DataFrame:
    return moves.groupBy("transfer").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def dry_check(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds check: what would stop a move now, without moving anything."""
    there = existing.select("path").distinct()
    rows = moves.join(there.select(F.col("path").alias("source"), F.lit(True).alias("__s")), "source", "left").join(
        there.select(F.col("path").alias("destination"), F.lit(True).alias("__d")), "destination", "left"
    )
    return rows.withColumn("check", F.when(F.col("__s").isNull(), "source_missing").when(F.col("__d").isNotNull(), "destination_exists").otherwise("ok")).drop("__s", "__d")


def sidecar_text(title: Column, taken_at: Column, source: Column) -> Column:
    """A small XMP description of a moved file."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    when = F.coalesce(F.date_format(F.timestamp_seconds(taken_at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" dc:title="'),
        esc(title), F.lit('" dc:source="'), esc(source), F.lit('" xmp:CreateDate="'), when, F.lit('"/></rdf:RDF></x:xmpmeta>'),
    )
