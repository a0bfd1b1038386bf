"""Names for events: a place, a person or a folder that enough of an event's photos share, else its dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.geocode import modal_value

SHARES = {"place": 0.6, "person": 0.5, "folder": 0.5}
SOLID = 3


def date_range(start: Column, end: Column) -> Column:
    """A day, days of a month, months of a year, or full dates; times are wall-clock seconds."""
    a, b = F.timestamp_seconds(start), F.timestamp_seconds(end)
    f = F.date_format
    same = lambda p: f(a, p) == f(b, p)
    return (
        F.when(same("yyyy-MM-dd"), f(a, "yyyy-MM-dd"))
        .when(same("yyyy-MM"), F.concat(f(a, "yyyy-MM-dd"), F.lit(".."), f(b, "dd")))
        .when(same("yyyy"), F.concat(f(a, "yyyy-MM-dd"), F.lit(".."), f(b, "MM-dd")))
        .otherwise(F.concat(f(a, "yyyy-MM-dd"), F.lit(".."), f(b, "yyyy-MM-dd")))
    )


def suggest_names(photos: DataFrame, keys: list[str], confirmed: DataFrame | None = None) -> DataFrame:
    """One row per event: candidates (array of kind, name, share, solid) in order, and name.

    photos: keys, display_path, content_hash, taken_at, place, person, folder (deepest named). A place's share is of
    the photos that have one, a person's of those with a known person, a folder's of all. Anchors of confirmed names
    (anchor, name) win.
    """
    rows = photos.withColumn("__order", F.struct("taken_at", "display_path"))
    heads = rows.groupBy(*keys).agg(
        F.count("*").alias("n_photos"), F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"), F.min_by(F.coalesce("content_hash", "display_path"), "__order").alias("anchor")
    )
    out = heads
    for kind, total in (("place", "place"), ("person", "person"), ("folder", None)):
        best = modal_value(rows, keys, kind, "__order", total).where(F.col("share") >= SHARES[kind])
        item = F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.col("share"), (F.col("n") >= SOLID).alias("solid"))
        out = out.join(best.select(*keys, item.alias(f"__{kind}")), keys, "left")
    dates = F.struct(F.lit("dates").alias("kind"), date_range(F.col("start_at"), F.col("end_at")).alias("name"), F.lit(1.0).alias("share"), F.lit(True).alias("solid"))
    out = out.withColumn("candidates", F.array_compact(F.array("__place", "__person", "__folder", dates))).drop("__place", "__person", "__folder")
    if confirmed is not None:
        out = out.join(confirmed.select("anchor", F.col("name").alias("__confirmed")), "anchor", "left")
    else:
        out = out.withColumn("__confirmed", F.lit(None).cast("string"))
    return out.withColumn("name", F.coalesce("__confirmed", F.element_at("candidates", 1)["name"])).withColumn("confirmed", F.col("__confirmed").isNotNull()).drop("__confirmed")


def naming_summary(named: DataFrame) -> DataFrame:
    return named.groupBy(F.element_at("candidates", 1)["kind"].alias("kind")).agg(F.count("*").alias("n"))


def group_albums(rows: DataFrame) -> DataFrame:
    """folder, name (modal, smallest of equals), n."""
    modal = modal_value(rows, ["folder"], "name", "name")
    return rows.groupBy("folder").agg(F.count("*").alias("n")).join(modal.select("folder", "name"), "folder", "left")
