"""Best copy of a group by measured quality, print fitness, and the album queue's tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.measures import megapixels, print_fitness

LADDER = ("__pixels", "__recompression", "__quality", "__sharpness", "__size", "content_hash")
LEVELS = ("resolution", "recompression", "jpeg_quality", "sharpness", "size", "hash")
CONFIDENT = {"resolution": 1.10, "recompression": 0.10, "jpeg_quality": 3, "sharpness": 1.25, "size": 1.05}


def best_copies(candidates: DataFrame, group: str = "group_id") -> DataFrame:
    """Measured candidates with copy_rank, and for the best its deciding level and whether it is a confident choice.

    Needs content_hash, size, width, height, sharpness, recompression, recompression_basis and jpeg_quality. Candidates
    without pixels or basis are left out. Recompression counts only where a group has one basis.
    """
    measured = candidates.where("width > 0 and height > 0 and recompression_basis is not null")
    one = F.min("recompression_basis").over(Window.partitionBy(group)) == F.max("recompression_basis").over(Window.partitionBy(group))
    rows = measured.withColumn("__one", one)
    tables = F.col("__one") & (F.col("recompression_basis") == "jpeg_tables")
    rows = rows.withColumns(
        {
            "__pixels": -(F.col("width").cast("long") * F.col("height")),
            "__recompression": F.when(F.col("__one"), F.coalesce("recompression", F.lit(0.0))).otherwise(0.0),
            "__quality": F.when(tables, -F.coalesce(F.col("jpeg_quality"), F.lit(0))).otherwise(0),
            "__sharpness": -F.coalesce("sharpness", F.lit(0.0)),
            "__size": -F.col("size"),
        }
    )
    w = Window.partitionBy(group).orderBy(*LADDER)
    level: Column | None = None
    for column, name in zip(LADDER, LEVELS, strict=True):
        differs = F.col(column) != F.lead(column).over(w)
        level = F.when(differs, name) if level is None else level.when(differs, name)
    ratio = lambda c: F.abs(F.col(c)) / F.greatest(F.abs(F.lead(c).over(w)), F.lit(1e-9))
    rows = rows.withColumns({"copy_rank": F.row_number().over(w), "__level": level})
    confident = (
        F.when(F.col("__level") == "resolution", ratio("__pixels") >= CONFIDENT["resolution"])
        .when(F.col("__level") == "recompression", F.lead("__recompression").over(w) - F.col("__recompression") >= CONFIDENT["recompression"])
        .when(F.col("__level") == "jpeg_quality", F.lead("__quality").over(w) - F.col("__quality") >= CONFIDENT["jpeg_quality"])
        .when(F.col("__level") == "sharpness", ratio("__sharpness") >= CONFIDENT["sharpness"])
        .when(F.col("__level") == "size", ratio("__size") >= CONFIDENT["size"])
        .otherwise(False)
    )
    rows = rows.withColumn("__confident", confident)
    first = F.col("copy_rank") == 1
    rows = rows.withColumns({"deciding_level": F.when(first, F.col("__level")), "confident": F.when(first & F.col("__level").isNotNull(), F.col("__confident"))})
    return rows.drop(*[c for c in LADDER if c.startswith("__")], "__one", "__level", "__confident")


def contested(ranked: DataFrame, group: str = "group_id") -> DataFrame:
    """Copies that beat the best one by compression (0.10 or more) or sharpness (1.25 times) without more compression."""
    w = Window.partitionBy(group).orderBy("copy_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ranked.withColumns({"__r": F.first("recompression").over(w), "__s": F.first("sharpness").over(w), "__b": F.first("recompression_basis").over(w)})
    same = F.col("recompression_basis") == F.col("__b")
    cleaner = same & (F.col("__r") - F.col("recompression") >= 0.10)
    worse = same & (F.col("recompression") - F.col("__r") >= 0.10)
    sharper = (F.col("__s") > 0) & (F.col("sharpness") >= 1.25 * F.col("__s")) & ~worse
    found = rows.where((F.col("copy_rank") > 1) & (cleaner | sharper))
    return found.withColumn("wins_by", F.when(cleaner, "compression").otherwise("sharpness")).drop("__r", "__s", "__b")


def album_queue(photos: DataFrame, album: str = "album") -> DataFrame:
    """Photos with print size, tier (0 ready with a face, 1 ready, 2 doubtful, 3 unmeasured, 9 unfit) and queue_rank.

    Needs content_hash, width, height, sharpness, recompression, faces. The album's median sharpness counts from three
    fully measured photos on.
    """
    full = F.col("sharpness").isNotNull() & F.col("recompression").isNotNull()
    rows = photos.withColumns({"mp": megapixels(F.col("width"), F.col("height")), "__full": full})
    stats = rows.where("__full").groupBy(album).agg(F.expr("percentile(sharpness, 0.5)").alias("__median"), F.count("*").alias("__n"))
    rows = rows.join(stats, album, "left").withColumn("__median", F.when(F.col("__n") >= 3, F.col("__median")))
    rows = rows.withColumn("print_size", print_fitness(F.col("mp")))
    doubtful = (F.col("recompression") > 0.5) | (F.col("sharpness") * 1.25 < F.coalesce("__median", F.lit(0.0)))
    tier = F.when(F.col("print_size").isNull() & F.col("mp").isNotNull(), 9).when(~F.col("__full"), 3).when(doubtful, 2).when(F.coalesce("faces", F.lit(0)) > 0, 0).otherwise(1)
    rows = rows.withColumn("tier", tier)
    w = Window.partitionBy(album).orderBy("tier", F.desc_nulls_last("mp"), F.asc_nulls_last("recompression"), F.desc_nulls_last("sharpness"), "content_hash")
    return rows.withColumn("queue_rank", F.row_number().over(w)).drop("__median", "__n", "__full")
