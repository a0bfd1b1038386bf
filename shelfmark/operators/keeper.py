"""Which copy of a content is kept: the one whose path says most about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.paths import GENERIC, NAMED, path_segments, segment_kind

KEY = ("k_member", "k_specific", "k_generic", "k_named", "k_length", "k_mtime", "k_path")
REASONS = ("not_in_archive", "more_specific_folder", "fewer_generic_folders", "more_named_folders", "shorter_path", "older", "path_order")


def keeper_keys(rows: DataFrame) -> DataFrame:
    """Adds the seven sort keys; needs display_path, real_path, member_name, is_archive_member and mtime."""
    raw = F.when(F.col("is_archive_member"), F.coalesce("member_name", F.lit(""))).otherwise(F.col("real_path"))
    kinds = F.transform(path_segments(raw), segment_kind)
    count = lambda k: F.size(F.filter("__kinds", lambda x: x == k))
    return (
        rows.withColumn("__kinds", kinds)
        .withColumns(
            {
                "k_member": F.col("is_archive_member").cast("int"),
                "k_specific": -F.coalesce(F.array_max("__kinds"), F.lit(GENERIC)),
                "k_generic": count(GENERIC),
                "k_named": -count(NAMED),
                "k_length": F.length("display_path"),
                "k_mtime": F.col("mtime"),
                "k_path": F.col("display_path"),
            }
        )
        .drop("__kinds")
    )


def keepers(rows: DataFrame, group: str = "full_hash") -> DataFrame:
    """The keeper of each group, by a minimum of the key struct: partial minima, no sort of a hot group."""
    keyed = keeper_keys(rows)
    best = keyed.groupBy(group).agg(F.min(F.struct(*KEY)).alias("__best"), F.count("*").alias("n"))
    return best.select(group, F.col("__best.k_path").alias("keeper_path"), "n")


def rank_keepers(rows: DataFrame, group: str = "full_hash") -> DataFrame:
    """All rows with keeper_rank from 1, and for the first the key position that decided against the second."""
    keyed = keeper_keys(rows)
    order = Window.partitionBy(group).orderBy(*KEY)
    ranked = keyed.withColumn("keeper_rank", F.row_number().over(order))
    decided: Column | None = None
    for k, reason in zip(KEY, REASONS, strict=True):
        differs = ~F.col(k).eqNullSafe(F.lead(k).over(order))
        decided = F.when(differs, reason) if decided is None else decided.when(differs, reason)
    has_next = F.lead("k_path").over(order).isNotNull()
    ranked = ranked.withColumn("keeper_reason", F.when((F.col("keeper_rank") == 1) & has_next, decided))
    return ranked.drop(*KEY)
