"""What an archive's members repeat of the loose files: verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_twins(files: DataFrame) -> DataFrame:
    """archive_path, member_name, size, n_twins of members whose full hash a plain file has; archives do not count as twins."""
    hashed = files.where("full_hash is not null")
    loose = hashed.where("not is_archive_member").groupBy("full_hash").agg(F.count("*").alias("n_twins"), F.min("display_path").alias("first_twin"))
    return hashed.where("is_archive_member").join(loose, "full_hash").select("archive_path", "member_name", "size", "n_twins", "first_twin")


def archive_verdicts(stats: DataFrame, twins: DataFrame) -> DataFrame:
    """archive_path, verdict, redundant_members, members_total, redundant_bytes.

    stats: archive_path, opened, members_total, members_unreadable. The first that applies: unread, unique (no members),
    fully, partially, unique. Members count by distinct names.
    """
    per_member = twins.groupBy("archive_path", "member_name").agg(F.max("size").alias("size"))
    redundant = per_member.groupBy("archive_path").agg(F.count("*").alias("redundant_members"), F.sum("size").alias("redundant_bytes"))
    rows = stats.join(redundant, "archive_path", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("redundant_members", "redundant_bytes")})
    verdict = (
        F.when(~F.col("opened") | (F.col("members_unreadable") > 0), "unread")
        .when(F.col("members_total") == 0, "unique")
        .when(F.col("redundant_members") >= F.col("members_total"), "fully_redundant")
        .when(F.col("redundant_members") > 0, "partially_redundant")
        .otherwise("unique")
    )
    return rows.select("archive_path", verdict.alias("verdict"), "redundant_members", "members_total", "redundant_bytes")
