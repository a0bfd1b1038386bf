"""Replaying an append-only journal of file operations, and what may be restored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operations(journal: DataFrame) -> DataFrame:
    """One row per op_id with an intent: status (restored over failed over moved over pending), first and last time, original, quarantined.

    An operation that never wrote its move_pending is passed over. Only restored undoes a move and only move_failed fails
    one: after restore_failed the file is still where it was moved, so it stays a candidate for another restore. Needs
    op_id, event, ts; original, quarantined and size are taken from the earliest line that has them.
    """
    has = lambda *events: F.bool_or(F.col("event").isin(*events))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    rows = journal.where("op_id is not null").groupBy("op_id").agg(
        has("move_pending").alias("__p"), has("restored").alias("__r"), has("move_failed").alias("__f"), has("move_done").alias("__d"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), *[first(c) for c in ("original", "quarantined", "size") if c in journal.columns],
    )
    status = F.when(F.col("__r"), "restored").when(F.col("__f"), "failed").when(F.col("__d"), "moved").otherwise("pending")
    return rows.where("__p").withColumn("status", status).drop("__p", "__r", "__f", "__d")


def summary(journal: DataFrame) -> DataFrame:
    """status, n, bytes."""
    ops = operations(journal)
    return ops.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def restore_decisions(ops: DataFrame, existing: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Adds decision: what a restore would do, from which paths exist (``existing``: path)."""
    there = existing.select("path").distinct()
    rows = ops.join(there.select(F.col("path").alias("quarantined"), F.lit(True).alias("__q")), "quarantined", "left")
    rows = rows.join(there.select(F.col("path").alias("original"), F.lit(True).alias("__o")), "original", "left")
    bad = F.lit(False)
    if unreadable is not None:
        rows = rows.join(unreadable.select(F.col("path").alias("quarantined"), F.lit(True).alias("__u")).distinct(), "quarantined", "left")
        bad = F.coalesce("__u", F.lit(False))
    q, o = F.coalesce("__q", F.lit(False)), F.coalesce("__o", F.lit(False))
    decision = (
        F.when(F.col("status") == "restored", "nothing_to_do")
        .when(~q & o, "skip_never_completed")
        .when(~q & ~o, "manual_both_missing")
        .when(bad, "skip_unreadable")
        .when(o, "skip_original_occupied")
        .otherwise("restore")
    )
    return rows.withColumn("decision", decision).drop("__q", "__o", "__u")


def rollback_order(ops: DataFrame) -> DataFrame:
    """Moved operations, newest first."""
    return ops.where("status = 'moved'").orderBy(F.desc("last_at"), F.desc("op_id"))
