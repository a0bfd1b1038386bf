"""The file index as snapshots: each operator takes tables and returns the next state; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRESH = {
    "hash": (("hashed_source_size", "source_size"), ("hashed_source_mtime", "source_mtime")),
    "origin": (("origin_stamp_size", "source_size"), ("origin_stamp_mtime", "source_mtime")),
    "moment": (("moment_stamp_size", "source_size"), ("moment_stamp_mtime", "source_mtime")),
}


def fresh(kind: str) -> Column:
    """True while a cached value's stamp is its source's; null where there is no stamp."""
    out = F.lit(True)
    for stamp, source in FRESH[kind]:
        out = out & (F.col(stamp) == F.col(source))
    return out


def needs(files: DataFrame, value: str, kind: str) -> DataFrame:
    """Rows without the value, or whose value is stale."""
    return files.where(F.col(value).isNull() | ~fresh(kind))


def upsert_files(index: DataFrame, scanned: DataFrame, scan_id: str, seen_at: float) -> DataFrame:
    """The index after a scan: cached hashes stay where the source's stamp did not change, else they become null.

    Rows of ``scanned`` have display_path, source_size and source_mtime and what else describes the file. Paths that
    were not scanned stay as they are, with their older last_scan_id.
    """
    old = index.alias("o")
    new = scanned.dropDuplicates(["display_path"]).alias("n")
    joined = old.join(new, F.col("o.display_path") == F.col("n.display_path"), "full_outer")
    seen = F.col("n.display_path").isNotNull()
    same = F.coalesce((F.col("o.hashed_source_size") == F.col("n.source_size")) & (F.col("o.hashed_source_mtime") == F.col("n.source_mtime")), F.lit(False))
    out = []
    for c in index.columns:
        if c in ("quick_hash", "full_hash", "hashed_source_size", "hashed_source_mtime"):
            out.append(F.when(~seen | same, F.col(f"o.{c}")).alias(c))
        elif c == "last_scan_id":
            out.append(F.when(seen, F.lit(scan_id)).otherwise(F.col("o.last_scan_id")).alias(c))
        elif c == "seen_at":
            out.append(F.when(seen, F.lit(seen_at)).otherwise(F.col("o.seen_at")).alias(c))
        elif c in scanned.columns:
            out.append(F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Keyed upsert; columns that the changes lack stay, those of ``keep_if_null`` stay where the change is null."""
    o, n = table.alias("o"), changes.withColumn("__hit", F.lit(True)).alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    joined = o.join(n, on, "full_outer")
    hit = F.coalesce(F.col("n.__hit"), F.lit(False))
    out = []
    for c in table.columns:
        if c not in changes.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c in keep_if_null:
            out.append(F.when(hit, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def record_decisions(table: DataFrame, changes: DataFrame, axis: str = "action") -> DataFrame:
    """One axis (``action`` or ``album_state``) of review decisions: a new decision is not applied yet; the other axis stays."""
    stamp = "applied_at" if axis == "action" else "album_applied_at"
    return upsert(table, changes.select("content_hash", axis).where("content_hash <> ''").withColumn(stamp, F.lit(None).cast("double")), ["content_hash"])


def clear_decisions(table: DataFrame, hashes: DataFrame, axis: str = "action") -> DataFrame:
    """Clears one axis; a row without both goes."""
    stamp = "applied_at" if axis == "action" else "album_applied_at"
    marked = table.join(hashes.select("content_hash").distinct().withColumn("__gone", F.lit(True)), "content_hash", "left")
    cleared = marked.withColumns({axis: F.when(F.col("__gone").isNull(), F.col(axis)), stamp: F.when(F.col("__gone").isNull(), F.col(stamp))})
    return cleared.drop("__gone").where("action is not null or album_state is not null").select(*table.columns)


def mark_applied(table: DataFrame, hashes: DataFrame, at: float, stamp: str = "applied_at") -> DataFrame:
    marked = table.join(hashes.select("content_hash").distinct().withColumn("__hit", F.lit(True)), "content_hash", "left")
    return marked.withColumn(stamp, F.when(F.col("__hit"), F.lit(at)).otherwise(F.col(stamp))).select(*table.columns)


def pending(table: DataFrame, present: DataFrame) -> DataFrame:
    """Decisions to quarantine that are not applied and whose content is still there."""
    return table.where("action = 'quarantine' and applied_at is null").join(present.select("content_hash").distinct(), "content_hash", "left_semi")


def replace_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``rows`` has are replaced (a photo's faces, a face's person)."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def prune_missing(index: DataFrame, enumerated: DataFrame, path: str = "real_path") -> DataFrame:
    """Index rows whose file is still there."""
    return index.join(enumerated.select(path).distinct(), path, "left_semi")


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last row of each key, by a maximum of a struct (no sort of a hot key)."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, tie)).alias("__r"))
    return best.select(key, "__r.*").select(*rows.columns)


def library_contents(moves: DataFrame, files: DataFrame) -> DataFrame:
    """What lies in the library: the last move to each destination that was not rolled back, with the content's size."""
    now = latest(moves.where("rolled_back_at is null"), "destination", "moved_at", "op_id")
    sizes = files.groupBy(F.col("full_hash").alias("content_hash")).agg(F.min("size").alias("size"))
    return now.join(sizes, "content_hash", "left")


def lru_evict(previews: DataFrame, cap_bytes: int, keep_share: float = 0.9) -> DataFrame:
    """content_hash of the previews to drop, least recently used first, until keep_share of the cap is left.

    Running sums go over days first (a row per day), then inside the day that the limit falls into, so no task orders
    all previews.
    """
    total = previews.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if total <= cap_bytes:
        return previews.select("content_hash").limit(0)
    over = int(total - cap_bytes * keep_share)
    daily = previews.withColumn("__day", F.floor(F.col("accessed_at") / 86400))
    days = daily.groupBy("__day").agg(F.sum("bytes").alias("__b"))
    before = days.select("__day", (F.sum("__b").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__b")).alias("__before"))
    w = Window.partitionBy("__day").orderBy("accessed_at", "content_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.join(before.where(F.col("__before") < over), "__day")
    return rows.withColumn("__upto", F.col("__before") + F.sum("bytes").over(w) - F.col("bytes")).where(F.col("__upto") < over).select("content_hash")


def scan_stats(files: DataFrame) -> DataFrame:
    """n_files, total_bytes, n_hashed, n_members, n_media of an index."""
    return files.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("full_hash").isNotNull() & F.coalesce(fresh("hash"), F.lit(False))).alias("n_hashed"),
        F.count_if("is_archive_member").alias("n_members"),
        F.count_if(F.col("media_kind").isin("image", "video")).alias("n_media"),
    )


def coverage(rows: DataFrame, column: str, absent: str = "unknown") -> DataFrame:
    """Counts by a label, nulls under ``absent``."""
    return rows.groupBy(F.coalesce(column, F.lit(absent)).alias(column)).agg(F.count("*").alias("n"))


def state_counts(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Counts of every state, zero where none has it."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in states], f"{column} string")
    return wanted.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def album_states(photos: DataFrame, states: DataFrame) -> DataFrame:
    """folder with the number of its photos that are keep, print, drop, or none of these."""
    joined = photos.join(states.select("content_hash", "album_state"), "content_hash", "left").withColumn("album_state", F.coalesce("album_state", F.lit("none")))
    counts = joined.groupBy("folder").pivot("album_state", ["keep", "print", "drop", "none"]).count()
    return counts.na.fill(0)


def latest_scan_id(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("last_scan_id", F.struct("seen_at", "last_scan_id")).alias("last_scan_id"))
