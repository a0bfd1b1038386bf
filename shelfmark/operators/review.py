"""Reviews for people: groups of similar pictures, routes into quarantine, and a study of event thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.session import checkpointed
from shelfmark.functions.measures import hamming
from shelfmark.operators.similar import member_labels


def similar_review(members: DataFrame, contents: DataFrame, distance: int) -> DataFrame:
    """One row per member: group_id, content_hash, is_reference, distance, labels. No keeper and no decision is given.

    contents: content_hash, bits, size, width, height, taken_at. The reference is the heaviest member, of equals the
    one with the larger hash; it comes from a maximum of a struct, so a large group is not sorted.
    """
    rows = members.join(contents, "content_hash")
    best = rows.groupBy("group_id").agg(F.max_by(F.struct("content_hash", "bits", "size", "width", "height", "taken_at"), F.struct("size", "content_hash")).alias("__r"), F.count("taken_at").alias("__n"), (F.max("taken_at") - F.min("taken_at")).alias("__range"))
    joined = rows.join(best, "group_id")
    d = hamming(F.col("bits"), F.col("__r.bits"))
    labels = member_labels(d, distance, F.col("taken_at") - F.col("__r.taken_at"), F.col("width") * F.col("height"), F.col("__r.width") * F.col("__r.height"), F.col("size"), F.col("__r.size"))
    burst = F.coalesce((F.col("__n") >= 2) & (F.col("__range") <= 10), F.lit(False))
    return joined.select("group_id", "content_hash", (F.col("content_hash") == F.col("__r.content_hash")).alias("is_reference"), d.alias("distance"), labels.alias("labels"), burst.alias("group_burst"))


def mirrored_path(path: Column, root: Column) -> Column:
    """Where a file lies in a quarantine folder: its own path under the root, a drive letter as a folder."""
    forward = F.translate(path, "\\", "/")
    bare = F.regexp_replace(F.regexp_replace(forward, "^([A-Za-z]):/*", "$1/"), "^/+", "")
    return F.concat(F.regexp_replace(root, "[/\\\\]+$", ""), F.lit("/"), bare)


def quarantine_routes(ranked: DataFrame, groups: DataFrame, decisions: DataFrame | None = None, root: str = "quarantine") -> DataFrame:
    """display_path, route, target: what happens to each copy of each group.

    ranked: full_hash, display_path, keeper_rank, is_archive_member; groups: full_hash, disposition. With ``decisions``
    (content_hash, action) only contents decided for quarantine move. Archive members are noted, never moved.
    """
    rows = ranked.join(groups.select("full_hash", "disposition"), "full_hash")
    if decisions is not None:
        rows = rows.join(decisions.where("action = 'quarantine'").select(F.col("content_hash").alias("full_hash")).distinct(), "full_hash", "left_semi")
    route = (
        F.when(F.col("disposition") == "report_only", "report")
        .when(F.col("disposition") == "awaits_confirmation", "pending")
        .when(F.col("keeper_rank") == 1, "keep")
        .when(F.col("is_archive_member"), "note")
        .otherwise("move")
    )
    rows = rows.withColumn("route", route)
    return rows.select("full_hash", "display_path", "route", F.when(F.col("route") == "move", mirrored_path(F.col("display_path"), F.lit(root))).alias("target"))


def unique_targets(routes: DataFrame) -> DataFrame:
    """Adds a number to targets that several files claim."""
    w = Window.partitionBy("target").orderBy("display_path")
    # Rows without a target claim none; they are not dealt with the others.
    claims = routes.where("target is not null").withColumn("__n", F.row_number().over(w) - 1)
    named = F.when(F.col("__n") > 0, F.regexp_replace("target", r"(\.[^./]*)?$", F.concat(F.lit("__"), F.col("__n").cast("string"), F.lit("$1"))))
    return claims.withColumn("target", F.coalesce(named, F.col("target"))).drop("__n").unionByName(routes.where("target is null"))


def wrong_cuts(marked: DataFrame, keys: list[str], folder: str, *, time: str = "taken_at", path: str = "display_path") -> DataFrame:
    """n_pairs, n_wrong: neighbours of one folder, and those of them that an event boundary parts."""
    w = Window.partitionBy(*keys).orderBy(time, path)
    same = F.col(folder) == F.lag(folder).over(w)
    return marked.select(same.alias("same"), "is_boundary").where("same").agg(F.count("*").alias("n_pairs"), F.count_if("is_boundary").alias("n_wrong"))


def mixed_events(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """n_events, n_mixed (more than one folder), folders_split (folders over more than one event)."""
    pairs = rows.groupBy(*keys, "event_no", folder).agg(F.lit(1).alias("one"))
    events = pairs.groupBy(*keys, "event_no").agg(F.count("*").alias("n"))
    folders = pairs.groupBy(*keys, folder).agg(F.count("*").alias("n"))
    a = events.agg(F.count("*").alias("n_events"), F.count_if(F.col("n") > 1).alias("n_mixed"))
    return a.crossJoin(folders.agg(F.count_if(F.col("n") > 1).alias("folders_split")))  # two scalars


def index_percentiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, value: the element at int(share * (n - 1)) of the sorted values, by counts of distinct values."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Checkpointed: the bounds of ranges are sampled, and both uses below need the same ones.
    buckets = checkpointed(counts.repartitionByRange(column).sortWithinPartitions(column).withColumn("__p", F.spark_partition_id()))
    heads = buckets.groupBy("__p").agg(F.sum("n").alias("__b"))
    before = heads.select("__p", (F.sum("__b").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__b")).alias("__before"))  # a row per partition
    w = Window.partitionBy("__p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    upto = buckets.join(before, "__p").withColumn("__upto", F.col("__before") + F.sum("n").over(w))
    wanted = [(float(s), int(s * (total - 1))) for s in shares]
    return upto.agg(*[F.min(F.when(F.col("__upto") > at, F.col(column))).alias(f"v{k}") for k, (_, at) in enumerate(wanted)]).select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"v{k}").alias("value")) for k, (s, _) in enumerate(wanted)])).alias("x")
    ).select("x.*")
