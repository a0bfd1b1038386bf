"""Event sessions of dated, placed moments: boundary rules, event measures, trips and sensitivity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.geo import haversine_m


@dataclass(frozen=True)
class EventThresholds:
    """Seconds, metres and km/h of the rules."""

    gap_s: float = 9 * 3600
    place_gap_s: float = 30 * 60
    place_m: float = 3_000
    same_place_m: float = 1_000
    max_kmh: float = 1_200
    trip_gap_s: float = 30 * 3600
    trip_m: float = 50_000


def _order(keys: list[str], time: str, path: str):
    return Window.partitionBy(*keys).orderBy(time, path)


def boundaries(moments: DataFrame, keys: list[str], t: EventThresholds = EventThresholds(), *, time: str = "taken_at", path: str = "display_path") -> DataFrame:
    """Dated moments with the gap and distance to the one before, and whether an event begins: rule, is_boundary, warning.

    ``time`` is wall-clock seconds. A distance at an impossible speed is not used and is marked as a warning. With no
    key columns use ``cluster_events`` with time blocks, so that no single task orders the whole library.
    """
    w = _order(keys, time, path)
    rows = moments.where(F.col(time).isNotNull())
    rows = rows.withColumns({"gap_s": F.col(time) - F.lag(time).over(w), "__lat": F.lag("lat").over(w), "__lon": F.lag("lon").over(w), "__t": F.lag(time).over(w), "__p": F.lag(path).over(w)})
    raw = haversine_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("__d", raw)
    fast = F.coalesce((F.col("gap_s") > 0) & (F.col("__d") / 1000 / (F.col("gap_s") / 3600) > t.max_kmh), F.lit(False))
    rows = rows.withColumn("warning", fast).withColumn("distance_m", F.when(~fast, F.col("__d")))
    day = lambda c: F.floor(F.col(c) / 86400)
    stays = F.coalesce((F.col("distance_m") <= t.same_place_m) & (day("__t") == day(time)), F.lit(False))
    rule = (
        F.when(F.col("__p").isNull(), "first")
        .when((F.col("gap_s") >= t.gap_s) & ~stays, "time_gap")
        .when((F.col("gap_s") < t.gap_s) & (F.col("gap_s") >= t.place_gap_s) & (F.col("distance_m") >= t.place_m), "place_change")
    )
    return rows.withColumn("rule", rule).withColumn("is_boundary", F.col("rule").isNotNull()).drop("__lat", "__lon", "__t", "__p", "__d")


def sessions(moments: DataFrame, keys: list[str], t: EventThresholds = EventThresholds(), *, time: str = "taken_at", path: str = "display_path") -> DataFrame:
    """Adds event_no (from 1 within the keys)."""
    marked = boundaries(moments, keys, t, time=time, path=path)
    running = _order(keys, time, path).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("event_no", F.sum(F.col("is_boundary").cast("long")).over(running))


def cluster_events(moments: DataFrame, t: EventThresholds = EventThresholds(), *, time: str = "taken_at", path: str = "display_path", block_s: int = 30 * 86400) -> DataFrame:
    """Sessions over a whole library, in time blocks that run side by side.

    A block's first moment needs the last moment of the nearest block before it: the blocks' last moments (one row per
    block) are ordered on their own, and carried into the block as a row that is dropped afterwards. Event numbers are
    (block, number in block) pairs made global by the blocks' counts, again one row per block.
    """
    dated = moments.where(F.col(time).isNotNull()).withColumn("__block", F.floor(F.col(time) / block_s))
    ends = dated.groupBy("__block").agg(F.max_by(F.struct(time, path, "lat", "lon"), F.struct(time, path)).alias("__last"))
    over_blocks = Window.orderBy("__block")  # a row per block of thirty days: decades are a few hundred rows
    carried = ends.select(F.lead("__block").over(over_blocks).alias("__block"), "__last").where("__block is not null")
    ghosts = carried.select(F.col(f"__last.{time}").alias(time), F.col(f"__last.{path}").alias(path), F.col("__last.lat").alias("lat"), F.col("__last.lon").alias("lon"), "__block", F.lit(True).alias("__ghost"))
    rows = dated.withColumn("__ghost", F.lit(False)).unionByName(ghosts, allowMissingColumns=True)
    marked = boundaries(rows, ["__block"], t, time=time, path=path).where("not __ghost").drop("__ghost")
    counts = marked.groupBy("__block").agg(F.count_if("is_boundary").alias("__n"))
    before = counts.select("__block", F.coalesce(F.sum("__n").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    running = Window.partitionBy("__block").orderBy(time, path).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.join(before, "__block").withColumn("event_no", F.col("__before") + F.sum(F.col("is_boundary").cast("long")).over(running))
    return numbered.drop("__block", "__before")


def event_summary(rows: DataFrame, keys: list[str], *, time: str = "taken_at", path: str = "display_path") -> DataFrame:
    """One row per event: size, start, end, anchor, sources, centre (mean of known positions), radius and confidence."""
    by = [*keys, "event_no"]
    source = F.col("time_source") if "time_source" in rows.columns else F.lit("exif")
    exif, named = F.count_if(source == "exif"), F.count_if(source.isin("exif", "sidecar", "filename"))
    head = rows.groupBy(*by).agg(
        F.count("*").alias("size"),
        F.min(time).alias("start_at"),
        F.max(time).alias("end_at"),
        F.min_by(path, F.struct(time, path)).alias("anchor"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("geo_known"),
        F.avg("lat").alias("centre_lat"),
        F.avg("lon").alias("centre_lon"),
        F.when(exif / F.count("*") >= 0.5, "high").when(named / F.count("*") >= 0.5, "medium").otherwise("low").alias("confidence"),
    )
    far = haversine_m(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon"))
    radius = rows.select(*by, "lat", "lon").join(head.select(*by, "centre_lat", "centre_lon"), by).groupBy(*by).agg(F.max(far).alias("radius_m"))
    return head.join(radius, by)


def trips(events: DataFrame, keys: list[str], t: EventThresholds = EventThresholds()) -> DataFrame:
    """Adds trip_no: an event joins the trip of the event before it if both have a centre, near in time and place."""
    w = Window.partitionBy(*keys).orderBy("start_at", "event_no")
    near = (F.col("start_at") - F.lag("end_at").over(w) <= t.trip_gap_s) & (
        haversine_m(F.lag("centre_lat").over(w), F.lag("centre_lon").over(w), F.col("centre_lat"), F.col("centre_lon")) <= t.trip_m
    )
    new = F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)
    marked = events.withColumn("__new", new)
    return marked.withColumn("trip_no", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def gap_sensitivity(moments: DataFrame, keys: list[str], gaps_s: list[int], *, time: str = "taken_at", path: str = "display_path") -> DataFrame:
    """Number of events for each time gap, from one pass over the gaps."""
    w = _order(keys, time, path)
    rows = moments.select((F.col(time) - F.lag(time).over(w)).alias("gap"))
    counts = rows.agg(*[F.count_if(F.col("gap").isNull() | (F.col("gap") >= g)).alias(str(g)) for g in gaps_s])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(g).cast("long").alias("gap_s"), F.col(str(g)).alias("n_events")) for g in gaps_s])).alias("x")).select("x.*")


def gap_histogram(moments: DataFrame, keys: list[str], edges_s: list[int], *, time: str = "taken_at", path: str = "display_path") -> DataFrame:
    """Gaps between neighbours, counted by bucket (0 below the first edge)."""
    gap = F.col(time) - F.lag(time).over(_order(keys, time, path))
    bucket: Column = sum(((F.col("gap") >= e).cast("int") for e in edges_s), F.lit(0))
    return moments.select(gap.alias("gap")).where("gap is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def clustering_summary(events: DataFrame) -> DataFrame:
    """n_events, n_photos, largest, singletons and the upper median size; sizes are counted, not collected."""
    sizes = events.groupBy("size").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n_events"), F.sum(F.col("n") * F.col("size")).alias("n_photos"), F.max("size").alias("largest"), F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("singletons"))
    w = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)  # distinct sizes only
    upto = sizes.select("size", F.sum("n").over(w).alias("__upto")).crossJoin(F.broadcast(total.select("n_events")))
    median = upto.where(F.col("__upto") > F.floor(F.col("n_events") / 2)).agg(F.min("size").alias("median_size"))
    return total.crossJoin(median)
