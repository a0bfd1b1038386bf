"""Near-duplicate groups of perceptual fingerprints: an exact Hamming join by pigeonhole blocks, and its components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.measures import aspect_log_ratio, hamming
from shelfmark.operators.components import FEW_EDGES, connected_components
from shelfmark.session import checkpointed

BITS = 63
#: Share of all pairs that equal blocks bring together, from which on comparing all of them in numpy costs less.
DENSE_BLOCKS = 1 / 100
#: Rows of a part that one task compares with another part.
PART_ROWS = 16_384
#: Different fingerprints of a group up to which Spark pairs them; in larger groups parts are compared in numpy.
JOINED_SPREAD = 64


@dataclass(frozen=True)
class SimilarThresholds:
    distance: int = 6
    aspect: float = 0.35


def normalise_threshold(value: int) -> int:
    """0 to 16, even: fingerprints with 31 of 63 bits differ by even numbers."""
    value = max(0, min(16, int(value)))
    return value - value % 2


def bit_blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of distance + 1 runs of bits: a pair within the distance agrees on all bits of one of them."""
    n = min(distance + 1, BITS)
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block_of(bits: Column, first: int, size: int) -> Column:
    return F.shiftright(bits, first).bitwiseAND(F.lit((1 << size) - 1))


def hamming_pairs(entries: DataFrame, t: SimilarThresholds = SimilarThresholds()) -> DataFrame:
    """a, b, distance of pairs within the distance and aspect guard; a < b by content_hash. Null bits are left out.

    Exact at any size. Where blocks of bits are wide enough to part the fingerprints, pairs meet in a hash join of equal
    blocks; where they are not (wide distances), parts of the table are compared with each other, part by part, bit by bit
    in numpy, which costs less than the pairs that narrow blocks would bring together.
    """
    cols = [F.col("content_hash"), F.col("bits"), (F.col("aspect") if "aspect" in entries.columns else F.lit(0.0)).cast("double").alias("aspect")]
    rows = entries.where("bits is not null").select(*cols)
    met = sum(2.0**-size for _, size in bit_blocks(t.distance))
    return _pairs_by_blocks(rows, t) if met < DENSE_BLOCKS else _pairs_by_parts(rows, t)


def _pairs_by_blocks(rows: DataFrame, t: SimilarThresholds) -> DataFrame:
    runs = bit_blocks(t.distance)
    keyed = rows.select("*", F.posexplode(F.array(*[_block_of(F.col("bits"), *r) for r in runs])).alias("block_no", "block"))
    side = lambda x: keyed.select("block_no", "block", *[F.col(c).alias(f"{x}_{c}") for c in ("content_hash", "bits", "aspect")])
    far = hamming(F.col("a_bits"), F.col("b_bits"))
    differ = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    # A pair may agree on several blocks; it counts in the first of them.
    earlier = [(F.col("block_no") > k) & (_block_of(differ, *r) == 0) for k, r in enumerate(runs[:-1])]
    again = earlier[0]
    for e in earlier[1:]:
        again |= e
    pairs = side("a").join(side("b").hint("merge"), ["block_no", "block"]).where(F.col("a_content_hash") < F.col("b_content_hash"))
    pairs = pairs.where((far <= t.distance) & (aspect_log_ratio(F.col("a_aspect"), F.col("b_aspect")) <= t.aspect) & ~again)
    return pairs.select(F.col("a_content_hash").alias("a"), F.col("b_content_hash").alias("b"), far.alias("distance"))


def _pairs_by_parts(rows: DataFrame, t: SimilarThresholds) -> DataFrame:
    distance, aspect = t.distance, t.aspect
    n = max(1, -(-rows.count() // PART_ROWS))

    def compare(part: pa.Table) -> pa.Table:
        member = part.column("member").to_numpy(zero_copy_only=False).astype(bool)
        bits = part.column("bits").to_numpy().view(np.uint64)
        ratio = np.log(np.maximum(part.column("aspect").fill_null(0.0).to_numpy(), 1e-300))
        known = part.column("aspect").fill_null(0.0).to_numpy() > 0
        names = part.column("content_hash")
        own, left, right, far = np.flatnonzero(member), [], [], []
        step = max(1, 4_000_000 // max(1, len(bits)))
        for k in range(0, len(own), step):
            mine = own[k : k + step]
            d = np.bitwise_count(bits[mine][:, None] ^ bits[None, :])
            i, j = np.nonzero(d <= distance)
            keep = (np.abs(ratio[mine[i]] - ratio[j]) <= aspect) | ~known[mine[i]] | ~known[j]
            left.append(mine[i[keep]])
            right.append(j[keep])
            far.append(d[i[keep], j[keep]])
        a, b, d = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (left, right, far))
        found = pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "distance": pa.array(d.astype(np.int32))})
        # A part against itself meets each pair twice, which counts from its smaller name; two parts meet each pair once.
        block = part.column("block")[0].as_py()
        found = found.filter(pc.less(found.column("a"), found.column("b")) if block // n == block % n else pa.array(~member[b]))
        swap = pc.greater(found.column("a"), found.column("b"))
        return pa.table({"a": pc.if_else(swap, found.column("b"), found.column("a")), "b": pc.if_else(swap, found.column("a"), found.column("b")), "distance": found.column("distance")})

    own = rows.withColumn("own", F.pmod(F.xxhash64("content_hash"), F.lit(n)).cast("int"))
    # Part i meets part j in block (i, j), i <= j; the rows of part i are its members.
    blocks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct((F.least(F.col("own"), j) * n + F.greatest(F.col("own"), j)).alias("block"), (F.col("own") <= j).alias("member")))
    dealt = own.select("content_hash", "bits", "aspect", "own", F.explode(blocks).alias("x")).select("content_hash", "bits", "aspect", "own", "x.*")
    return dealt.groupBy("block").applyInArrow(compare, "a string, b string, distance int")


def similar_groups(entries: DataFrame, t: SimilarThresholds = SimilarThresholds()) -> DataFrame:
    """content_hash, group_id of every member of a group of two or more; group_id is the smallest member."""
    pairs = checkpointed(hamming_pairs(entries, t))
    return connected_components(pairs, "a", "b", few=FEW_EDGES).select(F.col("node").alias("content_hash"), F.col("component").alias("group_id"))


def group_spread(members: DataFrame, entries: DataFrame, distance: int) -> DataFrame:
    """group_id, size, spread (greatest distance inside), kind (copies or scene).

    Exact for groups of any size; equal fingerprints are compared once. The spread is null where fewer than two members
    have bits.
    """
    members = checkpointed(members)
    sizes = members.groupBy("group_id").agg(F.count_distinct("content_hash").alias("size"))
    bits = members.join(entries.select("content_hash", "bits").where("bits is not null"), "content_hash")
    points = checkpointed(bits.groupBy("group_id", "bits").agg(F.count("*").alias("n")))
    counts = checkpointed(points.groupBy("group_id").agg(F.count("*").alias("points"), F.sum("n").alias("rows")))
    small = points.join(counts.where(F.col("points").between(2, JOINED_SPREAD)), "group_id")
    a, b = small.select("group_id", F.col("bits").alias("ab")), small.select("group_id", F.col("bits").alias("bb"))
    joined = a.join(b, "group_id").where("ab < bb").select("group_id", hamming(F.col("ab"), F.col("bb")).alias("far"))
    same = counts.where("points = 1 and rows > 1").select("group_id", F.lit(0).alias("far"))
    far = joined.unionAll(same).unionAll(_far_by_parts(points, counts.where(F.col("points") > JOINED_SPREAD)))
    spread = far.groupBy("group_id").agg(F.max("far").alias("spread"))
    kind = F.when(F.col("spread") <= distance, "copies").otherwise("scene")
    return sizes.join(spread, "group_id", "left").withColumn("kind", kind)


def _far_by_parts(points: DataFrame, counts: DataFrame) -> DataFrame:
    """group_id, far: the greatest distance in each block of two parts of a group (group_id, bits; counts: group_id, points)."""

    def compare(part: pa.Table) -> pa.Table:
        member = part.column("member").to_numpy(zero_copy_only=False).astype(bool)
        bits = part.column("bits").to_numpy().view(np.uint64)
        # Without rows of another part, the block is a part against itself.
        own, other = bits[member], bits if member.all() else bits[~member]
        step = max(1, 4_000_000 // max(1, len(other)))
        far = max((int(np.bitwise_count(own[k : k + step, None] ^ other[None, :]).max()) for k in range(0, len(own), step)), default=0)
        return pa.table({"group_id": part.column("group_id").slice(0, 1), "far": pa.array([far], pa.int32())})

    n = F.ceil(F.col("points") / PART_ROWS).cast("int")
    own = points.join(counts.select("group_id", n.alias("parts")), "group_id").withColumn("own", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
    # Part i meets part j in block (i, j), i <= j; the rows of part i are its members.
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") <= j).alias("member")))
    dealt = own.select("group_id", "bits", F.explode(blocks).alias("x")).select("group_id", "bits", "x.*")
    return dealt.groupBy("group_id", "i", "j").applyInArrow(compare, f"group_id {points.schema['group_id'].dataType.simpleString()}, far int")


def distance_sensitivity(entries: DataFrame, distances: list[int], t: SimilarThresholds = SimilarThresholds()) -> DataFrame:
    """distance, n_pairs, n_groups, n_contents for each distance; the pairs are found once, for the largest."""
    spark = entries.sparkSession
    widest = checkpointed(hamming_pairs(entries, SimilarThresholds(max(distances), t.aspect)))
    rows = []
    for d in distances:  # a handful of thresholds, each a scalar
        pairs = widest.where(F.col("distance") <= d)
        labels = connected_components(pairs, "a", "b", few=FEW_EDGES)
        n, groups = labels.agg(F.count("*"), F.countDistinct("component")).first()
        rows.append((d, pairs.count(), groups, n))
    return spark.createDataFrame(rows, "distance int, n_pairs long, n_groups long, n_contents long")


def member_labels(distance: Column, threshold: int, seconds: Column, pixels: Column, ref_pixels: Column, size: Column, ref_size: Column) -> Column:
    """What tells a member from the group's reference."""
    ratio = ref_size / size
    found = F.array_compact(
        F.array(
            F.when(distance > threshold, "beyond_threshold"),
            F.when(F.abs(seconds) <= 10, "burst"),
            F.when(pixels < ref_pixels, "downscaled").when(ratio >= 1.6, "recompressed"),
        )
    )
    return F.when((F.size(found) == 0) & (F.abs(ratio - 1) <= 0.05), F.array(F.lit("same_frame"))).otherwise(found)
