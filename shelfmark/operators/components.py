"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpointed

#: Edges up to which one task finds the components: some 16 bytes each, where rounds of steps take dozens of stages.
FEW_EDGES = 200_000


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) neighbour rows with the least of u and its neighbours: partial minima are taken before the shuffle.

    The minima are checkpointed, so that both sides of the join come straight from an exchange and Spark can split the
    rows of a hub with very many neighbours over several tasks.
    """
    least = checkpointed(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return pairs.join(least, "u")


def _together(part: pa.Table) -> pa.Table:
    ends = pa.concat_arrays([part.column(k).combine_chunks() for k in range(2)]).dictionary_encode()
    names = ends.dictionary.sort() if len(ends) else ends.dictionary
    code = pc.index_in(pa.concat_arrays([part.column(k).combine_chunks() for k in range(2)]), names).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = np.split(code, 2)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return pa.table({"node": names, "component": names.take(pa.array(label))})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = 0) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Self-loops keep their node; repeated edges and either direction are the same edge; null ends are left out. An
    empty edge list gives an empty result. Each round is checkpointed, so a lost executor repeats one round at most.
    Where there are ``few`` edges at most, one task finds the components instead; they are the same.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    if few and edges.count() <= few:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.groupBy(F.lit(0).alias("all")).applyInArrow(lambda part: _together(part.select(["u", "v"])), f"node {kind}, component {kind}")
    nodes = edges.select("u").unionAll(edges.select(F.col("v").alias("u"))).distinct()
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(_star(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        tied = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(tied, "u")
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(tied.select("u", F.col("m").alias("v")))
        now = checkpointed(linked.distinct())
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    labels = now.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(labels, "u", "left").select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
