"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size blocks. The distinct blocks are dealt by hash, sorted inside each partition
and numbered there, so a block's name is its partition and its rank in it; then adjacent pairs of names are named in the
same way, level by level, until every document has one name. Equal names at a level mean equal block sequences: names
are given to the bytes themselves, and no hash decides equality. Rows are told apart by their id and the SHA-256 that
the result carries anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import lean, pick, slices
from shelfmark.session import checkpointed, read_table

BLOCK_BYTES = 4096
_NO_RIGHT = -1


def _blocks(size: int, places: bool):
    """Distinct blocks of each slice of a batch, with ``places`` also where they stand: many copies of one text in a
    task become one row before the shuffle, whose list a slice bounds."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lowered = pc.ascii_lower(batch.column(1)).to_pylist()
            found: dict[bytes, list[int]] = {}
            own, pos, last, digests = [], [], [], []
            for row, text in enumerate(lowered):
                raw = (text or "").encode()
                n = max(1, -(-len(raw) // size))
                for k in range(n):
                    found.setdefault(raw[k * size : (k + 1) * size], []).append(len(own) + k)
                if places:
                    digests.append(hashlib.sha256(raw).digest())
                    pos += range(n)
                    last += [n - 1] * n
                own += [row] * n
            out = {"block": pa.array(list(found), pa.binary())}
            if places:
                order = pa.array([i for items in found.values() for i in items], pa.int64())
                rows = pa.array(own, pa.int64()).take(order)
                fields = [
                    batch.column(0).cast(pa.int64()).take(rows), pa.array(digests, pa.binary()).take(rows), pa.array(pos, pa.int32()).take(order), pa.array(last, pa.int32()).take(order),
                ]
                offsets = [0]
                for items in found.values():
                    offsets.append(offsets[-1] + len(items))
                out["places"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["doc_id", "digest", "pos", "last"]))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Sorted integer names for distinct rows: the hash partition and the rank in it, so the same on a recomputation."""
    return distinct.sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("name"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after lower-casing A-Z only; a null text counts as empty. The row with the
    largest doc_id of a group stays (null ids sort below all others). Of rows that repeat both id and text, one is
    kept and the others are not. An empty table gives an empty result. Columns other than the two named are ignored.
    """
    base = pick(docs, id_col, text_col)
    cut = base.mapInArrow(_blocks(block_bytes, True), "block binary, places array<struct<doc_id: long, digest: binary, pos: int, last: int>>")
    names = _named(base.mapInArrow(_blocks(block_bytes, False), "block binary").distinct(), "block")
    # The rows of a common block are many, those of its name one: a sort-merge join, whose large partitions are split.
    # Rows that repeat both id and text become one row that knows how often it occurred.
    level = checkpointed(
        cut.join(names.hint("merge"), "block").select("name", F.inline("places")).groupBy("doc_id", "digest", "pos", "last", "name").agg(F.count("*").alias("copies"))
    )
    done: list[DataFrame] = []
    while True:
        done.append(level.where("last = 0").select("doc_id", "digest", "name", "copies", F.lit(len(done)).alias("depth")))
        rest = level.where("last > 0")
        if rest.isEmpty():
            return _decide(done)
        half, odd = [F.shiftright(c, 1).alias(c) for c in ("pos", "last")], F.col("pos") % 2 == 1
        pairs = checkpointed(
            rest.groupBy("doc_id", "digest", *half).agg(
                F.max(F.when(~odd, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(_NO_RIGHT)).alias("r"),
                F.max("copies").alias("copies"),
            )
        )
        names = _named(pairs.select("l", "r").distinct(), "l", "r")
        level = checkpointed(pairs.join(names.hint("merge"), ["l", "r"]).drop("l", "r"))


def _decide(done: list[DataFrame]) -> DataFrame:
    identity = done[0]
    for other in done[1:]:
        identity = identity.unionByName(other)
    groups = checkpointed(identity.groupBy("depth", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    # Both sides now come straight from an exchange, so Spark can split the rows of a large group over several tasks.
    rows = identity.join(groups.hint("merge"), ["depth", "name"])
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy_no") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
