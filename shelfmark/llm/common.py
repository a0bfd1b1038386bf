"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_key(id_col: Column, text_col: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a row's id and text; never null, the same on every recomputation.

    Rows with the same id and the same text share a key, and operators treat them as one document.
    """
    return [
        F.xxhash64(F.lit("a"), id_col, text_col).alias("rk1"),
        F.xxhash64(F.lit("b"), text_col, id_col).alias("rk2"),
    ]


def lean(run):
    """A function of Arrow batches that hands its memory back when a task's rows are done: Python workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of a text column (by name or place), or a single row."""
    for batch in batches:
        place = batch.schema.get_field_index(column) if isinstance(column, str) else column
        lengths = pa.compute.binary_length(batch.column(place)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def least_hashes(rows: DataFrame, column: str, most: int, count: int) -> DataFrame:
    """The rows that can be among the ``most`` with the least hashes of a column, of ``count`` in all: not many more.

    So a sample in hash order is not gathered from each partition's first rows, which grow with the partitions.
    """
    share = (1.25 * most + 200) / max(1, count)
    return rows if share >= 1 else rows.where(F.xxhash64(column) < int((share - 0.5) * 2**64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int, most_total: int, where: Column | None = None):
    """A bounded sample of labelled texts for fitting: [(text, label 0 or 1)], and the rows of each label there are.

    ``per_class`` rows of each label at most, taken in hash order of the id, of at most ``most_chars`` characters each
    and ``most_total`` in all. Null ids, labels and texts are left out; where an id has several labels, the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    if where is not None:
        known = known.where(where)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    found: list[tuple[str, int]] = []
    for y in (0, 1):
        ids = least_hashes(known.where(F.col("y") == y), "doc_id", per_class, counts.get(y, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("n", F.length("text")).where(F.col("n") <= most_chars)
        top = rows.withColumns({"a": F.xxhash64("doc_id"), "b": F.xxhash64("text")}).orderBy("a", "b").limit(per_class)
        # The window sees no more than those rows.
        held = top.withColumn("held", F.sum("n").over(Window.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
        found += [(t, y) for t in held.where(F.col("held") <= most_total).select("text").toArrow().column("text").to_pylist()]
    return found, counts
