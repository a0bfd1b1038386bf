"""Substring dedup by sliding sentence spans.

A text is cut after each sentence, and within sentences at words that their content chooses: of any four successive
words, the last one with the least hash (ends of sentences first), so two copies are cut alike wherever they stand.
From each cut on, the shortest run of consecutive pieces with at least 37 words is hashed; so any 50 words that two
texts share hold a whole run, and 36 words or fewer that they share never do. The hashes are joined globally, and the characters of every run that has an earlier
occurrence are covered. Covered runs that touch become one span.

Most runs occur once. Their hashes meet in a compact exchange first, and only runs whose hash may repeat are exchanged
with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import lean, pick, row_key, slices
from shelfmark.llm.packed import binary_rows, bit_filter, dealt, shares
from shelfmark.llm.rolling import Rolling, code_points, mixed
from shelfmark.session import checkpointed, read_table

#: The words of a run: as many as WINDOW allows, so that common phrases and notices of a few lines are no passages.
WORDS = 37
#: Of so many successive words, one at least ends in a cut. Cuts of shared words agree from the fourth of them to the fourth from
#: their end; the first is in the 7th place at most, and a run of 37 words ends 3 words later at most: 4 * 4 + 37 - 3 <= 50.
WINDOW = 4
#: Hashes that a task holds before it sends them.
HELD = 1_000_000
_PLACE = ("doc_id", "rk1", "rk2", "start")
_END = np.array([ord(c) for c in ".!?…"], np.uint32)
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Of each code point: is it white space, and its lower-case form where that is one code point (one pair per worker)."""
    if not _TABLES:
        chars = [chr(c) for c in range(0x110000)]
        _TABLES.append(np.array([c.isspace() for c in chars]))
        _TABLES.append(np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32))
    return _TABLES


def runs(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of many texts: the text's number, two hashes (unsigned), start and end in code points.

    A piece ends after a word that ends a sentence (its last character is one of ``.!?…``, or a line ends behind it),
    after each chosen word, and with the text. A run is the shortest one of ``words`` words or more from its cut on.
    """
    space, lower = _tables()
    codes = code_points([f"{t}\n" for t in texts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = ~space[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]  # every text ends in a line end, so each word has both
    own = np.searchsorted(begins, first, "right") - 1
    none = np.empty(0, np.int64)
    if not len(first):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    size = last - first
    said = mixed(Rolling(mixed(lower[codes].astype(np.uint64)))(first, size) + size.astype(np.uint64))
    broken = np.cumsum(codes == 10)
    ends = np.isin(codes[last - 1], _END)
    ends[:-1] |= broken[first[1:] - 1] > broken[last[:-1] - 1]
    ends[-1] = True
    rank = (said >> np.uint64(1)) | (~ends).astype(np.uint64) << np.uint64(63)
    cut = ends | np.append(own[1:] != own[:-1], True)
    if len(rank) >= WINDOW:
        whole = np.flatnonzero(own[WINDOW - 1 :] == own[: len(own) - WINDOW + 1])
        least = np.lib.stride_tricks.sliding_window_view(rank, WINDOW)[:, ::-1].argmin(axis=1)[whole]
        cut[whole + WINDOW - 1 - least] = True
    bounds = np.concatenate([[0], np.flatnonzero(cut) + 1])
    start = bounds[:-1]
    till = np.searchsorted(bounds, start + words)
    text_end = np.searchsorted(own, own[start], "right")
    ok = till < len(bounds)
    ok[ok] &= bounds[till[ok]] <= text_end[ok]
    a, b = start[ok], bounds[till[ok]]
    h1 = mixed(Rolling(said)(a, b - a))
    h2 = mixed(Rolling(mixed(said, 1))(a, b - a), 2)
    at = begins[own[a]]
    return own[a], h1, h2, first[a] - at, last[b - 1] - at


def repeated_hashes(keyed: DataFrame, words: int) -> DataFrame:
    """The first hashes that occur more than once: h, signed."""
    n = shares(keyed.sparkSession)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        # Two of a kind say as much as many.
        every = every[np.concatenate([[True, True], every[2:] != every[:-2]])[: len(every)]]
        found, ends = dealt(every, n)
        return pa.RecordBatch.from_arrays([pa.array(found), binary_rows(every.view(np.uint8).reshape(-1, 8), ends)], ["share", "hashes"])

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in slices(batches, "text", 2_000_000):
            held.append(runs([t or "" for t in batch.column(0).to_pylist()], words)[1])
            if sum(map(len, held)) > HELD:
                yield send(held)
                held = []
        if sum(map(len, held)):
            yield send(held)

    def meet(share: pa.Table) -> pa.Table:
        every = np.sort(np.frombuffer(b"".join(share.column("hashes").to_pylist()), np.uint64))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        return pa.table({"h": pa.array(again.view(np.int64))})

    packed = keyed.select("text").mapInArrow(pack, "share int, hashes binary")
    return packed.groupBy("share").applyInArrow(meet, "h long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per span to remove: doc_id, start, end (code points, end exclusive), first_doc_id, rk1, rk2.

    The first occurrence of a run is the one of the smallest doc_id (null ids first), then the earliest in its text;
    first_doc_id is the smallest such id among the runs of the span. Rows that repeat both id and text are one
    document. Null, empty and short texts have no runs; an empty table gives no spans.
    """
    keyed = pick(docs, id_col, text_col).select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text")
    again = bit_filter(repeated_hashes(keyed, words), "h")

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            own, h1, h2, start, end = runs([t or "" for t in batch.column(3).to_pylist()], words)
            at = np.flatnonzero(again.value.passes(h1))
            rows = pa.array(own[at])
            kept = [batch.column(k).take(rows) for k in range(3)]
            more = [pa.array(h[at].view(np.int64)) for h in (h1, h2)] + [pa.array(x[at].astype(np.int32)) for x in (start, end)]
            yield pa.RecordBatch.from_arrays(kept + more, ["doc_id", "rk1", "rk2", "h1", "h2", "start", "end"])

    found = keyed.mapInArrow(emit, "doc_id long, rk1 long, rk2 long, h1 long, h2 long, start int, end int")
    place = F.struct(*_PLACE)
    # A run's occurrences are merged in each task before they are shuffled, so a common passage is a row per task.
    # They are checkpointed, so that Spark can split the occurrences of such a passage over several tasks of the join.
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = checkpointed(firsts.select("h1", "h2", *[F.col(f"first.{c}").alias(f"first_{c}") for c in _PLACE]))
    first = F.struct(*[F.col(f"first_{c}").alias(c) for c in _PLACE])
    again = found.join(firsts.hint("merge"), ["h1", "h2"]).where(place != first)
    doc = ["doc_id", "rk1", "rk2"]
    # One exchange by document serves what follows: rows that repeat, islands and spans.
    covered = again.repartition(*doc).groupBy(*doc, "start").agg(F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    order = Window.partitionBy(*doc).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.coalesce(F.col("reach"), F.lit(-1)), 1).otherwise(0)).over(order)
    islands = covered.withColumn("reach", reach).withColumn("island", island)
    spans = islands.groupBy(*doc, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.select("doc_id", "start", "end", "first_doc_id", "rk1", "rk2")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of the text; other columns, whatever they are called, and rows stay as they are."""
    per_doc = spans.groupBy(F.struct("rk1", "rk2").alias("own")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.struct(*row_key(F.col(id_col).cast("long"), F.col(text_col))).alias("own"), F.struct("*").alias("row"))
    text = F.col("row")[text_col]
    starts = F.array_append(F.transform("spans", lambda s: s["start"]), F.length(text))
    ends = F.array_prepend(F.transform("spans", lambda s: s["end"]), F.lit(0))
    pieces = F.zip_with(ends, starts, lambda e, s: F.substring(text, e + 1, s - e))
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(pieces, ""))
    return rows.join(per_doc, "own", "left").select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents")).drop("rk1", "rk2")
