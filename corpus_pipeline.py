"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece codes.

Each stage gets all rows that the stage before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.decontam import without_contaminated
from shelfmark.llm.lines import without_repeated_lines
from shelfmark.llm.pieces import piece_codes
from shelfmark.llm.simhash import without_near_copies
from shelfmark.llm.toxicity import fit_toxicity, without_toxic
from shelfmark.session import ensure_checkpoint_dir, read_table

#: Near copies here: sets of runs of five words with a Jaccard similarity of 0.8 or more, computed exactly. Candidates are what
#: differs by 7 of 64 bits and 14 of another 64, which finds about a quarter at 0.8, and what shares a key of least hashes.
NEAR = {"words": 5, "link_bits": 7, "lanes": 2, "confirm_bits": 14, "leaf_members": 4_000, "similarity": 0.8}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades as toxic go.

    The model is fitted on labelled rows of ``docs``; without labels of both kinds it says the share of toxic ones for all.
    Null and empty texts are scored by the cuts alone; repeated rows are judged each; an empty table stays empty.
    """
    return without_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text.

    All rows stay, also those whose text becomes empty. Null texts stay null (n_chars null), empty ones empty. Rows that
    repeat both id and text lose the same lines. Very long lines are compared like any other; an empty table stays empty.
    """
    kept = without_repeated_lines(docs, short=True)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id (null ids last).

    Rows without words, null or empty, are one group, and so are rows that repeat. An empty table stays empty.
    """
    return without_near_copies(docs, **NEAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts contain none; rows that repeat both id and text go or stay together; an empty table stays empty.
    """
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with their digests: one row per row; null and empty texts have no ids."""
    return piece_codes(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL expresses none of the model, the edit join and the codes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from one to the next is a table in the shared folder."""
    ensure_checkpoint_dir(spark)
    folder = posixpath.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
