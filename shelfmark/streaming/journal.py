"""The journal as a stream: status by operation, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators.journal import operations
from shelfmark.sources.files import JOURNAL_SCHEMA


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New journal files of a folder as they come."""
    return spark.readStream.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(folder)


def live_status(stream: DataFrame) -> DataFrame:
    """operations() over a stream; use output mode ``update`` or ``complete``. State is a row per operation."""
    return operations(stream)
