"""Data-quality jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count; partial counts before the shuffle."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def shared_value_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is used by more than one row."""
    return df.join(_shared(df, column), column, "left_semi")


def collision_count(df: DataFrame, column: str) -> DataFrame:
    """Number of rows that share their value with another row."""
    return _shared(df, column).agg(
        F.coalesce(F.sum("copies"), F.lit(0).cast("long")).alias("collisions")
    )


def content_duplicates(files: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Content hashes found in several files: number of files and the first path."""
    return (
        files.filter(F.col(hash_col).isNotNull())
        .groupBy(hash_col)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
        .filter("copies > 1")
    )
