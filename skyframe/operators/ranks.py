"""Places of rows in one global order, at any depth and without a single-task sort.

Rows are dealt by ranges of the sort keys and put in order inside each range; the counts of the ranges,
summed up, turn the place in a range into the place in all. Only one row per range is ever summed up or
compared with its neighbours in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import written


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with the 1-based ``position`` of each row and the ``total`` of rows, both BIGINT.

    ``order`` should end with a unique key; rows that are equal in it stand in any order. ``df`` must not
    have columns of these names. The ordered rows are written once to the shared folder.
    """
    return _pieces(df, order).drop("_at", "_piece")


def _pieces(df: DataFrame, order: list[Column]) -> DataFrame:
    """The ranked rows with the number of their range, ``_piece``, and their place in the writing, ``_at``."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    # The upper bits of a row number are the partition, the lower ones the place in it.
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    counts = placed.groupBy("_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = Window.orderBy("_piece")
    counts = counts.select(
        "_piece",
        "_first",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("total"),
    )
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    rows = placed.join(F.broadcast(counts), "_piece").withColumn("position", position)  # a row per range: bounded
    return rows.drop("_first", "_before")


def page_at(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page, however deep: the rows at its positions, with ``position`` and ``total``."""
    first = (page - 1) * size
    return ranked(df, order).where(F.col("position").between(first + 1, first + size))


def neighbours(df: DataFrame, order: list[Column], id_col: str = "id") -> DataFrame:
    """``id, prev_id, next_id, position, total`` of every row in the whole order.

    Neighbours are looked up inside a range; at its ends they are the last and the first row of the ranges
    beside it, taken from a table of one row per range.
    """
    rows = _pieces(df, order).withColumn("id", F.col(id_col))
    ends = rows.groupBy("_piece").agg(F.min_by("id", "_at").alias("_head"), F.max_by("id", "_at").alias("_tail"))
    along = Window.orderBy("_piece")
    ends = ends.select("_piece", F.lag("_tail").over(along).alias("_prev"), F.lead("_head").over(along).alias("_next"))
    inside = Window.partitionBy("_piece").orderBy("_at")
    first, last = F.row_number().over(inside) == 1, F.lead("_at").over(inside).isNull()
    return rows.select(
        "id",
        "_piece",
        "position",
        "total",
        F.lag("id").over(inside).alias("_before"),
        F.lead("id").over(inside).alias("_after"),
        first.alias("_is_first"),
        last.alias("_is_last"),
    ).join(F.broadcast(ends), "_piece").select(
        "id",
        F.when(F.col("_is_first"), F.col("_prev")).otherwise(F.col("_before")).alias("prev_id"),
        F.when(F.col("_is_last"), F.col("_next")).otherwise(F.col("_after")).alias("next_id"),
        "position",
        "total",
    )
