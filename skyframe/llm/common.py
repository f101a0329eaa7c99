"""What several operators share: scratch tables, null-safe keys and row counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import scratch_path


def saved(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors.

    Partition columns move to the end and are read as strings.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def key_of(name: str) -> Column:
    """A non-null text key: NULL gets a key that no value has."""
    return F.when(F.col(name).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(name).cast("string")))


def bucket_count(rows: int) -> int:
    """Square root of the rows: buckets and rows per bucket grow alike."""
    return max(1, math.ceil(math.sqrt(rows)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def hash_sample(df: DataFrame, limit: int, *columns: str) -> DataFrame:
    """The ``limit`` rows with the smallest hash of ``columns``, or nearly as many.

    The rows are counted first, and only hashes below twice the share that is wanted are put in order,
    so what reaches the last task is bounded by ``limit`` however many tasks there are.
    """
    share = min(1.0, (2 * limit + 100) / max(df.count(), 1))
    place = F.xxhash64(*columns)
    low = F.shiftrightunsigned(place, 11) * F.lit(2.0**-53) < share
    return df.where(low).orderBy(F.shiftrightunsigned(place, 11), *columns).limit(limit)


def ranked(rows: DataFrame, group: str, order: list[str], position: str = "pos", size: str = "n") -> DataFrame:
    """``rows`` with the gapless place of each in its group, from 0, and the size of the group.

    NULLs come first; rows that are equal in ``order`` stand in the order of their reading. Rows are put
    in order by ranges, so a group is spread over as many tasks as it has ranges, and only the counts of
    the ranges are summed up along a group. Written to the shared folder twice: before the ranges are
    sampled, and in order. Groups must not be NULL.
    """
    at, part, first, before = (fresh(rows, c) for c in ("at", "part", "first", "before"))
    rows = saved(rows, "unranked").withColumn(at, F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(group, *order, at).sortWithinPartitions(group, *order, at)
    # The upper bits of a row number are the partition, the lower ones the place in it.
    placed = saved(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked").withColumn(part, F.shiftright(at, 33))
    along = Window.partitionBy(group)
    counts = placed.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias(size))
    counts = counts.select(
        group,
        part,
        first,
        F.coalesce(F.sum(size).over(along.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before),
        F.sum(size).over(along).alias(size),
    )
    rows = placed.join(counts, [group, part]).withColumn(position, F.col(before) + F.col(at) - F.col(first))
    return rows.drop(at, part, first, before)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a short ASCII text, which DuckDB has no function for."""
    bits = "lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)"
    codes = f"[ord(x)::BIGINT FOR x IN string_split({text}, '')]"
    step = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bits})"
    return f"xor(list_reduce([4294967295] || {codes}, {step}), 4294967295)"
