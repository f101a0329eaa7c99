"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; row r of the n rows of a source
gets the fractional rank (r - u) / n, where u in [0, 1) is a seeded phase of the source, so small
sources do not all fall on the same place. The order of all fractional ranks interleaves the sources
in proportion, and cutting it into equal runs gives each shard the mixture of the whole.

Neither ranking puts a source or the corpus into one task. Shuffle values and fractional ranks are
spread evenly, so both are cut into as many buckets as the square root of the row count; rows are
ranked inside a bucket, and running sums over the bucket counts turn that into whole ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.common import bucket_count, key_of, saved, text_or_empty


def _unit(hex_digest):
    """The first 32 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def interleave(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``rows``: the counts of the shards differ by one at most. ``size`` is the UTF-8 length of the
    text plus 16 and a NULL text counts as empty. NULL is a source of its own; ties are put in order
    by id, size and checksum, rows that are equal in all of these are interchangeable. Other columns
    are ignored, an empty table gives an empty result. ``grown_shard`` is NULL under this law.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = text_or_empty(text_col)
    total = docs.count()
    buckets = bucket_count(total)
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        key_of(source_col).alias("stratum"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.alias("place"),
    ).withColumn("bucket", F.floor(_unit(F.col("place")) * buckets))

    along = Window.partitionBy("stratum").orderBy("bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.select(key_of(source_col).alias("stratum"), F.floor(_unit(place) * buckets).alias("bucket"))
    counts = (
        counts.groupBy("stratum", "bucket")
        .agg(F.count("*").alias("n"))
        .select(
            "stratum",
            "bucket",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
            F.sum("n").over(Window.partitionBy("stratum")).alias("stratum_rows"),
        )
    )
    inside = Window.partitionBy("stratum", "bucket").orderBy("place", "doc_id", "size", "text_crc32")
    phase = _unit(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("stratum")).cast("binary")))
    ranked = (
        rows.withColumn("inside", F.row_number().over(inside))
        .join(counts, ["stratum", "bucket"])
        .select(
            "doc_id",
            "stratum",
            "size",
            "text_crc32",
            "place",
            ((F.col("offset") + F.col("inside") - phase) / F.col("stratum_rows")).alias("fraction"),
        )
        .withColumn("run", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    )
    ranked = saved(ranked, "interleaved")

    runs = ranked.groupBy("run").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("run").orderBy("fraction", "stratum", "place", "doc_id", "size", "text_crc32")
    position = F.col("offset") + F.col("inside") - 1
    # Whole-number arithmetic: the shard of a position, and the first position of a shard.
    shard = F.expr(f"(position * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("inside", F.row_number().over(inside))
        .join(runs, "run")
        .withColumn("position", position)
        .withColumn("shard", shard)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("position") - first).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
