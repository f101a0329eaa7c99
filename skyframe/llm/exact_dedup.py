"""Exact duplicates by distributed MSD radix partitioning.

All documents start in one group. Each level cuts the next bytes (the digit) off what is left of the
texts and splits every group by them; groups of one leave, and so do groups whose texts have ended,
which therefore are equal byte for byte: no digest decides. Digits widen from level to level, so a
text of n bytes takes log(n) levels, and only texts that still share everything read so far go on.

A level is a partial aggregation (one row for each group and digit, however many copies there are)
and a join back to the documents. The document side of that join can be split anywhere, so adaptive
execution deals a hot group out to many tasks. Each level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import saved, text_or_empty


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = 128, widening: int = 16
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; NULL ids come before all others and NULL texts
    count as empty ones. Where the same id and text are listed more than once, one of those rows
    stays. Other columns of ``docs`` are ignored, an empty table gives an empty result.
    """
    if first_width < 1 or widening < 1:
        raise ValueError("digits must have a width")
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.lit(0).cast("long").alias("part"),
        text.cast("binary").alias("rest"),
    )
    width, finished, tagged = first_width, [], False
    while True:
        cut = rows.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        last = F.struct("doc_id", "tag") if tagged else F.struct("doc_id", F.lit(None).cast("long").alias("tag"))
        groups = cut.groupBy("part", "digit").agg(F.count("*").alias("size"), F.max(last).alias("last"))
        # The number of a group is written down before it is used, so a lost task cannot change it.
        groups = saved(groups.where("size > 1").withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        split = cut.join(groups, ["part", "digit"], "left")
        # The first level gives every row a tag for ties, so texts end at the second level at the earliest.
        ended = F.octet_length("digit") < width if tagged else F.lit(False)
        state = F.when(F.col("size").isNull(), "single").when(ended, "ended").otherwise("open")
        tag = F.col("tag") if tagged else F.monotonically_increasing_id()
        level = saved(
            split.select(
                "doc_id",
                "text_sha256",
                tag.alias("tag"),
                F.col("next").alias("part"),
                F.when(state == "open", F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                F.when(state == "ended", F.col("last")).alias("last"),
                F.when(state == "ended", F.col("size")).otherwise(F.lit(1)).cast("long").alias("size"),
                state.alias("state"),
            ),
            "radix-level",
            "state",
        )
        finished.append(level.where("state <> 'open'"))
        rows = level.where("state = 'open'").select("doc_id", "text_sha256", "tag", "part", "rest")
        if rows.isEmpty():
            break
        width, tagged = width * widening, True
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    single = F.col("state") == "single"
    return done.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (single | (F.col("tag") == F.col("last.tag"))).alias("kept"),
        "text_sha256",
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
