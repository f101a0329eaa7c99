"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 segments of two bits. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so fingerprints
within three bits lie within Manhattan distance three, and one half of the 16 + 16 coordinates lies
within distance one (3 = 1 + 2 at best). Each half is a point of an integer grid; a range join finds
the pairs within one step: one side stands in its own cell, the other in its cell and in all cells one
step away (about 25 of them). Pairs are then verified exactly by their differing bits.

Only distinct fingerprints enter the join, so copies cost nothing, and no fingerprint can have more
than 43,744 others within three bits, whatever the corpus holds. A random cell holds one in about
500,000 of the others, so few pairs are verified in vain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from skyframe.llm.common import saved, text_or_empty
from skyframe.llm.components import connected_components

#: Bits in which linked fingerprints may differ. The grid below is exact up to this number.
MAX_BITS = 3
SHINGLE = 3
#: Hashes that are unpacked to bits at a time.
BLOCK = 1 << 16


def fingerprint_of(text: bytes) -> int:
    """The SimHash of the three-word shingles; zero without words."""
    words = text.lower().split()  # on bytes: A-Z and the blanks of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [
            digest(joined[a:b], 42)
            for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        ]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.array(hashes[k : k + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@pandas_udf(T.LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        prints = np.fromiter((fingerprint_of(t.encode()) for t in texts), np.uint64, len(texts))
        yield pd.Series(prints.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print`` (as a signed long) for every row; NULL texts count as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(text_or_empty(text_col)).alias("print"))


def _cells(prints: DataFrame) -> DataFrame:
    """``print, half, cell``: the bit counts of 16 two-bit segments, two bits each."""
    bits = (F.shiftrightunsigned("print", 32), F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)))
    halves = F.array(*(x - F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555)) for x in bits))
    return prints.select("print", F.posexplode(halves).alias("half", "cell"))


def _around(cells: DataFrame) -> DataFrame:
    """The same with every cell within one step in place of the cell itself."""
    step = F.col("step")
    # Steps 1 .. 16 add one to a segment, -1 .. -16 take one off.
    count = F.expr("shiftright(cell, CAST(abs(step) * 2 - 2 AS INT)) & 3")
    moved = F.when(step == 0, F.col("cell")).when(
        ((step > 0) & (count < 2)) | ((step < 0) & (count > 0)),
        F.col("cell") + F.signum(step).cast("long") * F.expr("shiftleft(1L, CAST(abs(step) * 2 - 2 AS INT))"),
    )
    steps = F.explode(F.sequence(F.lit(-16), F.lit(16))).alias("step")
    return cells.select("print", "half", "cell", steps).select("print", "half", moved.alias("cell")).where("cell IS NOT NULL")


def links(prints: DataFrame) -> DataFrame:
    """``high, low``: all pairs of the distinct ``print`` that differ in three bits at most."""
    cells = _cells(prints)
    near = _around(cells).withColumnRenamed("print", "high")
    apart: Column = F.bit_count(F.col("high").bitwiseXOR(F.col("low")))
    # About 50 rows come from each print, which Spark sizes as one: never a table to broadcast.
    pairs = cells.withColumnRenamed("print", "low").join(near.hint("merge"), ["half", "cell"])
    return pairs.where((F.col("low") < F.col("high")) & (apart <= MAX_BITS)).select("high", "low").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, n_links``.

    Documents are linked if their fingerprints differ in at most three bits, texts without words (all
    of fingerprint zero) included; ``component_id`` is the smallest id that links lead to, and
    ``n_links`` the number of other fingerprints that the document's own is linked with. NULL ids are
    never the smallest, unless there is no other. Other columns are ignored.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = saved(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    pairs = saved(links(nodes.select("print")), "links")
    roots = connected_components(pairs).withColumnRenamed("node", "print")
    ends = pairs.select(F.explode(F.array("high", "low")).alias("print"))
    degrees = ends.groupBy("print").agg(F.count("*").alias("n_links"))
    rooted = saved(
        nodes.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root")), "rooted"
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(firsts, "root").join(degrees, "print", "left")
    labels = labels.select("print", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(labels, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )
