"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into the cells of a table of source, language and topic. Starting from the tokens of
each cell, weights are raked: scaled until the weighted tokens of every source, then of every language,
then of every topic reach their targets, over and over until all three hold. Documents are then drawn
by the calibrated weight of their cell, scaled to the wanted number of tokens; where that would exceed
one, the cell is taken whole and the others make up for it.

The documents are read once for the table and never move between tasks on their own. Margins are
partial aggregations over the cells, so a source that holds most cells is no hot key, and the sweeps
work on DataFrames however many cells there are. The drawing is a hash of the id: the same seed gives
the same documents on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skyframe.llm.common import key_of, saved, text_or_empty

DIMENSIONS = ("source_key", "lang_key", "topic")
#: Cells that a task rakes at least: a table of no more than this is raked without a shuffle.
CELLS_A_TASK = 100_000

# The topics, tried in this order, by what the text holds.
TOPICS = (
    ("legal", r"(?i)licen[cs]ed? under|all rights reserved|copyright"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]|\+[0-9]{1,3} ?\("),
    ("tabular", r" \| [^|\n]* \| "),
)
OTHER_TOPIC = "prose"


def topic_of(text: Column, topics=TOPICS, other: str = OTHER_TOPIC) -> Column:
    """The first topic whose pattern the text holds."""
    named = [F.when(text.rlike(pattern), name) for name, pattern in topics]
    return F.coalesce(*named, F.lit(other))


def keyed(docs: DataFrame, source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> list[Column]:
    """The cell of a document: ``source_key, lang_key, topic``. NULLs are keys of their own."""
    return [
        key_of(source_col).alias("source_key"),
        key_of(lang_col).alias("lang_key"),
        topic_of(text_or_empty(text_col)).alias("topic"),
    ]


def token_count(text_col: str = "text") -> Column:
    """Words between blanks."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"\S+")).cast("long")


def cell_table(features: DataFrame) -> DataFrame:
    """``source_key, lang_key, topic, tokens``; cells without tokens are left out."""
    cells = features.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    return saved(cells.where("tokens > 0"), "cells")


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """``key, share``: the observed shares to the power of ``exponent``, which evens them out, normalised."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("raised"))
    total = sums.agg(F.sum("raised")).first()[0]
    return sums.select(F.col(dimension).alias("key"), (F.col("raised") / F.lit(total)).alias("share"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, max_sweeps: int = 60
) -> tuple[DataFrame, float]:
    """``cells`` with ``weight``, and how far the worst margin is from its target, as a share of all tokens.

    ``targets`` has ``key, share`` for some of the dimensions. Keys without a target keep their tokens'
    proportion among themselves and share what the targets leave of 1; keys without cells are ignored
    and the shares normalised. Sweeps end at ``tolerance``, or, where targets contradict each other, once the
    gaps that a sweep meets are those of the sweep before, and at ``max_sweeps``. They contradict each other
    if, say, the only cells of a source are those of a language with target zero.

    Each scaling to one dimension is a written step of its own, so that a plan never holds more than one.
    Tables are read in one partition for each ``CELLS_A_TASK`` cells, where a table of one partition needs
    no exchange; the rows are the same for any number of them.
    """
    total, rows = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    tasks = max(1, math.ceil(rows / CELLS_A_TASK))
    table = cells.withColumn("weight", F.lit(1.0)).coalesce(tasks)
    if not total or not targets:
        return table, 0.0
    aims = {d: f"wanted_{d}" for d in targets}
    for dimension, target in targets.items():
        wanted = _wanted(cells, dimension, target, total).withColumnRenamed("wanted", aims[dimension])
        table = saved(table.join(wanted.coalesce(tasks).hint("shuffle_hash"), dimension), "targets").coalesce(tasks)
    worst, before = float("inf"), float("inf")
    for sweep in range(1, max_sweeps + 1):
        met = 0.0
        for dimension, aim in aims.items():
            # The gap that a scaling meets comes with its rows; what the sweep left is measured once it is small.
            seen = Observation()
            scaled = _scaled(table, dimension, aim).observe(seen, F.max("gap").alias("gap"))
            table = saved(scaled.drop("gap"), "raked").coalesce(tasks)
            met = max(met, seen.get["gap"] or 0.0)
        settled = abs(met - before) <= 1e-3 * tolerance * total
        before = met
        if met <= tolerance * total or settled or sweep == max_sweeps:
            worst = _widest_gap(table, aims) / total
            if settled or worst <= tolerance:
                break
    return table.select(*cells.columns, "weight"), worst


def _scaled(table: DataFrame, dimension: str, aim: str) -> DataFrame:
    """Weights scaled to the targets of one dimension, and in ``gap`` what its keys were off before."""
    sums = table.groupBy(dimension).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass"))
    factor = F.when(F.col("mass") > 0, F.col(aim) / F.col("mass")).otherwise(0.0)
    # Sums have one row for each key; joined by hash, for a broadcast would pass through the driver each time.
    rows = table.join(sums.hint("shuffle_hash"), dimension)
    return rows.withColumns({"weight": F.col("weight") * factor, "gap": F.abs(F.col("mass") - F.col(aim))}).drop("mass")


def _widest_gap(table: DataFrame, aims: dict[str, str]) -> float:
    """The largest difference between the weighted tokens of a key and what it shall have."""
    mass = F.sum(F.col("tokens") * F.col("weight"))
    gaps = [table.groupBy(d).agg(F.abs(mass - F.first(aim)).alias("gap")).agg(F.max("gap")).first()[0] for d, aim in aims.items()]
    return max((g for g in gaps if g is not None), default=0.0)


def _wanted(cells: DataFrame, dimension: str, target: DataFrame, total: int) -> DataFrame:
    """``dimension, wanted``: the tokens that each key shall have."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens"))
    target = target.groupBy(F.col("key").alias(dimension)).agg(F.max("share").alias("share"))
    rows = saved(sums.join(target, dimension, "left"), "wanted")
    given, rest = rows.agg(
        F.coalesce(F.sum("share"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("share").isNull(), F.col("tokens"))), F.lit(0))
    ).first()
    left = max(1.0 - given, 0.0) if rest else 0.0
    share = F.coalesce(F.col("share"), F.col("tokens") * F.lit(left / max(rest, 1)))
    whole = given + left
    return rows.select(dimension, (share * F.lit(total / whole if whole else 0.0)).alias("wanted"))


def probabilities(cells: DataFrame, keep_share: float) -> DataFrame:
    """``cells`` with ``probability``: proportional to ``weight`` up to one, ``keep_share`` of the tokens in all.

    Where cells with a weight have fewer tokens than that, all of them are taken.
    """
    budget = keep_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    taken, scale = -1, 0.0
    while True:
        over = F.col("weight") * scale >= 1
        row = cells.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)).alias("whole"),
            F.coalesce(F.sum(F.when(~over, F.col("tokens") * F.col("weight"))), F.lit(0.0)).alias("mass"),
        ).first()
        if row.n == taken or not row.mass:
            break
        # Each round takes more cells whole, and what they cannot give is spread over the others.
        taken, scale = row.n, max(scale, (budget - row.whole) / row.mass)
    return cells.withColumn("probability", F.least(F.col("weight") * scale, F.lit(1.0)))


def drawn(probability: Column, seed: int, id_col: str = "doc_id") -> Column:
    """Whether a document is drawn; rows with the same id share their fate."""
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.shiftrightunsigned(place, 11) * F.lit(2.0**-53) < probability


def calibrated_cells(features: DataFrame, exponent: float, keep_share: float, topic_shares: dict[str, float]) -> DataFrame:
    """``source_key, lang_key, topic, tokens, weight, probability, margin_gap`` for tempered sources and languages."""
    cells = cell_table(features)
    shares = features.sparkSession.createDataFrame(list(topic_shares.items()), "key string, share double")
    targets = {d: tempered(cells, d, exponent) for d in DIMENSIONS[:2]} | {"topic": shares}
    raked, gap = rake(cells, targets)
    return saved(probabilities(raked, keep_share).withColumn("margin_gap", F.lit(gap)), "calibrated")


#: Production targets: sources and languages are evened out, and legal lines and tables held down.
EXPONENT, KEEP_SHARE, TOPIC_SHARES, SEED = 0.8, 0.8, {"legal": 0.05, "contact": 0.05, "tabular": 0.02}, 11


def mix(
    docs: DataFrame,
    exponent: float = EXPONENT,
    keep_share: float = KEEP_SHARE,
    topic_shares: dict[str, float] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, n_tokens, weight, probability, kept, margin_gap``.

    ``margin_gap`` is the share of all tokens by which the worst margin misses its target: next to nothing,
    unless targets contradict each other, as those of sources and languages do where each source has but
    one language. NULL for documents in no cell. ``weight`` is what a token of the document's cell counts after raking (1: as before), and
    ``kept`` whether the document is drawn. Documents without tokens (NULL or blank texts) are in no
    cell: weight and probability zero, never drawn. NULL sources and languages are keys of their own.
    Other columns are ignored.
    """
    features = docs.select("doc_id", "source", "lang", *keyed(docs), token_count().alias("n_tokens"))
    features = saved(features, "mix-features")
    cells = calibrated_cells(features, exponent, keep_share, TOPIC_SHARES if topic_shares is None else topic_shares)
    rows = features.join(cells.drop("tokens"), list(DIMENSIONS), "left")
    known = F.col("n_tokens") > 0
    probability = F.when(known, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return rows.select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "n_tokens",
        F.when(known, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("weight"),
        probability.alias("probability"),
        drawn(probability, seed).alias("kept"),
        F.when(known, F.col("margin_gap")).alias("margin_gap"),
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` draws, with all their columns."""
    features = docs.select(*keyed(docs), token_count().alias("n_tokens"))
    cells = calibrated_cells(features, EXPONENT, KEEP_SHARE, TOPIC_SHARES)
    cells = cells.select(F.struct(*DIMENSIONS).alias("cell"), F.struct("probability").alias("drawn_with"))
    mine = docs.select(F.struct("*").alias("doc"), F.struct(*keyed(docs)).alias("cell"))
    rows = mine.join(cells, "cell").select("doc.*", F.col("drawn_with.probability").alias("drawn_with"))
    return rows.where(drawn(F.col("drawn_with"), seed)).select(*docs.columns)
