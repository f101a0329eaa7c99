"""The training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again before
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import Registry
from skyframe.llm import decontaminate, mixing, quality, sharding, simhash
from skyframe.llm.common import fresh, saved


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh(docs, "score")
    return quality.classify(docs, quality.train(docs, labels), score_col=score).where(F.col(score) >= 0.5).drop(score)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a written key of each row, and its name: ids may be NULL or repeat."""
    key = fresh(docs, "row")
    return saved(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, once; a NULL id only if there is no other."""
    rows, key = _keyed(docs)
    place = fresh(rows, "place")
    placed = rows.withColumn(place, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("row")))
    groups = simhash.near_duplicates(placed, id_col=place)
    first = groups.select(F.col("component_id.row").alias(key)).distinct()
    return rows.join(first, key, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, key = _keyed(docs)
    leaked = decontaminate.leaks(rows, benchmark, id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(saved(leaked, "leaked"), key, "left_anti").select(*docs.columns)


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the calibrated probabilities of their cell."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document that is left."""
    return sharding.interleave(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", draw_mixture),
    ("sharding", deal_shards),
]

#: The classifier, the fingerprints and the raking are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


registry = Registry()
registry.add("pipeline", run, ORACLE_SQL)
