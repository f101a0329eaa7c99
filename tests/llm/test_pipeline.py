"""The stages of the corpus pipeline on small and on odd documents."""

import pytest

import corpus_pipeline as C
from skyframe.llm import decontaminate, mixing, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_stage_order():
    assert [n for n, _ in C.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]


def test_stages_by_their_operators(spark, docs):
    """Every stage against what its operator says about all documents."""
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    groups = simhash.near_duplicates(docs).collect()
    leaked = {r.doc_id for r in decontaminate.leaks(docs, benchmark).collect()}
    drawn = {r.doc_id for r in mixing.mix(docs).where("kept").collect()}
    every = set(ids(docs))
    wants = (good, {r.component_id for r in groups}, every - leaked, drawn)
    for (_, stage), want in zip(C.STAGES, wants, strict=False):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert ids(got) == sorted(want)
    assert 0 < len(wants[0]) < len(every) and leaked


def test_run(spark, docs):
    got = C.run(spark, SF).collect()
    rows = {r.doc_id for r in got}
    assert len(rows) == len(got) < docs.count()
    assert sorted((r.shard, r.slot) for r in got) == sorted({(r.shard, r.slot) for r in got})


def test_odd_documents(spark):
    rows = [
        (None, None, None, None), (None, "a b c d", "en", "s"), (1, None, "en", "s"), (2, "", "en", "s"), (3, "same words here", "en", "s"),
        (3, "same words here", "en", "s"), (4, "Same words here", None, None), (5, "w " * 50_000, "en", "s"),
    ]
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, nth int")
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, odd, SF)
        assert got.columns == odd.columns and got.count() <= len(rows), name
        assert stage(spark, odd.where("false"), SF).count() == 0, name
    assert ids(C.keep_one_of_near_copies(spark, odd, SF)).count(3) == 1
    assert C.deal_shards(spark, odd, SF).count() == len(rows)


def test_rows_with_null_and_repeated_ids(spark, docs):
    """A row stands or falls by its own text, whatever its id and the rows that share it."""
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    half = item.index(" ", len(item) // 2)
    clean = "a few clean words about nothing that was ever asked anywhere"
    texts = [(None, item), (None, clean), (None, item[: half + 40]), (None, item[half - 40 :]), (7, item), (7, clean)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in C.drop_leaks(spark, rows, SF).collect()]
    assert sorted(got, key=str) == sorted((x for x in texts if x[1] != item), key=str)

    one, two, three = (r.text for r in docs.where("length(text) > 200").orderBy("doc_id").limit(3).collect())
    prints = {r.fingerprint for r in simhash.near_duplicates(docs.where(docs.text.isin(one, two, three))).collect()}
    assert len(prints) == 3
    one, two = sorted((one, two), reverse=True)
    rows = [(5, one), (5, two), (3, two), (None, three), (None, three), (None, two)]
    got = C.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, one), (3, two), (None, three)], key=str)
