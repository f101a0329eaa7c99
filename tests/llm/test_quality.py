"""The nearest-neighbour quality classifier: term counts, voting, held-out accuracy, odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import quality

SF = "/root/testdata/sf0.01"


def test_term_counts_do_not_depend_on_the_pieces(monkeypatch):
    text = ("Some text, 12 words! " * 50 + "é$$$").encode()
    whole = quality.term_counts(text)
    assert whole[: quality.BYTE_TERMS].sum() == len(text) - 2
    assert whole[quality.BYTE_TERMS : -quality.REPEAT_TERMS].sum() == len(text) - 3
    monkeypatch.setattr(quality, "PIECE", 97)
    assert (quality.term_counts(text) == whole).all()


@pytest.mark.parametrize("text", [b"", b"a", b"ab", b"abc", b"abcd"])
def test_short_texts_have_few_terms(text):
    assert quality.term_counts(text).sum() == max(0, len(text) - 2) + max(0, len(text) - 3)


def test_votes_are_those_of_a_plain_search():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "$$$", "gamma!!", "delta"], 30)).encode() for _ in range(60)]
    labels = rng.integers(0, 2, 60).tolist()
    counts = np.array([quality.term_counts(t) for t in texts])
    model = quality.fit_counts(counts, labels, dimensions=8, neighbours=5)
    probes = [*texts[:10], b"alpha beta", b""]
    got = model.scores(probes)
    for text, score in zip(probes, got, strict=True):
        v = model.embed([text])[0]
        cosines = sorted(((float(v @ u), y) for u, y in zip(model.vectors, labels, strict=True)), reverse=True)
        near = [(max(c, 0) ** model.power, y) for c, y in cosines[:5]]
        total = sum(w for w, _ in near)
        assert score == pytest.approx(sum(w * y for w, y in near) / total if total else np.mean(labels), abs=1e-3)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    judged = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in judged) >= 0.95 * len(judged)
    low = [p for p, q in judged if q == 0]
    assert sum(p == 0 for p in low) >= 0.6 * len(low)


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").where("doc_id < 300") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    schema = "doc_id long, text string, known_id long, quality_score double, found string"
    rows = [(1, None), (2, ""), (3, "x"), (None, "some text here"), (4, "w " * 100_000), (4, "w " * 100_000)]
    rows += [(k, "plain words in a row " * 5 if k % 2 else "$$$ !!! ### " * 9) for k in range(10, 60)]
    docs = spark.createDataFrame([(*r, 1, 0.5, "f") for r in rows], schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(10, 60)] + [(None, 1), (12, None), (10, 0)], "doc_id long, quality int")
    got = quality.score_documents(docs.drop("quality_score"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id and r.doc_id >= 10)
    prior = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(prior) == 1
    assert quality.score_documents(docs.where("false"), labels).count() == 0
    none = quality.score_documents(docs, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
