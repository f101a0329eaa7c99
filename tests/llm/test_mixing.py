"""Raking against NumPy, probabilities, and drawing."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, topic string, weight double, probability double, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 0.5, 0.5, "c") for r in rows], SCHEMA)


def plain_rake(tokens, targets, sweeps=500):
    w = np.ones_like(tokens)
    for _ in range(sweeps):
        for axis, target in enumerate(targets):
            mass = (tokens * w).sum(tuple(a for a in range(3) if a != axis))
            factor = np.divide(target * tokens.sum(), mass, out=np.zeros_like(mass), where=mass > 0)
            w = w * factor.reshape([-1 if a == axis else 1 for a in range(3)])
    return w


def test_raking(spark):
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 500, (4, 3, 2)).astype(float)
    tokens[0, 0, 0] = 100_000  # a hot cell
    tokens[1, 2, 1] = 0
    shares = [np.array(x) / sum(x) for x in ([1, 2, 3, 4], [5, 1, 1], [3, 2])]
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(n)) for (a, b, c), n in np.ndenumerate(tokens) if n]
    frame = spark.createDataFrame(cells, "source_key string, lang_key string, topic string, tokens long")
    targets = {
        d: spark.createDataFrame([(f"{d[0]}{k}", float(x)) for k, x in enumerate(s)], "key string, share double")
        for d, s in zip(M.DIMENSIONS, shares, strict=True)
    }
    got, worst = M.rake(frame, targets)
    want = plain_rake(tokens, shares)
    for r in got.collect():
        assert r.weight == pytest.approx(want[int(r.source_key[1]), int(r.lang_key[1]), int(r.topic[1])], rel=1e-3)
    assert worst <= 1e-6


def test_keys_without_a_target_share_the_rest(spark):
    cells = spark.createDataFrame([("a", "l", "t", 10), ("b", "l", "t", 30), ("c", "l", "t", 60)], "source_key string, lang_key string, topic string, tokens long")
    target = spark.createDataFrame([("c", 0.2), ("none", 0.3)], "key string, share double")
    got, worst = M.rake(cells, {"source_key": target})
    assert {r.source_key: round(r.tokens * r.weight, 6) for r in got.collect()} == {"a": 20, "b": 60, "c": 20}
    assert worst < 1e-6


def test_no_targets_and_targets_that_contradict(spark):
    cells = spark.createDataFrame([("a", "l", "t", 10), ("b", "m", "t", 30)], "source_key string, lang_key string, topic string, tokens long")
    got, worst = M.rake(cells, {})
    assert {r.source_key: r.weight for r in got.collect()} == {"a": 1.0, "b": 1.0} and worst == 0.0
    shares = [{"a": 0.5, "b": 0.5}, {"l": 0.25, "m": 0.75}]
    targets = {
        d: spark.createDataFrame(list(s.items()), "key string, share double") for d, s in zip(M.DIMENSIONS, shares, strict=False)
    }
    got, worst = M.rake(cells, targets, max_sweeps=3)
    # The last dimension holds, the sources are 10 of 40 tokens off.
    assert {r.lang_key: round(r.tokens * r.weight, 6) for r in got.collect()} == {"l": 10, "m": 30}
    assert worst == pytest.approx(0.25) and got.columns == [*cells.columns, "weight"]


def test_probabilities_meet_the_budget(spark):
    cells = spark.createDataFrame([(100, 5.0), (1000, 1.0), (500, 0.1), (50, 0.0)], "tokens long, weight double")
    for share, whole in ((0.5, False), (0.9, False), (1.0, True)):
        rows = M.probabilities(cells, share).collect()
        expected = sum(r.tokens * r.probability for r in rows)
        assert expected == pytest.approx(1600 if whole else share * 1650) and all(0 <= r.probability <= 1 for r in rows)
        free = [r.probability / r.weight for r in rows if 0 < r.probability < 1]
        assert max(free, default=1) == pytest.approx(min(free, default=1))


def mixed_rows():
    rows = []
    for k in range(3000):
        source = "hot" if k % 3 == 0 else f"s{k % 5}"
        text = "plain words " * (k % 17 + 1) + ("All rights reserved." if k % 9 == 0 else "")
        rows.append((k, text, ["en", "de", None][k % 3 if k % 4 else 0], source if k % 50 else None))
    return rows


def test_mix(spark):
    docs = frame(spark, mixed_rows())
    got = M.mix(docs).collect()
    rows = {i: (t, lang, s) for i, t, lang, s in mixed_rows()}
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    assert all(r.n_tokens == len(rows[r.doc_id][0].split()) and (r.lang, r.source) == rows[r.doc_id][1:] for r in got)
    observed, mass = defaultdict(float), defaultdict(float)
    for r in got:
        for dimension in ("source", "lang", "topic"):
            observed[dimension, r[dimension]] += r.n_tokens
            mass[dimension, r[dimension]] += r.n_tokens * r.weight
    for dimension in ("source", "lang"):
        keys = [k for k in observed if k[0] == dimension]
        raised = {k: observed[k] ** M.EXPONENT for k in keys}
        for k in keys:
            assert mass[k] / total == pytest.approx(raised[k] / sum(raised.values()), abs=1e-5)
    assert mass["topic", "legal"] / total == pytest.approx(0.05 / (0.05 + 0.95), abs=1e-5)
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(0.8 * total, rel=1e-6)
    assert sum(r.n_tokens for r in got if r.kept) == pytest.approx(0.8 * total, rel=0.03)
    again = {r.doc_id: r.kept for r in M.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.kept for r in got}


def test_mixed_documents_are_those_drawn(spark):
    docs = frame(spark, mixed_rows())
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in M.mix(docs).where("kept").collect()}


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "  ", "en", "a"), (None, "some words", None, None), (3, "w " * 200_000, "de", "b"), (3, "x", "de", "b")]
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == 5
    assert {(r.weight, r.probability, r.kept) for r in got if r.doc_id in (1, 2)} == {(0.0, 0.0, False)}
    assert all(0 < r.probability <= 1 for r in got if r.doc_id not in (1, 2))
    assert M.mix(frame(spark, rows[:2])).where("kept").count() == 0
    assert M.mix(frame(spark, [])).count() == 0 == M.mixed_documents(frame(spark, [])).count()


@pytest.mark.parametrize(
    "text, topic",
    [("All Rights Reserved", "legal"), ("mail x.y@z.org", "contact"), ("a | b | c", "tabular"), ("a | b", "prose"), ("", "prose")],
)
def test_topics(spark, text, topic):
    assert spark.createDataFrame([(text,)], "t string").select(M.topic_of(F.col("t"))).first()[0] == topic


def test_targets_that_contradict_show_in_the_result(spark):
    """Each source has one language, so tempered sources and languages cannot both hold."""
    rows = [(k, "some plain words here", ["en", "en", "de"][k % 10 // 4], ["a", "b", "c"][k % 10 // 4]) for k in range(200)]
    gaps = {r.margin_gap for r in M.mix(frame(spark, rows)).collect()}
    assert len(gaps) == 1 and 0.001 < gaps.pop() < 0.2
    agreed = [(k, "some plain words here", ["en", "de"][k % 2], ["a", "b"][k % 4 // 2]) for k in range(200)]
    assert all(r.margin_gap <= 1e-6 for r in M.mix(frame(spark, agreed)).collect())
