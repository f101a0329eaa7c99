"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted as hashed byte trigrams, hashed four-grams of character classes (capital, small,
digit, blank, other letter, and each mark for itself) and words that repeat the one before. Counts are damped, weighted by inverse document
frequency and normalised; a truncated singular value decomposition of the labelled texts gives the
latent space. Every document is projected, its cosines with all labelled vectors are computed in
blocks, and the nearest ones vote with their similarity.

The labelled texts are a bounded sample (``max_labelled``), and so are the two arrays that are
broadcast: terms x dimensions and labelled texts x dimensions. Everything else is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import dataclasses
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from skyframe.llm.common import hash_sample, text_or_empty

#: Hashed byte trigrams, hashed class four-grams, and terms that stand for a repeated word, which weighs as much.
BYTE_TERMS, CLASS_TERMS, REPEAT_TERMS = 4096, 2048, 32
TERMS = BYTE_TERMS + CLASS_TERMS + REPEAT_TERMS
#: Bytes of a text that are counted at a time, and documents that are projected at a time.
PIECE, BLOCK = 1 << 20, 128

_CLASSES = np.arange(256, dtype=np.uint32)
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("a") : ord("z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[128:] = 5


def _hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - bits)


def term_counts(text: bytes) -> np.ndarray:
    """How often each hashed term occurs in the whole text."""
    counts = np.zeros(TERMS, np.int64)
    for k in range(0, max(len(text) - 2, 0), PIECE):
        b = np.frombuffer(text, np.uint8)[k : k + PIECE + 3]
        x = b.astype(np.uint32)
        # Each piece reads on into the next one; the four-grams that this repeats are left out.
        grams = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[:PIECE]
        counts[:BYTE_TERMS] += np.bincount(_hashed(grams, 12), minlength=BYTE_TERMS)
        c = _CLASSES[b]
        grams = (c[:-3] << 24 | c[1:-2] << 16 | c[2:-1] << 8 | c[3:])[:PIECE]
        counts[BYTE_TERMS:-REPEAT_TERMS] += np.bincount(_hashed(grams, 11), minlength=CLASS_TERMS)
    words = text.split()
    counts[-REPEAT_TERMS:] = sum(map(operator.eq, words, words[1:]))
    return counts


@dataclasses.dataclass
class Model:
    """``project``: terms x dimensions, idf included; ``vectors``: labelled texts in the latent space."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: int

    def embed(self, texts: list[bytes]) -> np.ndarray:
        """Unit vectors; zero for texts too short to have a term."""
        weights = np.log1p(np.array([term_counts(t) for t in texts], np.float32).reshape(-1, TERMS))
        return _unit(weights @ self.project)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The labels of the nearest neighbours, weighted by similarity; without any, the share of label 1."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            cosines = self.embed(texts[a : a + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.clip(np.take_along_axis(cosines, near, 1), 0, 1).astype(np.float64) ** self.power
            total = votes.sum(1)
            share = (votes * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[a : a + BLOCK] = np.where(total > 0, np.clip(share, 0, 1), prior)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def fit_counts(
    counts: np.ndarray,
    labels: list[int],
    dimensions: int = 64,
    neighbours: int = 15,
    power: int = 8,
    seed: int = 7,
) -> Model:
    """The latent space of labelled texts, given as term counts, and their vectors in it.

    Leading right singular vectors by randomised subspace iteration. ``counts`` is damped in place and
    its weighted form is never written out, which keeps the driver's memory at one such array.
    """
    logs = np.log1p(counts, out=counts) if counts.dtype == np.float32 else np.log1p(counts.astype(np.float32))
    idf = (np.log((1 + len(logs)) / (1 + np.count_nonzero(logs, axis=0))) + 1).astype(np.float32)
    norms = np.sqrt(np.array([np.square(row * idf).sum() for row in logs], np.float32))[:, None]
    norms[norms == 0] = 1
    basis = np.random.default_rng(seed).standard_normal((TERMS, dimensions + 16)).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(idf[:, None] * (logs.T @ (logs @ (idf[:, None] * basis) / norms**2)))
    _, _, right = np.linalg.svd(logs @ (idf[:, None] * basis) / norms, full_matrices=False)
    project = (idf[:, None] * (basis @ right.T)[:, :dimensions]).astype(np.float32)
    return Model(project, _unit(logs @ project).astype(np.float32), np.array(labels, np.float64), neighbours, power)


def held_out(id_col: str = "doc_id"):
    """Rows kept for judging: crc32 of the id as text leaves 1 when divided by 3 (NULL ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **options,
) -> Model:
    """Fit on at most ``max_labelled`` labelled documents that are not held out.

    The ids with the smallest hash are taken; an id with several labels counts with the largest, one
    with several texts with each of them, up to ``max_labelled`` in all. NULL labels and ids are left
    out. Texts are counted by the executors, and the driver gets their texts' non-zero terms only.
    """
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("known_id")).agg(F.max(label_col).cast("int").alias("known_label"))
    known = hash_sample(known, max_labelled, "known_id")
    rows = docs.select(F.col(id_col).alias("known_id"), text_or_empty(text_col).alias("known_text"))
    rows = rows.join(F.broadcast(known), "known_id")  # at most max_labelled rows

    @pandas_udf("terms array<int>, counts array<int>")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            found = [term_counts(t.encode()) for t in texts]
            at = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame({"terms": at, "counts": [c[a] for c, a in zip(found, at, strict=True)]})

    rows = rows.select("known_id", "known_label", counted("known_text").alias("found"))
    rows = rows.orderBy(F.xxhash64("known_id"), "known_id", F.xxhash64("found.terms", "found.counts")).limit(max_labelled)
    got = rows.select("known_label", "found.terms", "found.counts").toArrow()
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    for row in range(got.num_rows):
        counts[row, got["terms"][row].values.to_numpy()] = got["counts"][row].values.to_numpy()
    return fit_counts(counts, got["known_label"].to_pylist(), **options)


def classify(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``score_col`` (0 to 1), computed from the text alone.

    NULL texts count as empty; texts too short for a term get the share of label 1 in the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf(T.DoubleType())
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shared.value.scores([t.encode() for t in texts]))

    return docs.select("*", scored(text_or_empty(text_col)).alias(score_col))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = train(docs, labels, **options)
    rows = docs.select("doc_id", "text")
    return classify(rows, model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
