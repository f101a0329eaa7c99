"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, card and phone numbers. The field then reads every word that
holds a digit or an at sign. Its labels are the four kinds and "none"; its edges join such words that
follow each other, and, over any distance, each such word to the next one in the document that is alike
(the same digits, or the same letters in any case). Words inside pattern spans are observed; loopy belief
propagation carries their labels to the others, so a number that a pattern finds in one place is also
found where it is written in another way. Runs of equally labelled words become further spans.

The weights of word shapes, of neighbours and of alike words are fitted together, by the
pseudo-likelihood of the pattern labels, on a bounded sample of documents (``max_documents``, of at most
``max_chars`` characters each, until there are ``max_words`` words). All documents are then read whole in
one pass without a shuffle. Words are kept in flat arrays and texts are judged in blocks of words, so a
task needs some 200 bytes for each word with a digit of its longest text.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skyframe.llm.common import hash_sample, text_or_empty

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = len(KINDS) + 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Repeated groups are possessive: the same matches, without a stack that grows with their length.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that fails at the first digit of a run fails at the others too, so each run is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches without overlap, looked for at each at sign: no run of letters is read twice."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, 0, m.end()
        last = m.end() if m else last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """``(start, kind, end)`` in order: what the patterns find and the checks let pass."""
    if not _HINT.search(text):
        return []
    found = list(_emails(text))
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") or "0" for p in m.group().split("."))
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# The field ---------------------------------------------------------------------------------------

#: Hashed features of a word.
WIDTH = 512
#: Shorter words say nothing by being alike.
SHORTEST_ALIKE = 4
_EDGES = "\"'`.,;:!?()[]{}<>|*#$%&"


#: Words, or edges, that are worked on together.
BLOCK = 65_536


def _numbers(code: str):
    return dataclasses.field(default_factory=lambda: array(code))


@dataclasses.dataclass
class Graph:
    """The words of some documents: spans, features, observed labels (-1: none) and edges, all as flat arrays."""

    document: Sequence[int] = _numbers("i")
    start: Sequence[int] = _numbers("i")
    end: Sequence[int] = _numbers("i")
    features: Sequence[int] = _numbers("H")
    observed: Sequence[int] = _numbers("b")
    chain: Sequence[int] = _numbers("i")
    skip: Sequence[int] = _numbers("i")

    def feature_rows(self) -> np.ndarray:
        return np.asarray(self.features).reshape(len(self.start), -1)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words, the earlier one first, and whether they are joined by a skip edge."""
        chain, skip = (np.asarray(edges, np.int32).reshape(-1, 2) for edges in (self.chain, self.skip))
        return np.concatenate([chain, skip]), np.repeat([False, True], [len(chain), len(skip)])


def _shape(word: str) -> str:
    return "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in word)


def _features(word: str) -> list[int]:
    digits, shape = _digits(word), _shape(word)
    parts = word.split(".")
    names = [
        "bias",
        "shape " + (shape if len(shape) <= 24 else "long"),
        "kinds " + re.sub(r"(.)\1+", r"\1", shape)[:40],
        f"digits {min(len(digits), 20)}",
        f"at {'@' in word}",
        f"plus {word.startswith('+')}",
        f"card {12 <= len(digits) <= 19 and _luhn(digits)} {len(digits) == sum(c not in ' -' for c in word)}",
        f"address {len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}",
    ]
    return [zlib.crc32(n.encode()) % WIDTH for n in names]


def _alike(word: str) -> str:
    """Words with the same key are alike: by their digits if there are enough, else by their letters."""
    digits = _digits(word)
    return digits if len(digits) >= 4 and "@" not in word and not any(c.isalpha() for c in word) else word.casefold()


def add_document(graph: Graph, number: int, text: str, base: list[Span]) -> None:
    """Append the words of a text that hold a digit or an at sign."""
    last_word, seen, k, at = None, {}, 0, 0
    while m := _HINT.search(text, at):
        start = max(at, m.start())
        while start > at and not text[start - 1].isspace():
            start -= 1
        word = _WORD.match(text, start)
        at = word.end()
        a, b = start, word.end()
        while a < b and text[a] in _EDGES and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGES and text[b - 1] != ")":
            b -= 1
        while k < len(base) and base[k][0] < b:
            k += 1
        inside = [x for x in base[max(0, k - 4) : k] if x[0] < b and x[2] > a]
        node = len(graph.start)
        graph.document.append(number)
        graph.start.append(a)
        graph.end.append(b)
        graph.features.extend(_features(text[a:b]))
        graph.observed.append(inside[0][1] if inside else -1)
        if last_word is not None and not text[last_word:start].strip():
            graph.chain.extend((node - 1, node))
        last_word = word.end()
        key = _alike(text[a:b])
        if len(key) >= SHORTEST_ALIKE:
            if key in seen:
                graph.skip.extend((seen[key], node))
            seen[key] = node


def graph_of(texts: list[str], bases: list[list[Span]]) -> Graph:
    graph = Graph()
    for number, (text, base) in enumerate(zip(texts, bases, strict=True)):
        add_document(graph, number, text, base)
    return graph


@dataclasses.dataclass
class Field:
    """``unary``: features x labels; ``chain`` and ``skip``: label x label, for edges of either kind."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit_field(graph: Graph, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Weights of the largest pseudo-likelihood of the observed labels.

    Words without one count as "none", unless they are alike to an observed word: such a word has the
    same label and half the weight. That is the consistency which the field shall learn to keep.
    """
    n = len(graph.start)
    pairs, skip = graph.links()
    observed = np.array(graph.observed, np.int64)
    labels = observed.copy()
    alike = pairs[skip].tolist()
    for links in (alike, [(b, a) for a, b in reversed(alike)]):  # from first to last, and back
        for a, b in links:
            if labels[b] < 0:
                labels[b] = labels[a]
    weight = np.where((observed < 0) & (labels >= 0), 0.5, 1.0).astype(np.float32)[:, None]
    labels[labels < 0] = NONE
    features = np.sort(graph.feature_rows(), axis=1) if n else np.zeros((0, 1), np.int64)
    once = np.ones(features.shape, np.float32)
    once[:, 1:] = features[:, 1:] != features[:, :-1]  # a feature that is met twice counts once
    around = np.zeros((n, 3 * LABELS), np.float32)  # labels of the word before, of the one after, of alike words
    a, b = pairs.T
    np.add.at(around, (b, np.where(skip, 2 * LABELS, 0) + labels[a]), 1)
    np.add.at(around, (a, np.where(skip, 2 * LABELS, LABELS) + labels[b]), 1)
    wanted = np.eye(LABELS, dtype=np.float32)[labels]
    weights = np.zeros((WIDTH + 3 * LABELS, LABELS), np.float32)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1 if n else 1):  # Adam on the whole sample
        score = around @ weights[WIDTH:]
        for k in range(features.shape[1]):
            score += weights[features[:, k]] * once[:, k, None]
        wrong = weight * (_softmax(score) - wanted)
        own = [np.bincount(features.ravel(), (once * wrong[:, y, None]).ravel(), WIDTH) for y in range(LABELS)]
        slope = np.concatenate([np.stack(own, axis=1), around.T @ wrong]).astype(np.float32) / n + decay * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    before, after, alike = (weights[WIDTH + k * LABELS : WIDTH + (k + 1) * LABELS] for k in range(3))
    return Field(weights[:WIDTH], (before + after.T) / 2, (alike + alike.T) / 2)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _blocks(n: int) -> Iterator[slice]:
    return (slice(at, at + BLOCK) for at in range(0, n, BLOCK))


def _sent(inner: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Messages over edges from what their sources believe without them."""
    scores = inner[:, :, None] + potential
    top = scores.max(axis=1, keepdims=True)
    new = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
    return new - new.max(axis=1, keepdims=True)


def beliefs(graph: Graph, field: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label probabilities of every word by loopy sum-product; all documents of the graph at once.

    Words and edges are worked on in blocks; all messages of a round rest on those of the round before.
    """
    n = len(graph.start)
    unary = np.zeros((n, LABELS), field.unary.dtype)
    if not n:
        return unary
    features, observed = graph.feature_rows(), np.asarray(graph.observed)
    for cut in _blocks(n):
        unary[cut] = field.unary[features[cut]].sum(1)
    known = np.flatnonzero(observed >= 0)
    unary[known] = -50.0
    unary[known, observed[known]] = 0.0
    pairs, skip = graph.links()
    there, back = (np.zeros((len(pairs), LABELS), unary.dtype) for _ in range(2))

    def add_messages(total: np.ndarray) -> np.ndarray:
        for cut in _blocks(len(pairs)):
            np.add.at(total, pairs[cut, 1], there[cut])
        for cut in _blocks(len(pairs)):
            np.add.at(total, pairs[cut, 0], back[cut])
        return total

    for _ in range(rounds if len(pairs) else 0):
        total = add_messages(unary.copy())
        for cut in _blocks(len(pairs)):
            a, b = pairs[cut].T
            potential = np.where(skip[cut, None, None], field.skip, field.chain).astype(unary.dtype)
            new = _sent(total[a] - back[cut], potential), _sent(total[b] - there[cut], potential.swapaxes(1, 2))
            there[cut], back[cut] = (damping * old[cut] + (1 - damping) * m for old, m in zip((there, back), new, strict=True))
    return _softmax(add_messages(unary))


#: Digits that a further span of a kind must have; an e-mail address needs an at sign instead.
_LEAST, _MOST = (0, 4, 12, 7), (99, 12, 19, 15)


def further_spans(texts: list[str], graph: Graph, chances: np.ndarray, threshold: float) -> list[list[Span]]:
    """Runs of words, next to each other, that have one kind with at least ``threshold`` and no pattern span."""
    out: list[list[Span]] = [[] for _ in texts]
    if not len(chances):
        return out
    label = np.where(chances.max(1) >= threshold, chances.argmax(1), NONE)
    label[np.asarray(graph.observed) >= 0] = NONE
    joined = np.zeros(len(label) + 1, bool)  # to the word before
    joined[np.asarray(graph.chain, np.int32)[1::2]] = True
    done = -1
    for first in np.flatnonzero(label != NONE).tolist():
        if first <= done:
            continue
        kind, done = int(label[first]), first
        while kind == 3 and joined[done + 1] and label[done + 1] == kind:
            done += 1
        number = graph.document[first]
        start, end = graph.start[first], graph.end[done]
        written = texts[number][start:end]
        fits = "@" in written if kind == 0 else _LEAST[kind] <= len(_digits(written)) <= _MOST[kind]
        if fits:
            out[number].append((start, kind, end))
    return out


def fit_on_documents(
    docs: DataFrame,
    max_documents: int = 2000,
    max_chars: int = 20_000,
    max_words: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Field:
    """The field, fitted on the documents with the smallest hash among those with a digit or an at sign.

    Documents are taken as long as the sample has fewer than ``max_words`` words, which bounds its memory.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.where((F.char_length("text") <= max_chars) & F.col("text").rlike("[0-9@]"))
    graph = Graph()
    for number, row in enumerate(hash_sample(rows, max_documents, "doc_id", "text").collect()):
        if len(graph.start) >= max_words:
            break
        add_document(graph, number, row.text, base_spans(row.text))
    return fit_field(graph)


def judged(texts: list[str], field: Field, threshold: float) -> Iterator[tuple[list[Span], list[Span]]]:
    """Pattern spans and further spans of each text; so many texts are judged together as make up a block."""
    at = 0
    while at < len(texts):
        graph, bases, first = Graph(), [], at
        while at < len(texts) and len(graph.start) < BLOCK:
            bases.append(base_spans(texts[at]))
            add_document(graph, at - first, texts[at], bases[-1])
            at += 1
        more = further_spans(texts[first:at], graph, beliefs(graph, field), threshold)
        yield from zip(bases, more, strict=True)


def find_personal_data(
    docs: DataFrame,
    field: Field | None = None,
    threshold: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
    **sample,
) -> DataFrame:
    """One row per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and the digest are those of the pattern spans, ``spans`` has them and the field's. Offsets
    count characters (code points), the end is exclusive. NULL texts count as empty and have no spans;
    repeated rows are judged one by one. Other columns are ignored. ``sample`` goes to the fit, if no
    field is given.
    """
    field = field or fit_on_documents(docs, id_col=id_col, text_col=text_col, **sample)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            rows = []
            for base, extra in judged(series.tolist(), shared.value, threshold):
                counts = [sum(s[1] == kind for s in base) for kind in range(NONE)]
                digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
                rows.append((*counts, digest, spans_text(sorted({*base, *extra}))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), found(text_or_empty(text_col)).alias("found"))
    return rows.select("doc_id", "found.*")
