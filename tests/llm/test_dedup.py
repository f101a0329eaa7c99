"""Exact groups, near-duplicate components and their parts against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from skyframe.llm import exact_dedup, simhash
from skyframe.llm.common import saved
from skyframe.llm.components import connected_components

SCHEMA = "doc_id long, text string, digit string, rest string, print long, root long"
LONG = "word " * 60_000


def frame(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", 7, 7) for i, t in rows], SCHEMA)


EDGE_ROWS = [
    (1, None), (2, ""), (3, "a"), (4, "a"), (None, "a"), (5, "A"), (6, "a "), (6, "a "), (7, LONG), (8, LONG),
    (9, LONG + "x"), (10, "é" * 64), (11, "é" * 64), (12, "b" * 128), (13, "b" * 128), (14, "b" * 129), (6, "other"),
]


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(frame(spark, EDGE_ROWS), first_width=4, widening=8).collect()
    groups = defaultdict(list)
    for i, t in EDGE_ROWS:
        groups[t or ""].append(i)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), sha) for i in ids]
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
        assert [r.doc_id for r in got if r.text_sha256 == sha and r.kept] == [keep]
    rows = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_exact_groups_do_not_depend_on_the_digits(spark):
    docs = frame(spark, EDGE_ROWS)
    cuts = [(1, 16), (128, 16), (1000, 1000)]
    assert len({str(sorted(map(str, exact_dedup.exact_groups(docs, "doc_id", "text", *c).collect()))) for c in cuts}) == 1


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_cells_around_a_print_are_not_broadcast(spark):
    prints = saved(spark.range(1000).select(F.xxhash64("id").alias("print")), "prints")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def slow_print(text):
    """By the contract, bit by bit."""
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "a b c a b c a b c", "É x\u00a0y z\tw", "İ ß a b"])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode()) == slow_print(text)


def test_fingerprint_of_a_text_beyond_one_block():
    text = " ".join(str(k % 7) for k in range(simhash.BLOCK + 500))
    assert simhash.fingerprint_of(text.encode()) == slow_print(text)


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(8):
            flips = rng.sample(range(64), rng.randint(1, 5))
            if rng.random() < 0.5:  # all in one half, or in one segment
                flips = [f % 32 for f in flips]
            x = base
            for f in flips:
                x ^= 1 << f
            prints.add(x)
    rows = [as_long(x) for x in prints]
    got = simhash.links(spark.createDataFrame([(x,) for x in rows], "print long"))
    want = {(max(a, b), min(a, b)) for a in rows for b in rows if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def roots_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(120), 2), reverse=True)) for _ in range(70)}
    edges |= {(k + 1, k) for k in range(200, 260)} | {(k, 300) for k in range(301, 340)}  # a chain and a star
    got = connected_components(spark.createDataFrame(sorted(edges), "high long, low long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == roots_of(edges)


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello there"), (5, "hello\tTHERE"), (None, "hello there"), (6, LONG), (7, LONG + "x")]
    for k in range(12):
        text = [rng.choice(words) for _ in range(400)]
        rows.append((100 + 10 * k, " ".join(text)))
        for n in range(1, 6):
            text[rng.randrange(400)] = "new"
            rows.append((100 + 10 * k + n, " ".join(text)))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [(i, slow_print(t or "")) for i, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 3]
    roots = roots_of(linked + [(a, a) for a in range(len(rows))])
    smallest = {r: min((prints[a][0] for a in roots if roots[a] == r and prints[a][0] is not None), default=None) for r in set(roots.values())}
    want = [(i, f"{p:016x}", smallest[roots[a]]) for a, (i, p) in enumerate(prints)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    degree = {p: len({q for _, q in prints if q != p and (p ^ q).bit_count() <= 3}) for _, p in prints}
    assert all(r.n_links == degree[int(r.fingerprint, 16)] for r in got)


def test_fingerprints_equal_the_query_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: slow_print(r.text or "") for r in docs.select("doc_id", "text").collect()}
    got = simhash.fingerprints(docs).withColumn("hex", F.hex("print")).collect()
    assert {r.doc_id: int(r.hex, 16) for r in got} == want
