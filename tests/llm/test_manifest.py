"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skyframe.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The top of ``nodes``, and the siblings of each on the way."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % fanout
            run = nodes[first : first + fanout]
            proofs[i].append(("".join(run[: k - first]), "".join(run[k - first + 1 :])))
            at[i] = k // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def tree(rows, fanout):
    """``{(doc_id, leaf): (subroot, root, proof)}``, for rows that differ."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    first = lambda x: (x[0] is not None, x[0] or 0, x[1])
    built = {g: climb([x[1] for x in sorted(groups[g], key=first)], fanout) for g in names}
    root, upper = climb([built[g][0] for g in names], fanout)
    return {
        x: (built[g][0], root, built[g][1][i] + upper[k])
        for k, g in enumerate(names)
        for i, x in enumerate(sorted(groups[g], key=first))
    }


def committed(spark, rows, fanout, levels):
    df = spark.createDataFrame(rows, SCHEMA)
    leaf_of = M.leaf_digest(*(F.col(c) for c in M.FIELDS))
    leaves = df.select(M.key_of("lang").alias("grp"), F.col("doc_id").alias("ord"), leaf_of.alias("digest"), F.col("doc_id").alias("item"))
    return M.commit(leaves, fanout, levels)


ODD = [
    (None, None, None, None, None), (3, "s", "de", 0, ""), (3, "s", "de", 1, "x"), (1, "s", "de", 2, "Ab"), (2, None, None, 3, "é\n|"),
    (10, "s", "", 5, "a:b"), (9, "-", "", None, "w " * 300_000), (11, "s", "Zz", 1, "é"), (-4, "s", "ü", 1, "😀"),
]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (2, 2), (3, 2), (8, 3)])
def test_against_a_plain_tree(spark, fanout, levels):
    """Groups of one leaf up to several rounds of blocks, as many groups as make the crown recurse."""
    rows = [(i * 7 % 101, "s", lang, i, f"Text {i}") for n, lang in ((1, "a"), (2, "b"), (5, "c"), (37, "d"), (64, None)) for i in range(n)]
    rows += [(i, "s", f"x{i}", 1, "one") for i in range(9)] + ODD[1:]
    got = committed(spark, rows, fanout, levels).collect()
    want = tree(rows, fanout)
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (r.subroot, r.root, [tuple(s) for s in r.proof]) == want[(r.item, r.digest)]


def test_odd_rows_and_tampering(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", leaf string, grp int")
    got = M.checked(M.manifest(docs, presented={"text": M.tampered_text()})).collect()
    want = tree(ODD, 8)
    assert len(got) == len(ODD)
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    shown = {leaf(r): leaf((*r[:4], low(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r) for r in ODD}
    for r in got:
        subroot, root, proof = want[(r.doc_id, r.leaf)]
        node = shown[r.leaf]
        for left, right in proof:
            node = H(left, node, right)
        assert (r.subroot, r.root, r.proof_sha256) == (subroot, root, H(*(x for s in proof for x in s)))
        assert (r.folded_root, r.verified) == (node, node == root)


def test_no_rows_one_row_and_equal_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert M.manifest(docs.where("false")).count() == 0
    one = M.checked(M.manifest(docs.where("doc_id = 1"))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H() and one.verified
    same = M.manifest(spark.createDataFrame([ODD[3]] * 20, SCHEMA)).collect()
    node = climb([leaf(ODD[3])] * 20, 8)
    assert len(same) == 20 and {r.root for r in same} == {node[0]}
    assert sorted([tuple(s) for s in r.proof] for r in same) == sorted(node[1])


def test_a_changed_row_does_not_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"Text {i}") for i in range(100)], SCHEMA)
    shown = F.when(F.col("doc_id") == 42, "other").otherwise(F.col("text"))
    got = M.checked(M.manifest(docs, presented={"text": shown})).collect()
    assert [r.doc_id for r in got if not r.verified] == [42]


def test_a_block_is_the_most_that_a_row_holds(spark):
    rows = committed(spark, [(i, "s", "en", 1, "t") for i in range(200)], 2, 2)
    assert rows.count() == 200
    with pytest.raises(ValueError):
        M.commit(rows, 1)
