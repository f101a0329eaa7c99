"""The conversation prefix trie against sequences in Python."""

import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from skyframe.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """All nodes, as the query returns them."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in said.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        path = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * words
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, ends.get(p, [])))))
        for p, m in members.items()
    )


def nodes(spark, rows, schema=SCHEMA, **options):
    turns = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in T.prefix_trie(*T.rebuilt(T.ordered(turns)), **options).collect())


def chat(conv, *texts):
    return [(conv, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]


ROWS = [
    *(row for c in range(60) for row in chat(c, "the same first turn", f"reply {c % 7}", f"so {c % 3}", "the end")),
    *(row for c in range(60, 90) for row in chat(c, "a copy", "word by word", "three times")),
    *chat(100), *chat(101, "alone"), *chat(120, "x"), *chat(121, "a", "b", "c", "d"), *chat(122, "a"), *chat(123, "a", "b"),
    *chat(-5, "before", "zero", "and", "more"), *chat(200, *(f"long {k % 5}   é" for k in range(90))), *chat(201, *(f"long {k % 5}   é" for k in range(60))),
]
ODD = [
    (None, 0, "user", "no conversation"), (7, None, None, None), (7, 2, "user", "b"), (7, 2, "user", "b"), (7, 2, "user", "a"),
    (8, 0, None, ""), (8, 0, "", None), (9, 0, "us", "erx"), (10, 0, "user", "x"), (11, 0, "user", "w " * 100_000), (27, 1, "user", "\x1c two words"),
]


def test_against_sequences(spark):
    assert nodes(spark, ROWS) == plain(ROWS)


def test_nothing_depends_on_blocks_shards_and_spills(spark):
    for options in ({"block_turns": 7, "queue_limit": 2, "heavy_weight": 10}, {"heavy_weight": 0}, {"heavy_weight": 10**9, "queue_limit": 3}):
        assert nodes(spark, ROWS, **options) == plain(ROWS)


def test_odd_rows(spark):
    assert nodes(spark, ODD) == plain(ODD)
    wide = [(*r, "x", 1) for r in ODD]
    assert nodes(spark, wide, SCHEMA + ", key string, depth int") == plain(ODD)
    assert nodes(spark, [r for r in ODD if r[0] is None]) == []


def test_conversations_without_turns_are_members_of_the_root(spark):
    """All of 20's turns are replaced by the first ones of a conversation that is not there."""
    convs = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [r for c in convs for r in chat(c, "a", "b")]
    assert nodes(spark, rows) == [(convs[0], 0, None, 2, 0, 1, 0, sha(",".join(map(str, convs))))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 0), st.sampled_from("abc"), st.integers(0, 9)), max_size=80), st.integers(2, 9), st.integers(1, 4))
def test_queue_gives_all_messages_back_in_order(messages, limit, fan):
    queue, got = T.SpillingQueue(limit, fan), []
    for depth, key, n in messages:
        queue.push((depth, key, n, 0))
    for depth in range(-4, 1):
        for key in "abc":
            got += queue.pop((depth, key))
    assert sorted(got) == sorted((*m, 0) for m in messages)
    assert [m[:2] for m in got] == sorted(m[:2] for m in messages)
    assert not queue.heap and not queue.runs


def test_pieces_of_a_long_list_of_ids(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(T, "PIECE", 20)
    frame = pd.DataFrame([(k, c) for k in "ab" for c in range(50)], columns=["key", "conv_id"])
    pieces = pd.concat(T._pieces(iter([frame[:33], frame[33:]])))
    assert pieces["ids"].str.len().max() < 30 and len(pieces) > 10
    want = sha(",".join(map(str, range(50))))
    assert pd.concat(T._hashed(iter([pieces]))).values.tolist() == [["a", want], ["b", want]]
