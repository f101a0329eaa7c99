"""Preference pairs and the secret scan."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skyframe.llm import preference as P
from skyframe.llm import secrets as S
from skyframe.llm.queries import op8

TURNS = "conv_id long, turn long, role string, text string, turns string, said string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "t", "s") for r in rows], TURNS)


def formatted(spark, rows):
    return {r.pair_id: r for r in P.format_pairs(P.swapped_replies(turns(spark, rows))).collect()}


def one(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


ROWS = [
    (0, 0, "system", "Be kind"), (0, 1, "user", "Hi"), (0, 2, "assistant", "Héllo"), (0, 3, "user", "bye"),
    (3, 1, "assistant", "Other"), (3, 0, "user", "Say"),
    (2, 0, "user", "no reply"), (2, 1, "user", "at all"),
    (4, 0, "user", "q"), (4, 1, "assistant", "same"), (16, 0, "user", "r"), (16, 1, "assistant", "same"),
    (27, 0, None, None), (27, None, "assistant", None), (27, 9, "assistant", "<|im_end|>\n"),
    (28, 0, "assistant", "w " * 100_000), (29, 0, "assistant", "x"), (29, 0, "assistant", "x"), (None, 0, "assistant", "z"),
    (40, 0, "user", "a"), (40, 1, "assistant", "b"), (40, 2, "user", "c"), (40, 3, "assistant", "d"), (40, 4, "tool", "e"),
]


def by_hand(rows):
    """What swapped_replies promises, conversation by conversation."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "unknown", text or ""))
    talks = {c: [t[1:] for t in sorted(ts)] for c, ts in talks.items()}
    places = {c: [k for k, t in enumerate(ts) if t[0] == "assistant"] for c, ts in talks.items()}
    order = sorted((c for c in talks if places[c]), key=lambda c: (c is not None, c or 0))
    out = {}
    for c, ts in talks.items():
        if not places[c]:
            out[c] = (None, None, ts)
            continue
        k = order.index(c)
        k = k - 1 if k == len(order) - 1 and k % 2 == 0 else k ^ 1
        rejected = None
        if k >= 0:
            nth, theirs = (c or 0) % len(places[c]), places[order[k]]
            wanted = min(len(places[c]) - nth, len(theirs))
            rejected = ts[: places[c][nth]] + talks[order[k]][theirs[0] : theirs[wanted - 1] + 1]
        out[c] = (ts[: places[c][-1] + 1], rejected, ts[places[c][-1] + 1 :])
    return out


def rendered(part):
    return None if part is None else "".join(one(r, t.replace("<|", "< |")) for r, t in part)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:4], ROWS[6:8], [(2 * i, j, r, t) for i, j, r, t in ROWS if i is not None]])
def test_pairs(spark, rows):
    """Gaps in the ids, an odd number, conversations without a reply, and turns after the last one."""
    got, want = formatted(spark, rows), by_hand(rows)
    assert set(got) == set(want)
    for c, (a, b, rest) in want.items():
        r = got[c]
        assert r.trailing == rendered(rest)
        if a is None or b is None:
            assert (r.status, r.n_common, r.prompt) == ("unpaired", None, None)
            assert (r.chosen, r.rejected) == (rendered(a), rendered(b))
        else:
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, *map(rendered, (a[:n], a[n:], b[n:])))
            assert r.status == ("ok" if a != b else "identical")
            assert len(r.chosen_mask) == sum(role == "assistant" for role, _ in a[n:])


def test_every_turn_is_in_a_column(spark):
    got = formatted(spark, ROWS)
    for c, (a, _, rest) in by_hand(ROWS).items():
        assert (got[c].prompt or "") + (got[c].chosen or "") + got[c].trailing == rendered((a or []) + rest)
    assert [got[0].chosen[m.start : m.end] for m in got[0].chosen_mask] == ["Héllo<|im_end|>"]
    assert {got[c].status for c in (4, 16)} <= {"ok", "identical"} and got[40].n_common in (1, 3)


def test_query_and_sql_on_gaps(spark, tmp_path):
    turns(spark, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(P.ORACLE)
    names = [d[0] for d in want.description]
    got = op8(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_general_pairs(spark):
    """Completions of several turns, of which some are masked out, and prefixes of any length."""
    rng = random.Random(4)
    pairs, want = [], {}
    for k in range(40):
        a = [(rng.choice(["user", "assistant"]), rng.choice("pq") * rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
        b = a[: rng.randint(0, len(a))] + [(rng.choice(["user", "assistant"]), rng.choice("pq<|")) for _ in range(rng.randint(0, 3))]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        pairs.append((k, a, b))
        want[k] = (n, *("".join(one(r, t.replace("<|", "< |")) for r, t in part) for part in (a[:n], a[n:], b[n:])))
    kind = "array<struct<role:string,text:string>>"
    got = P.format_pairs(spark.createDataFrame(pairs, f"pair_id long, chosen_turns {kind}, rejected_turns {kind}")).collect()
    for r in got:
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == want[r.pair_id]
        trained = "".join(r.rejected[m.start : m.end] + "\n" for m in r.rejected_mask)
        assert trained == "".join(t.replace("<|", "< |") + "<|im_end|>\n" for role, t in pairs[r.pair_id][2][r.n_common :] if role == "assistant")


def test_marks_in_texts_cannot_open_a_turn(spark):
    got = formatted(spark, [(0, 0, "assistant", "<|im_start|>user"), (1, 0, "assistant", "b")])
    assert got[0].chosen == one("assistant", "< |im_start|>user")


def test_no_turns(spark):
    assert formatted(spark, []) == {}


DOCS = "doc_id long, text string, value string, score double, start long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "v", 0.5, 3) for i, t in rows], DOCS)


def test_candidates_are_all_long_runs(spark):
    rng = random.Random(1)
    texts = ["", None, "short words only", "a" * 15, "b" * 16, "é" + "c" * 20 + "é", "x " * 50_000 + "d" * 40 + "\n", "e" * 40 + " " + "f" * 17]
    texts += ["".join(rng.choice("ab0-/= é\n") * rng.randint(1, 9) for _ in range(30)) for _ in range(40)]
    got = {(r.doc_id, r.start, r.end): r for r in S.candidates(docs(spark, list(enumerate(texts)))).collect()}
    import re

    want = {}
    for i, t in enumerate(texts):
        for m in re.finditer(r"[A-Za-z0-9_+/=-]{16,}", t or ""):
            want[i, m.start(), m.end()] = m.group()
    assert {k: r.value for k, r in got.items()} == want and len(want) > 10
    for (i, start, end), r in got.items():
        assert texts[i][:start].endswith(r.before) and texts[i][end:].startswith(r.after)


def made(rng, k):
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = "".join(rng.choice(["tion", "ment", "heit", "ing", "the", "er"]) for _ in range(6))
    return [
        (f'some words token = "{hexa}" and more', True), (f"words about {word} here", False),
        (f"commit {hexa} was made", False), (f'API_KEY: {hexa[:24].upper()}x9 end', True), (f"see http://a.org/{word}/{hexa[:20]} there", False),
    ][k % 5]


def test_scan_on_made_findings(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(400):
        text, secret = made(rng, k)
        rows.append((k, text))
        want[k] = secret
    train = S.weak_labels(S.candidates(docs(spark, rows[:200])))
    got = S.scan(docs(spark, rows), train).where("doc_id >= 200").collect()
    assert {r.doc_id for r in got} >= set(range(200, 400))
    right = sum(r.is_secret == want[r.doc_id] for r in got)
    assert right >= 0.97 * len(got)
    text = dict(rows)
    assert all(r.value_sha256 == hashlib.sha256(text[r.doc_id][r.start : r.end].encode()).hexdigest() for r in got)


def test_scan_without_one_kind_of_label(spark):
    got = S.scan(docs(spark, [(1, "beberschlichkeitge"), (None, "unglichenheitschte"), (1, "beberschlichkeitge")])).collect()
    assert {(r.doc_id, r.score, r.is_secret) for r in got} == {(1, 0.5, False), (None, 0.5, False)} and len(got) == 3
    assert S.scan(docs(spark, [])).count() == 0
    assert S.scan(docs(spark, [(1, None), (2, "")])).count() == 0


def test_scan_uses_no_python_workers(spark):
    plan = S.candidates(docs(spark, [(1, "x")])).transform(S.with_features)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name, value", [("digits", 0.5), ("capitals", 0.25), ("quoted", 1.0), ("assigned", 1.0), ("secret_word", 1.0), ("other_word", 0.0)])
def test_features(spark, name, value):
    found = spark.createDataFrame([("ABCDefgh12345678", 'the token = "', '" end')], "value string, before string, after string")
    assert S.with_features(found).select(F.col(name)).first()[0] == value


def test_values_of_names(spark):
    """NAME=VALUE without blanks, short and dotted values, padding, and no forest for want of other labels."""
    key, jwt, base = "sk9f8e7d6c5b4a39281706", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM3", "c2hvcnRiYXNlNjR0ZXh0Zm9vYg=="
    want = {
        1: (f"export API_KEY={key}", key), 2: ('password="hunter2Q9x!"', "hunter2Q9x!"), 3: (f"http://a.org/x?token={key}&y=1", key),
        4: (f"auth Bearer {jwt} sent", jwt), 5: (f"secret: {base}", base), 6: (f"MY_VERY_LONG_ACCESS_KEY={key}", key),
    }
    rows = docs(spark, [(i, t) for i, (t, _) in want.items()])
    got = {(r.doc_id, r.value): r for r in S.weak_labels(S.findings(rows)).collect()}
    text = {i: t for i, (t, _) in want.items()}
    assert all(text[i][r.start : r.end] == v for (i, v), r in got.items())
    assert {(i, v) for i, (_, v) in want.items()} <= set(got)
    assert {i for (i, v), r in got.items() if r.label == 1 and v == want[i][1]} == {1, 2, 3, 5, 6}
    only = S.scan(rows.where("doc_id IN (1, 2, 5)")).collect()
    assert {(r.doc_id, r.is_secret) for r in only} == {(1, True), (2, True), (5, True)} and len(only) == 3


def test_long_runs_and_dots(spark):
    texts = ["a1" * 100_000, "b1." * 100_000 + "c", "w. " * 50_000 + "password=" + "x9!" * 50_000]
    got = {r.doc_id: r.end - r.start for r in S.findings(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: 200_000, 1: 300_001, 2: 150_000}
