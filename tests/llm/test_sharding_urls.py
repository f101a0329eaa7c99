"""Interleaved shards and the URL filter."""

import zlib
from collections import Counter

import pytest

from skyframe.llm import sharding, url_filter

SCHEMA = "doc_id long, text string, source string, bucket string, run string, stratum string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "b", "r", "s") for i, t, s in rows], SCHEMA)


def shard_rows(spark):
    rows = [(k, f"text {k} " + "é" * (k % 50), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(1000)]
    return rows + [(None, None, None), (5000, "", None), (5001, "x", ""), (7, "again", "s0"), (7, "again", "s0"), (9, "w " * 200_000, "alone")]


@pytest.mark.parametrize("shards", [1, 7, 40, 3000])
def test_shards(spark, shards):
    rows = shard_rows(spark)
    got = sharding.interleave(frame(spark, rows), shards=shards).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) <= set(range(shards))
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_every_shard_has_the_mixture(spark):
    rows = [r for r in shard_rows(spark) if r[0] is not None and r[0] != 7]
    got = sharding.interleave(frame(spark, rows), shards=10).collect()
    source = {i: s for i, _, s in rows}
    for name, n in Counter(source.values()).items():
        parts = Counter(r.shard for r in got if source[r.doc_id] == name)
        assert all(abs(parts.get(k, 0) - n / 10) <= 2 for k in range(10)), name


def test_shards_follow_the_seed_alone(spark):
    docs = frame(spark, shard_rows(spark))
    one, same, other = (
        sorted(map(str, sharding.interleave(d, seed=s).collect())) for d, s in ((docs, 1), (docs.repartition(5), 1), (docs, 2))
    )
    assert one == same != other


def test_no_documents(spark):
    assert sharding.interleave(frame(spark, [])).count() == 0


RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
    ("com/de/", "block"), ("b.org/", "block"), ("org/ab/", "allow"), ("xn--é.net/ü/", "block"),
]
URLS = [
    "http://a.example.org/en/12?x#y", "https://EXAMPLE.ORG/es/", "https://example.org/ES/", "http://notexample.org/es/1",
    "http://x.com/fr", "http://x.com/fr/", "http://x.com/de/1#z", "http://com/de/", "http://x.com", "http://org", "http://org/",
    "http://b.org/ab/1", "nothing", "://", "", None, "a://b://c.org/x", "http://é.xn--é.net/ü/1", "http://x.org:80/", "http://u@x.org/",
    "http://x.org?/fr/", "HTTP://.com/fr/", "http://x.org/" + "p/" * 50_000, "http://x.org/",
    "http://" + "a." * 100_000 + "org/1", "http://" + "." * 100_000, "http://" + "com." * 50_000 + "b.org/ab/", "http://.org/", "http://org./",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for rule, verdict in RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fits.append((len(rule), len(name), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("slice_rows", [1000, 2])
def test_urls(spark, slice_rows):
    rules = spark.createDataFrame([*RULES, RULES[0]], "rule string, verdict string")
    pages = spark.createDataFrame([(k, u, "r", "h") for k, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    got = url_filter.judge_urls(pages, url_filter.publish(spark, rules, slice_rows)).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {k: brute(u) for k, u in enumerate(URLS)}


@pytest.mark.parametrize("labels", [[1], [2], [1, 2, 4], [3], [7]])
def test_parents(labels):
    for host in ("", ".", "a", "a.b", ".a.b", "a..b.", "a.b.c.d.e.f.g", "a.b.c.d.e.f.g.h"):
        pieces = host.split(".")
        want = [".".join(pieces[-n:]) for n in labels if n <= len(pieces)]
        assert list(url_filter._parents(host, labels)) == want


def test_a_host_of_many_labels_costs_what_the_rules_ask_for():
    host = "a." * 5_000_000 + "org"
    assert sum(map(len, url_filter._parents(host, [1, 2, 3]))) == 3 + 5 + 7


def test_equal_digests_are_told_apart_by_their_texts(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter, "_digest", lambda text: 5)
    path = tmp_path / "rules"
    path.write_bytes(url_filter._layout(RULES))
    part = url_filter._Slice(path)
    assert [k >= 0 for k in part.find(["com/de/", "com/xx/", "org/"])] == [True, False, True]


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    names = url_filter.publish(spark, none)
    assert [tuple(r) for r in url_filter.judge_urls(pages, names).collect()] == [(1, "x.org", "/", None, "allow")]
    assert url_filter.judge_urls(pages.where("false"), names).count() == 0


def test_bad_rules_are_refused(spark):
    with pytest.raises(ValueError):
        url_filter.publish(spark, spark.createDataFrame([("org", "block")], "rule string, verdict string"))
