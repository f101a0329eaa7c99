"""WARC archives: whole round trips, bounded chunks, revisits, damage."""

import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from skyframe.llm import warc as W

SCHEMA = "page_id long, url string, html string"
LONG, SAME = "é\r\n\r\nWARC/1.1\r\n" * 40_000, "x" * 999 + "ü"
ROWS = [
    (1, "http://a/1", SAME), (2, "http://a/2", SAME), (5, None, SAME), (3, "http://a/3", "x" * 999), (4, "http://a/4", "x" * 999),
    (6, "http://a/ 6\r\nWARC-Type: x", ""), (7, "", None), (8, "é", LONG), (9, "http://a/9", "HTTP/1.1 200 OK\r\n\r\n"), (10, "u", "y" * 65_536), (11, "u", LONG),
    (None, "http://a/n", SAME), (None, "http://a/n", "lone"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def expected(rows):
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 1000 and page is not None:
            first[html] = max(page, first.get(html, page))
    out = []
    for page, _, html in rows:
        raw, to = (html or "").encode(), first.get(html)
        again = to is not None and to != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_against_the_rows(spark, pages):
    assert sorted((tuple(r) for r in W.archived_pages(pages).collect()), key=str) == expected(ROWS)
    odd = spark.createDataFrame([(*r, "x", 1) for r in [*ROWS, *ROWS]], SCHEMA + ", payload string, record_id int")
    assert sorted((tuple(r) for r in W.archived_pages(odd).collect()), key=str) == expected([*ROWS, *ROWS])
    assert W.archived_pages(pages.where("false")).count() == 0


def test_payloads_come_back_in_bounded_chunks(spark, pages, tmp_path):
    records = W.record_table(pages, "page_id", "url", "html", 10**9)
    index = W.write_archives(records, str(tmp_path), chunk_bytes=1000, archive_bytes=1)
    assert index.count() == len(ROWS) == index.select("archive").distinct().count()
    chunks = W.read_archives(spark, index, chunk_bytes=777).where("record_type = 'response'").collect()
    assert max(len(r.data) for r in chunks) == 777
    for page, url, html in ROWS[:11]:
        mine = sorted((r for r in chunks if r.record_id == f"urn:x-row:{page}"), key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in mine] == list(range(len(mine))) and [r.last for r in mine] == [False] * (len(mine) - 1) + [True]
        whole = b""
        for r in mine:
            whole += r.data
            assert (r.payload_bytes, r.payload_sha1) == (len(whole), hashlib.sha1(whole).hexdigest())
        assert whole == (html or "").encode()
        assert mine[0].target_uri == (url and W._escaped(url))


def test_members_of_the_index_are_records(pages, tmp_path):
    """Each range of an archive can be opened alone and is a record by the format."""
    index = W.write_archives(W.record_table(pages, "page_id", "url", "html"), str(tmp_path)).collect()
    for r in index:
        with open(r.archive, "rb") as file:
            file.seek(r.offset)
            text = gzip.decompress(file.read(r.length))
        head, _, block = text.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: re") and f"<{r.record_id}>".encode() in head
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert block[size:] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
    files = {r.archive for r in index}
    assert sum(os.path.getsize(f) for f in files) > sum(r.length for r in index)


def test_a_task_holds_chunks_not_records(tmp_path):
    """Forty megabytes go through a writer and a reader that hold some chunks at a time."""
    import tracemalloc

    chunk, times = os.urandom(1 << 16), 640
    sha1 = hashlib.sha1(chunk * times).hexdigest()
    archive = W._Archive(str(tmp_path), "one.warc.gz", W.DATE)
    tracemalloc.start()
    archive.begin({"record_type": "response", "record_id": "urn:x-row:1", "target_uri": "u", "sha1": sha1, "refers_to": None, "bytes": len(chunk) * times})
    done = [archive.add(chunk) for _ in range(times)]
    archive.out.close()
    assert done[-1] and not any(done[:-1])
    last = None
    with W._opened(archive.name) as stream:
        for last in W._records(stream, 1 << 16):
            pass
    assert last[2:5] == (len(chunk) * times, sha1, True)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()


def archive(tmp_path, raw):
    path = tmp_path / f"{hashlib.md5(raw).hexdigest()}.warc"
    path.write_bytes(raw)
    return str(path)


def test_foreign_and_damaged_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x-row:1>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    whole = record % (b"resource", 3, b"abc") + record % (b"response", 0, b"")
    read = lambda raw: list(W._records(W._opened(archive(tmp_path, raw)), 2))
    assert [(x[1], x[5]) for x in read(whole)] == [(0, b"ab"), (1, b"c"), (0, b"")]
    for raw in (whole[:-1], whole[:-10], b"x" + whole, whole.replace(b"\r\n\r\nabc", b"\r\n\r\nabcd"), whole[:60]):
        with pytest.raises(ValueError):
            read(raw)
    good = "sha1:" + hashlib.sha1(b"abc").hexdigest()
    for kind, refers, digest in (("response", "", "sha1:" + "0" * 40), ("revisit", "WARC-Refers-To: <urn:x-row:9>\r\n", good)):
        raw = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-row:1>\r\n{refers}WARC-Payload-Digest: {digest}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
        named = spark.createDataFrame([(archive(tmp_path, raw.encode()),)], "archive string")
        with pytest.raises(Exception, match="differs|not there"):
            W.records(W.read_archives(spark, named)).collect()


def test_ids_survive_as_they_are(spark):
    ids = spark.createDataFrame([("a b/<>é",), ("",), (None,)], "id string")
    got = ids.select("id", W.row_id(W.record_id(F.col("id")), "string").alias("back")).collect()
    assert [r.id for r in got] == [r.back for r in got]
