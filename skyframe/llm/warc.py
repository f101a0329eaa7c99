"""WARC archives as chunked record tables.

Payloads are cut into rows of record identifier and chunk number before they reach Python and while they
are read back, so no task holds a whole record there, however long it is. A chunk carries the length and
the SHA-1 of its record up to and including itself; the last one therefore has those of the whole
payload, and nothing needs to be put together to know them.

Each task of a write makes archives of its own, one gzip member for a record, below a folder that all
executors reach, under names that no other attempt uses; the index that comes back lists what counts, so
a lost or repeated task leaves nothing but an unlisted file. Equal payloads are written once: the others
become revisit records that refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import saved
from skyframe.session import scratch_path

CHUNK_BYTES = 65_536
#: An archive is closed by the record that takes it beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
# Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Longest header line that is read.
LINE_BYTES = 1 << 20

_INDEX = "archive string, offset long, length long, record_id string"
_CHUNKS = (
    "archive string, record_id string, record_type string, refers_to string, target_uri string, announced_sha1 string, "
    "chunk_no long, payload_bytes long, payload_sha1 string, last boolean, data binary"
)


def record_id(id_col: Column) -> Column:
    """The identifier of a row's record: a URI made of its id."""
    return F.coalesce(F.concat(F.lit("urn:x-row:"), F.url_encode(id_col.cast("string"))), F.lit("urn:x-row-null:"))


def row_id(record: Column, kind: str) -> Column:
    """The id that :func:`record_id` was given, as a value of type ``kind``."""
    text = F.url_decode(F.substring(record, F.lit(len("urn:x-row:") + 1), F.length(record)))
    return F.when(record.startswith("urn:x-row:"), text).cast(kind)


def record_table(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``record_id, record_type, refers_to, target_uri, sha1, bytes, payload`` for each row.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest id are responses and the
    others revisits of it; all else are responses. Payloads are equal if length, SHA-1 and SHA-256 are.
    NULL payloads are empty, NULL ids come before all others.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    same = {"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload")).withColumns(same)
    known = rows.where(F.col("bytes") >= least_bytes).groupBy(*same).agg(F.max("id").alias("first"), F.count("*").alias("times"))
    rows = rows.join(known.where("times > 1").drop("times"), list(same), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.select(
        record_id(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, record_id(F.col("first"))).alias("refers_to"),
        "target_uri",
        "sha1",
        "bytes",
        "payload",
    )


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``records`` with ``chunk_no`` and ``data`` in place of ``payload``; a record's chunks are consecutive rows.

    Revisits and empty payloads have one empty chunk.
    """
    size = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("bytes"))
    chunks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(size / chunk_bytes) - 1, F.lit(0).cast("long")))
    data = F.substring("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    rows = records.withColumn("chunk_no", F.explode(chunks))
    return rows.withColumn("data", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(data)).drop("payload")


class _Archive:
    """An archive that is being written: records are begun, fed with chunks and ended."""

    def __init__(self, folder: str, name: str, date: str) -> None:
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.name, self.date, self.at = f"{folder}/{name}", date, 0
        self.out = files.open_output_stream(f"{path}/{name}", compression=None)
        info = f"software: skyframe\r\nformat: {VERSION}\r\n".encode()
        self._begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>")], "application/warc-fields", len(info))
        self.feed(info)
        self._end()

    def _put(self, raw: bytes) -> None:
        self.at += len(raw)
        self.out.write(raw)

    def _begin(self, fields: list[tuple[str, str]], kind: str, length: int) -> None:
        self.start, self.gzip = self.at, zlib.compressobj(wbits=31)
        fields = [*fields, ("WARC-Date", self.date), ("Content-Type", kind), ("Content-Length", str(length))]
        self.feed((VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode())

    def feed(self, raw: bytes) -> None:
        self._put(self.gzip.compress(raw))

    def _end(self) -> None:
        self.feed(b"\r\n\r\n")
        self._put(self.gzip.flush())

    def begin(self, row: dict) -> None:
        fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>")]
        if row["target_uri"] is not None:
            # Line breaks and blanks at the ends would change the header; they are escaped as URIs escape them.
            fields.append(("WARC-Target-URI", _escaped(row["target_uri"])))
        fields.append(("WARC-Payload-Digest", f"sha1:{row['sha1']}"))
        if row["refers_to"]:
            fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", PROFILE)]
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
        self.row, self.sha1, self.left = row, hashlib.sha1(), 0 if row["refers_to"] else row["bytes"]
        self._begin(fields, "application/http; msgtype=response", len(head) + self.left)
        self.feed(head)

    def add(self, data: bytes) -> dict | None:
        """Feeds a chunk; the last one ends the record, whose index row is returned."""
        self.sha1.update(data)
        self.left -= len(data)
        self.feed(data)
        if self.left:
            return None
        if not self.row["refers_to"] and self.sha1.hexdigest() != self.row["sha1"]:
            raise ValueError(f"chunks of {self.row['record_id']} do not make its payload")
        self._end()
        return {"archive": self.name, "offset": self.start, "length": self.at - self.start, "record_id": self.row["record_id"]}


def _escaped(uri: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in uri)


def _written(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, archive = TaskContext.get(), 0, None
        for batch in batches:
            index, columns = [], [c for c in batch.schema.names if c != "data"]
            data = batch.column("data")
            for k, row in enumerate(batch.select(columns).to_pylist()):
                if row["chunk_no"] == 0:
                    if archive is None:
                        made += 1
                        archive = _Archive(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}-{uuid.uuid4().hex}.warc.gz", date)
                    archive.begin(row)
                if done := archive.add(data[k].as_buffer()):
                    index.append(done)
                    if archive.at >= archive_bytes:
                        archive.out.close()
                        archive = None
            yield pa.RecordBatch.from_pylist(index, pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))
        if archive:
            archive.out.close()

    return run


def write_archives(records: DataFrame, folder: str, date: str = DATE, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``records``, as :func:`record_table` makes them, below ``folder``; the index of what was written.

    Index: ``archive, offset, length, record_id``, one row for each record. ``folder`` is a path or URI that
    every executor can write to. No records, no archives.
    """
    rows = chunked(records, chunk_bytes).select("record_id", "record_type", "refers_to", "target_uri", "sha1", "bytes", "chunk_no", "data")
    return saved(rows.mapInArrow(_written(folder, date, archive_bytes), _INDEX), "warc-index")


def _header(lines: io.BufferedIOBase, left: list[int] | None = None) -> dict[str, str]:
    """Fields up to the empty line, by lower-case name; ``left`` counts down the bytes of the block."""
    fields = {}
    while True:
        line = lines.readline(LINE_BYTES)
        if left:
            left[0] -= len(line)
        if not line.endswith(b"\n"):
            raise ValueError("a header line is cut off or too long")
        if not line.strip():
            return fields
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()


def _records(stream: io.BufferedIOBase, chunk_bytes: int) -> Iterator[tuple[dict, int, int, str, bool, bytes]]:
    """Header, chunk number, length and digest so far, whether it is the last, and the data of each chunk."""
    while True:
        version = stream.readline(LINE_BYTES)
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        fields = _header(stream)
        left = [int(fields["content-length"])]
        if fields.get("content-type", "").startswith("application/http"):
            status = stream.readline(min(LINE_BYTES, left[0]))
            if not status.startswith(b"HTTP/"):
                raise ValueError(f"no HTTP message in {fields.get('warc-record-id')}")
            left[0] -= len(status)
            _header(stream, left)
        sha1, size, number, todo = hashlib.sha1(), 0, 0, left[0]
        while True:
            data = stream.read(min(chunk_bytes, todo))
            if len(data) < min(chunk_bytes, todo):
                raise ValueError(f"{fields.get('warc-record-id')} is cut off")
            sha1.update(data)
            size, todo = size + len(data), todo - len(data)
            yield fields, number, size, sha1.hexdigest(), not todo, data
            number += 1
            if not todo:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{fields.get('warc-record-id')} does not end where it should")


def _opened(archive: str) -> io.BufferedIOBase:
    files, path = pafs.FileSystem.from_uri(archive)
    stream = files.open_input_stream(path, compression=None, buffer_size=1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream, 1 << 20)


def _chunks(chunk_bytes: int, with_data: bool):
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _CHUNKS.split(", ")])
    bare = lambda uri: uri and uri.strip("<>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                with _opened(archive) as stream:
                    for fields, number, size, digest, last, data in _records(stream, chunk_bytes):
                        announced = fields.get("warc-payload-digest", "")
                        rows.append(
                            dict(zip(names, (
                                archive, bare(fields.get("warc-record-id")), fields.get("warc-type"), bare(fields.get("warc-refers-to")),
                                fields.get("warc-target-uri"), announced[5:] if announced.startswith("sha1:") else None,
                                number, size, digest, last, data if with_data else None,
                            ), strict=True))
                        )
                        held += len(data) if with_data else 0
                        if held >= 1 << 22 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named by ``archives(archive)``, ``.warc`` or ``.warc.gz``.

    ``archive, record_id, record_type, refers_to, target_uri, announced_sha1, chunk_no, payload_bytes,
    payload_sha1, last, data``: lengths and digests are those of the payload up to this chunk. Payload is
    what follows the HTTP header, or the whole block of other records. Archives are read side by side, each
    as a stream; without ``with_data`` all bytes are read and digested, but not returned. A damaged archive
    fails with the record's name.
    """
    named = saved(archives.select("archive").distinct(), "warc-archives")
    return named.repartition(max(1, named.count())).mapInArrow(_chunks(chunk_bytes, with_data), _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per response and revisit: ``record_id, record_type, refers_to, target_uri, payload_bytes, payload_sha1``.

    Length and digest of a revisit are those of the record it refers to; a response whose digest is not the
    announced one, or a revisit of a record that is not there, fails.
    """
    ends = saved(chunks.where("last AND record_type IN ('response', 'revisit')").drop("data"), "warc-records")
    wrong = F.raise_error(F.concat(F.lit("digest of "), "record_id", F.lit(" differs")))
    good = F.coalesce(F.col("announced_sha1") == F.col("payload_sha1"), F.lit(True))
    own = ["record_id", "record_type", "refers_to", "target_uri"]
    responses = ends.where("record_type = 'response'").select(*own, "payload_bytes", F.when(good, F.col("payload_sha1")).otherwise(wrong).alias("payload_sha1"))
    known = responses.groupBy(F.col("record_id").alias("refers_to"), "payload_sha1").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = ends.where("record_type = 'revisit'").select(*own, F.col("announced_sha1").alias("payload_sha1"))
    revisits = revisits.join(known, ["refers_to", "payload_sha1"], "left")
    gone = F.raise_error(F.concat("record_id", F.lit(" revisits what is not there"))).cast("long")
    revisits = revisits.select(*own, F.coalesce("payload_bytes", gone).alias("payload_bytes"), "payload_sha1")
    return responses.unionByName(revisits)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each page, reads the archives back: one row per page with what they say about it.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. NULL pages are empty payloads, rows
    that repeat the largest id of equal payloads are all responses, a NULL id comes back as NULL, and an
    empty table makes no archive and no row. Other columns are ignored.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    index = write_archives(record_table(pages, id_col, url_col, payload_col), scratch_path(spark, "warc"))
    rows = records(read_archives(spark, index, with_data=False))
    return rows.select(
        row_id(F.col("record_id"), kind).alias("page_id"),
        "payload_bytes",
        F.col("payload_sha1").alias("payload_digest"),
        "record_type",
        row_id(F.col("refers_to"), kind).alias("refers_to"),
    )


ORACLE = f"""
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM max(page_id) OVER same
                 AND max(page_id) OVER same IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM max(page_id) OVER same
            THEN max(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))
"""
