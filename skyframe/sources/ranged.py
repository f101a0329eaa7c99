"""Files of any file system by byte ranges, and a data source of FITS headers on top of it.

Paths are opened through Arrow's file systems: local and mounted paths, and URIs of the stores that the
cluster reads (``s3://``, ``gs://``, ``hdfs://``). Of a FITS file only ranges of header blocks are fetched,
so what is read does not depend on the pixels.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are fetched at a time: four header blocks, more than most headers have.
RANGE_BYTES = 4 * 2880
#: Files of a task of the data source.
FILES_A_TASK = 256
#: Longest sidecar text that is read.
TEXT_BYTES = 1 << 20


def resolved(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and its name there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class RangedFile:
    """A file that is read range by range; ``bytes_read`` says how much was fetched."""

    def __init__(self, path: str, range_bytes: int = RANGE_BYTES) -> None:
        files, name = resolved(path)
        self.file, self.range_bytes = files.open_input_file(name), range_bytes
        self.at, self.start, self.held, self.bytes_read = 0, 0, b"", 0

    def read(self, size: int) -> bytes:
        """Up to ``size`` bytes from here, fewer at the end of the file."""
        if not self.start <= self.at or self.at + size > self.start + len(self.held):
            self.start = self.at
            self.held = self.file.read_at(max(size, self.range_bytes), self.at)
            self.bytes_read += len(self.held)
        out = self.held[self.at - self.start : self.at - self.start + size]
        self.at += len(out)
        return out

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> None:
        self.at = offset + (self.at if whence == os.SEEK_CUR else 0)

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for path in batch["path"]:
            try:
                with RangedFile(path, TEXT_BYTES) as file:
                    found.append(file.read(TEXT_BYTES).decode("utf-8", "replace"))
            except OSError:
                found.append(None)
        yield pd.DataFrame({"path": batch["path"], "text": found})


def read_small_texts(paths: DataFrame) -> DataFrame:
    """(path, text) of small text files by name; NULL where one cannot be read.

    A sidecar is a few hundred bytes; of a longer file the first ``TEXT_BYTES`` are read.
    """
    return paths.select("path").mapInPandas(_texts, "path string, text string")


class FilePartition(InputPartition):
    """Files of one task: name, size and time of each."""

    def __init__(self, files: list[tuple]) -> None:
        super().__init__(files)
        self.files = files


class FitsHeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.endings = tuple(f".{e.strip().lower()}" for e in options.get("extensions", "fits,fit,wcs,new").split(","))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.files_a_task = int(options.get("filespertask", options.get("filesPerTask", FILES_A_TASK)))

    def partitions(self) -> list[FilePartition]:
        """Files below the root in equal shares; nothing of them is opened here."""
        files, name = resolved(self.root)
        before = self.root[: -len(name)] if self.root.endswith(name) and "://" in self.root else ""
        info = files.get_file_info(name)
        listed = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(name, recursive=True))
        found = sorted(
            (before + f.path, f.size, f.mtime and f.mtime.replace(tzinfo=None))
            for f in listed
            if f.type == pafs.FileType.File and PurePosixPath(f.path).suffix.lower() in self.endings
        )
        step = max(1, self.files_a_task)
        return [FilePartition(found[k : k + step]) for k in range(0, len(found), step)] or [FilePartition([])]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        from skyframe.sources.headers import cards_of

        rows = []
        for path, size, mtime in partition.files:
            cards, error, fetched = cards_of(path, self.range_bytes)
            rows.append({"path": path, "size": size, "mtime": mtime, "cards": cards, "error": error, "bytes_read": fetched})
        yield pa.RecordBatch.from_pylist(rows, FitsHeaderSource.arrow_schema())


class FitsHeaderSource(DataSource):
    """``spark.read.format("fits_cards").load(root)``: path, size, mtime, cards, error, bytes_read.

    Options: ``extensions`` (comma-separated), ``rangeBytes`` fetched at a time, ``filesPerTask``. The
    driver lists names as for any file source; files are opened by the tasks only.
    """

    @classmethod
    def name(cls) -> str:
        return "fits_cards"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp_ntz, cards array<string>, error string, bytes_read long"

    @staticmethod
    def arrow_schema() -> pa.Schema:
        return pa.schema(
            [("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us")), ("cards", pa.list_(pa.string())),
             ("error", pa.string()), ("bytes_read", pa.int64())]
        )

    def reader(self, schema) -> FitsHeaderReader:
        return FitsHeaderReader(self.options)


def load_fits_headers(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, size, mtime, error, bytes_read, raw_header) of the FITS files below a folder of any file system."""
    from skyframe.sources.headers import with_card_map

    spark.dataSource.register(FitsHeaderSource)
    return with_card_map(spark.read.format(FitsHeaderSource.name()).options(**options).load(root))
