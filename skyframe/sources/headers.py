"""Header sources: FITS cards and XISF keywords to one key/value map per file."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.sources.ranged import RANGE_BYTES, RangedFile

CARD, BLOCK = 80, 2880
# Keywords that occur many times; their texts are joined by line breaks.
ACCUMULATING = ("COMMENT", "HISTORY")
# A primary header with fewer cards gives way to the first extension.
FEW_CARDS = 10


# --- FITS ------------------------------------------------------------------------------------

END_CARD = "END".ljust(CARD)
END_BYTES = END_CARD.encode()
# What a cast to a number passes over around it.
CAST_BLANKS = "".join(map(chr, range(33))) + "\x7f"
# The forms of HIERARCH cards and of texts. Blanks and line ends are named, Unicode has more.
_S, _EOL = r"[ \t\n\x0b\f\r]", r"\n\r\x85\u2028\u2029"
LONG_KEY = re.compile(rf"HIERARCH{_S}+([^=]*[^= \t\n\x0b\f\r]){_S}*=")
LONG_VALUE = re.compile(rf"[^=]*=([^{_EOL}]*)(?:\r\n|[{_EOL}])?\Z")
QUOTE, QUOTED = re.compile(f"{_S}*'"), re.compile(f"{_S}*'((?:[^']|'')*)'")


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain projection may be merged into the expressions that use it and then run again for every
    element of a lambda; a generator is never merged.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _cards_before_end(content: bytes) -> tuple[list[str] | None, int]:
    """The cards of a header at the start of ``content``, None without an END card, and the bytes of its blocks."""
    for at in range(0, len(content) - CARD + 1, CARD):
        if content[at : at + CARD] == END_BYTES:
            text = content[:at].decode("latin-1")
            return [text[i : i + CARD] for i in range(0, at, CARD)], (at // BLOCK + 1) * BLOCK
    return None, 0


def _card_number(cards: list[str], key: str, default: int) -> int:
    own = next((c for c in cards if c.startswith(key.ljust(8) + "=")), "")
    text = own[10:].split("/", 1)[0].strip(CAST_BLANKS)
    number = int(text) if re.fullmatch("[+-]?[0-9]{1,19}", text) else default
    return number if -(2**63) <= number < 2**63 else default


def _cards_of_bytes(content: bytes | None) -> list[str] | None:
    """The cards of the primary header, or of the first extension where the primary header is nearly empty."""
    if content is None:
        return None
    first, behind = _cards_before_end(content)
    if first is None or len(first) >= FEW_CARDS:
        return first
    axes = _card_number(first, "NAXIS", 0)
    if axes > 0:
        size = abs(_card_number(first, "BITPIX", 8)) / 8
        for i in range(1, min(axes, 3) + 1):
            size *= _card_number(first, f"NAXIS{i}", 1)
        behind += math.ceil(size / BLOCK) * BLOCK
    extension, _ = _cards_before_end(content[max(behind, 0) :])
    return first if extension is None else extension


@F.pandas_udf(T.ArrayType(T.StringType()))
def _content_cards(content: pd.Series) -> pd.Series:
    return pd.Series([_cards_of_bytes(c) for c in content], dtype=object)


def header_cards(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, cards) of FITS bytes: the primary header, or that of the first extension.

    The extension counts when the primary header is nearly empty; it starts at the block after the
    primary header and its data.
    """
    return files.select("path", _content_cards(content).alias("cards"))


def _card_entry(card: str) -> tuple[str, str | None]:
    """Key and value of one 80-character card."""
    long_key = card.startswith("HIERARCH")
    if long_key:
        named, after = LONG_KEY.match(card), LONG_VALUE.match(card)
        key, field = named[1] if named else "", after[1] if after else ""
    else:
        key, field = card[:8].rstrip(" "), card[10:]
        if card[8:10] != "= ":
            return key, card[8:].rstrip(" ")
    if QUOTE.match(field):
        text = QUOTED.match(field)
        return key, text[1].replace("''", "'").rstrip(" ") if text else ""
    return key, field.split("/", 1)[0].strip(" ") or None


def _header_map(entries: Iterable[tuple[str, str | None]]) -> dict[str, str | None]:
    """The map of a header: the first entry of a keyword counts, COMMENT and HISTORY accumulate."""
    header: dict[str, str | None] = {}
    texts: dict[str, list[str]] = {}
    for key, value in entries:
        if key in ACCUMULATING:
            texts.setdefault(key, []).extend([] if value is None else [value])
        elif key:
            header.setdefault(key, value)
    return header | {key: "\n".join(texts[key]) for key in ACCUMULATING if key in texts}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _card_maps(cards: pd.Series) -> pd.Series:
    return pd.Series([None if own is None else _header_map(map(_card_entry, own)) for own in cards], dtype=object)


def with_card_map(df: DataFrame, cards: str = "cards") -> DataFrame:
    """Replace an array of 80-character cards by the map of its keywords, ``raw_header``."""
    return df.withColumn("raw_header", _card_maps(cards)).drop(cards)


def fits_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, raw_header) of FITS files given as bytes."""
    return with_card_map(header_cards(files, content))


# Fixed value: how a FITS file begins.
SIGNATURE = b"SIMPLE  ="


def _read_header(file) -> list[str] | None:
    """Cards up to END from the current position, leaving the file after the header's blocks.

    Reading stops at a block that is no text, so a file without END is not read to its last byte.
    """
    cards: list[str] = []
    while raw := file.read(BLOCK):
        if not raw.isascii():
            return None
        block = raw.decode("ascii")
        for at in range(0, len(block), CARD):
            if block[at : at + CARD] == END_CARD:
                return cards
            cards.append(block[at : at + CARD])
    return None


def _data_bytes(cards: list[str]) -> int:
    """Size of the data that follows a header, in whole blocks."""
    number = {c[:8].rstrip(): c[10:].split("/")[0].strip() for c in cards if c[8:10] == "= "}
    axes = int(float(number.get("NAXIS", 0)))
    size = abs(int(float(number.get("BITPIX", 8)))) // 8 if axes else 0
    for i in range(1, axes + 1):
        size *= int(float(number[f"NAXIS{i}"]))
    return -(-size // BLOCK) * BLOCK


def cards_of(path: str, range_bytes: int = RANGE_BYTES) -> tuple[list[str] | None, str | None, int]:
    """The cards of a file, what was wrong with it, and the bytes that were fetched.

    A damaged file does not end the job.
    """
    cards, fetched = None, 0
    try:
        with RangedFile(path, range_bytes) as file:
            try:
                if not file.read(9).startswith(SIGNATURE):
                    return None, "not a FITS file", file.bytes_read
                file.seek(0)
                cards = _read_header(file)
                if cards is None:
                    return None, "no END card", file.bytes_read
                if len(cards) < FEW_CARDS:
                    file.seek(_data_bytes(cards), os.SEEK_CUR)
                    cards = _read_header(file) or cards
            finally:
                fetched = file.bytes_read
    except (OSError, ValueError, KeyError, OverflowError) as error:
        return cards, f"{type(error).__name__}: {error}", fetched
    return cards, None, fetched


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Read only the header blocks of each file, skipping over the pixel data."""
    for batch in batches:
        found = [cards_of(path)[:2] for path in batch["path"]]
        cards, errors = zip(*found, strict=True) if found else ((), ())
        yield pd.DataFrame({"path": batch["path"], "cards": list(cards), "error": list(errors)})


def read_fits_headers(inventory: DataFrame) -> DataFrame:
    """(path, error, raw_header) of the FITS files named by ``path``, on any file system.

    Damaged and foreign files have ``error`` set and, unless the primary header could be read, no
    header.

    Only the header blocks are read, a few kilobytes per file however large its pixels are; the
    decoding of the cards is the same as for :func:`fits_headers`.
    """
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("cards", T.ArrayType(T.StringType())),
            T.StructField("error", T.StringType()),
        ]
    )
    cards = inventory.select("path").mapInPandas(_read_headers, schema)
    return with_card_map(cards)


# --- XISF ------------------------------------------------------------------------------------


XISF_PREFIX = 16  # signature, length of the XML as little-endian 32 bits, 4 reserved bytes


def xisf_xml(content) -> Column:
    """The XML header inside XISF bytes; only its own bytes are decoded."""
    content = F.col(content) if isinstance(content, str) else content
    size = F.hex(F.substring(content, 9, 4))
    swapped = F.concat(*[F.substring(size, i, 2) for i in (7, 5, 3, 1)])
    length = F.conv(swapped, 16, 10).cast("int")
    return F.decode(F.substring(content, XISF_PREFIX + 1, length), "UTF-8")


def _first_image(xml: str | None) -> tuple[str | None, list[tuple[str, str]] | None]:
    """Geometry and keywords of the first image, from one reading of the XML."""
    if not xml:
        return None, None
    geometry, whole, bare = "", [], []
    path, images = [], 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal geometry, images
        path.append(name)
        if path == ["xisf", "Image"]:
            images += 1
            if images == 1:
                geometry = attributes.get("geometry", "")
        elif path == ["xisf", "Image", "FITSKeyword"] and images == 1 and "name" in attributes:
            if "value" in attributes:
                whole.append((attributes["name"], attributes["value"].strip("'").strip(" ")))
            else:
                bare.append((attributes["name"], ""))

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: path.pop()
    parser.Parse(xml, True)
    return geometry, whole + bare


_XISF_IMAGE = T.StructType([T.StructField("geometry", T.StringType()), T.StructField("raw_header", T.MapType(T.StringType(), T.StringType()))])


@F.pandas_udf(_XISF_IMAGE)
def _xisf_image(xml: pd.Series) -> pd.DataFrame:
    images = [_first_image(x) for x in xml]
    maps = [None if entries is None else _header_map(entries) for _, entries in images]
    return pd.DataFrame({"geometry": pd.Series([g for g, _ in images], dtype=object), "raw_header": pd.Series(maps, dtype=object)})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def _xisf_entries(xml: pd.Series) -> pd.Series:
    images = [_first_image(x)[1] for x in xml]
    return pd.Series([None if own is None else [{"key": k, "value": v} for k, v in own] for own in images], dtype=object)


def xisf_entries(xml) -> Column:
    """Keywords of the first image as struct<key,value> array, values without their quotes.

    Keywords without a value have an empty one and stand at the end; elements without a name are
    left out. Names and values are read from the same elements, so none can slip to another.
    """
    return _xisf_entries(xml)


def xisf_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, width_pixels, height_pixels, raw_header) of XISF files given as bytes."""
    read = files.select("path", _xisf_image(xisf_xml(content)).alias("_image"))
    geometry = F.split("_image.geometry", ":")
    return read.select(
        "path",
        F.get(geometry, F.lit(0)).try_cast("int").alias("width_pixels"),
        F.get(geometry, F.lit(1)).try_cast("int").alias("height_pixels"),
        "_image.raw_header",
    )


def read_binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Whole files as bytes, for formats without a reader of ranges."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "content")
    )
