"""Parsing and formatting of header values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- numbers ---------------------------------------------------------------------------------


def to_float(value) -> Column:
    """Number or NULL; never fails."""
    return _col(value).try_cast("double")


def to_int(value) -> Column:
    """Integer or NULL; text such as "1.0" or "2.9" is truncated."""
    number = to_float(value)
    return F.when(~F.isnan(number), number).try_cast("int")


def ratio(numerator, denominator) -> Column:
    """Rational tag value; NULL for a zero denominator."""
    return F.try_divide(to_float(numerator), to_float(denominator))


def ratio_text(value) -> Column:
    """"num/den" or a plain number as DOUBLE."""
    value = _col(value)
    parts = F.split(value, "/")
    return F.when(
        value.contains("/"), ratio(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    ).otherwise(to_float(value))


def low_bit(value) -> Column:
    """The flash tag: fired when the lowest bit of the leading integer is set."""
    return to_int(F.get(F.split(F.trim(_col(value)), r"\s+"), F.lit(0))).bitwiseAND(1) == 1


# --- sexagesimal -----------------------------------------------------------------------------


def sexagesimal(value, hours: bool = False) -> Column:
    """"D M S" or "D:M:S" to degrees, the sign taken from a leading minus.

    With ``hours`` the first part is hours and the result lies in [0, 360). Text of fewer than
    three parts is read as a plain number.
    """
    value = _col(value)
    parts = F.split(F.trim(F.replace(value, F.lit(":"), F.lit(" "))), r"\s+")
    first = F.get(parts, F.lit(0))
    lead = to_float(first)
    minutes, seconds = to_float(F.get(parts, F.lit(1))), to_float(F.get(parts, F.lit(2)))
    negative = first.startswith("-")
    size = F.when(negative, F.abs(lead)).otherwise(lead) + minutes / 60 + seconds / 3600
    if hours:
        angle = F.pmod(size * 15, F.lit(360.0))
    else:
        angle = F.when(negative, -size).otherwise(size)
    return F.when(F.size(parts) >= 3, angle).otherwise(to_float(value))


def coordinate(value, hours: bool = False) -> Column:
    """Plain degrees if numeric, else sexagesimal."""
    return F.coalesce(to_float(value), sexagesimal(value, hours))


def _colon_sum(value) -> Column:
    """"a:b:c" as a + b/60 + c/3600 with absent parts 0; NULL when a present part is bad."""
    parts = F.split(value, ":")

    def part(i: int) -> Column:
        return F.when(F.size(parts) > i, to_float(F.get(parts, F.lit(i)))).otherwise(F.lit(0.0))

    return part(0) + part(1) / 60 + part(2) / 3600


def catalog_ra(value) -> Column:
    """Catalogue "h:m:s" to degrees; missing or unreadable text is 0."""
    return F.coalesce(_colon_sum(_col(value)) * 15, F.lit(0.0))


def catalog_dec(value) -> Column:
    """Catalogue "±d:m:s" to degrees; missing or unreadable text is 0."""
    value = _col(value)
    size = _colon_sum(F.regexp_replace(value, "^[+-]", ""))
    return F.coalesce(F.when(value.startswith("-"), -size).otherwise(size), F.lit(0.0))


def clock_to_degrees(value) -> Column:
    """"HH:MM" to degrees; bad or absent parts count 0, blank text gives NULL."""
    value = _col(value)
    parts = F.split(value, ":")
    number = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))"

    def part(i: int) -> Column:
        return F.coalesce(to_float(F.regexp_extract(F.get(parts, F.lit(i)), number, 1)), F.lit(0.0))

    return F.when(value != "", (part(0) + part(1) / 60) * 15)


def _split_sexagesimal(value: Column) -> tuple[Column, Column, Column]:
    whole = F.floor(value)
    minutes = F.floor((value - whole) * 60)
    return whole, minutes, ((value - whole) * 60 - minutes) * 60


def coordinates_display(ra, dec) -> Column:
    """"05h 34m 31.00s, +22° 00' 52.1"" or NULL."""
    ra, dec = _col(ra), _col(dec)
    h, hm, hs = _split_sexagesimal(ra / 15)
    d, dm, ds = _split_sexagesimal(F.abs(dec))
    text = F.format_string(
        "%02dh %02dm %05.2fs, %s%02d° %02d' %04.1f\"",
        h, hm, hs, F.when(dec >= 0, "+").otherwise("-"), d, dm, ds,
    )
    return F.when(ra.isNotNull() & dec.isNotNull(), text)


def ra_clock(degrees) -> Column:
    """"HH:MM:SS.s", "--" when missing."""
    degrees = _col(degrees)
    h, m, s = _split_sexagesimal(degrees / 15)
    return F.when(degrees.isNull(), "--").otherwise(F.format_string("%02d:%02d:%04.1f", h, m, s))


def dec_display(degrees) -> Column:
    """"±D° M' S.s"", "--" when missing."""
    degrees = _col(degrees)
    d, m, s = _split_sexagesimal(F.abs(degrees))
    sign = F.when(degrees >= 0, "+").otherwise("-")
    return F.when(degrees.isNull(), "--").otherwise(
        F.format_string("%s%d° %d' %.1f\"", sign, d, m, s)
    )


def ra_hours_minutes(degrees) -> Column:
    """"HH:MM" with rounded minutes, empty when missing."""
    degrees = _col(degrees)
    hours = degrees / 15
    whole = F.floor(hours)
    minutes = F.floor((hours - whole) * 60 + 0.5)
    return F.when(degrees.isNull(), "").otherwise(F.format_string("%02d:%02d", whole, minutes))


# --- names -----------------------------------------------------------------------------------

# Spellings of one filter, compared in lower case without punctuation.
FILTER_SYNONYMS = {
    "Red": ("r", "red"),
    "Green": ("g", "green"),
    "Blue": ("b", "blue"),
    "Luminance": ("l", "lum", "luminance", "uvircut", "lpro"),
    "H-Alpha": ("h", "ha", "halpha"),
    "OIII": ("o", "o3", "oiii", "oxygen3"),
    "SII": ("s", "s2", "sii", "sulfur2"),
    "Dark": ("dark",),
    "Flat": ("flat",),
    "Bias": ("bias", "offset"),
}


def canonical_filter(name) -> Column:
    """Filter name with synonyms folded; others get a capital first letter."""
    name = _col(name)
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    chain = F.when(name.isNull() | (name == ""), "Unknown")
    for canonical, spellings in FILTER_SYNONYMS.items():
        chain = chain.when(plain.isin(*spellings), canonical)
    return chain.otherwise(F.concat(F.upper(F.substring(name, 1, 1)), name.substr(F.lit(2), F.length(name))))


# Display names of the subtypes.
SUBTYPE_LABELS = {
    "SUB_FRAME": "Sub Frame",
    "INTEGRATION_MASTER": "Integration Master",
    "INTEGRATION_DEPRECATED": "Deprecated",
    "PLANETARY": "Planetary",
}


def subtype_label(subtype) -> Column:
    subtype = _col(subtype)
    chain = F.when(subtype.isNull() | (subtype == ""), "Unclassified")
    for code, label in SUBTYPE_LABELS.items():
        chain = chain.when(subtype == code, label)
    return chain.otherwise(subtype)


def without_blanks(value) -> Column:
    """Normal form of a designation: no blanks."""
    return F.replace(_col(value), F.lit(" "), F.lit(""))


def designation_number(name) -> Column:
    """NGC0224 -> 224, IC0010 -> 10; anything else, or trailing letters, gives 0."""
    digits = F.regexp_extract(_col(name), r"^(?:NGC|IC)\s*([0-9]+)\s*$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def strip_nul(value) -> Column:
    """Remove the NUL character and its six-character escape."""
    text = F.replace(_col(value), F.lit("\x00"), F.lit(""))
    return F.replace(text, F.lit("\\u0000"), F.lit(""))


def strip_nul_map(header) -> Column:
    """:func:`strip_nul` on the keys and values of a header map; of keys that become equal the first counts."""
    entries = F.transform(
        F.map_entries(_col(header)),
        lambda e: F.struct(strip_nul(e["key"]).alias("key"), strip_nul(e["value"]).alias("value")),
    )
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


# --- dates -----------------------------------------------------------------------------------

# Layouts tried, in order, after ISO 8601.
DATE_LAYOUTS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("dd/MM/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
)
_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
    r"(?:Z|[+-]\d{2}:?\d{2})?)?$"
)


def header_date(value) -> Column:
    """Capture date of a header as TIMESTAMP_NTZ, or NULL.

    ISO 8601 first (the offset, if any, is dropped), then the plain date layouts. A second of 60
    is read as 59.
    """
    text = F.trim(_col(value))
    text = F.regexp_replace(text, r"^([^T]*T[^:]*:[^:]*:)60", "$159")

    def piece(group: int, default: str) -> Column:
        found = F.regexp_extract(text, _ISO, group)
        return F.when(found == "", F.lit(default)).otherwise(found)

    iso = F.when(
        text.rlike(_ISO),
        F.concat(
            piece(1, ""), F.lit(" "), piece(2, "00"), F.lit(":"), piece(3, "00"), F.lit(":"),
            piece(4, "00"), F.lit("."), F.substring(piece(5, "0"), 1, 6),
        ),
    ).try_cast("timestamp_ntz")
    dates = []
    for layout, shape in DATE_LAYOUTS:
        first, middle, last = (F.get(F.split(text, "[-/]"), F.lit(i)) for i in range(3))
        year, day = (first, last) if layout.startswith("yyyy") else (last, first)
        ymd = F.concat_ws("-", year, F.lpad(middle, 2, "0"), F.lpad(day, 2, "0"))
        dates.append(F.when(text.rlike(shape), ymd).try_cast("timestamp_ntz"))
    return F.coalesce(iso, *dates)


def exif_date(value) -> Column:
    """"yyyy:MM:dd HH:mm:ss" as TIMESTAMP_NTZ, or NULL."""
    text = _col(value)
    shape = r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
    parts = [F.lpad(F.regexp_extract(text, shape, i), 2, "0") for i in range(2, 7)]
    month, day, hour, minute, second = parts
    iso = F.concat(
        F.concat_ws("-", F.regexp_extract(text, shape, 1), month, day), F.lit(" "),
        F.concat_ws(":", hour, minute, second),
    )
    return F.when(text.rlike(shape), iso).try_cast("timestamp_ntz")


# --- display ---------------------------------------------------------------------------------


def angular_size_display(major, minor) -> Column:
    """"a' × b'", "a'" or "Unknown"; 0 counts as missing."""
    major, minor = _col(major), _col(minor)
    return (
        F.when((major != 0) & (minor != 0), F.format_string("%.1f' × %.1f'", major, minor))
        .when(major != 0, F.format_string("%.1f'", major))
        .otherwise("Unknown")
    )


def _short_number(value: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    return F.regexp_replace(
        F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", ""
    )


def bytes_display(size) -> Column:
    """"1.5 MB"."""
    size = _col(size).cast("double")
    chain = F.when(size == 0, "0 B")
    units = ("B", "KB", "MB", "GB", "TB")
    for power, unit in enumerate(units):
        text = F.concat(_short_number(size / float(1024**power)), F.lit(f" {unit}"))
        chain = chain.when(size < float(1024 ** (power + 1)), text) if unit != "TB" else chain.when(
            size.isNotNull(), text
        )
    return chain


def exposure_display(seconds) -> Column:
    """Milliseconds, seconds, minutes or hours, "N/A" when missing."""
    seconds = _col(seconds)
    left = seconds - F.floor(seconds / 60) * 60
    whole_left = F.when(left == F.floor(left), left.cast("long").cast("string")).otherwise(
        left.cast("string")
    )
    return (
        F.when(seconds.isNull(), "N/A")
        .when(seconds < 1, F.concat(F.format_string("%.0f", seconds * 1000), F.lit("ms")))
        .when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .when(
            seconds < 3600,
            F.concat(
                F.floor(seconds / 60).cast("string"), F.lit("m "), whole_left, F.lit("s")
            ),
        )
        .otherwise(
            F.concat(
                F.floor(seconds / 3600).cast("string"), F.lit("h "),
                F.floor((seconds % 3600) / 60).cast("string"), F.lit("m"),
            )
        )
    )


# --- paths and hashes ------------------------------------------------------------------------


def file_name(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def extension(path) -> Column:
    """Lower-case extension without the dot, "" when there is none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/]\.([^./]+)$", 1))


def stem(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def parent_folder(path) -> Column:
    """Everything before the last slash or backslash; NULL when there is none."""
    path = _col(path)
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1))


def path_hash(path) -> Column:
    return F.substring(F.md5(_col(path)), 1, 8)


def thumbnail_name(path) -> Column:
    return F.concat(stem(path), F.lit("_"), path_hash(path), F.lit("_thumb.jpg"))


def content_hash(content) -> Column:
    return F.sha2(_col(content), 256)


def is_safe_path(path, roots: list[str]) -> Column:
    """Under one of the allowed roots and without parent references."""
    path = _col(path)
    allowed = F.lit(False)
    for root in roots:
        allowed = allowed | path.startswith(root)
    return allowed & ~path.contains("..")
