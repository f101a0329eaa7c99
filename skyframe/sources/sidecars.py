"""Sidecar files: solver results in INI form, XMP ratings and worker logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.functions.text import to_float
from skyframe.operators.matches import header_matrix, header_value, is_tangent
from skyframe.sources.headers import ACCUMULATING, read_fits_headers
from skyframe.sources.ranged import read_small_texts

# Sidecar extensions in order of preference.
SIDECAR_EXTENSIONS = (".wcs", ".new", ".ini")


def read_texts(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text) of whole text files."""
    return (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def without_extension(path) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def choose_sidecar(images: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """The preferred existing sidecar per image: (path, sidecar_path)."""
    rank = F.lit(None)
    for i, ext in enumerate(SIDECAR_EXTENSIONS):
        rank = F.when(F.col("path").endswith(ext), F.lit(i)).otherwise(rank)
    sidecars = (
        inventory.select("path", rank.alias("_rank"))
        .filter(F.col("_rank").isNotNull())
        .groupBy(without_extension("path").alias("_base"))
        .agg(F.min_by("path", "_rank").alias("sidecar_path"))
    )
    return (
        images.select(F.col(path).alias("path"), without_extension(path).alias("_base"))
        .join(sidecars, "_base")
        .select("path", "sidecar_path")
    )


def ini_solution(text) -> Column:
    """Solution struct of an INI sidecar; NULL without a known section or with a bad number.

    The section is [Astrometry] or else [Field]; absent keys are 0.
    """
    text = F.col(text) if isinstance(text, str) else text
    body = F.lit(None).cast("string")
    for section in ("Field", "Astrometry"):
        shape = rf"(?ms)^\[{section}\][^\n]*$(.*?)(?=^\[|\z)"
        body = F.when(text.rlike(shape), F.regexp_extract(text, shape, 1)).otherwise(body)

    def number(key: str) -> Column:
        line = rf"(?im)^{key}[ \t]*[=:][ \t]*([^\r\n]*?)[ \t]*\r?$"
        return F.when(body.rlike(line), to_float(F.regexp_extract(body, line, 1))).otherwise(
            F.lit(0.0)
        )

    numbers = {
        "ra_center": number("ra"),
        "dec_center": number("dec"),
        "pixel_scale": number("pixscale"),
        "radius_degrees": number("radius"),
    }
    good = body.isNotNull()
    for value in numbers.values():
        good = good & value.isNotNull()
    return F.when(
        good,
        F.struct(*[v.alias(k) for k, v in numbers.items()], F.lit("SIDECAR_INI").alias("wcs_type")),
    )


def wcs_solution(header) -> Column:
    """Solution struct of the header of a ``.wcs`` or ``.new`` sidecar; NULL without a tangent-plane WCS.

    The centre is the sky position of the middle of the frame. Such a sidecar says nothing about scale
    and radius in the columns: the scale is 0 and the radius NULL.
    """

    def number(key: str) -> Column:
        return to_float(header_value(header, key))

    def or_zero(key: str) -> Column:
        return F.coalesce(number(key), F.lit(0.0))

    def text(key: str) -> Column:
        return header_value(header, key)

    known = is_tangent(text) & number("CRVAL1").isNotNull() & number("CRVAL2").isNotNull()
    center = geo.pixel_to_sky_cd(
        or_zero("NAXIS1") / 2, or_zero("NAXIS2") / 2, number("CRVAL1"), number("CRVAL2"),
        or_zero("CRPIX1"), or_zero("CRPIX2"), *header_matrix(number),
    )
    return F.when(
        known,
        F.struct(
            center["ra"].alias("ra_center"),
            center["dec"].alias("dec_center"),
            F.lit(0.0).alias("pixel_scale"),
            F.lit(None).cast("double").alias("radius_degrees"),
            F.lit("SIDECAR_WCS").alias("wcs_type"),
        ),
    )


def sidecar_solutions(chosen: DataFrame, headers: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, sidecar_path, sidecar, wcs_header) of images from the sidecar that was chosen for each.

    ``chosen`` is as :func:`choose_sidecar` gives it, ``headers`` has (path, raw_header) of ``.wcs`` and
    ``.new`` files, ``texts`` (path, text) of ``.ini`` files. ``sidecar`` is NULL where the chosen file gives
    no solution, another one is not tried then; ``wcs_header`` is the whole header behind a solution,
    without its comments, for :func:`skyframe.operators.matches.wcs_choice`.
    """
    headers = headers.select(F.col("path").alias("sidecar_path"), F.col("raw_header").alias("_header"))
    texts = texts.select(F.col("path").alias("sidecar_path"), F.col("text").alias("_text"))
    rows = chosen.join(headers, "sidecar_path", "left").join(texts, "sidecar_path", "left")
    from_text = F.col("sidecar_path").endswith(".ini")
    solution = F.when(from_text, ini_solution("_text")).otherwise(wcs_solution("_header"))
    bare = F.map_filter("_header", lambda key, _: ~key.isin(*ACCUMULATING))
    return rows.withColumn("sidecar", solution).select(
        "path",
        "sidecar_path",
        "sidecar",
        F.when(F.col("sidecar").isNotNull() & ~from_text, bare).alias("wcs_header"),
    )


def read_sidecars(images: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """:func:`sidecar_solutions` with the chosen files read, header blocks only, on any file system."""
    chosen = choose_sidecar(images, inventory, path)
    named = chosen.select(F.col("sidecar_path").alias("path"))
    texts = F.col("path").endswith(".ini")
    return sidecar_solutions(chosen, read_fits_headers(named.filter(~texts)), read_small_texts(named.filter(texts)))


# The forms in which editors write a rating.
RATING_FORMS = (
    r"<xmp:Rating>(\d+)</xmp:Rating>",
    r'xmp:Rating="(\d+)"',
    r"<Rating>(\d+)</Rating>",
    r'exif:Rating="(\d+)"',
)


def xmp_rating(text) -> Column:
    """Rating 0-5 from XMP text, the first form with a valid number; NULL when there is none."""
    text = F.col(text) if isinstance(text, str) else text

    def form(pattern: str) -> Column:
        value = F.regexp_extract(text, pattern, 1).try_cast("int")
        return F.when(value.between(0, 5), value)

    return F.coalesce(*[form(p) for p in RATING_FORMS])


def sidecar_ratings(images: DataFrame, xmp_files: DataFrame) -> DataFrame:
    """(path, rating) from XMP sidecars: ``x.jpg.xmp`` first, then ``x.xmp``."""
    rated = (
        xmp_files.select(
            F.regexp_replace("path", r"\.xmp$", "").alias("_base"), xmp_rating("text").alias("rating")
        )
        .filter(F.col("rating").isNotNull())
    )
    names = images.select(
        "path",
        F.inline(
            F.array(
                F.struct(F.col("path").alias("_base"), F.lit(0).alias("_rank")),
                F.struct(without_extension("path").alias("_base"), F.lit(1).alias("_rank")),
            )
        ),
    )
    return names.join(rated, "_base").groupBy("path").agg(F.min_by("rating", "_rank").alias("rating"))


def xmp_document(rating) -> Column:
    """A minimal XMP sidecar that carries a rating."""
    return F.format_string(
        '<x:xmpmeta xmlns:x="adobe:ns:meta/">'
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
        '<rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/">'
        "<xmp:Rating>%d</xmp:Rating></rdf:Description></rdf:RDF></x:xmpmeta>",
        F.col(rating) if isinstance(rating, str) else rating,
    )


# --- worker logs -----------------------------------------------------------------------------


def log_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds to each log line the concurrency it announces, or the task and seconds it reports.

    A line that announces a concurrency reports no task.
    """
    text = F.col(line)
    announced = F.regexp_extract(text, r"concurrency:\s+(\d+)\s+\(prefork\)", 1)
    seconds = F.regexp_extract(text, r"succeeded in\s+([0-9.]+)\s*s", 1).try_cast("double")
    task = F.regexp_extract(text, r"Task ([\w.]+)", 1)
    is_task = (announced == "") & seconds.isNotNull()
    return lines.withColumns(
        {
            "concurrency": F.when(announced != "", announced.cast("int")),
            "task": F.when(
                is_task,
                F.when(task == "", "generic_task").otherwise(F.substring_index(task, ".", -1)),
            ),
            "seconds": F.when(is_task, seconds),
        }
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, line): log lines in file order.

    Lines of one file are numbered by position within their input split, splits by their place in
    the file, so the order needs no global sort.
    """
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("offset"),
            F.col("value").alias("line"),
        )
    )
