"""Ingest jobs: headers to image rows, upsert, solver work lists and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.functions.text import (
    coordinate,
    exif_date,
    header_date,
    low_bit,
    ratio_text,
    sexagesimal,
    to_float,
    to_int,
)
from skyframe.operators.filters import lacks_metadata
from skyframe.operators.matches import header_matrix, header_value, is_tangent
from skyframe.operators.updates import BUSY_STATES


def _truthy(value: Column) -> Column:
    """The value unless it is empty or the number zero."""
    return F.when((value != "") & F.coalesce(to_float(value) != 0, F.lit(True)), value)


def _first(header: str, keys: tuple[str, ...], strict: bool) -> Column:
    """First keyword with a value; in strict mode zeros and empty texts are passed over too."""
    values = [header_value(header, k) for k in keys]
    return F.coalesce(*[_truthy(v) if strict else v for v in values])


# Keywords of each column in order of precedence.
TEXT_KEYWORDS = {
    "telescope_name": "TELESCOP",
    "filter_name": "FILTER",
    "observer_name": "OBSERVER",
    "object_name": "OBJECT",
}


def header_columns(header: str, strict_reference: bool = False) -> dict[str, Column]:
    """Typed image columns of a header map.

    ``strict_reference`` passes over zeros in keyword alternatives, and lets an INSTRUME without
    value hide CAMERA.
    """

    def first(*keys: str) -> Column:
        return _first(header, keys, strict_reference)

    def value(key: str) -> Column:
        return header_value(header, key)

    camera = F.coalesce(value("INSTRUME"), value("CAMERA"))
    if strict_reference:
        camera = F.when(
            F.map_contains_key(F.col(header), "INSTRUME"), value("INSTRUME")
        ).otherwise(value("CAMERA"))
    columns = {
        "width_pixels": to_int(value("NAXIS1")),
        "height_pixels": to_int(value("NAXIS2")),
        "exposure_time_seconds": F.coalesce(
            to_float(value("EXPTIME")), to_float(value("EXPOSURE")), F.lit(0.0)
        ),
        "capture_date": header_date(first("DATE-OBS", "DATE")),
        "gain": to_float(value("GAIN")),
        "iso_speed": to_int(first("ISOSPEED", "ISO")),
        "temperature_celsius": to_float(first("CCD-TEMP", "TEMP", "SET-TEMP")),
        "camera_name": camera,
    }
    columns |= {name: value(key) for name, key in TEXT_KEYWORDS.items()}
    columns["site_latitude"] = to_float(value("SITELAT"))
    columns["site_longitude"] = to_float(value("SITELONG"))
    return columns


def canonical_header(df: DataFrame, map_col: str, strict_reference: bool = False) -> DataFrame:
    """Add the typed image columns of a header map."""
    return df.withColumns(header_columns(map_col, strict_reference))


# Keywords that say where a frame points.
WCS_NUMBERS = (
    "NAXIS1", "NAXIS2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2",
    "CDELT1", "CDELT2", "CROTA2", "FOCALLEN",
)
WCS_KEYWORDS = WCS_NUMBERS + (
    "CTYPE1", "CTYPE2", "RA", "DEC", "OBJCTRA", "OBJCTDEC", "PIXSCALE", "SCALE", "RESOLUTN",
    "XPIXSZ", "PIXSIZE1", "ROTATION", "POSANGLE", "ANGLE", "POSANG", "ROTATANG", "ROTATOR",
)


def header_wcs(df: DataFrame, map_col: str, strict_reference: bool = False) -> DataFrame:
    """Add ``wcs``: struct<ra_center,dec_center,radius_degrees,pixel_scale,rotation,wcs_type>.

    NULL when the header has no position. Works in steps, each a plain projection: the WCS cards,
    then direct coordinates, then scale, rotation and radius from other keywords.
    """

    # Keywords are looked up once, numbers parsed once; later steps only refer to them.
    looked_up = F.struct(*[header_value(map_col, k).alias(k) for k in WCS_KEYWORDS])
    df = df.withColumn("_h", looked_up).withColumn(
        "_n", F.struct(*[to_float(F.col(f"_h.{k}")).alias(k) for k in WCS_NUMBERS])
    )

    def number(key: str) -> Column:
        return F.col(f"_n.{key}")

    def raw(key: str) -> Column:
        return F.col(f"_h.{key}")

    def has(key: str) -> Column:
        return raw(key).isNotNull()

    def first(*keys: str) -> Column:
        return F.coalesce(*[_truthy(raw(k)) if strict_reference else raw(k) for k in keys])

    width, height = number("NAXIS1"), number("NAXIS2")
    cd11, cd12 = number("CD1_1"), F.coalesce(number("CD1_2"), F.lit(0.0))
    cd22 = F.coalesce(number("CD2_2"), F.lit(0.0))
    card_scale = (
        F.when(has("CDELT1"), F.abs(number("CDELT1")) * 3600)
        .when(has("CD1_1"), F.sqrt(cd11 * cd11 + cd12 * cd12) * 3600)
        .otherwise(F.lit(0.0))
    )
    has_center = has("CRVAL1") & has("CRVAL2")
    trusted = has_center & (card_scale > 0) & (width != 0) & (height != 0)
    steps = df.withColumns(
        {
            "_scale": card_scale,
            "_trusted": F.coalesce(trusted, F.lit(False)),
            "_cd": F.array(*header_matrix(number)),
        }
    )

    def world(x: Column, y: Column) -> Column:
        cd = [F.get("_cd", F.lit(i)) for i in range(4)]
        return geo.pixel_to_sky_cd(
            x, y, number("CRVAL1"), number("CRVAL2"),
            F.coalesce(number("CRPIX1"), F.lit(0.0)), F.coalesce(number("CRPIX2"), F.lit(0.0)), *cd,
        )

    # A trusted header whose axes are not a tangent plane gives no centre at all here.
    usable = F.col("_trusted") & is_tangent(raw)
    steps = steps.withColumns(
        {
            "_center": F.when(usable, world(width / 2, height / 2)),
            "_corner": F.when(usable, world(F.lit(0.0), F.lit(0.0))),
        }
    )
    direct = has_center & ~F.col("_trusted")
    card_rotation = (
        F.when(has("CD1_1"), F.degrees(F.atan2(-cd12, cd22)))
        .when(has("CROTA2"), number("CROTA2"))
        .otherwise(F.lit(0.0))
    )
    steps = steps.withColumns(
        {
            "_other_ra": F.when(has("RA"), coordinate(raw("RA"), True)).otherwise(
                sexagesimal(raw("OBJCTRA"), True)
            ),
            "_other_dec": F.when(has("DEC"), coordinate(raw("DEC"))).otherwise(
                sexagesimal(raw("OBJCTDEC"))
            ),
        }
    )
    other_ra, other_dec = F.col("_other_ra"), F.col("_other_dec")
    solved = F.col("_center").isNotNull()
    direct_ra = F.when(direct, number("CRVAL1"))
    steps = steps.withColumns(
        {
            "_ra": F.coalesce(F.col("_center.ra"), direct_ra, other_ra),
            # Declination follows the source of the right ascension.
            "_dec": F.when(solved, F.col("_center.dec"))
            .when(direct_ra.isNotNull(), number("CRVAL2"))
            .otherwise(other_dec),
            "_type": F.when(solved, "HEADER_WCS")
            .when(direct_ra.isNotNull(), "HEADER_CRVAL")
            .otherwise("HEADER_FALLBACK"),
            "_rot": F.when(solved, card_rotation).otherwise(F.lit(0.0)),
            "_radius": F.coalesce(
                geo.angular_separation("_center.ra", "_center.dec", "_corner.ra", "_corner.dec"),
                F.lit(1.0),
            ),
        }
    )
    named_scale = first("PIXSCALE", "SCALE", "RESOLUTN")
    focal, pixel = number("FOCALLEN"), to_float(first("XPIXSZ", "PIXSIZE1"))
    optics = F.when((focal != 0) & (pixel != 0), pixel / focal * 206.265)
    scale = F.when(solved, F.col("_scale")).otherwise(
        F.when(named_scale.isNotNull(), to_float(named_scale)).otherwise(optics)
    )
    named_rotation = to_float(
        first("ROTATION", "POSANGLE", "ANGLE", "POSANG", "ROTATANG", "ROTATOR")
    )
    steps = steps.withColumns(
        {
            "_scale": scale,
            "_rot": F.when(F.col("_rot") == 0, F.coalesce(named_rotation, F.lit(0.0))).otherwise(
                F.col("_rot")
            ),
        }
    )
    suspicious = (F.col("_scale") != 0) & ((F.col("_radius") == 1.0) | (F.col("_radius") > 20.0))
    radius = (
        F.when(suspicious & (width != 0) & (height != 0), geo.frame_radius(width, height, "_scale"))
        .when(suspicious & (F.col("_radius") > 20.0), F.lit(1.0))
        .otherwise(F.col("_radius"))
    )
    known = F.col("_ra").isNotNull() & F.col("_dec").isNotNull()
    wcs = F.when(
        known,
        F.struct(
            F.col("_ra").alias("ra_center"),
            F.col("_dec").alias("dec_center"),
            radius.alias("radius_degrees"),
            F.coalesce("_scale", F.lit(0.0)).alias("pixel_scale"),
            F.col("_rot").alias("rotation"),
            F.col("_type").alias("wcs_type"),
        ),
    )
    return steps.withColumn("wcs", wcs).drop(
        "_h", "_n", "_scale", "_trusted", "_cd", "_center", "_corner", "_other_ra", "_other_dec",
        "_ra", "_dec", "_type", "_rot", "_radius",
    )


def solution_columns(wcs: Column, sidecar: Column | None = None) -> dict[str, Column]:
    """Image columns from the header's WCS struct, or else from a sidecar's."""
    names = {
        "ra_center_degrees": "ra_center",
        "dec_center_degrees": "dec_center",
        "field_radius_degrees": "radius_degrees",
        "pixel_scale_arcsec": "pixel_scale",
    }
    columns = {}
    for name, field in names.items():
        value = wcs[field]
        if sidecar is not None:
            value = F.when(wcs.isNotNull(), value).otherwise(sidecar[field])
        columns[name] = value
    columns["rotation_degrees"] = wcs["rotation"]
    solved = wcs.isNotNull() if sidecar is None else wcs.isNotNull() | sidecar.isNotNull()
    columns["is_plate_solved"] = solved
    columns["plate_solve_source"] = F.when(wcs.isNotNull(), "HEADER").when(solved, "SIDECAR")
    return columns


def header_images(headers: DataFrame, map_col: str = "raw_header", sidecar_col: str | None = None):
    """Complete image rows from (path, header map): typed columns and solution.

    With a sidecar column its solution counts where the header has none; a ``wcs_header`` that came with
    it is kept for those rows only.
    """
    rows = canonical_header(header_wcs(headers, map_col), map_col)
    sidecar = F.col(sidecar_col) if sidecar_col else None
    rows = rows.withColumns(solution_columns(F.col("wcs"), sidecar))
    if sidecar_col and "wcs_header" in rows.columns:
        rows = rows.withColumn("wcs_header", F.when(F.col("wcs").isNull(), F.col("wcs_header")))
    return rows.drop("wcs")


# --- EXIF ----------------------------------------------------------------------------------------

# Tags that feed image columns.
EXIF_TAGS = (
    "EXIF ExposureTime", "EXIF ISOSpeedRatings", "EXIF DateTimeOriginal", "Image DateTime",
    "Image Make", "Image Model", "EXIF LensModel", "EXIF FNumber", "EXIF FocalLength",
    "EXIF FocalLengthIn35mmFilm", "EXIF WhiteBalance", "EXIF MeteringMode", "EXIF Flash",
    "Image Rating", "EXIF Rating", "MakerNote Rating",
)


def exif_images(
    tags: DataFrame,
    sidecar_ratings: DataFrame | None = None,
    embedded: DataFrame | None = None,
    inventory: DataFrame | None = None,
) -> DataFrame:
    """Image columns from (path, tag, value) rows; one aggregation, no pivot pass.

    One row for every path of ``inventory``, or, without it, for every path with any tag, listed or not.

    Ratings: XMP sidecar (path, rating) before embedded XMP (path, rating) before the EXIF tag.
    """
    wide = tags.groupBy("path").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in EXIF_TAGS]
    )
    if inventory is not None:
        wide = inventory.select("path").distinct().join(wide, "path", "left")

    def tag(name: str) -> Column:
        return F.col(f"`{name}`")

    rating_tag = to_int(
        F.coalesce(tag("Image Rating"), tag("EXIF Rating"), tag("MakerNote Rating"))
    )
    film = F.get(F.split(F.trim(tag("EXIF FocalLengthIn35mmFilm")), r"\s+"), F.lit(0))
    make_model = F.concat_ws(
        " ",
        F.trim(F.coalesce(tag("Image Make"), F.lit(""))),
        F.trim(F.coalesce(tag("Image Model"), F.lit(""))),
    )
    rows = wide.select(
        "path",
        ratio_text(tag("EXIF ExposureTime")).alias("exposure_time_seconds"),
        to_int(tag("EXIF ISOSpeedRatings")).alias("iso_speed"),
        to_float(tag("EXIF ISOSpeedRatings")).alias("gain"),
        exif_date(F.coalesce(tag("EXIF DateTimeOriginal"), tag("Image DateTime"))).alias(
            "capture_date"
        ),
        F.trim(make_model).alias("camera_name"),
        F.trim(tag("EXIF LensModel")).alias("lens_model"),
        ratio_text(tag("EXIF FNumber")).alias("aperture"),
        ratio_text(tag("EXIF FocalLength")).alias("focal_length"),
        to_float(film).alias("focal_length_35mm"),
        F.trim(tag("EXIF WhiteBalance")).alias("white_balance"),
        F.trim(tag("EXIF MeteringMode")).alias("metering_mode"),
        low_bit(tag("EXIF Flash")).alias("flash_fired"),
        F.when(rating_tag.between(0, 5), rating_tag).alias("rating"),
    )
    ratings = [F.col("rating")]
    for i, source in enumerate((embedded, sidecar_ratings)):
        if source is not None:
            rows = rows.join(source.select("path", F.col("rating").alias(f"_r{i}")), "path", "left")
            ratings.insert(0, F.col(f"_r{i}"))
    return rows.withColumn("rating", F.coalesce(*ratings)).drop("_r0", "_r1")


# --- upsert --------------------------------------------------------------------------------------

IDENTITY_COLUMNS = ("id", "file_path", "file_name", "file_format", "subtype")
SOLUTION_COLUMNS = (
    "is_plate_solved", "plate_solve_source", "ra_center_degrees", "dec_center_degrees",
    "field_radius_degrees", "pixel_scale_arcsec", "rotation_degrees",
)
# Kept when the new extraction has none.
STICKY_COLUMNS = ("pixinsight_annotation_path", "thumbnail_path")


def _with_date(incoming: DataFrame) -> DataFrame:
    """The capture date falls back to the file's modification time."""
    if "capture_date" not in incoming.columns or "file_last_modified" not in incoming.columns:
        return incoming
    return incoming.withColumn("capture_date", F.coalesce("capture_date", "file_last_modified"))


def path_id(path: str = "file_path") -> Column:
    """A number for a path, the same in every run: the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.col(path).cast("binary")), 1, 15), 16, 10).cast("long")


def _newest(incoming: DataFrame) -> DataFrame:
    """The newest state of each path."""
    ages = [c for c in ("file_last_modified", "file_size_bytes") if c in incoming.columns]
    newest = Window.partitionBy("file_path").orderBy(*[F.col(c).desc_nulls_last() for c in ages], "file_path")
    return incoming.withColumn("_n", F.row_number().over(newest)).filter("_n <= 1").drop("_n")


def upsert_images(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Image table after an extraction run; key ``file_path``.

    Known files get the new metadata, but keep the solution when the solver made it, keep
    thumbnail and annotation when there is no new one, and never change name, format or subtype.
    New files are added with the defaults; without an ``id`` of their own they get :func:`path_id`. Of
    a file that is reported twice the newest state counts.

    The current table is only joined to the incoming side, so when that is small the wide rows
    stay where they are.
    """
    incoming = _newest(_with_date(incoming))
    fields = [c for c in incoming.columns if c in current.columns and c != "file_path"]
    changes = incoming.select(
        "file_path", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    hit = F.coalesce("_hit", F.lit(False))
    protected = F.coalesce(F.col("astrometry_status") == "SOLVED", F.lit(False))
    columns = []
    for name in current.columns:
        old, new = F.col(name), F.col(f"_new_{name}")
        if name not in fields or name in IDENTITY_COLUMNS:
            columns.append(old)
        elif name in SOLUTION_COLUMNS:
            columns.append(F.when(hit & ~protected, new).otherwise(old).alias(name))
        elif name in STICKY_COLUMNS:
            columns.append(F.coalesce(new, old).alias(name))
        else:
            columns.append(F.when(hit, new).otherwise(old).alias(name))
    updated = current.join(changes, "file_path", "left").select(*columns)
    known = current.select("file_path").join(incoming.select("file_path"), "file_path", "left_semi")
    added = incoming.join(known, "file_path", "left_anti")
    if "id" in current.columns:
        own = [F.col("id")] if "id" in added.columns else []
        added = added.withColumn("id", F.coalesce(*own, path_id()).cast(current.schema["id"].dataType))
    if "astrometry_status" not in added.columns:
        added = added.withColumn("astrometry_status", F.lit("NONE"))
    return updated.unionByName(
        added.select(*[c for c in added.columns if c in current.columns]), allowMissingColumns=True
    )


def backfill(
    images: DataFrame,
    extracted: DataFrame,
    fields: list[str],
    none_only: tuple[str, ...] = ("aperture", "focal_length"),
) -> DataFrame:
    """Fill missing columns from a new extraction (key ``file_path``); adds ``backfilled``.

    Only images that lack a dimension, the exposure or the camera are touched. Zero counts as
    missing, on both sides, except in ``none_only`` columns of the table.
    """
    renamed = extracted.select("file_path", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = images.join(renamed, "file_path", "left")
    kinds = dict(images.dtypes)
    changed, columns, lacking = F.lit(False), {}, lacks_metadata()
    for name in fields:
        old, new = F.col(name), F.col(f"_new_{name}")
        numeric = kinds[name] in ("double", "float", "int", "bigint")
        empty = F.lit(0) if numeric else F.lit("")
        blank = old.isNull()
        offered = new.isNotNull()
        if kinds[name] not in ("timestamp_ntz", "timestamp", "boolean"):
            offered = offered & (new != empty)
            if name not in none_only:
                blank = blank | (old == empty)
        fill = F.coalesce(lacking & blank & offered, F.lit(False))
        changed = changed | fill
        columns[name] = F.when(fill, new).otherwise(old)
    return (
        joined.withColumns({"backfilled": changed, **columns})
        .drop(*[f"_new_{f}" for f in fields])
    )


# --- solver work ---------------------------------------------------------------------------------


def solve_queue(images: DataFrame, prefix: str, force: bool = False) -> DataFrame:
    """How a bulk re-solve treats each image below a path: ``queue`` and its ``rank``.

    PRIORITY (0): solved from a header only. STANDARD (1): unsolved, failed or forced. SKIPPED (2).
    """
    status, solved = F.col("astrometry_status"), F.col("is_plate_solved")
    busy = status.isin(*BUSY_STATES)
    retry = F.lit(True) if force else (
        (~solved & ~status.isin(*BUSY_STATES, "SOLVED")) | (status == "FAILED")
    )
    imported = solved & (status != "SOLVED")
    queue = (
        F.when(F.col("subtype") == "PLANETARY", "SKIPPED")
        .when(imported & busy & F.lit(not force), "SKIPPED")
        .when(imported, "PRIORITY")
        .when(retry, "STANDARD")
        .otherwise("SKIPPED")
    )
    rank = F.when(F.col("queue") == "PRIORITY", 0).when(F.col("queue") == "STANDARD", 1).otherwise(2)
    return (
        images.filter(F.col("file_path").startswith(prefix))
        .withColumn("queue", queue)
        .withColumn("rank", rank)
    )


def work_list(images: DataFrame, prefix: str, force: bool = False) -> DataFrame:
    """The images to submit, priority first."""
    return (
        solve_queue(images, prefix, force)
        .filter(F.col("queue") != "SKIPPED")
        .orderBy("rank", "id")
    )


def solver_hints(images: DataFrame) -> DataFrame:
    """Adds ``hints``: position and scale bounds; NULL fields after a failed attempt."""
    usable = F.col("astrometry_status") != "FAILED"
    placed = usable & F.col("ra_center_degrees").isNotNull() & F.col("dec_center_degrees").isNotNull()
    radius = F.col("field_radius_degrees")
    scaled = usable & F.col("pixel_scale_arcsec").isNotNull()
    return images.withColumn(
        "hints",
        F.struct(
            F.when(placed, F.col("ra_center_degrees")).alias("center_ra"),
            F.when(placed, F.col("dec_center_degrees")).alias("center_dec"),
            F.when(placed, F.coalesce(F.when(radius != 0, radius), F.lit(5.0))).alias("radius"),
            F.when(scaled, F.lit("arcsecperpix")).alias("scale_units"),
            F.when(scaled, F.col("pixel_scale_arcsec") * 0.9).alias("scale_lower"),
            F.when(scaled, F.col("pixel_scale_arcsec") * 1.1).alias("scale_upper"),
        ),
    )
