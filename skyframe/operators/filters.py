"""One composable set of image predicates, shared by listing, export and bulk updates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, fields
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.text import without_blanks
from skyframe.operators.crossmatch import near_point

# File formats that name the same kind of file.
FORMAT_ALIASES = {
    "FITS": ("FITS", "FIT"),
    "FIT": ("FITS", "FIT"),
    "TIFF": ("TIFF", "TIF"),
    "TIF": ("TIFF", "TIF"),
    "JPG": ("JPG", "JPEG"),
    "JPEG": ("JPG", "JPEG"),
}


def contains_text(column, text: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in ``text`` act as wildcards."""
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike(f"%{text}%")


def contains_any(column, texts: Iterable[str]) -> Column | None:
    """True when any non-blank text is contained; None when there is none to test."""
    tests = [contains_text(column, text) for text in texts if text]
    return reduce(or_, tests) if tests else None


def in_range(column: str, low=None, high=None, high_exclusive: bool = False) -> list[Column]:
    tests = []
    if low is not None:
        tests.append(F.col(column) >= low)
    if high is not None:
        tests.append(F.col(column) < high if high_exclusive else F.col(column) <= high)
    return tests


def timestamp_bound(value) -> Column:
    """A date means its midnight."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = f"{value.isoformat()} 00:00:00"
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def solve_state_test(state) -> Column | None:
    """Predicate for a solve-state option; None when the option does not restrict."""
    solved = F.col("is_plate_solved")
    if state == "solved":
        return F.col("astrometry_status") == "SOLVED"
    if state == "imported":
        return solved & (F.col("astrometry_status") != "SOLVED")
    if state is True or state in ("true", "1"):
        return solved
    if state is False or state in ("unsolved", "false", "0"):
        return ~solved
    return None


def header_test(header_col: str, key: str, value: str | None) -> Column:
    """Header map: the key's value contains ``value``, or just the key is present."""
    if value:
        return contains_text(F.try_element_at(F.col(header_col), F.lit(key)), value)
    return F.map_contains_key(F.col(header_col), key)


def json_header_test(json_col: str, key: str, value: str | None) -> Column:
    """The same for headers kept as JSON text."""
    if value:
        return contains_text(F.get_json_object(json_col, f"$['{key}']"), value)
    return F.array_contains(F.json_object_keys(json_col), key)


def images_of_object(images: DataFrame, matches: DataFrame, stars: DataFrame, q: str) -> DataFrame:
    """Images whose own object name or a matched object answers to ``q``.

    Designations must equal ``q`` ignoring blanks and case, so M1 does not find M13; star common
    names may contain it. Qualifying matches are found first, in one reading that shuffles none of the others,
    and reach the images by a semi join, so wide rows are neither multiplied nor made distinct.
    """
    wanted = q.replace(" ", "")
    star_hits = stars.filter(
        without_blanks("designation").ilike(wanted) | contains_text("common_name", q)
    ).select(F.col("designation").alias("catalog_designation"), F.lit(True).alias("_star")).distinct()
    answering = matches.select("image_id", "catalog_designation").join(
        F.broadcast(star_hits), "catalog_designation", "left"
    ).filter(F.col("_star") | without_blanks("catalog_designation").ilike(wanted))
    own_name = images.filter(without_blanks("object_name").ilike(wanted))
    ids = (
        answering.select("image_id")
        .unionAll(own_name.select(F.col("id").alias("image_id")))
    )
    return images.join(ids, images["id"] == ids["image_id"], "left_semi")


@dataclass(frozen=True)
class ImageFilter:
    """Optional predicates, combined with AND; an absent option does not restrict."""

    subtype: str | None = None
    format: str | None = None
    solve_state: bool | str | None = None
    rating: int | None = None
    search: str | None = None
    object_name: str | None = None
    exposure_min: float | None = None
    exposure_max: float | None = None
    max_exposure_exclusive: bool = False
    rotation_min: float | None = None
    rotation_max: float | None = None
    pixel_scale_min: float | None = None
    pixel_scale_max: float | None = None
    pixel_scale_max_exclusive: bool = False
    filter: str | None = None
    camera: str | None = None
    telescope: str | None = None
    gain_min: float | None = None
    gain_max: float | None = None
    ra: float | None = None
    dec: float | None = None
    radius: float | None = None
    path: str | None = None
    start_date: dt.date | str | None = None
    end_date: dt.date | str | None = None
    header_key: str | None = None
    header_value: str | None = None
    header_col: str = "raw_header"

    @classmethod
    def from_options(cls, options: dict) -> ImageFilter:
        known = {f.name for f in fields(cls)}
        unknown = set(options) - known
        if unknown:
            raise ValueError(f"unknown filter options: {sorted(unknown)}")
        return cls(**options)

    def conditions(self) -> list[Column]:
        """All predicates on single rows (everything but object name and cone)."""
        tests: list[Column] = []
        if self.subtype:
            tests.append(F.col("subtype") == self.subtype)
        if self.format:
            tests.append(F.col("file_format").isin(*FORMAT_ALIASES.get(self.format, [self.format])))
        state = None if self.solve_state is None else solve_state_test(self.solve_state)
        if state is not None:
            tests.append(state)
        if self.rating is not None:
            tests.append(F.col("rating") >= self.rating)
        if self.search:
            tests.append(
                contains_text("file_name", self.search) | contains_text("object_name", self.search)
            )
        tests += in_range(
            "exposure_time_seconds", self.exposure_min, self.exposure_max,
            self.max_exposure_exclusive,
        )
        for column, text in (
            ("camera_name", self.camera),
            ("telescope_name", self.telescope),
            ("filter_name", self.filter),
        ):
            if text:
                tests.append(contains_text(column, text))
        tests += in_range("gain", self.gain_min, self.gain_max)
        tests += in_range("rotation_degrees", self.rotation_min, self.rotation_max, True)
        tests += in_range(
            "pixel_scale_arcsec", self.pixel_scale_min, self.pixel_scale_max,
            self.pixel_scale_max_exclusive,
        )
        if self.start_date:
            tests.append(F.col("capture_date") >= timestamp_bound(self.start_date))
        if self.end_date:
            tests.append(F.col("capture_date") <= timestamp_bound(self.end_date))
        if self.path:
            tests.append(F.col("file_path").startswith(self.path))
        if self.header_key:
            tests.append(header_test(self.header_col, self.header_key, self.header_value))
        return tests

    def apply(
        self, images: DataFrame, matches: DataFrame | None = None, stars: DataFrame | None = None
    ) -> DataFrame:
        """The rows of ``images`` that pass; ``matches`` and ``stars`` serve ``object_name``."""
        for test in self.conditions():
            images = images.filter(test)
        if self.ra is not None and self.dec is not None:
            radius = 1.0 if self.radius is None else self.radius
            images = near_point(images, self.ra, self.dec, radius).drop("separation")
        if self.object_name:
            if matches is None or stars is None:
                raise ValueError("object_name needs the matches and the star catalogue")
            images = images_of_object(images, matches, stars, self.object_name)
        return images


def analytics_filter(
    images: DataFrame,
    date_from=None,
    date_to=None,
    cameras: Iterable[str] = (),
    telescopes: Iterable[str] = (),
    objects: Iterable[str] = (),
) -> DataFrame:
    """Date window and multi-value text filters of the analytics page.

    Several values of one field are alternatives; the fields restrict together.
    """
    if date_from:
        images = images.filter(F.col("capture_date") >= timestamp_bound(date_from))
    if date_to:
        images = images.filter(F.col("capture_date") <= timestamp_bound(date_to))
    for column, texts in (
        ("camera_name", cameras),
        ("telescope_name", telescopes),
        ("object_name", objects),
    ):
        test = contains_any(column, texts)
        if test is not None:
            images = images.filter(test)
    return images


def box_filter(images: DataFrame, ra: float, dec: float, ra_width: float, dec_width: float):
    """Images within a coordinate box; RA is taken linearly, without wrap-around."""
    return images.filter(
        (F.abs(F.col("ra_center_degrees") - ra) < ra_width)
        & (F.abs(F.col("dec_center_degrees") - dec) < dec_width)
    )


def lacks_metadata() -> Column:
    return (
        F.col("width_pixels").isNull()
        | F.col("height_pixels").isNull()
        | F.col("exposure_time_seconds").isNull()
        | F.col("camera_name").isNull()
    )


def incomplete_metadata(images: DataFrame) -> DataFrame:
    """Images that lack a dimension, the exposure or the camera."""
    return images.filter(lacks_metadata())


def header_entries(headers: DataFrame, map_col: str, key_cols: list[str], term: str = ""):
    """Header entries as rows, those whose key or value contains ``term`` ignoring case."""
    entries = headers.select(*key_cols, F.explode(map_col).alias("key", "value"))
    if not term:
        return entries
    needle = term.lower()
    return entries.filter(
        F.lower("key").contains(needle)
        | F.lower(F.coalesce(F.col("value"), F.lit("null"))).contains(needle)
    )


# Columns of the list view: everything but headers, solver bookkeeping and timestamps.
LIST_COLUMNS = (
    "id",
    "file_path",
    "file_name",
    "file_format",
    "file_size_bytes",
    "width_pixels",
    "height_pixels",
    "subtype",
    "is_plate_solved",
    "plate_solve_source",
    "exposure_time_seconds",
    "capture_date",
    "gain",
    "iso_speed",
    "temperature_celsius",
    "camera_name",
    "telescope_name",
    "filter_name",
    "lens_model",
    "rating",
    "rating_manually_edited",
    "aperture",
    "focal_length",
    "focal_length_35mm",
    "white_balance",
    "metering_mode",
    "flash_fired",
    "object_name",
    "ra_center_degrees",
    "dec_center_degrees",
    "file_created",
    "file_last_modified",
    "thumbnail_path",
    "thumbnail_generated_at",
    "pixel_scale_arcsec",
    "rotation_degrees",
)


def list_view(images: DataFrame) -> DataFrame:
    return images.select(*[c for c in LIST_COLUMNS if c in images.columns])
