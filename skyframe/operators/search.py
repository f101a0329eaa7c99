"""Sorting, paging and lookups over image and catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.text import without_blanks
from skyframe.operators.crossmatch import CELL_KEYS
from skyframe.operators.filters import ImageFilter, contains_text


def image_order(images: DataFrame, sort_by: str = "capture_date", order: str = "desc") -> list[Column]:
    """Sort keys for any image column, NULLs last both ways; unknown names sort by date.

    The id breaks ties, so pages never overlap.
    """
    column = F.col(sort_by if sort_by in images.columns else "capture_date")
    first = column.asc_nulls_last() if order.lower() == "asc" else column.desc_nulls_last()
    return [first, F.col("id").asc()]


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page; a top-k of (page * size) rows, not a full sort."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(
    images: DataFrame, sort_by: str, order: str, after: tuple | None, size: int
) -> DataFrame:
    """The page that follows the row ``(sort value, id)``, or the first one: a top-k of ``size`` rows.

    Takes the order of :func:`image_order`, so going on from the last row of each page gives the pages of
    :func:`page_of` without ever sorting what was already shown.
    """
    if after is not None:
        column = F.col(sort_by if sort_by in images.columns else "capture_date")
        value, last_id = after
        if value is None:
            images = images.filter(column.isNull() & (F.col("id") > last_id))
        else:
            value = F.lit(value).cast(images.select(column).schema[0].dataType)
            beyond = column > value if order.lower() == "asc" else column < value
            images = images.filter(
                column.isNull() | beyond | ((column == value) & (F.col("id") > last_id))
            )
    return images.orderBy(*image_order(images, sort_by, order)).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Row count and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / size)
    )


def search_page(
    images: DataFrame,
    flt: ImageFilter,
    sort_by: str = "capture_date",
    order: str = "desc",
    page: int = 1,
    size: int = 50,
    matches: DataFrame | None = None,
    stars: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page of the filtered images, totals of the filtered images)."""
    found = flt.apply(images, matches, stars)
    return page_of(found, image_order(images, sort_by, order), page, size), page_totals(found, size)


def page_neighbours(page_df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Previous id, next id and 1-based position for each image of one page.

    The window spans a single page, whose size the caller chose; it never sees the whole result.
    """
    whole_page = Window.partitionBy().orderBy(*order)
    return page_df.select(
        "id",
        F.lag("id").over(whole_page).alias("prev_id"),
        F.lead("id").over(whole_page).alias("next_id"),
        (F.row_number().over(whole_page) + (page - 1) * size).cast("long").alias("position"),
    )


def recent_images(images: DataFrame, n: int = 6) -> DataFrame:
    return images.orderBy(*image_order(images)).limit(n)


def sky_coverage_points(images: DataFrame, limit: int | None = None) -> DataFrame:
    """Centres of the images for a sky map, or of the ``limit`` newest; undated images come first."""
    solved = images.filter(
        F.col("ra_center_degrees").isNotNull() & F.col("dec_center_degrees").isNotNull()
    )
    if limit is not None:
        solved = solved.orderBy(F.col("capture_date").desc_nulls_first(), F.col("id")).limit(limit)
    return solved.select(
        F.col("ra_center_degrees").alias("ra"), F.col("dec_center_degrees").alias("dec")
    )


def containing_object(
    images: DataFrame, matches: DataFrame, catalog_type: str, designation: str
) -> DataFrame:
    """Images with a match on exactly this object."""
    hits = matches.filter(
        (F.col("catalog_type") == catalog_type) & (F.col("catalog_designation") == designation)
    )
    return images.join(hits, images["id"] == hits["image_id"], "left_semi")


def with_matches(images: DataFrame, matches: DataFrame) -> DataFrame:
    """Each image with the sorted array of its matches, NULL when it has none.

    An image holds at most the capped number of objects, so the array stays small.
    """
    lists = matches.groupBy("image_id").agg(
        F.array_sort(
            F.collect_list(F.struct("catalog_type", "catalog_designation", "separation"))
        ).alias("catalog_matches")
    )
    return images.join(lists, images["id"] == lists["image_id"], "left").drop("image_id")


# --- catalogue listings ----------------------------------------------------------------------


def _coverage_in_cells(matches: DataFrame) -> DataFrame:
    """:func:`coverage` of matches that carry their cells and what ``stats.with_exposure`` adds.

    A pair that is there twice is told where it was found; only images in several cells need a shuffle.
    """
    key = ["catalog_type", "catalog_designation", "image_id"]
    totals = [F.sum("image_exposure").alias("image_exposure"), F.max("separation").alias("separation")]
    cells = [c for c in (*CELL_KEYS, "_spread") if c in matches.columns]
    pairs = matches.filter("image_id IS NOT NULL").groupBy(*cells, *key).agg(*totals)
    columns = [*key, "image_exposure", "separation"]
    if "_spread" in cells:
        parts = pairs.filter("_spread").groupBy(*key).agg(*totals)
        pairs = pairs.filter(~F.col("_spread")).select(*columns).unionAll(parts.select(*columns))
    return pairs.groupBy(*key[:2]).agg(
        F.coalesce(F.sum("image_exposure"), F.lit(0.0)).alias("cumulative_exposure_seconds"),
        F.count(F.lit(1)).alias("image_count"),
        F.coalesce(F.max("separation"), F.lit(0.0)).alias("max_separation_degrees"),
    )


def coverage(matches: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Exposure, number of images and largest separation per matched object.

    Without ``images`` the matches come from ``field_match`` with ``keep=stats.EXPOSURE`` and ``keep_cells``,
    on images of ``stats.with_exposure``; they are then neither joined nor shuffled before they are summed.
    """
    if images is None:
        return _coverage_in_cells(matches)
    exposure = images.select(F.col("id").alias("image_id"), "exposure_time_seconds")
    return (
        matches.select("image_id", "catalog_type", "catalog_designation", "separation")
        .join(exposure, "image_id")
        .groupBy("catalog_type", "catalog_designation")
        .agg(
            F.coalesce(F.sum("exposure_time_seconds"), F.lit(0.0)).alias(
                "cumulative_exposure_seconds"
            ),
            F.countDistinct("image_id").alias("image_count"),
            F.coalesce(F.max("separation"), F.lit(0.0)).alias("max_separation_degrees"),
        )
    )


def catalog_text_search(catalog: DataFrame, q: str) -> DataFrame:
    """Designation equals ``q`` ignoring blanks and case, or a name contains it.

    The constellation is searched too, except for stars.
    """
    return catalog.filter(
        without_blanks("designation").ilike(q.replace(" ", ""))
        | contains_text("common_name", q)
        | ((F.col("catalog_type") != "NAMED_STAR") & contains_text("constellation", q))
    )


def catalog_facets(
    catalog: DataFrame, constellation: str | None = None, prefix: str | None = None
) -> DataFrame:
    """Constellation equality and designation prefix ("NGC", "IC") ignoring case."""
    if constellation:
        catalog = catalog.filter(F.col("constellation") == constellation)
    if prefix:
        catalog = catalog.filter(F.col("designation").ilike(f"{prefix}%"))
    return catalog


def find_object(catalog: DataFrame, designation: str) -> DataFrame:
    """The object with this designation, ignoring case."""
    return catalog.filter(F.lower("designation") == designation.lower())


def catalog_order(sort_by: str = "default", order: str = "asc", number: str = "number") -> list[Column]:
    """NULLs come last ascending and first descending; the designation breaks ties."""
    names = {
        "exposure": "cumulative_exposure_seconds",
        "ra": "ra_degrees",
        "mag": "magnitude",
    }
    column = F.col(names.get(sort_by, number))
    first = column.desc_nulls_first() if order == "desc" else column.asc_nulls_last()
    return [first, F.col("designation").asc()]


def with_coverage(catalog: DataFrame, covered: DataFrame) -> DataFrame:
    """Catalogue rows with coverage figures, zero where nothing matched."""
    figures = covered.withColumnRenamed("catalog_designation", "designation")
    return catalog.join(figures, ["catalog_type", "designation"], "left").withColumns(
        {
            "cumulative_exposure_seconds": F.coalesce("cumulative_exposure_seconds", F.lit(0.0)),
            "image_count": F.coalesce("image_count", F.lit(0).cast("long")),
            "max_separation_degrees": F.coalesce("max_separation_degrees", F.lit(0.0)),
        }
    )


def catalog_listing(
    catalog: DataFrame,
    covered: DataFrame,
    q: str | None = None,
    constellation: str | None = None,
    prefix: str | None = None,
    has_images: bool = False,
    sort_by: str = "default",
    order: str = "asc",
    page: int | None = None,
    size: int = 50,
) -> DataFrame:
    """Searchable catalogue table with coverage; all rows unless a page is asked for."""
    found = catalog_facets(catalog, constellation, prefix)
    if q:
        found = catalog_text_search(found, q)
    found = with_coverage(found, covered)
    if has_images:
        found = found.filter(F.col("image_count") > 0)
    if page is None:
        return found
    return page_of(found, catalog_order(sort_by, order), page, size)
