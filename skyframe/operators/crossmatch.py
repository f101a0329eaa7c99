"""Sky cross-matching: cone search, circle join, in-frame test, overlays and density."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import geo

DEFAULT_RADIUS = 1.0
FRAME_MARGIN = 100
# Catalogue types without a per-image limit on candidates.
UNCAPPED_TYPES = ("MESSIER",)
# Rows of one sky cell that a single task of the shuffled join may hold per side.
ROWS_PER_CELL_TASK = 500_000
# Pairs of one cell that a single task may test; what it keeps of them is sorted in its memory.
PAIRS_PER_TASK = 20_000_000
# Columns by which ``keep_cells`` tells where a pair was found; all pairs of an image share them unless ``_spread``.
CELL_KEYS = ("cell_id", "_a", "_b")


def search_radius(radius) -> Column:
    """Field radius, with 0 and NULL meaning one degree."""
    radius = geo.as_column(radius)
    return F.when(radius.isNull() | (radius == 0), F.lit(DEFAULT_RADIUS)).otherwise(radius)


def image_cells(
    images: DataFrame, ra: str, dec: str, radius: str, level: Column | None = None
) -> DataFrame:
    """One row per circle and sky cell it touches, tagged ``cell_id``; the level fits the radius unless given."""
    reach = F.col(radius) + geo.ANGLE_TOLERANCE
    in_zones = (
        images.withColumn("_level", geo.level_for_radius(radius) if level is None else level)
        .withColumn("_height", geo.zone_height("_level"))
        .withColumn("_half", geo.ra_half_width(dec, reach) + geo.ANGLE_TOLERANCE)
        .withColumn(
            "_zone",
            F.explode(
                F.sequence(
                    geo.zone_of(F.greatest(F.col(dec) - reach, F.lit(-90.0)), "_height"),
                    geo.zone_of(F.least(F.col(dec) + reach, F.lit(90.0)), "_height"),
                )
            ),
        )
        .withColumn("_cells", geo.cells_in_zone("_zone", "_height"))
    )
    first = F.floor((F.col(ra) - F.col("_half")) / 360.0 * F.col("_cells"))
    last = F.floor((F.col(ra) + F.col("_half")) / 360.0 * F.col("_cells"))
    return (
        in_zones.withColumn("_first", first)
        .withColumn(
            "_cell",
            F.explode(
                F.sequence(F.col("_first"), F.least(last, F.col("_first") + F.col("_cells") - 1))
            ),
        )
        .withColumn(
            "cell_id", geo.cell_key("_level", "_zone", F.pmod(F.col("_cell"), F.col("_cells")))
        )
        .drop("_level", "_height", "_zone", "_cells", "_half", "_first", "_cell")
    )


def catalog_cells(catalog: DataFrame, ra: str, dec: str, levels: DataFrame) -> DataFrame:
    """One row per catalogue object and level that ``levels`` lists, tagged ``cell_id``."""
    every = catalog.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(geo.MAX_LEVEL))))
    return (
        every.join(F.broadcast(levels), "_level", "left_semi")
        .withColumn("_height", geo.zone_height("_level"))
        .withColumn("_zone", geo.zone_of(dec, "_height"))
        .withColumn("_cells", geo.cells_in_zone("_zone", "_height"))
        .withColumn("cell_id", geo.cell_key("_level", "_zone", geo.cell_of(ra, "_cells")))
        .drop("_level", "_height", "_zone", "_cells")
    )


def home_level(radius) -> Column:
    """Level of the one cell an image is put into: at least two radii high."""
    return F.least(geo.level_for_radius(radius) + 1, F.lit(geo.MAX_LEVEL)).cast("int")


def home_cells(images: DataFrame, ra: str, dec: str, radius: str) -> DataFrame:
    """Each image once, tagged with the ``cell_id`` its centre lies in."""
    return (
        images.withColumn("_level", home_level(radius))
        .withColumn("_height", geo.zone_height("_level"))
        .withColumn("_zone", geo.zone_of(dec, "_height"))
        .withColumn("_cells", geo.cells_in_zone("_zone", "_height"))
        .withColumn("cell_id", geo.cell_key("_level", "_zone", geo.cell_of(ra, "_cells")))
        .drop("_level", "_height", "_zone", "_cells")
    )


def reached_cells(catalog: DataFrame, ra: str, dec: str, reach: dict[int, float]) -> DataFrame:
    """One row per object and home cell from which a circle may hold it; ``reach``: widest radius by level."""
    levels = F.array(
        *[F.struct(F.lit(k).alias("level"), F.lit(r).alias("reach")) for k, r in sorted(reach.items())]
    )
    every = catalog.withColumn("_at", F.explode(levels)).withColumn("_reach", F.col("_at.reach"))
    return image_cells(every, ra, dec, "_reach", F.col("_at.level")).drop("_at", "_reach")


def _hot_cells(sizes: DataFrame, objects: DataFrame, limit: int) -> DataFrame:
    """Per cell that both sides have: candidate pairs, and into how many parts each side is cut."""
    counts = sizes.select("cell_id", "n_images").join(
        objects.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_objects")), "cell_id"
    )
    dealt = F.least(F.lit(limit), F.ceil(F.lit(PAIRS_PER_TASK) / F.least("n_objects", F.lit(limit))))
    return counts.select(
        "cell_id",
        (F.col("n_images") * F.col("n_objects")).alias("_pairs"),
        F.ceil(F.col("n_images") / dealt).alias("_a_n"),
        F.ceil(F.col("n_objects") / limit).alias("_b_n"),
    )


def _split_hot_cells(
    images: DataFrame, objects: DataFrame, hot: DataFrame, image_key: list[str], object_key: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Cut crowded sky cells into a grid of sub-cells so that no task holds a whole one.

    Images of a cell are dealt to ``a`` groups and copied to ``b`` columns, objects the other way
    round, so every pair meets exactly once. The table of crowded cells has at most one row per
    sky cell (under a million), which bounds its broadcast.
    """
    hot = hot.filter((F.col("_a_n") > 1) | (F.col("_b_n") > 1)).drop("_pairs")

    def dealt(side: DataFrame, key: list[str], own: str, other: str) -> DataFrame:
        one = F.lit(1).cast("long")
        return (
            side.join(F.broadcast(hot), "cell_id", "left")
            .withColumn(own, F.pmod(F.xxhash64(*key), F.coalesce(F.col(f"{own}_n"), one)))
            .withColumn(
                other,
                F.explode(
                    F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(f"{other}_n"), one) - 1)
                ),
            )
        )

    images = dealt(images, image_key, "_a", "_b")
    cut = F.coalesce(F.col("_b_n") > 1, F.lit(False))
    images = images.withColumn("_spread", F.col("_spread") | cut).drop("_a_n", "_b_n")
    return images, dealt(objects, object_key, "_b", "_a").drop("_a_n", "_b_n")


def _with_spread(images: DataFrame, image_key: list[str], look: bool) -> tuple[DataFrame, bool]:
    """``_spread``: rows of the same image lie in several cells; and whether there are any."""
    if look:
        several = images.groupBy(*image_key).agg(
            F.min("cell_id").alias("_first"), F.max("cell_id").alias("_last")
        ).filter("_first < _last")
        if not several.isEmpty():
            several = several.select(*[F.col(k).alias(f"_{k}") for k in image_key], F.lit(True).alias("_spread"))
            same = F.lit(True)
            for k in image_key:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            found = images.join(several, same, "left").drop(*[f"_{k}" for k in image_key])
            return found.withColumn("_spread", F.coalesce("_spread", F.lit(False))), True
    return images.withColumn("_spread", F.lit(False)), False


def _meeting_in_cells(
    images: DataFrame, catalog: DataFrame, image_key: list[str], object_key: list[str], limit: int, look: bool
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides by cell, in as many partitions as their candidate pairs ask for, and the join keys.

    An image is in one cell, its own, and objects are copied to the cells around them, so all pairs of an
    image come from one task and need no further shuffle. Counts are looked up first: the widest radius
    per level (eleven rows at most), and one row of totals over the cells.
    """
    ra0, dec0 = "ra_center_degrees", "dec_center_degrees"
    left = home_cells(images, ra0, dec0, "_radius")
    # At most one row per sky cell, kept while the counts are looked up, so the images are read once for them.
    sizes = left.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_images"), F.max(home_level("_radius")).alias("_level"),
        F.max(F.nanvl("_radius", F.lit(0.0))).alias("_reach"),
    ).persist()
    levels = sizes.groupBy("_level").agg(F.max("_reach").alias("_reach")).collect()
    reach = {r["_level"]: r["_reach"] for r in levels} or {0: 0.0}
    right = reached_cells(catalog, "ra_degrees", "dec_degrees", reach)
    left, spread = _with_spread(left, image_key, look)
    hot = _hot_cells(sizes, right, limit)
    total = hot.agg(
        F.sum(F.col("_pairs").cast("double")).alias("pairs"), F.max("_a_n").alias("a"), F.max("_b_n").alias("b")
    ).first()
    sizes.unpersist()
    keys = ["cell_id"]
    if max(total["a"] or 1, total["b"] or 1) > 1:
        left, right = _split_hot_cells(left, right, hot, image_key, object_key)
        keys, spread = list(CELL_KEYS), spread or total["b"] > 1
    if not spread:
        left = left.drop("_spread")
    tasks = int((total["pairs"] or 0) / PAIRS_PER_TASK) + 1
    if tasks > 1:
        # A merge join keeps both sides where they are, whatever their sizes are guessed to be.
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys).hint("merge")
    return left, right, keys


def circle_join(
    images: DataFrame,
    catalog: DataFrame,
    radius_col: str = "field_radius_degrees",
    strategy: str = "shuffle",
    image_key: tuple[str, ...] = ("id",),
    object_key: tuple[str, ...] = ("catalog_type", "designation"),
    rows_per_task: int = ROWS_PER_CELL_TASK,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    keep_vectors: bool = False,
    keep_cells: bool = False,
) -> DataFrame:
    """Every (image, object) pair whose separation is within the image's radius.

    Adds ``separation``. Both sides are put into sky cells and joined on the cell with the exact
    distance as residual condition, so no pair outside neighbouring cells is formed. With
    ``keep_vectors`` the objects keep their direction as ``_object``; ``prepare`` may add columns
    to the images before they meet the objects. With ``keep_cells`` the pairs keep the columns by which
    ``nearest_per_type`` finds those of an image in one task.

    strategy: ``shuffle`` joins on the cell with crowded cells split and works at any size;
    ``broadcast``, for catalogues known to be small, copies the catalogue to every executor and spreads
    the images by their key, so that what follows per image needs no shuffle of the pairs.
    """
    ra0, dec0 = "ra_center_degrees", "dec_center_degrees"
    images = images.filter(geo.usable_coordinates(ra0, dec0))
    catalog = catalog.filter(geo.usable_coordinates("ra_degrees", "dec_degrees"))
    if strategy == "broadcast":
        images = images.repartition(*image_key)
    if prepare is not None:
        images = prepare(images)
    images = images.withColumn("_radius", search_radius(radius_col)).withColumns(
        {
            "_limit": geo.chord_limit(F.col("_radius") + geo.ANGLE_TOLERANCE),
            "_center": geo.unit_vector(ra0, dec0),
        }
    )
    catalog = catalog.withColumn("_object", geo.unit_vector("ra_degrees", "dec_degrees"))
    if strategy == "broadcast":
        left = image_cells(images, ra0, dec0, "_radius")
        levels = images.select(geo.level_for_radius("_radius").alias("_level")).distinct()  # eleven at most
        right = catalog_cells(catalog, "ra_degrees", "dec_degrees", levels)
        keys, right, kept = ["cell_id"], F.broadcast(right), ()
    elif strategy == "shuffle":
        left, right, keys = _meeting_in_cells(
            images, catalog, list(image_key), list(object_key), rows_per_task, keep_cells
        )
        kept = (*keys, "_spread") if keep_cells else ()
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    surplus = [c for c in (*keys, "_spread") if c not in kept]
    chord2 = geo.squared_chord("_center", "_object")
    return (
        left.join(right, keys)
        .filter(chord2 <= F.col("_limit"))
        .withColumn("separation", geo.chord_angle(chord2))
        .drop("_radius", "_limit", "_center", *(() if keep_vectors else ("_object",)), *surplus)
    )


def nearest_per_type(
    pairs: DataFrame, cap: int | None, image_key: str = "id", uncapped: tuple[str, ...] = UNCAPPED_TYPES,
    keep_cells: bool = False,
) -> DataFrame:
    """At most ``cap`` nearest objects per image and catalogue type, all without ``cap``; ties go by designation.

    Uncapped types get a partition per object, so one plain ``rank <= cap`` filter serves all and
    Spark can already drop surplus rows before the shuffle. Pairs that ``circle_join`` gave with their cells
    are ranked where they were found, without a shuffle.
    """
    cells = [c for c in CELL_KEYS if c in pairs.columns]
    surplus = [] if keep_cells else cells
    if cap is None:
        return pairs if keep_cells else pairs.drop(*cells, "_spread")
    own_group = F.when(F.col("catalog_type").isin(*uncapped), F.col("designation"))

    def nearest(rows: DataFrame, *within: str) -> DataFrame:
        order = Window.partitionBy(*within, image_key, "catalog_type", own_group).orderBy(
            F.floor(F.col("separation") / geo.ANGLE_TOLERANCE + 0.5), "designation"
        )
        return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")

    if "_spread" not in pairs.columns:
        return nearest(pairs, *cells).drop(*surplus)
    # Few images have pairs in several cells; only what is nearest in each of these is shuffled.
    found = nearest(pairs, *cells, "_spread").drop(*surplus)
    whole, parts = found.filter(~F.col("_spread")), found.filter("_spread")
    found = whole.unionAll(nearest(parts))
    return found if keep_cells else found.drop("_spread")


def in_frame(x, y, width, height, margin: float = FRAME_MARGIN) -> Column:
    x, y = geo.as_column(x), geo.as_column(y)
    return x.between(-margin, geo.as_column(width) + margin) & y.between(
        -margin, geo.as_column(height) + margin
    )


IMAGE_GEOMETRY = (
    "id",
    "ra_center_degrees",
    "dec_center_degrees",
    "field_radius_degrees",
    "pixel_scale_arcsec",
    "width_pixels",
    "height_pixels",
    "rotation_degrees",
    "parity",
)


def field_match(
    images: DataFrame,
    catalog: DataFrame,
    margin_px: float = FRAME_MARGIN,
    cap: int | None = None,
    strategy: str = "shuffle",
    strict_reference: bool = False,
    keep: tuple[str, ...] = (),
    keep_cells: bool = False,
) -> DataFrame:
    """Catalogue objects that really lie in each solved image.

    Circle join, per-type cap, then the projected pixel must fall into the frame widened by
    ``margin_px``. Images without scale or size keep every object of the circle. The catalogue
    must be unique on (catalog_type, designation).

    ``strict_reference`` also skips images centred exactly on RA 0 or Dec 0. Matches also have the columns of
    their image to ``keep``, and with ``keep_cells`` those that tell where they were found.
    """
    solved = images.filter(F.col("is_plate_solved")).select(*IMAGE_GEOMETRY, *keep)
    if strict_reference:
        solved = solved.filter(
            (F.col("ra_center_degrees") != 0) & (F.col("dec_center_degrees") != 0)
        )
    known = (
        F.col("pixel_scale_arcsec").isNotNull()
        & F.col("width_pixels").isNotNull()
        & F.col("height_pixels").isNotNull()
    )

    def framed(images: DataFrame) -> DataFrame:
        return geo.with_frame(
            images.withColumn("_framed", known), "_frame", "ra_center_degrees",
            "dec_center_degrees", F.col("width_pixels") / 2, F.col("height_pixels") / 2,
            geo.cd_matrix("pixel_scale_arcsec", "rotation_degrees", "parity"),
        ).drop("pixel_scale_arcsec", "rotation_degrees", "parity")

    objects = catalog.select("catalog_type", "designation", "ra_degrees", "dec_degrees")
    pairs = circle_join(
        solved, objects, strategy=strategy, prepare=framed, keep_vectors=True,
        keep_cells=keep_cells or cap is not None,
    )
    inside = in_frame("_px.x", "_px.y", "width_pixels", "height_pixels", margin_px)
    # The pixel comes first, so that ranking sorts narrow rows.
    pairs = (
        pairs.withColumn("_px", geo.frame_pixel("_frame", "_object"))
        .withColumn("_inside", ~F.col("_framed") | F.coalesce(inside, F.lit(False)))
        .drop("_frame", "_object", "width_pixels", "height_pixels", "ra_center_degrees", "dec_center_degrees")
        .drop("field_radius_degrees", "ra_degrees", "dec_degrees")
    )
    near = nearest_per_type(pairs, cap, keep_cells=keep_cells)
    return (
        near.filter("_inside")
        .select(
            F.col("id").alias("image_id"),
            "catalog_type",
            F.col("designation").alias("catalog_designation"),
            "separation",
            (1 - F.col("separation") / 5.0).alias("confidence"),
            F.when(F.col("_framed"), F.col("_px.x")).alias("x"),
            F.when(F.col("_framed"), F.col("_px.y")).alias("y"),
            F.lit(True).alias("is_in_field"),
            F.lit("AUTOMATIC").alias("source"),
            *keep,
            *([c for c in (*CELL_KEYS, "_spread") if c in near.columns] if keep_cells else []),
        )
    )


def near_point(images: DataFrame, ra: float, dec: float, radius: float = 1.0) -> DataFrame:
    """Images whose centre lies within ``radius`` of a point; adds ``separation``."""
    center = geo.usable_coordinates("ra_center_degrees", "dec_center_degrees")
    band = F.col("dec_center_degrees").between(
        dec - radius - geo.ANGLE_TOLERANCE, dec + radius + geo.ANGLE_TOLERANCE
    )
    sep = geo.angular_separation(
        "ra_center_degrees", "dec_center_degrees", float(ra), float(dec)
    )
    return (
        images.filter(center & band)
        .withColumn("separation", sep)
        .filter(F.col("separation") <= radius + geo.ANGLE_TOLERANCE)
    )


def cone_search(
    images: DataFrame, ra: float, dec: float, radius: float = 1.0, limit: int | None = None
) -> DataFrame:
    """The images within ``radius`` of a point, or the ``limit`` nearest of them."""
    found = near_point(images, ra, dec, radius)
    if limit is None:
        return found
    nearest = F.floor(F.col("separation") / geo.ANGLE_TOLERANCE + 0.5)
    return found.orderBy(nearest, "id").limit(limit)


def sky_density(images: DataFrame, size: float = 5.0) -> DataFrame:
    """Image count per square cell of the (RA, Dec) plane and its share of the fullest cell."""
    cells = (
        images.filter(geo.usable_coordinates("ra_center_degrees", "dec_center_degrees"))
        .groupBy(
            F.floor(F.col("ra_center_degrees") / size).alias("ra_bin"),
            F.floor(F.col("dec_center_degrees") / size).alias("dec_bin"),
        )
        .agg(F.count(F.lit(1)).alias("image_count"))
    )
    # At most (360/size) * (180/size) rows reach this window.
    return cells.withColumn(
        "density", F.col("image_count") / F.max("image_count").over(Window.partitionBy())
    )
