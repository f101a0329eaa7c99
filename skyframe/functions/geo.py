"""Geometry on the sphere and the tangent plane, as Column expressions.

Angles are degrees. Pixel positions are 0-based with the origin at the top left of the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two separations closer than this (degrees) are the same; used where a result must not depend
# on the last bit of a trigonometric function.
ANGLE_TOLERANCE = 1e-9


def as_column(value) -> Column:
    """Column, column name or number -> Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))


def clamp(value, low: float, high: float) -> Column:
    """Value limited to [low, high]; NULL stays NULL, which least and greatest would pass over."""
    value = as_column(value)
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def angular_separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance by the haversine formula."""
    ra1, dec1, ra2, dec2 = (F.radians(as_column(v)) for v in (ra1, dec1, ra2, dec2))
    half_dec = F.sin((dec2 - dec1) / 2)
    half_ra = F.sin((ra2 - ra1) / 2)
    chord = half_dec * half_dec + F.cos(dec1) * F.cos(dec2) * half_ra * half_ra
    return F.degrees(2 * F.asin(F.sqrt(F.when(chord > 1.0, F.lit(1.0)).otherwise(chord))))


def tangent_plane(ra, dec, ra0, dec0) -> tuple[Column, Column, Column]:
    """Gnomonic projection about (ra0, dec0): (depth, xi, eta), the last two in degrees.

    Points with ``depth <= 0`` lie on the far hemisphere and have no projection.
    """
    dec, dec0 = F.radians(as_column(dec)), F.radians(as_column(dec0))
    delta = F.radians(as_column(ra) - as_column(ra0))
    depth = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(delta)
    visible = F.when(depth > 0, depth)
    xi = F.cos(dec) * F.sin(delta) / visible
    eta = (F.cos(dec0) * F.sin(dec) - F.sin(dec0) * F.cos(dec) * F.cos(delta)) / visible
    return depth, F.degrees(xi), F.degrees(eta)


def sky_from_plane(xi, eta, ra0, dec0) -> Column:
    """Inverse of :func:`tangent_plane`: struct<ra,dec> with ra in [0, 360)."""
    xi, eta = F.radians(as_column(xi)), F.radians(as_column(eta))
    dec0 = F.radians(as_column(dec0))
    across = F.cos(dec0) - eta * F.sin(dec0)
    ra = F.pmod(as_column(ra0) + F.degrees(F.atan2(xi, across)), F.lit(360.0))
    dec = F.degrees(F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + across * across)))
    return F.struct(ra.alias("ra"), dec.alias("dec"))


def cd_matrix(scale, rot, parity) -> tuple[Column, Column, Column, Column]:
    """CD matrix (degrees per pixel) of a frame given arcsec/pixel, rotation and parity.

    Rows run downwards, so north is up for rotation 0; parity 1 puts east on the left.
    A missing rotation is 0 and a missing parity 1.
    """
    step = as_column(scale) / 3600.0
    angle = F.radians(F.coalesce(as_column(rot), F.lit(0.0)))
    along = -step * F.coalesce(as_column(parity).cast("double"), F.lit(1.0))
    return (
        along * F.cos(angle),
        step * F.sin(angle),
        along * F.sin(angle),
        -step * F.cos(angle),
    )


def sky_to_pixel_cd(ra, dec, ra0, dec0, crpix1, crpix2, cd11, cd12, cd21, cd22) -> Column:
    """Sky position to pixel for a general linear WCS: struct<x,y,ok>."""
    depth, xi, eta = tangent_plane(ra, dec, ra0, dec0)
    cd11, cd12, cd21, cd22 = (as_column(v) for v in (cd11, cd12, cd21, cd22))
    area = cd11 * cd22 - cd12 * cd21
    invertible = F.when(area != 0, area)
    x = (cd22 * xi - cd12 * eta) / invertible + as_column(crpix1) - 1
    y = (cd11 * eta - cd21 * xi) / invertible + as_column(crpix2) - 1
    return F.struct(
        x.alias("x"), y.alias("y"), F.coalesce(depth > 0, F.lit(False)).alias("ok")
    )


def pixel_to_sky_cd(x, y, ra0, dec0, crpix1, crpix2, cd11, cd12, cd21, cd22) -> Column:
    """Pixel to sky for a general linear WCS: struct<ra,dec>."""
    u = as_column(x) + 1 - as_column(crpix1)
    v = as_column(y) + 1 - as_column(crpix2)
    xi = as_column(cd11) * u + as_column(cd12) * v
    eta = as_column(cd21) * u + as_column(cd22) * v
    return sky_from_plane(xi, eta, ra0, dec0)


def sky_to_pixel(ra, dec, ra0, dec0, scale, rot, parity, w, h) -> Column:
    """Sky position to pixel of a frame described by table columns: struct<x,y,ok>.

    The reference pixel is the frame centre w/2, h/2 counted from 1.
    """
    depth, xi, eta = tangent_plane(ra, dec, ra0, dec0)
    step = as_column(scale) / 3600.0
    step = F.when(step != 0, step)
    angle = F.radians(F.coalesce(as_column(rot), F.lit(0.0)))
    flip = F.coalesce(as_column(parity).cast("double"), F.lit(1.0))
    x = (F.cos(angle) * xi + F.sin(angle) * eta) / (-step * flip) + as_column(w) / 2 - 1
    y = (F.cos(angle) * eta - F.sin(angle) * xi) / -step + as_column(h) / 2 - 1
    return F.struct(
        x.alias("x"), y.alias("y"), F.coalesce(depth > 0, F.lit(False)).alias("ok")
    )


def pixel_to_sky(x, y, ra0, dec0, scale, rot, parity, w, h) -> Column:
    """Exact inverse of :func:`sky_to_pixel`: struct<ra,dec>."""
    return pixel_to_sky_cd(
        x, y, ra0, dec0, as_column(w) / 2, as_column(h) / 2, *cd_matrix(scale, rot, parity)
    )


def pixel_to_sky_linear(x, y, w, h, ra0, dec0, scale, rot, parity=1) -> Column:
    """Small-field approximation used for cursor read-outs: struct<ra,dec>.

    The pixel offset is taken from w/2, h/2 without the 1-based shift, so this is not the exact
    inverse of :func:`sky_to_pixel`. NULL when centre, scale or rotation is missing.
    """
    ra0, dec0, rot = as_column(ra0), as_column(dec0), as_column(rot)
    cd11, cd12, cd21, cd22 = cd_matrix(scale, rot, parity)
    dx, dy = as_column(x) - as_column(w) / 2, as_column(y) - as_column(h) / 2
    xi = cd11 * dx + cd12 * dy
    eta = cd21 * dx + cd22 * dy
    stretch = F.when(F.abs(dec0) < 89.9, F.cos(F.radians(dec0))).otherwise(F.lit(1.0))
    ra = F.pmod(ra0 + xi / stretch, F.lit(360.0))
    dec = clamp(dec0 + eta, -90.0, 90.0)
    known = ra0.isNotNull() & dec0.isNotNull() & as_column(scale).isNotNull() & rot.isNotNull()
    return F.when(known, F.struct(ra.alias("ra"), dec.alias("dec")))


def frame_radius(w, h, scale) -> Column:
    """Half the frame diagonal in degrees."""
    w, h = as_column(w), as_column(h)
    return F.sqrt(w * w + h * h) / 2 * as_column(scale) / 3600


def usable_coordinates(ra, dec) -> Column:
    """True when both coordinates are real numbers (NaN would sort above every bound)."""
    ra, dec = as_column(ra), as_column(dec)
    return ra.isNotNull() & dec.isNotNull() & ~F.isnan(ra) & ~F.isnan(dec)


# --- vectors ----------------------------------------------------------------------------------
# For joins, where one position meets many: everything that depends on one side only is computed
# before the join, as unit vectors, so that a pair costs a few multiplications.


def _dot(a: str, b: str) -> Column:
    return F.col(f"{a}.x") * F.col(f"{b}.x") + F.col(f"{a}.y") * F.col(f"{b}.y") + F.col(
        f"{a}.z"
    ) * F.col(f"{b}.z")


def _vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def unit_vector(ra, dec) -> Column:
    """Direction of a sky position: struct<x,y,z>."""
    ra, dec = F.radians(as_column(ra)), F.radians(as_column(dec))
    return _vector(F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))


def chord_limit(radius) -> Column:
    """Squared chord of an angle; two unit vectors at most this far apart lie within the angle."""
    half = F.sin(F.radians(clamp(as_column(radius), 0.0, 180.0)) / 2)
    return 4 * half * half


def squared_chord(a: str, b: str) -> Column:
    """Squared distance of two unit-vector columns."""
    x, y, z = (F.col(f"{a}.{i}") - F.col(f"{b}.{i}") for i in "xyz")
    return x * x + y * y + z * z


def chord_angle(chord2) -> Column:
    """Angle in degrees of a squared chord."""
    chord2 = as_column(chord2)
    return F.degrees(2 * F.asin(F.sqrt(F.when(chord2 > 4, F.lit(4.0)).otherwise(chord2)) / 2))


def with_frame(df: DataFrame, name: str, ra0, dec0, crpix1, crpix2, cd) -> DataFrame:
    """Add what a frame contributes to the pixel of any object: struct<axis,px,py,x0,y0>.

    ``axis`` points to the reference position; the pixel of direction s is
    (px . s / axis . s + x0, py . s / axis . s + y0). Computed in steps of plain projections, so
    that each angle function runs once and the generated code stays short.
    """
    ra, dec = F.radians(as_column(ra0)), F.radians(as_column(dec0))
    steps = df.withColumns(
        {"_sin_a": F.sin(ra), "_cos_a": F.cos(ra), "_sin_d": F.sin(dec), "_cos_d": F.cos(dec)}
        | {f"_m{i}": as_column(c) for i, c in zip(("11", "12", "21", "22"), cd, strict=True)}
    )
    sin_a, cos_a, sin_d, cos_d, m11, m12, m21, m22 = (
        F.col(c) for c in ("_sin_a", "_cos_a", "_sin_d", "_cos_d", "_m11", "_m12", "_m21", "_m22")
    )
    area = m11 * m22 - m12 * m21
    steps = steps.withColumn("_k", F.degrees(F.lit(1.0)) / F.nullif(area, F.lit(0.0)))
    east = (-sin_a, cos_a, F.lit(0.0))
    north = (-sin_d * cos_a, -sin_d * sin_a, cos_d)
    px = [(m22 * e - m12 * n) * F.col("_k") for e, n in zip(east, north, strict=True)]
    py = [(m11 * n - m21 * e) * F.col("_k") for e, n in zip(east, north, strict=True)]
    frame = F.struct(
        _vector(cos_d * cos_a, cos_d * sin_a, sin_d).alias("axis"),
        _vector(*px).alias("px"), _vector(*py).alias("py"),
        (as_column(crpix1) - 1).alias("x0"), (as_column(crpix2) - 1).alias("y0"),
    )
    return steps.withColumn(name, frame).drop(
        "_sin_a", "_cos_a", "_sin_d", "_cos_d", "_m11", "_m12", "_m21", "_m22", "_k"
    )


def frame_pixel(frame: str, vector: str) -> Column:
    """Pixel of a direction column in a frame column: struct<x,y>, NULL on the far side."""
    depth = _dot(f"{frame}.axis", vector)
    visible = F.when(depth > 0, depth)
    x = _dot(f"{frame}.px", vector) / visible + F.col(f"{frame}.x0")
    y = _dot(f"{frame}.py", vector) / visible + F.col(f"{frame}.y0")
    return F.struct(x.alias("x"), y.alias("y"))


# --- sky cells -------------------------------------------------------------------------------
# The sphere is cut into declination zones and each zone into right-ascension cells of about the
# same width, at several resolutions ("levels"): zones of level L are BASE_HEIGHT * 2**L high.
# A circle is looked up at the first level whose zones are at least as high as its radius, so it
# touches at most a handful of cells whatever its size, while a point has one cell per level.

BASE_HEIGHT = 0.25
MAX_LEVEL = 10  # zones of 256 degrees: the whole sphere is one cell
ZONE_STRIDE, CELL_STRIDE = 1024, 2048


def zone_height(level) -> Column:
    return F.lit(BASE_HEIGHT) * F.pow(F.lit(2.0), as_column(level))


def level_for_radius(radius) -> Column:
    steps = F.ceil(F.log2(F.greatest(as_column(radius), F.lit(BASE_HEIGHT)) / BASE_HEIGHT))
    return F.least(steps, F.lit(MAX_LEVEL)).cast("int")


def zone_of(dec, height) -> Column:
    return F.floor((as_column(dec) + 90.0) / as_column(height))


def cells_in_zone(zone, height) -> Column:
    """Number of right-ascension cells of a zone; one near the poles."""
    height = as_column(height)
    middle = F.least((as_column(zone) + 0.5) * height - 90.0, F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(middle)) / height))


def cell_of(ra, cells) -> Column:
    cells = as_column(cells)
    return F.least(F.floor(F.pmod(as_column(ra), F.lit(360.0)) / 360.0 * cells), cells - 1)


def cell_key(level, zone, cell) -> Column:
    """One BIGINT per (level, zone, cell)."""
    return (as_column(level).cast("long") * ZONE_STRIDE + as_column(zone)) * CELL_STRIDE + as_column(
        cell
    )


def ra_half_width(dec, radius) -> Column:
    """Half width in RA of the circle around (any ra, dec); 180 when it holds a pole."""
    dec, radius = as_column(dec), as_column(radius)
    inside = F.abs(F.cos(F.radians(dec - radius)) * F.cos(F.radians(dec + radius)))
    width = F.degrees(F.atan(F.sin(F.radians(radius)) / F.sqrt(F.when(inside > 0, inside))))
    return F.when(F.abs(dec) + radius >= 90.0, F.lit(180.0)).otherwise(
        F.coalesce(width, F.lit(180.0))
    )
