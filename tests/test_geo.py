import math
import random

import pytest
from pyspark.sql import functions as F

from skyframe.functions import geo


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_round_trip_of_random_frames(spark):
    rng = random.Random(7)
    rows = [
        (
            rng.uniform(0, 360), rng.uniform(-89, 89), rng.uniform(0.3, 6), rng.uniform(-30, 400),
            rng.choice([1, -1]), rng.randint(500, 5000), rng.randint(500, 5000),
            rng.uniform(-100, 5000), rng.uniform(-100, 5000),
        )
        for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, "ra0 double, dec0 double, s double, rot double, p int, w int, h int, x double, y double")
    sky = df.withColumn("sky", geo.pixel_to_sky("x", "y", "ra0", "dec0", "s", "rot", "p", "w", "h"))
    back = sky.withColumn(
        "px", geo.sky_to_pixel("sky.ra", "sky.dec", "ra0", "dec0", "s", "rot", "p", "w", "h")
    )
    worst = back.agg(
        F.max(F.abs(F.col("px.x") - F.col("x"))), F.max(F.abs(F.col("px.y") - F.col("y"))),
        F.count_if(~F.col("px.ok")),
    ).first()
    assert worst[0] < 1e-6 and worst[1] < 1e-6 and worst[2] == 0


# X, y, rotation -> ra, dec for a 200 x 200 frame at (100, 0), one degree per pixel.
LINEAR = [
    (100, 100, 0, 100, 0),
    (99, 100, 0, 101, 0),
    (100, 99, 0, 100, 1),
    (99, 100, 180, 99, 0),
    (100, 99, 180, 100, -1),
]


@pytest.mark.parametrize("x,y,rot,ra,dec", LINEAR)
def test_linear_pixel_to_sky(spark, x, y, rot, ra, dec):
    sky = geo.pixel_to_sky_linear(x, y, 200, 200, 100, 0, 3600, rot)
    got = one(spark, sky.alias("s")).s
    assert got.ra == pytest.approx(ra, abs=1e-3)
    assert got.dec == pytest.approx(dec, abs=1e-3)


def test_linear_wraps_clamps_and_needs_all_inputs(spark):
    wrapped = geo.pixel_to_sky_linear(0, 0, 200, 200, 359.5, 89.95, 3600, 0)
    missing = geo.pixel_to_sky_linear(0, 0, 200, 200, F.lit(None).cast("double"), 0, 3600, 0)
    got = one(spark, wrapped.alias("w"), missing.alias("m"))
    assert 0 <= got.w.ra < 360 and got.w.dec == 90.0 and got.m is None


def test_separation(spark):
    null = F.lit(None).cast("double")
    got = one(
        spark,
        geo.angular_separation(359.9, 0, 0.1, 0).alias("wrap"),
        geo.angular_separation(0, 90, 123, 90).alias("pole"),
        geo.angular_separation(10, 20, 190, -20).alias("opposite"),
        geo.angular_separation(10, 20, 30, 40).alias("there"),
        geo.angular_separation(30, 40, 10, 20).alias("back"),
        geo.angular_separation(null, 20, 30, 40).alias("none"),
    )
    assert got.wrap == pytest.approx(0.2) and got.pole == pytest.approx(0, abs=1e-12)
    assert got.opposite == pytest.approx(180) and got.there == got.back and got.none is None


def test_far_side_has_no_pixel(spark):
    pixel = geo.sky_to_pixel(180, 0, 0, 0, 1.0, 0, 1, 100, 100)
    got = one(spark, pixel.alias("p")).p
    assert got.x is None and got.y is None and got.ok is False


def test_center_lands_on_reference_pixel(spark):
    got = one(spark, geo.sky_to_pixel(50, 10, 50, 10, 1.0, 33, -1, 300, 200).alias("p")).p
    assert (got.x, got.y) == (149.0, 99.0)


def test_frame_radius(spark):
    got = one(spark, geo.frame_radius(3000, 4000, 3.6).alias("r")).r
    assert math.isclose(got, 2.5)
