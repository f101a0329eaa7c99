"""Pixel statistics over long tables (image, pixel, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.geo import clamp
from skyframe.operators.order_stats import order_statistics
from skyframe.session import written

TARGET_BACKGROUND = 0.25
SHADOWS_CLIP = -1.25
LARGEST = 1.7976931348623157e308


def clean_values(value) -> Column:
    """NaN becomes 0, infinities the largest finite numbers."""
    value = F.col(value) if isinstance(value, str) else value
    return clamp(F.nanvl(value.cast("double"), F.lit(0.0)), -LARGEST, LARGEST)


def _normalised(pixels: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(pixels with ``_v`` scaled to [0, 1], range per image); ``_v`` is NULL for flat images."""
    cleaned = pixels.withColumn("_clean", clean_values(value))
    ranges = cleaned.groupBy(key).agg(F.min("_clean").alias("_min"), F.max("_clean").alias("_max"))
    return cleaned, ranges


def _unit(column: str = "_clean") -> Column:
    return F.try_divide(F.col(column) - F.col("_min"), F.col("_max") - F.col("_min"))


def linear_stretch(pixels: DataFrame, key: str = "image_id", value: str = "value") -> DataFrame:
    """Adds ``level`` 0-255: min to 0, max to 255, truncated; flat images are 0."""
    cleaned, ranges = _normalised(pixels, key, value)
    level = F.coalesce(_unit() * 255, F.lit(0.0)).cast("int")
    return cleaned.join(ranges, key).withColumn("level", level).drop("_clean", "_min", "_max")


def stretch_parameters(pixels: DataFrame, key: str = "image_id", value: str = "value") -> DataFrame:
    """Per image: range, median, deviation, shadow clip and midtone balance of the auto-stretch.

    Median and median absolute deviation are exact and found by counting, never by collecting an
    image. Clipping and rescaling keep the order of the pixels and the clip point never exceeds
    the middle values, so the median after clipping follows from the one before.

    The pixels are read once, for how often each value occurs in each image; range, median and
    deviation come from these counts, which are written out.
    """
    cleaned = pixels.select(key, clean_values(value).alias("_clean"))
    counts = written(cleaned.groupBy(key, "_clean").agg(F.count("_clean").alias("_times")), "pixel-counts")
    ranges = counts.groupBy(key).agg(F.min("_clean").alias("_min"), F.max("_clean").alias("_max"))
    unit = counts.join(ranges, key).select(key, _unit().alias("_v"), "_times")
    medians = order_statistics(unit, [key], "_v", {"_median": "median"}, "_times")
    known = written(ranges.join(medians, key, "left"), "medians")
    deviation = counts.join(known, key).select(key, F.abs(_unit() - F.col("_median")).alias("_d"), "_times")
    spreads = order_statistics(deviation, [key], "_d", {"_mad": "median"}, "_times")
    clip_point = F.col("_median") + F.lit(SHADOWS_CLIP) * F.col("_mad")
    shadow = F.when(clip_point < 0, F.lit(0.0)).otherwise(clip_point)
    after = F.try_divide(F.col("_median") - F.col("_shadow"), 1 - F.col("_shadow"))
    y = F.lit(TARGET_BACKGROUND)
    denominator = F.col("_x") + y - 2 * F.col("_x") * y
    defined = (F.col("_x") > 0) & (F.col("_x") < 1) & (F.col("_x") != y) & (denominator != 0)
    return (
        known.join(spreads, key, "left")
        .withColumn("_shadow", shadow)
        .withColumn("_x", F.coalesce(after, F.col("_median")))
        .withColumn(
            "_balance",
            F.when(defined, F.col("_x") * (1 - y) / denominator).otherwise(F.lit(0.5)),
        )
        .drop("_x")
    )


def stretch(pixels: DataFrame, key: str = "image_id", value: str = "value") -> DataFrame:
    """Adds ``level`` 0-255 of the screen auto-stretch; flat images are 0.

    Shadows are clipped 1.25 deviations below the median, and the midtones are balanced so that
    the background lands at a quarter of the range.
    """
    # One row per image, stored so that its size is known: small ones are copied to the pixels, which then need no sort.
    parameters = written(stretch_parameters(pixels, key, value), "stretch-parameters")
    shadow, m = F.col("_shadow"), F.col("_balance")
    clipped = F.when(_unit() < shadow, shadow).otherwise(_unit())
    rescaled = F.when(shadow < 1, (clipped - shadow) / (1 - shadow)).otherwise(clipped)
    v = F.col("_v")
    toned = F.when(m == 0.5, v).otherwise(F.try_divide((m - 1) * v, (2 * m - 1) * v - m))
    level = F.coalesce(clamp(toned, 0.0, 1.0) * 255, F.lit(0.0))
    return (
        pixels.withColumn("_clean", clean_values(value))
        .join(parameters, key)
        .withColumn("_v", rescaled)
        .withColumn("level", level.cast("int"))
        .drop("_clean", "_min", "_max", "_median", "_mad", "_shadow", "_balance", "_v")
    )
