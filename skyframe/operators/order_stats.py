"""Exact order statistics of large groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import written

#: Bits of a digit: a group adds as many rows to a window as a digit has values, at most.
DIGIT_BITS = 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL keys meet."""
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(right, same).drop(*[f"_key_{k}" for k in keys])


def _positions(spec: str | float, n: Column) -> list[Column]:
    """0-based positions in sorted order that a statistic needs."""
    if spec == "median":
        return [F.floor((n - 1) / 2), F.floor(n / 2)]
    return [F.least(F.floor(n * F.lit(float(spec))), n - 1)]


def order_bits(value: str) -> Column:
    """A long that orders as the double ``value`` does: its bits, negated for negative numbers.

    Both zeros are 0. NaN has none. Scaling by powers of two is exact, so equal numbers have equal bits.
    """
    size = F.abs(F.col(value))
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023).cast("long")), F.lit(-1074).cast("long"))
    power = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm may be off by one beside a power of two.
    exponent = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    mantissa = ((size / power(exponent) - 1) * F.lit(2.0**52)).cast("long")
    normal = (exponent + 1023) * F.lit(1 << 52) + mantissa
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < F.lit(2.0**-1022), tiny)
        .otherwise(normal)
    )
    return F.when(F.col(value) < 0, -bits).otherwise(bits)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """How often each value occurs per key: ``keys, _v, _n``; NULL and NaN values are left out."""
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    rows = df.withColumn("_v", F.col(value).cast("double")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*keys, "_v").agg(number.alias("_n"))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, str | float],
    weight: str | None = None,
    digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """Exact order statistics of ``value`` per key; NULL and NaN values are left out.

    ``wanted`` maps output names to "median" (mean of the two middle values) or to a fraction f,
    meaning the element at position int(n * f). Rows count ``weight`` times if a column is named.

    The rows are read once, for the counts of the values. Radix selection then goes through the bits
    by which doubles are ordered, from the highest digit to the lowest: each step counts, for each
    position that is looked for, the values that share the digits found so far by their next digit, and
    keeps the one that holds the position. The number of steps and the rows of a window are the same
    for any spread of the values, infinities too. All steps are deterministic, so a recomputed task
    gives the same result.
    """
    if not 1 <= digit_bits <= 32:
        raise ValueError("digits have 1 to 32 bits")
    keys = list(keys)
    data = value_counts(df, keys, value, weight)
    data = written(data.select(*keys, "_v", "_n", order_bits("_v").alias("_bits")), "value-counts")
    sizes = data.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    targets = F.array(
        *[
            F.struct(
                F.lit(name).alias("_stat"),
                position.cast("long").alias("_target"),
                position.cast("long").alias("_pos"),
            )
            for name, spec in wanted.items()
            for position in _positions(spec, F.col("_n"))
        ]
    )
    found = sizes.select(*keys, F.inline(F.array_distinct(targets)))
    shift = 64
    while shift:
        lower = max(0, shift - digit_bits)
        found = _narrow(data, found, keys, None if shift == 64 else shift, lower)
        shift = lower
    return found.groupBy(*keys).agg(
        # min and max of the (one or two) middle values; their mean is the statistic.
        *[
            (
                (
                    F.min(F.when(F.col("_stat") == name, F.col("_value")))
                    + F.max(F.when(F.col("_stat") == name, F.col("_value")))
                )
                / 2
            ).alias(name)
            for name in wanted
        ]
    )


def _narrow(data: DataFrame, found: DataFrame, keys: list[str], known: int | None, lower: int) -> DataFrame:
    """Of the values whose bits from ``known`` up are found, the digit above ``lower`` that holds the position."""
    prefix = [] if known is None else ["_prefix"]
    rows = data if known is None else data.withColumn("_prefix", F.shiftright("_bits", known))
    target = [*keys, "_stat", "_target", "_pos"]
    inside = null_safe_join(rows, found.select(*target, *prefix), [*keys, *prefix])
    counts = inside.groupBy(*target, F.shiftright("_bits", lower).alias("_prefix")).agg(
        F.sum("_n").alias("_c"), F.min("_v").alias("_value")
    )
    upto = F.sum("_c").over(Window.partitionBy(*target).orderBy("_prefix"))
    here = (F.col("_pos") < F.col("_upto")) & (F.col("_pos") >= F.col("_upto") - F.col("_c"))
    rest = (F.col("_pos") - (F.col("_upto") - F.col("_c"))).alias("_pos")
    return counts.withColumn("_upto", upto).filter(here).select(*keys, "_stat", "_target", rest, "_prefix", "_value")
