import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import pixels
from skyframe.operators.order_stats import order_bits, order_statistics
from skyframe.operators.stats import carry_forward, top_n_other


@pytest.mark.parametrize("digit_bits", [16, 24])
def test_matches_numpy_on_awkward_groups(spark, digit_bits):
    """Ties, one value, even counts, outliers, exponential spread, infinities, the smallest numbers."""
    rng = np.random.default_rng(1)
    groups = {
        "ties": rng.integers(0, 5, 1001).astype(float),
        "flat": np.full(10, 3.25),
        "even": rng.normal(size=500),
        "outlier": np.append(rng.normal(size=801), 1e12),
        "single": np.array([-7.5]),
        "pair": np.array([1.0, 2.0]),
        "spread": 10.0 ** rng.uniform(-300, 300, 701) * rng.choice([-1, 1], 701),
        "infinite": np.concatenate([rng.normal(size=300), [np.inf] * 40, [-np.inf] * 21]),
        "tiny": np.arange(-50, 51) * 5e-324,
    }
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    df = spark.createDataFrame(frame).unionByName(
        spark.createDataFrame([("ties", None), ("even", float("nan"))], "g string, v double")
    )
    got = order_statistics(df, ["g"], "v", {"m": "median", "p": 0.95}, digit_bits=digit_bits).collect()
    assert len(got) == len(groups)
    for row in got:
        values = np.sort(groups[row.g])
        assert row.m == pytest.approx(np.median(values), rel=1e-15)
        assert row.p == values[min(int(len(values) * 0.95), len(values) - 1)]


def test_bits_order_as_numbers_do(spark):
    """Against the bits of the machine, beside all powers of two and at the ends."""
    powers = 2.0 ** np.arange(-1074, 1024, 3)
    sizes = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), [0.0, 5e-324, 2.0**-1022, 1.7976931348623157e308, np.inf]])
    values = np.unique(np.concatenate([sizes, -sizes]))
    got = spark.createDataFrame(pd.DataFrame({"v": values})).select("v", order_bits("v").alias("b")).toPandas()
    bits = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got.b.to_numpy() == np.where(got.v < 0, -bits, bits)).all() and len(got) == len(values)
    assert (np.argsort(got.b.to_numpy(), kind="stable") == np.argsort(got.v.to_numpy(), kind="stable")).all()


def test_weights_and_windows(spark):
    """Weighted rows count as many times; the plan has a window over digits only, whatever the spread."""
    rows = [("a", float(v), n) for v, n in ((1, 5), (2, 1), (1e300, 3), (-1e-300, 4), (2, 2))]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = order_statistics(df, ["g"], "v", {"m": "median", "p": 0.95}, "n").first()
    values = np.sort(np.repeat([r[1] for r in rows], [r[2] for r in rows]))
    assert got.m == np.median(values) and got.p == values[int(len(values) * 0.95)]


def test_an_image_is_read_twice(spark, tmp_path):
    """Once for the counts of its values, once for the levels."""
    spark.range(1000).selectExpr("id % 3 AS image_id", "id AS ix", "rand(1) AS value").write.parquet(f"{tmp_path}/p")
    frame = spark.read.parquet(f"{tmp_path}/p")
    plan = pixels.stretch(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/p") == 1  # the first reading is behind the written counts


def numpy_stretch(data):
    data = np.nan_to_num(np.asarray(data, dtype=float))
    low, high = data.min(), data.max()
    if high <= low:
        return np.zeros(len(data), dtype=int)
    v = (data - low) / (high - low)
    median = np.median(v)
    c0 = max(0.0, median - 1.25 * np.median(np.abs(v - median)))
    v = (np.clip(v, c0, 1) - c0) / (1 - c0)
    x = np.median(v)
    m = x * 0.75 / (x + 0.25 - 2 * x * 0.25) if 0 < x < 1 and x != 0.25 else 0.5
    if m != 0.5:
        v = (m - 1) * v / ((2 * m - 1) * v - m)
    return np.trunc(np.clip(v, 0, 1) * 255).astype(int)


def test_auto_stretch_equals_numpy(spark):
    rng = np.random.default_rng(5)
    images = {
        1: rng.gamma(2.0, 100.0, 700),
        2: np.full(20, 9.0),
        3: rng.integers(0, 65536, 501).astype(float),
        4: np.append(rng.normal(1000, 3, 400), [60000.0, np.nan]),
        5: np.array([0.0, 1.0]),
    }
    frame = pd.concat(
        [pd.DataFrame({"image_id": i, "ix": range(len(v)), "value": v}) for i, v in images.items()]
    )
    got = pixels.stretch(spark.createDataFrame(frame)).toPandas()
    for i, values in images.items():
        mine = got[got.image_id == i].sort_values("ix").level.to_numpy()
        assert (mine == numpy_stretch(values)).all(), i
    linear = pixels.linear_stretch(spark.createDataFrame(frame)).toPandas()
    assert (linear[linear.image_id == 2].level == 0).all()
    assert set(linear[linear.image_id == 5].level) == {0, 255}


def test_clean_values(spark):
    df = spark.createDataFrame(
        [(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "v double"
    )
    got = [r[0] for r in df.select(pixels.clean_values("v")).collect()]
    assert got == [0.0, pixels.LARGEST, -pixels.LARGEST, 1.5, None]


def test_carry_forward_crosses_blocks(spark):
    rows = [("a", i, i if i in (3, 57) else None) for i in range(100)]
    rows += [("b", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "f string, n long, c long")
    got = carry_forward(df, ["f"], "n", F.floor(F.col("n") / 10), {"c": "out"}).collect()
    assert len(got) == 120
    for row in got:
        want = None if row.f == "b" or row.n < 3 else 3 if row.n < 57 else 57
        assert row.out == want


def test_top_n_other_keeps_a_real_other_apart(spark):
    df = spark.createDataFrame([("Other", 9), ("x", 8), ("y", 2), ("z", 1)], "name string, n long")
    got = sorted(tuple(r) for r in top_n_other(df, "name", 2).collect())
    assert got == [("Other", 3), ("Other", 9), ("x", 8)]
    assert top_n_other(df, "name", 10).count() == 4
