import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyframe.functions import text


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_numbers(spark):
    assert values(spark, text.to_float("v"), ["1.5", " 2 ", "x", "", None]) == [1.5, 2.0, None, None, None]
    assert values(spark, text.to_int("v"), ["1.0", "2.9", "-2.9", "x", "NaN"]) == [1, 2, -2, None, None]
    assert values(spark, text.ratio_text("v"), ["1/4", "1/0", "2.5", "a/b", None]) == [0.25, None, 2.5, None, None]
    assert values(spark, text.low_bit("v"), ["1", "16 (off)", "25", "none"]) == [True, False, True, None]


def test_sexagesimal(spark):
    dec = values(spark, text.sexagesimal("v"), ["-00 30 00", "+10:30:36", "-5 0 0", "12.5", "1 2", "a b c", None])
    assert dec == [-0.5, pytest.approx(10.51), -5.0, 12.5, None, None, None]
    ra = values(spark, text.sexagesimal("v", hours=True), ["05 34 31.0", "24 00 00", "-01 00 00"])
    assert ra == [pytest.approx(83.629166, abs=1e-5), 0.0, 15.0]
    assert values(spark, text.coordinate("v", True), ["83.5", "01 00 00"]) == [83.5, 15.0]


def test_catalog_coordinates(spark):
    assert values(spark, text.catalog_ra("v"), ["01:30:00", "01:30", "02", "", "bad", None]) == [22.5, 22.5, 30.0, 0.0, 0.0, 0.0]
    assert values(spark, text.catalog_dec("v"), ["-00:30:00", "+10:00:00", "", "x", "-01:xx"]) == [-0.5, 10.0, 0.0, 0.0, 0.0]
    assert values(spark, text.clock_to_degrees("v"), ["01:30", "2", "x:30", "", None]) == [22.5, 30.0, 7.5, None, None]


def test_dates(spark):
    cases = {
        "2023-01-02T03:04:05": dt.datetime(2023, 1, 2, 3, 4, 5),
        "2023-01-02T03:04:05.25": dt.datetime(2023, 1, 2, 3, 4, 5, 250000),
        "2023-01-02T03:04:60": dt.datetime(2023, 1, 2, 3, 4, 59),
        "2023-01-02T03:60:05": None,
        "2023-01-02 03:04:05": dt.datetime(2023, 1, 2, 3, 4, 5),
        "2023-01-02": dt.datetime(2023, 1, 2),
        "2023/01/02": dt.datetime(2023, 1, 2),
        "31/12/2022": dt.datetime(2022, 12, 31),
        "2023-13-02": None,
        "yesterday": None,
        "": None,
    }
    assert values(spark, text.header_date("v"), list(cases)) == list(cases.values())
    exif = values(spark, text.exif_date("v"), ["2023:01:02 03:04:05", "2023-01-02 03:04:05", "0000:00:00 00:00:00"])
    assert exif == [dt.datetime(2023, 1, 2, 3, 4, 5), None, None]


def test_names(spark):
    got = values(spark, text.canonical_filter("v"), ["Ha", "H-alpha", "UV/IR cut", "L-Pro", "offset", "duo", "", None, "O III"])
    assert got == ["H-Alpha", "H-Alpha", "Luminance", "Luminance", "Bias", "Duo", "Unknown", "Unknown", "OIII"]
    assert values(spark, text.designation_number("v"), ["NGC0224", "IC0010", "NGC 7", "NGC5A", "M31"]) == [224, 10, 7, 0, 0]
    assert values(spark, text.subtype_label("v"), ["SUB_FRAME", "OTHER", "", None]) == ["Sub Frame", "OTHER", "Unclassified", "Unclassified"]
    assert values(spark, text.strip_nul("v"), ["a\x00b", "a\\u0000b", "ab"]) == ["ab", "ab", "ab"]


def test_display(spark):
    shown = spark.range(1).select(
        text.coordinates_display(F.lit(83.629167), F.lit(22.014472)).alias("a"),
        text.dec_display(F.lit(-0.5)).alias("b"), text.ra_clock(F.lit(15.0)).alias("c"),
        text.dec_display(F.lit(None).cast("double")).alias("d"),
    ).first()
    assert shown.a == "05h 34m 31.00s, +22° 00' 52.1\""
    assert (shown.b, shown.c, shown.d) == ("-0° 30' 0.0\"", "01:00:00.0", "--")
    sizes = values(spark, text.bytes_display("v"), [0, 500, 1536, 1048576, 5 * 1024**4, None], "long")
    assert sizes == ["0 B", "500 B", "1.5 KB", "1 MB", "5 TB", None]
    times = values(spark, text.exposure_display("v"), [0.25, 1.5, 90.0, 90.5, 3700.0, None], "double")
    assert times == ["250ms", "1.5s", "1m 30s", "1m 30.5s", "1h 1m", "N/A"]
    sizes = spark.createDataFrame([(3.0, 2.0), (3.0, None), (None, 2.0), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in sizes.select(text.angular_size_display("a", "b")).collect()] == ["3.0' × 2.0'", "3.0'", "Unknown", "Unknown"]


def test_paths(spark):
    paths = ["/a/b.c/img.fit", "C:\\x\\y.jpg", "plain", "/a/.hidden"]
    assert values(spark, text.parent_folder("v"), paths) == ["/a/b.c", "C:\\x", None, "/a"]
    assert values(spark, text.extension("v"), ["/a/b.FITS", "/a.b/c", "/a/.hidden", "/a/x.tar.gz"]) == ["fits", "", "", "gz"]
    assert values(spark, text.stem("v"), ["/a/b.fits", "/a/c", "/a/x.y.z"]) == ["b", "c", "x.y"]
    assert values(spark, text.is_safe_path("v", ["/data"]), ["/data/x", "/data/../etc", "/etc"]) == [True, False, False]
