import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from skyframe.operators.filters import ImageFilter, header_test, json_header_test
from skyframe.plans import ingest

TAN = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN"}


def header(spark, **cards):
    cards = {k.replace("__", "-"): v for k, v in cards.items()}
    return spark.createDataFrame([(cards,)], "h map<string,string>")


def wcs(spark, strict=False, **cards):
    return ingest.header_wcs(header(spark, **cards), "h", strict).first().wcs


def test_header_precedence(spark):
    row = ingest.canonical_header(
        header(spark, EXPOSURE="12", EXPTIME="x", SET__TEMP="-5", TEMP="1", CAMERA="c", ISO="800.0"), "h"
    ).first()
    assert row.exposure_time_seconds == 12.0 and row.temperature_celsius == 1.0
    assert row.camera_name == "c" and row.iso_speed == 800 and row.capture_date is None
    assert ingest.canonical_header(header(spark), "h").first().exposure_time_seconds == 0.0


def test_zero_is_a_value_unless_strict(spark):
    cards = {"CCD__TEMP": "0.0", "TEMP": "7"}
    assert ingest.canonical_header(header(spark, **cards), "h").first().temperature_celsius == 0.0
    strict = ingest.canonical_header(header(spark, **cards), "h", strict_reference=True)
    assert strict.first().temperature_celsius == 7.0


def test_wcs_variants(spark):
    assert wcs(spark, NAXIS1="10") is None
    crval = wcs(spark, CRVAL1="10", CRVAL2="-5", PIXSCALE="2", ROTATION="30")
    assert (crval.wcs_type, crval.ra_center, crval.pixel_scale, crval.rotation) == ("HEADER_CRVAL", 10.0, 2.0, 30.0)
    full = wcs(spark, **TAN, CRVAL1="10", CRVAL2="0", CRPIX1="51", CRPIX2="51", CDELT1="-0.001",
               CDELT2="0.001", NAXIS1="100", NAXIS2="100", CROTA2="0", POSANGLE="12")
    assert full.wcs_type == "HEADER_WCS" and full.ra_center == pytest.approx(10.0)
    assert full.pixel_scale == pytest.approx(3.6) and full.rotation == 12.0
    assert full.radius_degrees == pytest.approx(0.05 * 2**0.5, rel=1e-4)
    # The axes are no tangent plane: direct coordinates are used.
    other = wcs(spark, CRVAL1="10", CRVAL2="0", CDELT1="0.1", NAXIS1="9", NAXIS2="9", RA="01 00 00", DEC="5")
    assert (other.wcs_type, other.ra_center, other.dec_center) == ("HEADER_FALLBACK", 15.0, 5.0)
    optics = wcs(spark, RA="1", DEC="2", FOCALLEN="1000", XPIXSZ="4", NAXIS1="3000", NAXIS2="4000")
    assert optics.pixel_scale == pytest.approx(4 / 1000 * 206.265)
    assert optics.radius_degrees == pytest.approx(2500 * optics.pixel_scale / 3600)
    assert wcs(spark, RA="1") is None


def test_sidecar_only_without_header_solution(spark):
    sidecar = F.struct(
        F.lit(5.0).alias("ra_center"), F.lit(6.0).alias("dec_center"), F.lit(2.0).alias("pixel_scale"),
        F.lit(0.5).alias("radius_degrees"),
    )
    rows = header(spark, GAIN="1").withColumn("s", sidecar)
    got = ingest.header_images(rows, "h", "s").first()
    assert (got.ra_center_degrees, got.plate_solve_source, got.is_plate_solved) == (5.0, "SIDECAR", True)
    got = ingest.header_images(header(spark, RA="1", DEC="2").withColumn("s", sidecar), "h", "s").first()
    assert (got.ra_center_degrees, got.plate_solve_source) == (1.0, "HEADER")
    assert ingest.header_images(header(spark, GAIN="1"), "h").first().is_plate_solved is False


CURRENT = (
    "id long, file_path string, file_name string, subtype string, astrometry_status string,"
    " is_plate_solved boolean, ra_center_degrees double, rating long, thumbnail_path string,"
    " capture_date timestamp_ntz"
)
INCOMING = (
    "file_path string, file_name string, subtype string, is_plate_solved boolean,"
    " ra_center_degrees double, rating long, thumbnail_path string, capture_date timestamp_ntz,"
    " file_last_modified timestamp_ntz"
)


def test_upsert_rules(spark):
    day, mtime = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2)
    current = spark.createDataFrame(
        [
            (1, "/a", "a", "PLANETARY", "SOLVED", True, 10.0, 5, "/t1", day),
            (2, "/b", "b", "SUB_FRAME", "NONE", True, 20.0, 4, "/t2", day),
            (3, "/c", "c", "SUB_FRAME", "NONE", True, 30.0, 3, "/t3", day),
        ],
        CURRENT,
    )
    incoming = spark.createDataFrame(
        [
            ("/a", "zz", "SUB_FRAME", False, None, None, None, None, mtime),
            ("/b", "zz", "SUB_FRAME", False, None, 1, "/new", day, mtime),
            ("/d", "d", "SUB_FRAME", True, 40.0, 2, None, None, mtime),
        ],
        INCOMING,
    )
    rows = {r.file_path: r for r in ingest.upsert_images(current, incoming).collect()}
    assert len(rows) == 4
    a, b, c, d = rows["/a"], rows["/b"], rows["/c"], rows["/d"]
    assert (a.ra_center_degrees, a.is_plate_solved, a.subtype, a.file_name) == (10.0, True, "PLANETARY", "a")
    assert (a.rating, a.thumbnail_path, a.capture_date) == (None, "/t1", mtime)
    assert (b.ra_center_degrees, b.is_plate_solved, b.rating, b.thumbnail_path) == (None, False, 1, "/new")
    assert (c.ra_center_degrees, c.rating) == (30.0, 3)
    path_number = int(hashlib.md5(b"/d").hexdigest()[:15], 16)
    assert (d.id, d.astrometry_status, d.capture_date) == (path_number, "NONE", mtime)


@pytest.mark.parametrize(
    "subtype,solved,status,force,queue",
    [
        ("PLANETARY", False, "NONE", True, "SKIPPED"),
        ("SUB_FRAME", True, "NONE", False, "PRIORITY"),
        ("SUB_FRAME", True, "PROCESSING", False, "SKIPPED"),
        ("SUB_FRAME", True, "PROCESSING", True, "PRIORITY"),
        ("SUB_FRAME", True, "SOLVED", False, "SKIPPED"),
        ("SUB_FRAME", True, "SOLVED", True, "STANDARD"),
        ("SUB_FRAME", False, "NONE", False, "STANDARD"),
        ("SUB_FRAME", False, "FAILED", False, "STANDARD"),
        ("SUB_FRAME", False, "SUBMITTED", False, "SKIPPED"),
        ("SUB_FRAME", True, "FAILED", False, "PRIORITY"),
    ],
)
def test_solve_queue(spark, subtype, solved, status, force, queue):
    df = spark.createDataFrame(
        [(1, "/data/x", subtype, solved, status)],
        "id long, file_path string, subtype string, is_plate_solved boolean, astrometry_status string",
    )
    assert ingest.solve_queue(df, "/data", force).first().queue == queue
    assert ingest.solve_queue(df, "/other", force).count() == 0


def test_hints_after_failure_are_blind(spark):
    df = spark.createDataFrame(
        [("FAILED", 1.0, 2.0, 0.0, 3.0), ("NONE", 1.0, 2.0, 0.0, 3.0), ("NONE", None, 2.0, 1.0, None)],
        "astrometry_status string, ra_center_degrees double, dec_center_degrees double,"
        " field_radius_degrees double, pixel_scale_arcsec double",
    )
    failed, idle, bare = [r.hints for r in ingest.solver_hints(df).collect()]
    assert all(v is None for v in failed)
    assert idle.radius == 5.0 and idle.scale_lower == pytest.approx(2.7)
    assert bare.center_ra is None and bare.scale_units is None


def test_header_predicates(spark):
    rows = spark.createDataFrame(
        [({"OBJECT": None, "GAIN": "100"}, '{"OBJECT": null, "GAIN": "100"}')],
        "h map<string,string>, j string",
    )
    for test in (
        header_test("h", "OBJECT", None), header_test("h", "GAIN", "10"),
        json_header_test("j", "OBJECT", None), json_header_test("j", "GAIN", "10"),
    ):
        assert rows.filter(test).count() == 1
    for test in (header_test("h", "NOPE", None), header_test("h", "OBJECT", "x"), header_test("h", "NOPE", "x")):
        assert rows.filter(test).count() == 0


def test_unknown_filter_option_is_an_error():
    with pytest.raises(ValueError):
        ImageFilter.from_options({"colour": "red"})
