"""Rows that stay in the task that made them, and headers that are read once."""

import pytest
from pyspark.sql import functions as F

from checks.match_queries import rounded
from skyframe.operators import crossmatch, pixels, updates
from skyframe.plans import batch
from skyframe.sources import headers
from skyframe.streaming.store import latest_matches

MATCH = "image_id long, catalog_type string, catalog_designation string, source string"
IMAGE = (
    "id long, file_path string, is_plate_solved boolean, ra_center_degrees double, dec_center_degrees double, field_radius_degrees double,"
    " pixel_scale_arcsec double, width_pixels int, height_pixels int, rotation_degrees double, parity int"
)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def image_rows(spark, n):
    return spark.createDataFrame([(i, f"/d/{i}.fits", True, 10.0 + i, 0.0, 1.0, None, None, None, 0.0, 1) for i in range(n)], IMAGE)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("NGC", f"N{i}", 10.0 + 0.4 * i, 0.1) for i in range(4)]
    return spark.createDataFrame(rows, "catalog_type string, designation string, ra_degrees double, dec_degrees double")


def test_new_matches_are_not_compared_where_nothing_is_kept(spark, catalog):
    images = image_rows(spark, 3)
    old = spark.createDataFrame([(0, "NGC", "N3", "AUTOMATIC")], MATCH)
    renewed = batch.renewed_matches(old, images, catalog, keep=("file_path",))
    assert "LeftAnti" not in plan(renewed)
    got = {(r.image_id, r.catalog_designation, r.file_path) for r in renewed.collect()}
    assert {g for g in got if g[0] == 0} == {(0, f"N{i}", "/d/0.fits") for i in range(3)}


def test_kept_matches_bring_the_columns_of_their_image(spark, catalog):
    images = image_rows(spark, 3)
    old = spark.createDataFrame([(0, "NGC", "N0", "MANUAL"), (0, "NGC", "N3", "MANUAL"), (9, "NGC", "N0", "MANUAL")], MATCH)
    renewed = batch.renewed_matches(old, images, catalog, keep=("file_path",))
    got = sorted((r.image_id, r.catalog_designation, r.source, r.file_path) for r in renewed.filter("image_id = 0").collect())
    assert got == [(0, "N0", "MANUAL", "/d/0.fits"), (0, "N1", "AUTOMATIC", "/d/0.fits"), (0, "N2", "AUTOMATIC", "/d/0.fits"), (0, "N3", "MANUAL", "/d/0.fits")]
    assert {r.image_id for r in renewed.collect()} == {0, 1, 2}


def test_current_matches_are_read_without_a_join_to_the_images(spark):
    log = "base int, batch int, " + MATCH
    found = spark.createDataFrame(
        [(0, 0, 1, "NGC", "A", "AUTOMATIC"), (0, 1, 1, "NGC", "B", "AUTOMATIC"), (0, 0, 2, "NGC", "A", "AUTOMATIC"), (0, -2, 2, "NGC", "A", "MANUAL")], log
    )
    images = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 0, 2)], "base int, batch int, id long")
    current = latest_matches(found, images)
    assert {(r.image_id, r.catalog_designation, r.source) for r in current.collect()} == {(1, "B", "AUTOMATIC"), (2, "A", "MANUAL")}
    # What leaves rows out is stored, so it can be copied to the matches.
    assert "Join Inner" not in plan(current)


def test_cards_are_decoded_in_one_pass(spark):
    cards = ["SIMPLE  =                    T", "OBJECT  = 'O''Brien / 1 '  / name", "HIERARCH CAM MODE = 'fast'", "GAIN    = 5 / x", "GAIN    = 7",
             "EMPTY   =   / none", "BAD     = 'open", "COMMENT one", "COMMENT two", "", "KEY10   = 1"]
    content = "".join(c.ljust(80) for c in [*cards, "END"]).ljust(2880).encode()
    files = spark.createDataFrame([("a", content), ("b", b"no end"), ("c", None)], "path string, content binary")
    read = headers.fits_headers(files)
    assert "lambda" not in plan(read)
    got = {r.path: r.raw_header for r in read.collect()}
    assert got["a"] == {"SIMPLE": "T", "OBJECT": "O'Brien / 1", "CAM MODE": "fast", "GAIN": "5", "EMPTY": None, "BAD": "", "KEY10": "1", "COMMENT": "one\ntwo"}
    assert got["b"] is None and got["c"] is None


def test_xml_is_parsed_once(spark):
    xml = b'<xisf><Image geometry="3:2:1"><FITSKeyword name="A" value="\'x &amp; y \'"/><FITSKeyword name="B"/></Image><Image geometry="9:9:1"/></xisf>'
    content = b"XISF0100" + len(xml).to_bytes(4, "little") + bytes(4) + xml
    read = headers.xisf_headers(spark.createDataFrame([("a", content), ("b", None)], "path string, content binary"))
    assert "xpath" not in plan(read)
    got = {r.path: (r.width_pixels, r.height_pixels, r.raw_header) for r in read.collect()}
    assert got == {"a": (3, 2, {"A": "x & y", "B": ""}), "b": (None, None, None)}


def test_pixels_are_not_sorted_to_meet_their_image(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "image_id long, value double")
    assert "SortMergeJoin" not in pixels.stretch(df)._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_that_of_decimals(spark):
    values = [0.0, -0.0, -1e-9, 0.0005, 0.0015, 0.0025, -0.0015, 1.0005, 2.6755, 0.1235, 123456.7895, 1e15 / 3, -1e300, float("nan"), float("inf"), None]
    values += [(i - 5000) * 0.0005 for i in range(10_000)] + [i / 7 for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(rounded("x", 3).cast("string").alias("got"), F.bround("x", 3).cast("string").alias("want"))
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_designations_merge_where_they_were_found(spark, catalog, monkeypatch):
    monkeypatch.setattr(crossmatch, "PAIRS_PER_TASK", 2)  # so that the sides are dealt to tasks by cell
    images = image_rows(spark, 3)
    key = ["image_id", "catalog_type", "catalog_designation"]
    found = crossmatch.field_match(images, catalog, keep_cells=True)
    both = F.explode(F.array("catalog_designation", F.concat(F.lit(" "), "catalog_designation"))).alias("catalog_designation")
    merged = updates.normalise_designations(found.select(*key[:2], both, *[c for c in found.columns if c in crossmatch.CELL_KEYS]), key[2], key)
    assert merged.columns == key
    want = crossmatch.field_match(images, catalog).select(*key)
    assert sorted(merged.collect()) == sorted(want.collect())
    assert "hashpartitioning(image_id" not in merged._jdf.queryExecution().executedPlan().toString()


def test_designations_of_an_image_in_several_cells_merge_across_them(spark):
    rows = [(1, "A 1", 0.3, "AUTOMATIC", 7, True), (1, "A1", 0.2, "AUTOMATIC", 8, True), (1, "A1", 0.9, "MANUAL", 9, True),
            (2, "A1", 0.4, "AUTOMATIC", 7, False), (2, "A 1", 0.1, "AUTOMATIC", 7, False), (None, "B", 0.1, "AUTOMATIC", 7, False), (None, "B ", 0.2, "AUTOMATIC", 7, False)]
    df = spark.createDataFrame(rows, "image_id long, name string, separation double, source string, cell_id long, _spread boolean")
    got = updates.normalise_designations(df, "name", ["image_id", "name"])
    assert got.columns == ["image_id", "name", "separation", "source"]
    assert {tuple(r) for r in got.collect()} == {(1, "A1", 0.9, "MANUAL"), (2, "A1", 0.1, "AUTOMATIC"), (None, "B", 0.1, "AUTOMATIC")}
    bare = updates.normalise_designations(df.drop("separation", "source"), "name", ["image_id", "name"])
    assert sorted(bare.collect(), key=str) == sorted([(1, "A1"), (2, "A1"), (None, "B")], key=str)
