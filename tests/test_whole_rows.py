"""Rows that fixtures rarely have: NULL keys, repeated paths, files without tags, damaged headers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyframe.functions import text
from skyframe.operators import crossmatch, stats, updates
from skyframe.operators.filters import ImageFilter
from skyframe.plans import ingest
from skyframe.sources import catalogs, files, headers


def test_null_keys_keep_their_rows(spark):
    rows = [(None, 1, None), (None, 2, 5.0), (None, 3, None), ("a", 1, 7.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = stats.carry_forward(df, ["k"], "t", F.floor(F.col("t") / 2), {"v": "seen"}).collect()
    assert sorted((r.k or "", r.t, r.seen) for r in got) == [("", 1, None), ("", 2, 5.0), ("", 3, 5.0), ("a", 1, 7.0)]
    times = spark.createDataFrame([(None, "x", 2.0), (None, "x", 4.0), ("3", "x", 1.0)], "w string, task string, s double")
    got = {r.w: (r.n, r.median_s, r.tasks_per_minute) for r in stats.duration_summary(times, ["w", "task"], "s", "w").collect()}
    assert got == {None: (2, 3.0, 0.0), "3": (1, 1.0, 180.0)}
    log = spark.createDataFrame([(None, 1.0, True), ("u", 2.0, False)], "k string, ms double, ok boolean")
    assert {r.k: r.p95_latency for r in stats.latency_summary(log, "k", "ms", "ok").collect()} == {None: 1.0, "u": 2.0}


IMAGES = "id long, file_path string, subtype string, rating long, astrometry_status string, file_last_modified timestamp_ntz, file_size_bytes long"


def test_a_missing_subtype_counts_as_changed(spark):
    df = spark.createDataFrame([(1, "/a", None, 5, "NONE", None, 1), (2, "/b", "X", 5, "NONE", None, 1), (3, "/c", "Y", 5, "NONE", None, 1)], IMAGES)
    report = updates.reclassify_report(updates.reclassify(df, ImageFilter(rating=5), "Y")).first()
    assert (report.updated_count, report.changed_count) == (3, 2)


def test_upsert_takes_the_newest_state_and_numbers_new_files(spark):
    day = dt.datetime(2024, 1, 1)
    current = spark.createDataFrame([(1, "/a", "X", 0, "NONE", day, 1)], IMAGES)
    incoming = spark.createDataFrame(
        [("/a", 1, day, 10), ("/a", 2, day + dt.timedelta(1), 20), ("/n", 3, day, 1), ("/n", 4, day + dt.timedelta(1), 2), ("/m", 1, day, 1)],
        "file_path string, rating long, file_last_modified timestamp_ntz, file_size_bytes long",
    )
    got = ingest.upsert_images(current, incoming).collect()
    assert {r.file_path: r.rating for r in got} == {"/a": 2, "/n": 4, "/m": 1} and len(got) == 3
    ids = {r.file_path: r.id for r in got}
    assert ids["/a"] == 1 and len(set(ids.values())) == 3 and None not in ids.values()
    again = {r.file_path: r.id for r in ingest.upsert_images(current, incoming).collect()}
    assert again == ids


def test_images_without_listed_tags_stay(spark):
    tags = spark.createDataFrame([("a", "EXIF FNumber", "4"), ("b", "Thumbnail Width", "1")], "path string, tag string, value string")
    ratings = spark.createDataFrame([("b", 3), ("c", 4)], "path string, rating int")
    assert {r.path: r.rating for r in ingest.exif_images(tags, ratings).collect()} == {"a": None, "b": 3}
    inventory = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    got = {r.path: r.rating for r in ingest.exif_images(tags, ratings, inventory=inventory).collect()}
    assert got == {"a": None, "b": 3, "c": 4, "d": None}


def test_manual_matches_survive_a_merge(spark):
    rows = [("M 31", "AUTOMATIC", 0.1), ("M31", "MANUAL", 0.9), ("M 33", "AUTOMATIC", 0.5), ("M33", "AUTOMATIC", 0.2)]
    df = spark.createDataFrame(rows, "designation string, source string, separation double")
    got = updates.normalise_designations(df, "designation", ["designation"]).collect()
    assert {r.designation: (r.source, r.separation) for r in got} == {"M31": ("MANUAL", 0.9), "M33": ("AUTOMATIC", 0.2)}


def test_xisf_keywords_keep_their_values(spark):
    xml = (
        '<xisf><Image geometry="3:2:1"><FITSKeyword name="OBJECT"/><FITSKeyword name="A" value="5"/>'
        '<FITSKeyword value="lost"/><FITSKeyword name="GAIN" value="\'M31\'"/></Image></xisf>'
    )
    row = spark.createDataFrame([(xml,)], "xml string").select(headers.xisf_entries("xml").alias("e")).first()
    assert {e.key: e.value for e in row.e} == {"OBJECT": "", "A": "5", "GAIN": "M31"}


def test_damaged_files_do_not_end_the_job(spark, tmp_path):
    def card(text):
        return text.ljust(80)

    def header(*cards):
        return "".join(map(card, ("SIMPLE  =                    T", *cards, "END"))).ljust(2880).encode()

    contents = {
        "good": header(*[f"KEY{k:05}=                    {k}" for k in range(20)]),
        "float": header("BITPIX  =                  8.0", "NAXIS   =                  1.0", "NAXIS1  =                  8.0"),
        "axis": header("NAXIS   =                    2", "NAXIS1  =                    8"),
        "word": header("NAXIS   =                 many"),
        "jpeg": b"\xff\xd8\xff" * 5000,
        "cut": header()[:100],
        "bytes": header("A       = 1")[:80] + b"\xff" * 50_000,
        "empty": b"",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    paths = [(str(tmp_path / n),) for n in (*contents, "missing")]
    got = {r.path.rsplit("/", 1)[1]: r for r in headers.read_fits_headers(spark.createDataFrame(paths, "path string")).collect()}
    assert got["good"].error is None and got["good"].raw_header["KEY00019"] == "19"
    assert got["float"].error is None and got["float"].raw_header["NAXIS1"] == "8.0"
    assert "KeyError" in got["axis"].error and got["axis"].raw_header["NAXIS1"] == "8"
    assert "ValueError" in got["word"].error
    assert all(got[n].error and got[n].raw_header is None for n in ("jpeg", "cut", "bytes", "empty", "missing"))


def test_a_root_ends_at_a_folder(spark):
    images = spark.createDataFrame([("/data/m1/a.fits",), ("/data/m10/b.fits",)], "file_path string")
    none = spark.createDataFrame([], "path string")
    for root in ("/data/m1", "/data/m1/"):
        assert [r.file_path for r in files.vanished_files(images, none, root).collect()] == ["/data/m1/a.fits"]


def test_header_keys_that_become_equal(spark):
    df = spark.createDataFrame([({"A\x00": "1", "A": "2", "B": "\x003"},)], "h map<string,string>")
    got = df.select(text.strip_nul_map("h").alias("h")).first().h
    assert set(got) == {"A", "B"} and got["A"] in ("1", "2") and got["B"] == "3"


def test_no_cap_by_default_and_only_levels_in_use(spark):
    images = spark.createDataFrame([(k, 10.0, 10.0, 1.0) for k in range(2)], "id long, ra_center_degrees double, dec_center_degrees double, field_radius_degrees double")
    objects = spark.range(120).select(F.lit("NGC").alias("catalog_type"), F.col("id").cast("string").alias("designation"), (10 + F.col("id") / 1000).alias("ra_degrees"), F.lit(10.0).alias("dec_degrees"))
    pairs = crossmatch.circle_join(images, objects)
    assert crossmatch.nearest_per_type(pairs, None).count() == 240
    assert crossmatch.nearest_per_type(pairs, 50).count() == 100
    levels = images.select(crossmatch.geo.level_for_radius("field_radius_degrees").alias("_level")).distinct()
    assert crossmatch.catalog_cells(objects, "ra_degrees", "dec_degrees", levels).count() == 120


def test_details_that_are_listed_twice_multiply_nothing(spark):
    rows = spark.createDataFrame([("M1", 1), ("M2", 2), ("M3", 3)], "designation string, messier_number int")
    extra = [(1, "M1", "b"), (1, "M1", "a"), (1, "M9", "c"), (None, "M2", "x"), (None, "M2", "y"), (None, None, "z")]
    extra = spark.createDataFrame(extra, "messier_number int, designation string, type string")
    got = catalogs.enrich_by_number(rows, extra).collect()
    assert sorted((r.designation, r._meta and r._meta.type) for r in got) == [("M1", "a"), ("M2", "x"), ("M3", None)]


def test_progress_crosses_blocks_of_each_series(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(hours=h), h * h) for k in ("a", None) for h in (0, 1, 30, 31, 100)] + [("b", None, 1), ("b", base, 4)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n long")
    got = {(r.k, r.n): (r.fixed, r.rate) for r in stats.progress_rate(df, "ts", "n", ["k"]).collect()}
    assert len(got) == len(rows)
    for k in ("a", None):
        assert got[k, 0] == (None, None) and got[k, 1] == (-1, pytest.approx(-1 / 3600))
        assert got[k, 900] == (-899, pytest.approx(-899 / 29 / 3600)) and got[k, 10000] == (961 - 10000, pytest.approx((961 - 10000) / 69 / 3600))
    assert got["b", 1] == (None, None) and got["b", 4][0] == -3
    plain = stats.progress_rate(df.where("k = 'a'").drop("k"), "ts", "n").collect()
    assert {r.n: r.fixed for r in plain} == {n: f for (k, n), (f, _) in got.items() if k == "a"}
