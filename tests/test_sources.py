"""File sources over real files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from skyframe.functions.text import content_hash
from skyframe.operators.quality import content_duplicates
from skyframe.operators.stats import carry_forward
from skyframe.sources import catalogs, exports, files, headers, sidecars


def fits(cards, data=b""):
    text = "".join(c.ljust(80) for c in [*cards, "END"])
    text = text.ljust(-(-len(text) // 2880) * 2880)
    return text.encode("latin-1") + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


MANY = [f"{f'KEY{i}':<8}= {i}" for i in range(40)]


@pytest.fixture
def archive(tmp_path):
    (tmp_path / "sub").mkdir()
    size = ["SIMPLE  = T", "BITPIX  = -32", "NAXIS   = 2", "NAXIS1  = 100", "NAXIS2  = 20"]
    word = ["COMMENT this ends the WEEK" + "END".rjust(80 - 26), "", *MANY, "OBJECT  = 'M 31    '  / name"]
    # Data that looks like a header's end must not be taken for one.
    data = "END".ljust(80).encode() * 100
    (tmp_path / "a.fits").write_bytes(fits(size + word, data))
    (tmp_path / "sub" / "b.FIT").write_bytes(fits(size, data) + fits(["XTENSION= 'IMAGE'", "GAIN    = 5"]))
    (tmp_path / "sub" / "c.fits").write_bytes(b"not a fits file at all")
    (tmp_path / "sub" / "only.fits").write_bytes(fits(size, data))
    (tmp_path / "x.jpg").write_bytes(b"same")
    (tmp_path / "y.jpeg").write_bytes(b"same")
    (tmp_path / "notes.txt").write_text("no image")
    return tmp_path


def test_scan_finds_images_without_reading_them(spark, archive):
    found = files.scan(spark, str(archive))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    rows = {os.path.basename(r.path): r for r in found.collect()}
    assert set(rows) == {"a.fits", "b.FIT", "c.fits", "only.fits", "x.jpg", "y.jpeg"}
    assert rows["b.FIT"].file_format == "FIT" and rows["x.jpg"].size == 4
    assert rows["x.jpg"].path == str(archive / "x.jpg")


def test_fits_headers_by_bytes_and_by_blocks(spark, archive):
    inventory = files.scan(spark, str(archive)).filter("file_format IN ('FITS', 'FIT')")
    by_blocks = headers.read_fits_headers(inventory).collect()
    by_bytes = headers.fits_headers(headers.read_binary(spark, str(archive), "*.{fits,FIT}")).collect()
    for rows in (by_blocks, by_bytes):
        got = {os.path.basename(r.path): r.raw_header for r in rows}
        assert set(got) == {"a.fits", "b.FIT", "c.fits", "only.fits"}
        assert got["a.fits"]["OBJECT"] == "M 31" and got["a.fits"]["KEY39"] == "39"
        assert got["b.FIT"] == {"XTENSION": "IMAGE", "GAIN": "5"}
        assert got["c.fits"] is None
        assert got["only.fits"]["NAXIS1"] == "100"


def test_content_duplicates(spark, archive):
    content = headers.read_binary(spark, str(archive), "*.jp*")
    hashed = content.select("path", content_hash("content").alias("file_hash"))
    got = content_duplicates(hashed).collect()
    assert [r.copies for r in got] == [2]


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.ini").write_text("[Astrometry]\nRA = 10.5\ndec: -3\n[Other]\nradius=9\n")
    (tmp_path / "b.ini").write_text("[Nothing]\nra=1\n")
    (tmp_path / "c.ini").write_text("[Field]\nra=north\n")
    rows = sidecars.read_texts(spark, str(tmp_path), "*.ini").select(
        "path", sidecars.ini_solution("text").alias("s")
    )
    got = {os.path.basename(r.path): r.s for r in rows.collect()}
    assert (got["a.ini"].ra_center, got["a.ini"].dec_center, got["a.ini"].radius_degrees) == (10.5, -3.0, 0.0)
    assert got["b.ini"] is None and got["c.ini"] is None


def test_ratings(spark):
    texts = [
        ("<xmp:Rating>5</xmp:Rating>", 5), ('<r xmp:Rating="3"/>', 3), ("<Rating>0</Rating>", 0),
        ('<r exif:Rating="2"/>', 2), ("<xmp:Rating>9</xmp:Rating><Rating>4</Rating>", 4),
        ("<xmp:Rating>-1</xmp:Rating>", None), ("", None),
    ]
    df = spark.createDataFrame(texts, "t string, want int")
    for row in df.select("want", sidecars.xmp_rating("t").alias("got")).collect():
        assert row.got == row.want


def test_log_with_concurrency(spark, tmp_path):
    lines = ["concurrency: 2 (prefork)", "Task a.b.scan succeeded in 1.5s", "noise",
             "concurrency: 4 (prefork)", "succeeded in 2 s", "Task x.match succeeded in 3.0s: {}"]
    (tmp_path / "w.log").write_text("Task a.early succeeded in 9s\n" + "\n".join(lines))
    log = sidecars.log_events(sidecars.read_log(spark, str(tmp_path / "w.log")))
    assert [r.line for r in log.orderBy("block", "offset").collect()][1:] == lines
    carried = carry_forward(log, ["file"], "offset", F.col("block"), {"concurrency": "workers"})
    got = [(r.workers, r.task, r.seconds) for r in carried.filter("task IS NOT NULL").orderBy("offset").collect()]
    assert got == [(None, "early", 9.0), (2, "scan", 1.5), (4, "generic_task", 2.0), (4, "match", 3.0)]


def test_catalogue_files(spark, tmp_path):
    csv = tmp_path / "m.csv"
    csv.write_text(
        "id,alpha,delta,magnitude,diameter,axisRatio,posAngle,Common name,NGC/IC,PGC\n"
        "M1,83.6287,22.0147,8.4,6,0.67,,Crab Nebula,NGC 1952,\nM2,,1,,,,,,,\nMX,1,1,,,,,,,\nM3,205.5,28.4,6.2,18,,,,,\n"
    )
    details = tmp_path / "m.json"
    details.write_text(
        '[{"messier_number": 1, "designation": "M1", "type": "Supernova Remnant", "const": "Tau"},\n'
        ' {"messier_number": null, "designation": "M3", "common_name": "three", "const": "CVn"}]'
    )
    got = {
        r.designation: r
        for r in catalogs.load_messier(
            catalogs.read_messier_csv(spark, str(csv)), catalogs.read_messier_json(spark, str(details))
        ).collect()
    }
    assert set(got) == {"M1", "M3"}
    assert got["M1"].object_type == "Supernova Remnant" and got["M1"].common_name == "Crab Nebula"
    assert got["M3"].object_type == "Deep Sky Object" and got["M3"].common_name == "three"

    ngc = tmp_path / "n.csv"
    ngc.write_text(
        "Name;Type;RA;Dec;Const;MajAx;MinAx;PosAng;B-Mag;V-Mag;SurfBr;Hubble;Redshift;M;IC;Common names;OpenNGC notes\n"
        "NGC0224;G;00:42:44.35;+41:16:08.6;And;177.83;69.66;35;4.29;3.44;;Sb;;031;;Andromeda;\n"
        "IC 0010;G;00:20:17;;Cas;;;;;;;;;;;;\n"
    )
    rows = catalogs.load_ngc(catalogs.read_ngc_csv(spark, str(ngc)))
    by_name = {r.designation: r for r in rows.collect()}
    m31 = by_name["NGC0224"]
    assert (m31.ngc_number, m31.messier_designation, m31.apparent_magnitude) == (224, "M031", 3.44)
    assert m31.ra_degrees == pytest.approx(10.684792) and m31.dec_degrees == pytest.approx(41.269056, abs=1e-6)
    assert (by_name["IC0010"].ngc_number, by_name["IC0010"].dec_degrees) == (10, 0.0)
    again = catalogs.load_ngc(catalogs.read_ngc_csv(spark, str(ngc)), rows)
    assert again.count() == 0

    stars = tmp_path / "s.csv"
    stars.write_text(
        "id,alpha,delta,magnitude,HIP,HD,Common name,Spectral type\nHR 1,10,20,1.5, ,1,,A0\nHR 1,99,99,,,,,\n,1,1,,,,,\nHR 2,,,,,,Vega,\n"
    )
    got = {r.designation: r for r in catalogs.load_stars(catalogs.read_star_csv(spark, str(stars))).collect()}
    assert set(got) == {"HR 1", "HR 2"}
    assert got["HR 1"].ra_degrees == 10.0 and got["HR 1"].hip_id is None and got["HR 2"].ra_degrees == 0.0


def test_exports_write_and_read_back(spark, tmp_path):
    images = spark.createDataFrame(
        [(1, "a,b.fits", "/d/a,b.fits", 10.12345678, 0, dt.datetime(2024, 1, 2, 3, 4, 5))],
        "id long, file_name string, file_path string, ra_center_degrees double, rating long,"
        " capture_date timestamp_ntz",
    )
    found = spark.createDataFrame(
        [(1, "NGC2"), (1, "M1"), (1, "M1")], "image_id long, catalog_designation string"
    )
    full = exports.full_export(images, found)
    assert len(full.columns) == 44
    path = str(tmp_path / "csv")
    full.write.option("header", True).csv(path)
    row = spark.read.option("header", True).csv(path).first()
    assert row["File Name"] == "a,b.fits" and row["RA"] == "10.123457"
    assert row["Detected Objects"] == "M1, NGC2" and row["Capture Date"] == "2024-01-02T03:04:05"
    document = exports.metadata_documents(images).first().document
    assert '"rating":0' in document and '"rawHeaders":{}' in document and '"observer":null' in document
    lines = {r.field: r.value for r in exports.field_lines(images).collect()}
    assert lines["Rating"] == "" and lines["File Name"] == "a,b.fits" and len(lines) == 31


def test_annotations_and_folders(spark):
    disk = spark.createDataFrame(
        [("/m/a.fits",), ("/m/a_Annotated.fits",), ("/m/b.fits",), ("/m/b_Annotated.jpg",)], "path string"
    )
    pairs = [tuple(r) for r in files.annotation_pairs(disk).collect()]
    assert pairs == [("/m/a.fits", "/m/a_Annotated.fits")]
    images = spark.createDataFrame([("/m/x/1.fits",), ("/m/x/y/2.fits",), ("/m/3.fits",)], "file_path string")
    counts = {r.folder: r.image_count for r in files.folder_counts(images).collect()}
    assert counts == {"/m": 3, "/m/x": 2, "/m/x/y": 1}
    children = {r.folder: r.image_count for r in files.child_folder_counts(images, "/m").collect()}
    assert children == {"/m/x": 2}


def test_annotations_are_added_where_none_is_set(spark):
    names = ("a.fits", "a_Annotated.fits", "b.fits", "b_Annotated.fits", "c.fits", "c_Annotated.fits", "d.fits")
    inventory = spark.createDataFrame([(f"/d/{n}",) for n in names], "path string")
    known = [("/d/a.fits", None), ("/d/b.fits", "/d/other.fits"), ("/d/d.fits", None)]
    images = spark.createDataFrame(known, "file_path string, pixinsight_annotation_path string")
    assert {r.path for r in files.annotation_pairs(inventory).collect()} == {"/d/a.fits", "/d/b.fits", "/d/c.fits"}
    assert [tuple(r) for r in files.annotation_pairs(inventory, images).collect()] == [("/d/a.fits", "/d/a_Annotated.fits")]
