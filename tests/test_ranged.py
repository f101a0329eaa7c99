"""Header reads by byte ranges, and solutions out of sidecar files of every kind."""

import os

import pytest

from skyframe.operators.matches import wcs_choice
from skyframe.plans import ingest
from skyframe.sources import headers, ranged, sidecars


def card(text):
    return text.ljust(80).encode()


def fits(*cards, data=b"", few=False):
    filler = [] if few else [f"KEY{k:05}=                    {k}" for k in range(12)]
    block = b"".join(map(card, ("SIMPLE  =                    T", *filler, *cards, "END")))
    return block.ljust(-(-len(block) // 2880) * 2880) + data


def test_what_is_read_does_not_depend_on_the_pixels(spark, tmp_path):
    """A large image, one whose header lies behind its pixels, a long header, a text file."""
    pixels = b"\x07" * 20_000_000
    size = ("BITPIX  =                    8", "NAXIS   =                    1", f"NAXIS1  = {len(pixels):20}")
    padded = pixels + b"\x00" * (-len(pixels) % 2880)
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "large.fits").write_bytes(fits(*size, "GAIN    =                    1", data=pixels))
    (tmp_path / "deep" / "behind.FIT").write_bytes(fits(*size, few=True, data=padded + fits("GAIN    =                    2")))
    (tmp_path / "deep" / "er" / "long.fits").write_bytes(fits(*[f"LONG{k:04}=                    {k}" for k in range(900)]))
    (tmp_path / "other.fits").write_bytes(b"no header" * 100_000)
    (tmp_path / "notes.txt").write_text("SIMPLE  = T")
    got = {os.path.basename(r.path): r for r in ranged.load_fits_headers(spark, str(tmp_path), filesPerTask=2).collect()}
    assert set(got) == {"large.fits", "behind.FIT", "long.fits", "other.fits"}
    assert got["large.fits"].raw_header["GAIN"] == "1" and got["behind.FIT"].raw_header["GAIN"] == "2"
    assert got["long.fits"].raw_header["LONG0899"] == "899" and got["other.fits"].error == "not a FITS file"
    assert got["large.fits"].bytes_read <= ranged.RANGE_BYTES and got["other.fits"].bytes_read <= ranged.RANGE_BYTES
    assert got["behind.FIT"].bytes_read <= 2 * ranged.RANGE_BYTES
    assert got["long.fits"].bytes_read <= 900 * 80 + 2 * ranged.RANGE_BYTES
    assert got["large.fits"].size > len(pixels) and got["large.fits"].mtime is not None
    # Files of a task are planned beforehand, and the same headers come from an inventory of paths or URIs.
    assert len(ranged.FitsHeaderReader({"path": str(tmp_path), "filesPerTask": "3"}).partitions()) == 2
    inventory = spark.createDataFrame([("file://" + r.path,) for r in got.values()], "path string")
    for r in headers.read_fits_headers(inventory).collect():
        assert r.raw_header == got[os.path.basename(r.path)].raw_header


@pytest.mark.parametrize("path", ["file:/a/b", "file:///a/b", "/a/b"])
def test_paths_and_uris(path):
    assert ranged.resolved(path)[1] == "/a/b"


def test_an_empty_folder_and_a_single_file(spark, tmp_path):
    assert ranged.load_fits_headers(spark, str(tmp_path)).count() == 0
    (tmp_path / "a.fits").write_bytes(fits())
    assert ranged.load_fits_headers(spark, str(tmp_path / "a.fits")).first().raw_header["KEY00011"] == "11"


WCS = ("NAXIS   =                    0", "IMAGEW  =                 4000", "CTYPE1  = 'RA---TAN-SIP'", "CTYPE2  = 'DEC--TAN-SIP'",
       "CRVAL1  =                 83.5", "CRVAL2  =                 -5.5", "CD1_1   =              -0.0004", "CD2_2   =               0.0004",
       "A_2_0   =              1.0E-06", "HISTORY of the solver")


def test_sidecars_are_read_and_reach_the_overlay(spark, tmp_path):
    """The first kind that is there counts, also if it gives no solution; a header's own WCS counts before all."""
    files = {
        "a.wcs": fits(*WCS), "a.ini": b"[Field]\nra=1\ndec=2\n", "b.new": fits(*WCS), "c.ini": b"[Astrometry]\nra=1\ndec=2\nradius=3\n",
        "d.wcs": b"damaged", "d.ini": b"[Field]\nra=1\ndec=2\n", "e.wcs": fits("CTYPE1  = 'GLON-CAR'"), "own.wcs": fits(*WCS),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    names = ("a", "b", "c", "d", "e", "own", "none")
    plain, own = {"NAXIS1": "4000", "NAXIS2": "3000"}, {"NAXIS1": "4000", "NAXIS2": "3000", "RA": "7.0", "DEC": "8.0"}
    images = spark.createDataFrame([(f"{tmp_path}/{n}.fits", own if n == "own" else plain) for n in names], "path string, raw_header map<string,string>")
    inventory = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in files], "path string")
    found = sidecars.read_sidecars(images, inventory)
    rows = ingest.header_images(images.join(found, "path", "left"), sidecar_col="sidecar")
    rows = rows.selectExpr("*", "1 AS parity")
    got = {os.path.basename(r.path)[:-5]: r for r in rows.withColumn("wcs", wcs_choice(rows)).collect()}
    source = {n: r.plate_solve_source for n, r in got.items()}
    assert source == {"a": "SIDECAR", "b": "SIDECAR", "c": "SIDECAR", "d": None, "e": None, "own": "HEADER", "none": None}
    assert got["a"].ra_center_degrees == pytest.approx(83.5, abs=1e-3) and got["a"].pixel_scale_arcsec == 0.0
    assert got["c"].field_radius_degrees == 3 and got["c"].wcs_header is None and got["own"].wcs_header is None
    assert got["a"].wcs_header["A_2_0"] == "1.0E-06" and "HISTORY" not in got["a"].wcs_header
    assert (got["a"].wcs.origin, got["a"].wcs.ra0, got["b"].wcs.origin) == ("SOLVER_HEADER", 83.5, "SOLVER_HEADER")
    assert got["d"].wcs is None and got["d"].is_plate_solved is False
