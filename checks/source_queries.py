"""Registered queries for the sources, exports and catalogue loads.

File sources read files that Spark writes from the driver's tables, or bytes and texts that Spark
derives from them, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.fixtures import duck, table, view
from checks.match_queries import DEPROJECT, matches, wcs_images
from checks.registry import Registry
from checks.search_queries import images
from skyframe.operators import stats
from skyframe.operators.filters import ImageFilter
from skyframe.operators.matches import wcs_choice
from skyframe.plans import ingest
from skyframe.session import scratch_path
from skyframe.sources import catalogs, exports, headers, sidecars

registry = Registry()


def key() -> Column:
    """Key of an order; made on demand, because columns need a running session."""
    return F.col("o_orderkey")


def write_csv(df: DataFrame, name: str, sep: str = ",") -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


# --- catalogue files ------------------------------------------------------------------------------


def messier_file(spark, sf_dir) -> str:
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("M"), p.cast("string")).alias("id"),
        F.when(p % 20 != 0, ((p * 7919) % 360).cast("string")).alias("alpha"),
        ((p * 104729) % 90).cast("string").alias("delta"),
        F.when(p % 6 != 0, F.col("p_size").cast("string")).alias("magnitude"),
        F.col("p_size").cast("string").alias("diameter"),
        F.lit("0.5").alias("axisRatio"),
        F.when(p % 5 == 0, "x").otherwise("90").alias("posAngle"),
        F.when(p % 4 != 0, F.concat("p_name", F.lit(", the"))).alias("Common name"),
        F.when(p % 3 == 0, F.concat(F.lit("NGC"), p.cast("string"))).alias("NGC/IC"),
        F.lit("PGC1").alias("PGC"),
    )
    return write_csv(rows, "messier-csv")


def messier_details(spark, sf_dir, listed: str = "p_partkey % 2 = 0") -> DataFrame:
    """Details of the ``listed`` objects, a third of them known by designation only.

    Loads take every other object, for the rows of the catalogue that have none.
    """
    p = F.col("p_partkey")
    path = scratch_path(spark, "messier-json")
    rows = table(spark, sf_dir, "part").filter(listed).select(
        F.when(p % 3 != 0, p.cast("int")).alias("messier_number"),
        F.concat(F.lit("M"), p.cast("string")).alias("designation"),
        F.concat(F.lit("json "), "p_name").alias("common_name"),
        F.lit("NGC-J").alias("ngc"), F.lit(1.5).alias("ra"), F.lit(2.5).alias("dec"),
        F.col("p_type").alias("type"), F.col("p_brand").alias("const"), F.lit(9.0).alias("mag"),
    )
    rows.select(F.to_json(F.array(F.struct(*rows.columns)))).write.text(path)
    return catalogs.read_messier_json(spark, path, multi_line=False)


@registry.query(
    "a3_messier_csv",
    "SELECT 'M' || p_partkey AS id, CASE WHEN p_partkey % 20 <> 0 THEN ((p_partkey * 7919) % 360)::varchar"
    " END AS alpha, CASE WHEN p_partkey % 4 <> 0 THEN p_name || ', the' END AS name, CASE WHEN"
    " p_partkey % 3 = 0 THEN 'NGC' || p_partkey END AS ngc FROM part",
)
def a3(spark, sf_dir):
    return catalogs.read_messier_csv(spark, messier_file(spark, sf_dir)).select(
        "id", "alpha", F.col("Common name").alias("name"), F.col("NGC/IC").alias("ngc")
    )


@registry.query(
    "a6_messier_json",
    "SELECT CASE WHEN p_partkey % 3 <> 0 THEN p_partkey::int END AS messier_number, 'M' || p_partkey"
    " AS designation, p_type AS type, p_brand AS const FROM part",
)
def a6(spark, sf_dir):
    return messier_details(spark, sf_dir, "true").select("messier_number", "designation", "type", "const")


_MESSIER = (
    "SELECT 'M' || p_partkey AS designation, p_partkey::int AS messier_number, CASE WHEN p_partkey % 4"
    " <> 0 THEN p_name || ', the' WHEN p_partkey % 2 = 0 THEN 'json ' || p_name END AS common_name,"
    " CASE WHEN p_partkey % 3 = 0 THEN 'NGC' || p_partkey WHEN p_partkey % 2 = 0 THEN 'NGC-J' END AS"
    " ngc_designation, ((p_partkey * 7919) % 360)::double AS ra_degrees, CASE WHEN p_partkey % 2 = 0"
    " THEN p_type ELSE 'Deep Sky Object' END AS object_type, CASE WHEN p_partkey % 2 = 0 THEN p_brand"
    " END AS constellation, CASE WHEN p_partkey % 6 <> 0 THEN p_size::double END AS"
    " apparent_magnitude, CASE WHEN p_partkey % 5 <> 0 THEN 90::double END AS position_angle"
    " FROM part WHERE p_partkey % 20 <> 0"
)
_MESSIER_COLUMNS = [
    "designation", "messier_number", "common_name", "ngc_designation", "ra_degrees", "object_type",
    "constellation", "apparent_magnitude", "position_angle",
]


@registry.query("k8_load_messier", _MESSIER)
def k8(spark, sf_dir):
    csv = catalogs.read_messier_csv(spark, messier_file(spark, sf_dir))
    return catalogs.load_messier(csv, messier_details(spark, sf_dir)).select(*_MESSIER_COLUMNS)


@registry.query(
    "e7_catalog_enrichment",
    "SELECT 'M' || p_partkey AS designation, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type"
    " FROM part",
)
def e7(spark, sf_dir):
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("M"), p.cast("string")).alias("designation"),
        p.cast("int").alias("messier_number"),
    )
    return catalogs.enrich_by_number(rows, messier_details(spark, sf_dir)).select(
        "designation", "_meta.type"
    )


@registry.query(
    "k8_upsert_catalog",
    f"WITH loaded AS ({_MESSIER}) SELECT designation, object_type FROM loaded UNION ALL SELECT 'M' ||"
    " p_partkey, 'old' FROM part WHERE p_partkey % 20 = 0",
)
def k8_upsert(spark, sf_dir):
    csv = catalogs.read_messier_csv(spark, messier_file(spark, sf_dir))
    loaded = catalogs.load_messier(csv, messier_details(spark, sf_dir))
    current = csv.select(F.col("id").alias("designation"), F.lit("old").alias("object_type"))
    return catalogs.upsert_catalog(current, loaded).select("designation", "object_type")


def ngc_file(spark, sf_dir) -> str:
    rows = view(spark, sf_dir, "catalog_raw").select(
        F.col("name").alias("Name"), F.col("obj_type").alias("Type"), F.col("ra_text").alias("RA"),
        F.col("dec_text").alias("Dec"), F.lit("And").alias("Const"),
        F.col("size").cast("string").alias("MajAx"), F.lit(None).cast("string").alias("MinAx"),
        F.lit("12.5").alias("PosAng"), F.col("b_mag").alias("B-Mag"), F.col("v_mag").alias("V-Mag"),
        F.lit("").alias("SurfBr"), F.lit("Sb").alias("Hubble"), F.lit("0.01").alias("Redshift"),
        F.col("messier").alias("M"), F.col("ic").alias("IC"),
        F.col("common_name").alias("Common names"), F.lit("note; more").alias("OpenNGC notes"),
    )
    return write_csv(rows, "ngc-csv", sep=";")


@registry.query(
    "a4_ngc_csv",
    duck("catalog_raw") + "SELECT name, nullif(ra_text, '') AS ra, nullif(v_mag, '') AS v,"
    " 'note; more' AS notes FROM catalog_raw",
)
def a4(spark, sf_dir):
    return catalogs.read_ngc_csv(spark, ngc_file(spark, sf_dir)).select(
        F.col("Name").alias("name"), F.nullif("RA", F.lit("")).alias("ra"),
        F.nullif("V-Mag", F.lit("")).alias("v"), F.col("OpenNGC notes").alias("notes"),
    )


@registry.query(
    "k9_load_ngc",
    duck("catalog_raw") + "SELECT replace(name, ' ', '') AS designation, CASE WHEN name LIKE '%A'"
    " THEN 0 ELSE line_no END::int AS ngc_number, CASE WHEN messier <> '' THEN 'M' || messier END AS"
    " messier_designation, CASE WHEN ic <> '' THEN 'IC' || replace(ic, ' ', '') END AS ic_designation,"
    " round_even(CASE WHEN line_no % 50 IN (3, 4) THEN 0 ELSE (line_no % 24 + (line_no % 60) / 60 +"
    " CASE WHEN line_no % 9 = 0 THEN 0 ELSE (line_no % 59 + 0.5::double) / 3600 END) * 15 END, 9) AS"
    " ra_degrees, coalesce(try_cast(v_mag AS double), try_cast(b_mag AS double)) AS"
    " apparent_magnitude, size::double AS major_axis_arcmin FROM catalog_raw WHERE line_no % 8 <> 0",
)
def k9(spark, sf_dir):
    """Every eighth object is in the catalogue already, written with its blank."""
    csv = catalogs.read_ngc_csv(spark, ngc_file(spark, sf_dir))
    raw = view(spark, sf_dir, "catalog_raw").filter("line_no % 8 = 0")
    existing = raw.select(F.col("name").alias("designation"))
    return catalogs.load_ngc(csv, existing).select(
        "designation", "ngc_number", "messier_designation", "ic_designation",
        F.bround("ra_degrees", 9).alias("ra_degrees"), "apparent_magnitude", "major_axis_arcmin",
    )


def star_rows(spark, sf_dir) -> DataFrame:
    """Star lines from ``lineitem``: four lines per designation on average."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.when(o % 50 != 0, F.concat(F.lit("HR "), o.cast("string"))).alias("id"),
        F.when(n % 3 != 0, F.col("l_partkey").cast("string")).alias("alpha"),
        F.col("l_suppkey").cast("string").alias("delta"),
        F.when(n % 2 == 0, F.col("l_quantity").cast("string")).alias("magnitude"),
        F.when(n % 4 == 0, " ").otherwise(o.cast("string")).alias("HIP"),
        F.lit("  ").alias("HD"),
        F.when(n % 2 == 1, "Vega").alias("Common name"),
        F.lit("A0").alias("Spectral type"),
    )


@registry.query(
    "a5_star_csv",
    "SELECT CASE WHEN l_orderkey % 50 <> 0 THEN 'HR ' || l_orderkey END AS id, CASE WHEN l_linenumber"
    " % 3 <> 0 THEN l_partkey::varchar END AS alpha, CASE WHEN l_linenumber % 2 = 1 THEN 'Vega' END"
    " AS name FROM lineitem",
)
def a5(spark, sf_dir):
    stars = catalogs.read_star_csv(spark, write_csv(star_rows(spark, sf_dir), "star-csv"))
    return stars.select("id", "alpha", F.col("Common name").alias("name"))


_FIRST_STAR = (
    "SELECT 'HR ' || l_orderkey AS designation, CASE WHEN n % 2 = 1 THEN 'Vega' END AS common_name,"
    " CASE WHEN n % 3 <> 0 THEN l_partkey ELSE 0 END::double AS ra_degrees, CASE WHEN n % 2 = 0 THEN"
    " l_quantity END AS magnitude, CASE WHEN n % 4 <> 0 THEN l_orderkey::varchar END AS hip_id,"
    " NULL::varchar AS hd_id FROM (SELECT *, l_linenumber AS n, row_number() OVER (PARTITION BY"
    " l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE"
    " rn = 1 AND l_orderkey % 50 <> 0"
)


@registry.query("k10_load_stars", _FIRST_STAR)
def k10(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = table(spark, sf_dir, "lineitem")
    rows = star_rows(spark, sf_dir).columns
    with_line = items.select(
        *[c.alias(n) for c, n in zip(_star_columns(), rows, strict=True)], order.alias("line_no")
    )
    return catalogs.load_stars(with_line).select(
        "designation", "common_name", "ra_degrees", "magnitude", "hip_id", "hd_id"
    )


def _star_columns() -> list:
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return [
        F.when(o % 50 != 0, F.concat(F.lit("HR "), o.cast("string"))),
        F.when(n % 3 != 0, F.col("l_partkey").cast("string")),
        F.col("l_suppkey").cast("string"),
        F.when(n % 2 == 0, F.col("l_quantity").cast("string")),
        F.when(n % 4 == 0, " ").otherwise(o.cast("string")),
        F.lit("  "),
        F.when(n % 2 == 1, "Vega"),
        F.lit("A0"),
    ]


@registry.query(
    "h9_first_of_duplicates",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY"
    " l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)"
    " WHERE rn = 1",
)
def h9(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn(
        "line_no", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    )
    return catalogs.first_of_duplicates(items, "l_orderkey", "line_no").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


# --- headers --------------------------------------------------------------------------------------


def _card(key: str, value) -> Column:
    return F.rpad(F.concat(F.rpad(F.lit(key), 8, " "), F.lit("= "), value), 80, " ")


def _header_block(*cards) -> Column:
    """Cards, END and padding to whole blocks."""
    text = F.concat(*cards, F.rpad(F.lit("END"), 80, " "))
    return F.rpad(text, (len(cards) + 36) // 36 * 2880, " ")


def fits_files(spark, sf_dir) -> DataFrame:
    """FITS bytes from orders; every fourth file has its header in the first extension."""
    own = [
        _card("EXPTIME", F.concat((key() % 600).cast("string"), F.lit(".5 / seconds"))),
        _card("OBJECT", F.lit("'O''Brien / 1'      / name")),
        _card("GAIN", F.lpad((key() % 300).cast("string"), 20, " ")),
        _card("CLEAR", F.lit("                   T")),
        F.rpad(F.lit("COMMENT first line"), 80, " "),
        F.rpad(F.lit("COMMENT second line"), 80, " "),
        F.rpad(F.lit("HIERARCH CAM MODE = 'fast'"), 80, " "),
        _card("GAIN", F.lit("999")),
        _card("EMPTY", F.lit("  / nothing")),
    ]
    size = [_card("NAXIS1", F.lit("8")), _card("NAXIS2", F.lit("4"))]
    start = [_card("SIMPLE", F.lit("T")), _card("BITPIX", F.lit("16")), _card("NAXIS", F.lit("2"))]
    plain = F.concat(_header_block(*start, *size, *own), F.rpad(F.lit("\x01"), 2880, "END"))
    short = _header_block(*start, *size)
    extension = _header_block(_card("XTENSION", F.lit("'IMAGE   '")), *start[1:2], *own, *own)
    stored = F.when(key() % 4 == 0, F.concat(short, F.rpad(F.lit(""), 2880, "x"), extension)).otherwise(
        plain
    )
    # Files are listed over many tasks; the table that stands for them is one small file.
    return headers.pinned(
        table(spark, sf_dir, "orders").repartition(16, "o_orderkey").select(
            "o_orderkey", F.concat(F.lit("/data/f"), key().cast("string"), F.lit(".fits")).alias("path")
        ),
        "content",
        F.encode(stored, "ISO-8859-1"),
    )


@registry.query(
    "a7_fits_headers",
    "SELECT '/data/f' || o_orderkey || '.fits' AS path, (o_orderkey % 600) || '.5' AS exptime,"
    " 'O''Brien / 1' AS object, (o_orderkey % 300)::varchar AS gain, 'T' AS clear, CASE WHEN"
    " o_orderkey % 4 = 0 THEN 'first line' || chr(10) || 'second line' || chr(10) || 'first line'"
    " || chr(10) || 'second line' ELSE 'first line' || chr(10) || 'second line' END AS comment,"
    " 'fast' AS mode, true AS has_empty, NULL::varchar AS empty FROM orders",
)
def a7(spark, sf_dir):
    h = F.col("raw_header")
    return headers.fits_headers(fits_files(spark, sf_dir)).select(
        "path", h["EXPTIME"].alias("exptime"), h["OBJECT"].alias("object"), h["GAIN"].alias("gain"),
        h["CLEAR"].alias("clear"), h["COMMENT"].alias("comment"), h["CAM MODE"].alias("mode"),
        F.map_contains_key(h, "EMPTY").alias("has_empty"), h["EMPTY"].alias("empty"),
    )


def xisf_files(spark, sf_dir) -> DataFrame:
    def keyword(name: str, value) -> list:
        return [F.lit(f'<FITSKeyword name="{name}" value="'), value, F.lit('" comment="c"/>')]

    xml = F.concat(
        F.lit('<xisf version="1.0" xmlns="http://www.pixinsight.com/xisf"><Image geometry="'),
        (key() % 4000).cast("string"), F.lit(':3000:1">'),
        *keyword("OBJECT", F.lit("'M 31 '")), *keyword("GAIN", (key() % 300).cast("string")),
        *keyword("HISTORY", F.lit("one")), *keyword("HISTORY", F.lit("two")),
        *keyword("FILTER", F.lit("'H&amp;a'")),
        F.lit('</Image><Image geometry="1:1:1">'), *keyword("GAIN", F.lit("5")),
        F.lit("</Image></xisf>"),
    )
    size = F.lpad(F.hex(F.length(xml)), 8, "0")
    swapped = F.unhex(F.concat(*[F.substring(size, i, 2) for i in (7, 5, 3, 1)]))
    stored = F.concat(
        F.encode(F.lit("XISF0100"), "UTF-8"), swapped, F.unhex(F.lit("00000000")),
        F.encode(xml, "UTF-8"), F.unhex(F.lit("FFFE")),
    )
    # Files are listed over many tasks; the table that stands for them is one small file.
    return headers.pinned(
        table(spark, sf_dir, "orders").repartition(16, "o_orderkey").select(
            "o_orderkey", F.concat(F.lit("/data/x"), key().cast("string"), F.lit(".xisf")).alias("path")
        ),
        "content",
        stored,
    )


@registry.query(
    "a8_xisf_headers",
    "SELECT '/data/x' || o_orderkey || '.xisf' AS path, (o_orderkey % 4000)::int AS width_pixels,"
    " 3000 AS height_pixels, 'M 31' AS object, (o_orderkey % 300)::varchar AS gain, 'one' || chr(10)"
    " || 'two' AS history, 'H&a' AS filter FROM orders",
)
def a8(spark, sf_dir):
    h = F.col("raw_header")
    return headers.xisf_headers(xisf_files(spark, sf_dir)).select(
        "path", "width_pixels", "height_pixels", h["OBJECT"].alias("object"),
        h["GAIN"].alias("gain"), h["HISTORY"].alias("history"), h["FILTER"].alias("filter"),
    )


@registry.query(
    "k1_canonical_header",
    duck("headers") + "SELECT id, CASE WHEN id % 4 = 0 THEN 3000 END AS width_pixels, (id % 600 +"
    " 0.5)::double AS exposure_time_seconds, make_timestamp(2024, 1 + id % 9, 10 + id % 10, 20 + id"
    " % 4, 30, CASE WHEN id % 6 = 0 THEN 59 ELSE 15 END::double) AS capture_date, CASE WHEN id % 8 <>"
    " 0 THEN (id % 300)::double END AS gain, CASE WHEN id % 3 = 0 THEN -10 ELSE -5 END::double AS"
    " temperature_celsius, 'CAM' || (id % 6) AS camera_name, CASE WHEN id % 5 <> 0 THEN 'F' || (id %"
    " 9) END AS filter_name FROM headers",
)
def k1(spark, sf_dir):
    maps = view(spark, sf_dir, "headers").select(
        "id", F.from_json("header_json", "map<string,string>").alias("raw_header")
    )
    return ingest.canonical_header(maps, "raw_header").select(
        "id", "width_pixels", "exposure_time_seconds", "capture_date", "gain",
        "temperature_celsius", "camera_name", "filter_name",
    )


_WCS_COLUMNS = ["ra_center", "dec_center", "radius_degrees", "pixel_scale", "rotation"]


def _rounded_wcs(df: DataFrame) -> DataFrame:
    return df.select(
        "id", *[F.bround(f"wcs.{c}", 6).alias(c) for c in _WCS_COLUMNS], "wcs.wcs_type"
    )


@registry.query(
    "k2_header_wcs_fallback",
    duck("headers") + "SELECT id, round_even((id % 24 + (id % 60) / 60 + 30.5::double / 3600) * 15, 6)"
    " AS ra_center, round_even(CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END * (id % 90 + (id % 60) / 60 +"
    " 15.0::double / 3600), 6) AS dec_center, round_even(CASE WHEN id % 8 = 0 THEN sqrt(3000.0 * 3000"
    " + 2000.0 * 2000) / 2 * 1.5 / 3600 ELSE 1 END::double, 6) AS radius_degrees, round_even(CASE"
    " WHEN id % 8 = 0 THEN 1.5 WHEN id % 8 = 1 THEN 3.76::double / 800 * 206.265 ELSE 0 END::double,"
    " 6) AS pixel_scale, 0.0::double AS rotation, 'HEADER_FALLBACK' AS wcs_type FROM headers",
)
def k2_fallback(spark, sf_dir):
    maps = view(spark, sf_dir, "headers").select(
        "id", F.from_json("header_json", "map<string,string>").alias("raw_header")
    )
    return _rounded_wcs(ingest.header_wcs(maps, "raw_header"))


_NUM = "json_extract_string(header_json, '$.{}')::double AS {}"
_WCS_ORACLE = (
    duck("wcs_headers") + ", n AS (SELECT id, " + ", ".join(
        _NUM.format(key, name)
        for key, name in (
            ("CRVAL1", "ra0"), ("CRVAL2", "dec0"), ("CRPIX1", "crpix1"), ("CRPIX2", "crpix2"),
            ("CROTA2", "crota"),
        )
    )
    + " FROM wcs_headers), m AS (SELECT *, CASE WHEN id % 4 = 0 THEN -0.0003 ELSE -0.0004 *"
    " cos(radians(crota)) END AS cd11, CASE WHEN id % 4 = 0 THEN 0.0001 ELSE -0.0004 *"
    " sin(radians(crota)) END AS cd12, CASE WHEN id % 4 = 0 THEN 0.0001 ELSE -0.0004 *"
    " sin(radians(crota)) END AS cd21, CASE WHEN id % 4 = 0 THEN 0.0003 ELSE 0.0004 *"
    " cos(radians(crota)) END AS cd22 FROM n), p AS (SELECT m.*, u, v, radians(cd11 * u + cd12 * v) AS"
    " xi, radians(cd21 * u + cd22 * v) AS eta, c FROM m, (VALUES (true, 1500, 1000), (false, 0, 0))"
    " q(c, x, y), LATERAL (SELECT x + 1 - crpix1 AS u, y + 1 - crpix2 AS v) uv WHERE id % 4 IN (0, 1)),"
    f" s AS (SELECT *, {DEPROJECT} FROM p), w AS (SELECT a.id, a.ra, a.dec, a.crota,"
    " degrees(2 * asin(sqrt(least(1.0::double, pow(sin(radians(b.dec - a.dec) / 2), 2) +"
    " cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) AS r"
    " FROM s a JOIN s b USING (id) WHERE a.c AND NOT b.c)"
    " SELECT id, round_even(ra, 6) AS ra_center, round_even(dec, 6) AS dec_center, round_even(r, 6) AS"
    " radius_degrees, round_even(CASE WHEN id % 4 = 0 THEN sqrt(0.0003::double * 0.0003 +"
    " 0.0001::double * 0.0001) ELSE 0.0004 END * 3600, 6) AS pixel_scale, round_even(CASE WHEN id % 4 ="
    " 0 THEN degrees(atan2(-0.0001, 0.0003)) ELSE crota END, 6) AS rotation, 'HEADER_WCS' AS wcs_type"
    " FROM w UNION ALL SELECT id, ra0, dec0, round_even(sqrt(3000.0::double * 3000 + 2000.0 * 2000) / 2"
    " * 1.5 / 3600, 6), 1.5, 15, 'HEADER_CRVAL' FROM n WHERE id % 4 = 2 UNION ALL SELECT id, id % 360 +"
    " 0.5, round_even(-(id % 90 + 0.5::double), 6), 1, 0, 0, 'HEADER_FALLBACK' FROM n WHERE id % 4 = 3"
)


@registry.query("k2_header_wcs", _WCS_ORACLE)
def k2(spark, sf_dir):
    return _rounded_wcs(ingest.header_wcs(wcs_images(spark, sf_dir), "raw_header"))


# --- sidecars -------------------------------------------------------------------------------------


def ini_files(spark, sf_dir) -> DataFrame:
    section = F.when(key() % 5 == 0, "[Other]").when(key() % 2 == 0, "[Astrometry]").otherwise("[Field]")
    text = F.concat_ws(
        "\n",
        F.when(key() % 6 == 0, F.lit("[Field]\nra = 1\ndec = 1")),
        section,
        F.concat(F.lit("RA = "), (key() % 360).cast("string"), F.lit(".25")),
        F.concat(F.lit("dec: "), F.when(key() % 7 == 0, "north").otherwise((key() % 90).cast("string"))),
        F.when(key() % 3 == 0, F.lit("pixscale=1.5")),
        F.lit("[Last]\nradius = 9"),
    )
    return table(spark, sf_dir, "orders").select(key().alias("id"), text.alias("text"))


@registry.query(
    "a9_ini_solution",
    "SELECT id, CASE WHEN kind = 'first' THEN 1 ELSE id % 360 + 0.25 END::double AS ra_center, CASE"
    " WHEN kind = 'first' THEN 1 ELSE id % 90 END::double AS dec_center, CASE WHEN kind <> 'first' AND"
    " id % 3 = 0 THEN 1.5 ELSE 0 END::double AS pixel_scale, 0::double AS radius_degrees FROM"
    " (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN"
    " 'first' ELSE 'none' END WHEN o_orderkey % 7 = 0 THEN 'none' ELSE 'own' END AS kind FROM orders)"
    " WHERE kind <> 'none'",
)
def a9(spark, sf_dir):
    solved = ini_files(spark, sf_dir).select("id", sidecars.ini_solution("text").alias("s"))
    return solved.filter("s IS NOT NULL").select(
        "id", "s.ra_center", "s.dec_center", "s.pixel_scale", "s.radius_degrees"
    )


@registry.query(
    "a10_choose_sidecar",
    duck("images") + "SELECT file_path AS path, regexp_replace(file_path, '\\.[^.]+$', '') || CASE"
    " WHEN id % 2 = 0 THEN '.wcs' WHEN id % 3 = 0 THEN '.new' ELSE '.ini' END AS sidecar_path"
    " FROM images WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0",
)
def a10(spark, sf_dir):
    table_ = images(spark, sf_dir)
    base = F.regexp_replace("file_path", r"\.[^.]+$", "")
    disk = table_.select(F.col("file_path").alias("path"))
    for step, ext in ((2, ".wcs"), (3, ".new"), (5, ".ini")):
        disk = disk.unionAll(
            table_.filter(F.col("id") % step == 0).select(F.concat(base, F.lit(ext)).alias("path"))
        )
    return sidecars.choose_sidecar(table_, disk, "file_path")


# --- solutions out of sidecars of every kind ---------------------------------------------------------


def _sidecar_path(ext: str) -> Column:
    return F.concat(F.lit("/data/s/f"), key().cast("string"), F.lit(ext))


def sidecar_archive(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Image headers, the inventory, and headers and texts of the sidecars beside every image.

    Each second image has a ``.wcs``, each third a ``.new`` and each fifth an ``.ini``; each eleventh
    has a WCS of its own, and each seventh sidecar header is of another projection.
    """
    orders = table(spark, sf_dir, "orders").repartition(16, "o_orderkey")
    number = lambda value: F.lpad(value.cast("string"), 20, " ")
    text = lambda value: F.rpad(F.concat(F.lit("'"), value, F.lit("'")), 20, " ")
    kind = F.when(key() % 7 == 0, "GLON-CAR").otherwise("RA---TAN")
    block = _header_block(
        _card("SIMPLE", number(F.lit("T"))), _card("BITPIX", number(F.lit(8))), _card("NAXIS", number(F.lit(0))),
        _card("NAXIS1", number(F.lit(4000))), _card("NAXIS2", number(F.lit(3000))),
        _card("CTYPE1", text(kind)), _card("CTYPE2", text(F.lit("DEC--TAN"))),
        _card("CRVAL1", number(key() % 360 + 0.5)), _card("CRVAL2", number(key() % 120 - 60)),
        _card("CRPIX1", number(2001 - key() % 5)), _card("CRPIX2", number(1501 - key() % 3)),
        *(_card(k, number(F.lit(v))) for k, v in (("CD1_1", -0.0004), ("CD1_2", 0.0001), ("CD2_1", 0.0001), ("CD2_2", 0.0004))),
        F.rpad(F.lit("COMMENT of the solver"), 80, " "),
    )
    ini = F.concat(F.lit("[Field]\nra="), (key() % 360).cast("string"), F.lit("\ndec=5\nradius=2.5\npixscale=1.5\n"))
    wide = orders.select(
        key().alias("id"),
        *(F.when(key() % n == 0, _sidecar_path(e)).alias(e[1:]) for n, e in ((2, ".wcs"), (3, ".new"), (5, ".ini"))),
        F.encode(block, "ISO-8859-1").alias("content"),
        ini.alias("text"),
    )
    wide = headers.pinned(wide, "pinned", F.col("content")).drop("content").withColumnRenamed("pinned", "content")
    inventory = wide.select(F.explode(F.array_compact(F.array("wcs", "new", "ini"))).alias("path"))
    cards = wide.select(F.explode(F.array_compact(F.array("wcs", "new"))).alias("path"), "content")
    texts = wide.where("ini IS NOT NULL").select(F.col("ini").alias("path"), "text")
    plain = F.create_map(F.lit("NAXIS1"), F.lit("100"), F.lit("NAXIS2"), F.lit("80"), F.lit("GAIN"), (key() % 300).cast("string"))
    solved = F.map_concat(plain, F.create_map(F.lit("RA"), F.lit("12.5"), F.lit("DEC"), F.lit("-3.5")))
    own = orders.select(key().alias("id"), _sidecar_path(".fits").alias("path"), F.when(key() % 11 == 0, solved).otherwise(plain).alias("raw_header"))
    return own, inventory, headers.fits_headers(cards), texts


def sidecar_images(spark, sf_dir) -> DataFrame:
    own, inventory, cards, texts = sidecar_archive(spark, sf_dir)
    chosen = sidecars.choose_sidecar(own, inventory)
    found = sidecars.sidecar_solutions(chosen, cards, texts)
    return ingest.header_images(own.join(found, "path", "left"), sidecar_col="sidecar")


_SIDECARS = """WITH kinds AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'wcs' WHEN o_orderkey % 3 = 0 THEN 'new'
  WHEN o_orderkey % 5 = 0 THEN 'ini' END AS kind, o_orderkey % 11 = 0 AS own FROM orders
), angles AS (
  SELECT *, radians(-0.0004 * (id % 5) + 0.0001 * (id % 3)) AS xi, radians(0.0001 * (id % 5) + 0.0004 * (id % 3)) AS eta,
    id % 360 + 0.5 AS ra0, radians(id % 120 - 60) AS dec0, NOT own AND kind IN ('wcs', 'new') AND id % 7 <> 0 AS by_wcs,
    NOT own AND kind = 'ini' AS by_ini
  FROM kinds
)"""


@registry.query(
    "k2_sidecar_solutions",
    _SIDECARS + """ SELECT id, '/data/s/f' || id || '.' || kind AS sidecar_path,
  CASE WHEN own THEN 'HEADER' WHEN by_wcs OR by_ini THEN 'SIDECAR' END AS source, own OR coalesce(by_wcs OR by_ini, false) AS solved,
  round_even(CASE WHEN own THEN 12.5 WHEN by_ini THEN id % 360
    WHEN by_wcs THEN (ra0 + degrees(atan2(xi, cos(dec0) - eta * sin(dec0))) + 360) % 360 END::double, 6) AS ra_center,
  round_even(CASE WHEN own THEN -3.5 WHEN by_ini THEN 5
    WHEN by_wcs THEN degrees(atan2(sin(dec0) + eta * cos(dec0), sqrt(xi * xi + pow(cos(dec0) - eta * sin(dec0), 2)))) END::double, 6) AS dec_center,
  CASE WHEN by_ini THEN 2.5 WHEN own THEN 1.0 END::double AS radius, CASE WHEN by_ini THEN 1.5 WHEN by_wcs OR own THEN 0 END::double AS pixel_scale
FROM angles""",
)
def k2_sidecars(spark, sf_dir):
    return sidecar_images(spark, sf_dir).select(
        "id", "sidecar_path", F.col("plate_solve_source").alias("source"), F.col("is_plate_solved").alias("solved"),
        F.bround("ra_center_degrees", 6).alias("ra_center"), F.bround("dec_center_degrees", 6).alias("dec_center"),
        F.col("field_radius_degrees").alias("radius"), F.col("pixel_scale_arcsec").alias("pixel_scale"),
    )


@registry.query(
    "d10_sidecar_wcs",
    _SIDECARS + """ SELECT id, CASE WHEN by_wcs THEN 'SOLVER_HEADER' WHEN own OR by_ini THEN 'COLUMNS' END AS origin,
  CASE WHEN by_wcs THEN ra0 WHEN own THEN 12.5 WHEN by_ini THEN id % 360 END::double AS ra0,
  CASE WHEN by_wcs THEN 2001 - id % 5 WHEN own OR by_ini THEN 50 END::double AS crpix1 FROM angles""",
)
def d10_sidecars(spark, sf_dir):
    """The header of a sidecar is what overlays of its image are drawn with."""
    rows = sidecar_images(spark, sf_dir).withColumns({"rotation_degrees": F.coalesce("rotation_degrees", F.lit(0.0)), "parity": F.lit(1)})
    wcs = rows.select("id", wcs_choice(rows).alias("wcs"))
    return wcs.select("id", "wcs.origin", "wcs.ra0", "wcs.crpix1")


@registry.query(
    "a11_xmp_ratings",
    duck("images") + "SELECT file_path AS path, (CASE WHEN id % 3 = 0 AND id % 7 <= 5 THEN id % 7 ELSE"
    " 4 END)::int AS rating FROM images WHERE (id % 3 = 0 AND id % 7 <= 5) OR id % 2 = 0",
)
def a11(spark, sf_dir):
    """Every third image has a ``x.ext.xmp`` in one of four forms, every second an ``x.xmp``."""
    table_ = images(spark, sf_dir)
    stars = (F.col("id") % 7).cast("string")
    text = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("<xmp:Rating>"), stars, F.lit("</xmp:Rating>")))
        .when(F.col("id") % 4 == 1, F.concat(F.lit('<a xmp:Rating="'), stars, F.lit('"/>')))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("<Rating>"), stars, F.lit("</Rating>")))
        .otherwise(F.concat(F.lit('<a exif:Rating="'), stars, F.lit('"/>')))
    )
    lightroom = table_.filter("id % 3 = 0").select(
        F.concat("file_path", F.lit(".xmp")).alias("path"), text.alias("text")
    )
    plain = table_.filter("id % 2 = 0").select(
        F.concat(F.regexp_replace("file_path", r"\.[^.]+$", ""), F.lit(".xmp")).alias("path"),
        F.lit("<x><xmp:Rating>9</xmp:Rating><Rating>4</Rating></x>").alias("text"),
    )
    return sidecars.sidecar_ratings(
        table_.select(F.col("file_path").alias("path")), lightroom.unionAll(plain)
    )


def log_lines(spark, sf_dir) -> DataFrame:
    """Worker logs, one file per load level; sign-ups announce a new concurrency."""
    e, seconds = F.col("event_id"), F.col("value").cast("string")
    line = (
        F.when(
            F.col("event_type") == "signup",
            F.concat(F.lit("- ** concurrency: "), (e % 8 + 1).cast("string"), F.lit(" (prefork)")),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit("Task archive.scan[x] succeeded in "), seconds, F.lit("s: ok")),
        )
        .when(F.col("event_type") == "click", F.concat(F.lit("succeeded in  "), seconds, F.lit(" s")))
        .otherwise("Task archive.bulk failed")
    )
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("file"), e.alias("offset"), line.alias("line")
    )


_LOG = (
    "WITH log AS (SELECT user_id % 5 AS file, event_id AS \"offset\", CASE WHEN event_type = 'signup'"
    " THEN (event_id % 8 + 1)::int END AS concurrency, CASE event_type WHEN 'view' THEN 'scan' WHEN"
    " 'click' THEN 'generic_task' END AS task, CASE WHEN event_type IN ('view', 'click') THEN value"
    " END AS seconds FROM events)"
)


@registry.query("a12_worker_log", _LOG + " SELECT * FROM log")
def a12(spark, sf_dir):
    return sidecars.log_events(log_lines(spark, sf_dir)).drop("line")


@registry.query(
    "f20_worker_log_summary",
    _LOG + ", c AS (SELECT *, last_value(concurrency IGNORE NULLS) OVER (PARTITION BY file ORDER BY"
    " \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS workers FROM log) SELECT"
    " workers, task, count(*) AS n, round_even(avg(seconds), 9) AS mean_s, median(seconds) AS median_s,"
    " coalesce(round_even(60 / avg(seconds) * workers, 4), 0) AS tasks_per_minute FROM c WHERE task IS NOT NULL"
    " GROUP BY 1, 2",
)
def f20_log(spark, sf_dir):
    events = sidecars.log_events(log_lines(spark, sf_dir))
    block = F.floor(F.col("offset") / 5000)
    carried = stats.carry_forward(events, ["file"], "offset", block, {"concurrency": "workers"})
    # Tasks before the first announcement are a group of their own, with workers unknown.
    tasks = carried.filter("task IS NOT NULL")
    return stats.duration_summary(tasks, ["workers", "task"], "seconds", "workers").select(
        "workers", "task", "n", F.bround("mean_s", 9).alias("mean_s"), "median_s",
        F.bround("tasks_per_minute", 4).alias("tasks_per_minute"),
    )


def exif_tags(spark, sf_dir) -> DataFrame:
    values = {
        "EXIF ExposureTime": F.concat((key() % 50).cast("string"), F.lit("/"), (key() % 4).cast("string")),
        "EXIF ISOSpeedRatings": (key() % 6400).cast("string"),
        "EXIF DateTimeOriginal": F.when(key() % 3 != 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")),
        "Image DateTime": F.lit("2020:02:03 04:05:06"),
        "Image Make": F.lit(" Canon "),
        "Image Model": F.when(key() % 2 == 0, "EOS Ra "),
        "EXIF FNumber": F.lit("28/10"),
        "EXIF FocalLengthIn35mmFilm": F.lit("50 mm"),
        "EXIF Flash": (key() % 32).cast("string"),
        "EXIF Rating": (key() % 8).cast("string"),
        "Thumbnail Width": F.lit("1"),
    }
    tags = F.array(
        *[F.struct(F.lit(k).alias("tag"), v.alias("value")) for k, v in values.items()]
    )
    return (
        table(spark, sf_dir, "orders")
        .select(key().cast("string").alias("path"), F.inline(tags))
        .filter("value IS NOT NULL")
    )


@registry.query(
    "k3_exif_images",
    "SELECT k::varchar AS path, CASE WHEN k % 4 <> 0 THEN (k % 50) / (k % 4) END AS"
    " exposure_time_seconds, (k % 6400)::int AS iso_speed, (k % 6400)::double AS gain, CASE WHEN k % 3"
    " <> 0 THEN d ELSE TIMESTAMP '2020-02-03 04:05:06' END AS capture_date, CASE WHEN k % 2 = 0 THEN"
    " 'Canon EOS Ra' ELSE 'Canon' END AS camera_name, 2.8::double AS aperture, 50::double AS"
    " focal_length_35mm, k % 2 = 1 AS flash_fired, CASE WHEN k % 5 = 0 THEN 1 WHEN k % 7 = 0 THEN 2"
    " WHEN k % 8 <= 5 THEN k % 8 END::int AS rating FROM (SELECT o_orderkey AS k, o_orderdate AS d"
    " FROM orders)",
)
def k3(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = key().cast("string").alias("path")
    sidecar = orders.filter(key() % 5 == 0).select(path, F.lit(1).alias("rating"))
    embedded = orders.filter(key() % 7 == 0).select(path, F.lit(2).alias("rating"))
    return ingest.exif_images(exif_tags(spark, sf_dir), sidecar, embedded).select(
        "path", "exposure_time_seconds", "iso_speed", "gain", "capture_date", "camera_name",
        "aperture", "focal_length_35mm", "flash_fired", "rating",
    )


# --- exports --------------------------------------------------------------------------------------

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


_NO_TEXT = ("Hash", "Solve Provider", "Binning", "White Balance", "Metering", "Lens", "Observer", "Site", "Submission ID", "Job ID", "Indexed At")
_NOTHING = ("Aperture", "Focal Length", "35mm Equiv", "Flash", "Site Lat", "Site Lon")
_EXPORTED = {
    "ID": "id", "File Name": "file_name", "File Path": "file_path", "Format": "file_format", "Size (Bytes)": "file_size_bytes",
    "Width": "width_pixels", "Height": "height_pixels", "Subtype": "subtype", "Plate Solved": "is_plate_solved",
    "Solve Source": "coalesce(plate_solve_source, '')", "RA": "round_even(ra_center_degrees, 6)", "Dec": "round_even(dec_center_degrees, 6)",
    "Field Radius": "round_even(field_radius_degrees, 4)", "Pixel Scale": "round_even(pixel_scale_arcsec, 4)",
    "Rotation": "round_even(rotation_degrees, 3)", "Exposure (s)": "exposure_time_seconds",
    "Capture Date": f"coalesce({_ISO.format('capture_date')}, '')", "Camera": "coalesce(camera_name, '')",
    "Telescope": "coalesce(telescope_name, '')", "Filter": "coalesce(filter_name, '')", "Gain": "gain", "Rating": "rating",
    "Manual Rating": "rating_manually_edited", "Object (Header)": "coalesce(object_name, '')", "Astrometry Status": "astrometry_status",
    "Updated At": f"coalesce({_ISO.format('updated_at')}, '')", "Detected Objects": "coalesce(d, '')",
} | {t: "''" for t in _NO_TEXT} | {t: "NULL::varchar" for t in _NOTHING}
_FOUND = (
    ", found AS (SELECT image_id, array_to_string(list_sort(list_distinct(list("
    "catalog_designation))), ', ') AS d FROM matches GROUP BY 1)"
)


@registry.query(
    "a13_full_export",
    duck("matches") + _FOUND + " SELECT " + ", ".join(f'{sql} AS "{title}"' for title, sql in _EXPORTED.items())
    + " FROM images LEFT JOIN found ON image_id = id",
)
def a13(spark, sf_dir):
    return exports.full_export(images(spark, sf_dir), matches(spark, sf_dir))


@registry.query(
    "a13_filtered_lines",
    duck("matches") + _FOUND + " SELECT id::varchar AS id, file_path, is_plate_solved::varchar AS solved, coalesce(rating::varchar, '') AS rating,"
    " coalesce(camera_name, '') AS camera, coalesce(d, '') AS objects FROM images LEFT JOIN found ON image_id = id"
    " WHERE rating >= 3 AND file_format IN ('FITS', 'FIT')",
)
def a13_lines(spark, sf_dir):
    """The export of filtered images, written sorted as text and read as CSV with its titles."""
    path = scratch_path(spark, "export")
    flt = ImageFilter(rating=3, format="FITS")
    exports.write_export(exports.export_lines(images(spark, sf_dir), matches(spark, sf_dir), flt, "rating"), path)
    titles = [title for title, *_ in exports.FULL_EXPORT] + ["Detected Objects"]
    rows = spark.read.csv(path, schema=", ".join(f"`{t}` string" for t in titles), escape='"')
    text = lambda title: F.coalesce(F.col(f"`{title}`"), F.lit(""))
    return rows.where("ID <> 'ID'").select(
        F.col("ID").alias("id"), F.col("`File Path`").alias("file_path"), F.lower(text("Plate Solved")).alias("solved"),
        text("Rating").alias("rating"), text("Camera").alias("camera"), text("Detected Objects").alias("objects"),
    )


@registry.query(
    "a14_narrow_export",
    duck("images") + "SELECT file_name AS \"File Name\", file_format AS \"Format\", object_name AS \"Object\", camera_name"
    " AS \"Camera\", telescope_name AS \"Telescope\", filter_name AS \"Filter\", nullif(exposure_time_seconds, 0) AS"
    " \"Exposure (s)\", nullif(gain, 0) AS \"Gain\", CASE WHEN id % 8 = 1 THEN 100 * (id % 16) END AS \"ISO\","
    " CASE WHEN is_plate_solved THEN 'Yes' ELSE 'No' END AS \"Plate Solved\", nullif(ra_center_degrees, 0) AS \"RA\","
    f" nullif(dec_center_degrees, 0) AS \"Dec\", {_ISO.format('capture_date')} AS \"Capture Date\", nullif(rating, 0) AS"
    " \"Rating\", subtype AS \"Classification\" FROM images WHERE id % 4 = 1",
)
def a14(spark, sf_dir):
    """A selection of the images is what this export takes; all 15 columns are compared."""
    table_ = images(spark, sf_dir).withColumn("iso_speed", F.expr("CASE WHEN id % 8 = 1 THEN 100 * (id % 16) END"))
    return exports.narrow_export(table_, table_.filter("id % 4 = 1"))


#: Fields of the documents that the images have a column for, with the type and the column; the others are null.
_DOCUMENT_FIELDS = {
    "file": (
        ("name", "string", "file_name"), ("format", "string", "file_format"), ("size", "bigint", "file_size_bytes"),
        ("path", "string", "file_path"), ("created", "string", None), ("modified", "string", _ISO.format("file_last_modified")),
        ("hash", "string", None), ("indexed", "string", None), ("updated", "string", _ISO.format("updated_at")),
        ("sidecar", "string", None),
    ),
    "observation": (
        ("object", "string", "object_name"), ("observer", "string", None), ("site", "string", None),
        ("captureDate", "string", _ISO.format("capture_date")),
    ),
    "plateSolving": (
        ("solved", "boolean", "is_plate_solved"), ("provider", "string", None), ("ra", "double", "ra_center_degrees"),
        ("dec", "double", "dec_center_degrees"), ("fieldOfView", "double", "field_radius_degrees"),
        ("pixelScale", "double", "pixel_scale_arcsec"), ("rotation", "double", "rotation_degrees"),
    ),
    "exposure": (
        ("exposureTime", "double", "exposure_time_seconds"), ("gain", "double", "gain"), ("iso", "string", None),
        ("binning", "string", None), ("temperature", "string", None), ("filter", "string", "filter_name"),
    ),
    "equipment": (
        ("camera", "string", "camera_name"), ("telescope", "string", "telescope_name"), ("focalLength", "string", None),
        ("aperture", "string", None),
    ),
    "classification": (("rating", "bigint", "rating"), ("subtype", "string", "subtype")),
}


@registry.query(
    "a15_json_documents",
    duck("images")
    + "SELECT id, 7 AS sections, "
    + ", ".join(
        f"{column or 'NULL::varchar'} AS {section}_{field}, 1 AS has_{section}_{field}"
        for section, fields in _DOCUMENT_FIELDS.items()
        for field, _, column in fields
    )
    + " FROM images",
)
def a15(spark, sf_dir):
    """All 33 fields, and that each is there even if it is null."""
    shape = ", ".join(
        f"{section}: struct<{', '.join(f'{field}: {kind}' for field, kind, _ in fields)}>"
        for section, fields in _DOCUMENT_FIELDS.items()
    )
    documents = exports.metadata_documents(images(spark, sf_dir)).select(
        "id", "document", F.from_json("document", f"struct<{shape}>").alias("d"),
        F.from_json("document", "map<string,string>").alias("texts"),
    )
    here = lambda section, field: F.array_contains(F.json_object_keys(F.col("texts")[section]), field).cast("int")
    return documents.select(
        "id",
        F.size(F.json_object_keys("document")).alias("sections"),
        *[
            c
            for section, fields in _DOCUMENT_FIELDS.items()
            for field, *_ in fields
            for c in (
                F.col(f"d.{section}.{field}").alias(f"{section}_{field}"),
                here(section, field).alias(f"has_{section}_{field}"),
            )
        ],
    )


_NUMBER_LINE = "coalesce(nullif({}, 0)::varchar, '')"
_LINES = (
    ("File Name", "file_name"), ("File Format", "file_format"), ("File Size (MB)", "printf('%.2f', file_size_bytes / 1048576)"),
    ("File Path", "file_path"), ("File Created", "''"), ("File Modified", f"coalesce({_ISO.format('file_last_modified')}, '')"),
    ("Indexed At", "''"), ("Last Updated", _ISO.format("updated_at")), ("Object Name", "coalesce(object_name, '')"),
    ("Observer", "''"), ("Site", "''"), ("Capture Date", f"coalesce({_ISO.format('capture_date')}, '')"),
    ("Plate Solved", "CASE WHEN is_plate_solved THEN 'Yes' ELSE 'No' END"), ("Plate Solve Provider", "''"),
    ("Right Ascension", _NUMBER_LINE.format("ra_center_degrees")), ("Declination", _NUMBER_LINE.format("dec_center_degrees")),
    ("Field of View", _NUMBER_LINE.format("field_radius_degrees")), ("Pixel Scale", _NUMBER_LINE.format("pixel_scale_arcsec")),
    ("Rotation", _NUMBER_LINE.format("rotation_degrees")), ("Exposure Time (s)", _NUMBER_LINE.format("exposure_time_seconds")),
    ("Gain", _NUMBER_LINE.format("gain")), ("ISO", "''"), ("Binning", "''"), ("Temperature (°C)", "''"),
    ("Filter", "coalesce(filter_name, '')"), ("Camera", "coalesce(camera_name, '')"), ("Telescope", "coalesce(telescope_name, '')"),
    ("Focal Length (mm)", "''"), ("Aperture (f/)", "''"), ("Rating", _NUMBER_LINE.format("rating")), ("Classification", "subtype"),
)


@registry.query(
    "a16_field_lines",
    duck("images")
    + f"SELECT id, unnest(range(1, {len(_LINES) + 1}))::integer AS line,"
    + f" unnest([{', '.join(repr(title) for title, _ in _LINES)}]) AS field,"
    + f" unnest([{', '.join(value for _, value in _LINES)}]) AS \"value\" FROM images",
)
def a16(spark, sf_dir):
    """All 31 lines of every image, in their order."""
    return exports.field_lines(images(spark, sf_dir)).select("id", "line", "field", "value")
