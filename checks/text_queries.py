"""Registered queries for section J."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck, table, view
from checks.registry import Registry
from checks.stats_queries import CANONICAL_CTE
from skyframe.functions import text

registry = Registry()


def header(spark, sf_dir):
    return view(spark, sf_dir, "headers").select(
        "id", F.from_json("header_json", "map<string,string>").alias("h")
    )


_G = "json_extract_string(header_json, '$.{}')"


@registry.query(
    "j1_safe_numbers",
    duck("headers") + f"SELECT id, try_cast({_G.format('GAIN')} AS double) AS gain,"
    f" cast(trunc(try_cast({_G.format('EXPTIME')} AS double)) AS int) AS whole_seconds,"
    f" try_cast({_G.format('INSTRUME')} AS double) AS not_a_number FROM headers",
)
def j1(spark, sf_dir):
    return header(spark, sf_dir).select(
        "id",
        text.to_float(F.col("h")["GAIN"]).alias("gain"),
        text.to_int(F.col("h")["EXPTIME"]).alias("whole_seconds"),
        text.to_float(F.col("h")["INSTRUME"]).alias("not_a_number"),
    )


@registry.query(
    "j2_sexagesimal",
    "SELECT o_orderkey AS id, round_even((o_orderkey % 24 + (o_orderkey % 60) / 60 + 30.5::double /"
    " 3600) * 15, 9) AS ra, round_even(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END *"
    " (o_orderkey % 90 + (o_orderkey % 60) / 60 + 15.0::double / 3600), 9) AS dec FROM orders",
)
def j2(spark, sf_dir):
    return header(spark, sf_dir).select(
        "id",
        F.bround(text.sexagesimal(F.col("h")["OBJCTRA"], hours=True), 9).alias("ra"),
        F.bround(text.sexagesimal(F.col("h")["OBJCTDEC"]), 9).alias("dec"),
    )


@registry.query(
    "j3_catalog_coordinates",
    "SELECT p_partkey AS line_no, round_even(CASE WHEN p_partkey % 50 IN (3, 4) THEN 0 ELSE"
    " (p_partkey % 24 + (p_partkey % 60) / 60 + CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE"
    " (p_partkey % 59 + 0.5::double) / 3600 END) * 15 END, 9) AS ra,"
    " round_even(CASE WHEN p_partkey % 50 = 5 THEN 0 ELSE CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1"
    " END * (p_partkey % 90 + (p_partkey % 60) / 60 + (p_partkey % 59)::double / 3600) END, 9)"
    " AS dec FROM part",
)
def j3(spark, sf_dir):
    return view(spark, sf_dir, "catalog_raw").select(
        "line_no",
        F.bround(text.catalog_ra("ra_text"), 9).alias("ra"),
        F.bround(text.catalog_dec("dec_text"), 9).alias("dec"),
    )


_PARTS = (
    ", p AS (SELECT id, ra_center_degrees AS ra, dec_center_degrees AS dec, ra_center_degrees / 15"
    " AS hours, abs(dec_center_degrees) AS a FROM images), q AS (SELECT *, floor(hours) AS h,"
    " floor((hours - floor(hours)) * 60) AS hm, floor(a) AS d, floor((a - floor(a)) * 60) AS dm"
    " FROM p), r AS (SELECT *, ((hours - h) * 60 - hm) * 60 AS hs, ((a - d) * 60 - dm) * 60 AS ds"
    " FROM q)"
)


@registry.query(
    "j4_coordinate_text",
    duck("images") + _PARTS + " SELECT id,"
    " printf('%02dh %02dm %05.2fs, %s%02d° %02d'' %04.1f\"', h::bigint, hm::bigint, hs,"
    " CASE WHEN dec >= 0 THEN '+' ELSE '-' END, d::bigint, dm::bigint, ds) AS full_text,"
    " CASE WHEN ra IS NULL THEN '--' ELSE printf('%02d:%02d:%04.1f', h::bigint, hm::bigint, hs) END"
    " AS ra_text, CASE WHEN dec IS NULL THEN '--' ELSE printf('%s%d° %d'' %.1f\"', CASE WHEN dec >="
    " 0 THEN '+' ELSE '-' END, d::bigint, dm::bigint, ds) END AS dec_text, CASE WHEN ra IS NULL THEN"
    " '' ELSE printf('%02d:%02d', h::bigint, floor((hours - h) * 60 + 0.5)::bigint) END AS ra_short"
    " FROM r",
)
def j4(spark, sf_dir):
    ra, dec = "ra_center_degrees", "dec_center_degrees"
    return view(spark, sf_dir, "images").select(
        "id",
        text.coordinates_display(ra, dec).alias("full_text"),
        text.ra_clock(ra).alias("ra_text"),
        text.dec_display(dec).alias("dec_text"),
        text.ra_hours_minutes(ra).alias("ra_short"),
    )


@registry.query(
    "j5_clock_to_degrees",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round_even((CASE WHEN"
    " o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 24 END + (o_orderkey % 60) / 60) * 15, 9) END AS"
    " degrees FROM orders",
)
def j5(spark, sf_dir):
    k = F.col("o_orderkey")
    hours = F.when(k % 11 == 0, "x").otherwise((k % 24).cast("string"))
    clock = F.when(k % 7 == 0, "").otherwise(F.concat(hours, F.lit(":"), (k % 60).cast("string")))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.bround(text.clock_to_degrees(clock), 9).alias("degrees")
    )


@registry.query(
    "j6_filter_names", duck("images") + CANONICAL_CTE + " SELECT id, filter_name, name FROM named"
)
def j6(spark, sf_dir):
    return view(spark, sf_dir, "images").select(
        "id", "filter_name", text.canonical_filter("filter_name").alias("name")
    )


@registry.query(
    "j7_header_dates",
    "SELECT o_orderkey AS id, make_timestamp(2024, 1 + o_orderkey % 9, 10 + o_orderkey % 10,"
    " 20 + o_orderkey % 4, 30, CASE WHEN o_orderkey % 6 = 0 THEN 59 ELSE 15 END::double) AS iso,"
    " CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE date_trunc('day', o_orderdate)::timestamp END AS"
    " other FROM orders",
)
def j7(spark, sf_dir):
    day = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy/MM/dd"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "MMM d yyyy"))
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), text.header_date(written).alias("other")
    )
    return orders.join(
        header(spark, sf_dir).select("id", text.header_date(F.col("h")["DATE-OBS"]).alias("iso")), "id"
    )


@registry.query(
    "j8_exif_dates",
    "SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END AS taken"
    " FROM events",
)
def j8(spark, sf_dir):
    layout = F.when(
        F.col("event_id") % 9 != 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    ).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), text.exif_date(layout).alias("taken")
    )


@registry.query(
    "j9_rationals",
    "SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey /"
    " (l_linenumber % 3) END AS ratio, l_quantity / 10 AS plain FROM lineitem",
)
def j9(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    fraction = F.concat_ws("/", "l_orderkey", (F.col("l_linenumber") % 3).cast("string"))
    return items.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("n"),
        text.ratio_text(fraction).alias("ratio"),
        text.ratio_text((F.col("l_quantity") / 10).cast("string")).alias("plain"),
    )


@registry.query(
    "j10_flash_bit", "SELECT o_orderkey AS id, o_orderkey % 2 = 1 AS fired FROM orders"
)
def j10(spark, sf_dir):
    tag = F.concat(F.col("o_orderkey").cast("string"), F.lit(" auto"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), text.low_bit(tag).alias("fired")
    )


@registry.query(
    "j11_strip_nul",
    "SELECT o_orderkey AS id, 'KEY' AS key, o_orderpriority AS \"value\" FROM orders",
)
def j11(spark, sf_dir):
    dirty = F.create_map(
        F.lit("K\x00EY"), F.concat(F.lit("\x00"), "o_orderpriority", F.lit("\\u0000"))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.explode(text.strip_nul_map(dirty)).alias("key", "value")
    )


@registry.query(
    "j12_designation_number",
    duck("catalog_raw") + "SELECT line_no, name, replace(name, ' ', '') AS plain, CASE WHEN"
    " name LIKE '%A' THEN 0 ELSE line_no END::int AS number FROM catalog_raw",
)
def j12(spark, sf_dir):
    return view(spark, sf_dir, "catalog_raw").select(
        "line_no",
        "name",
        text.without_blanks("name").alias("plain"),
        text.designation_number("name").alias("number"),
    )


@registry.query(
    "j13_plain_designation",
    duck("catalog_raw") + "SELECT line_no, replace(name, ' ', '') AS designation FROM catalog_raw",
)
def j13(spark, sf_dir):
    return view(spark, sf_dir, "catalog_raw").select("line_no", text.without_blanks("name").alias("designation"))


@registry.query(
    "j14_angular_size",
    "SELECT p_partkey AS id, CASE WHEN p_size = 0 THEN 'Unknown' WHEN p_size % 7 = 0 THEN"
    " printf('%.1f''', p_size / 3) ELSE printf('%.1f'' × %.1f''', p_size / 3, (p_size % 7)::double)"
    " END AS size_text FROM part",
)
def j14(spark, sf_dir):
    minor = (F.col("p_size") % 7).cast("double")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        text.angular_size_display(F.col("p_size") / 3, minor).alias("size_text"),
    )


_SHORT = "regexp_replace(regexp_replace(printf('%.2f', {}), '0+$', ''), '\\.$', '')"


@registry.query(
    "j15_size_and_duration",
    duck("images") + "SELECT id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN "
    + _SHORT.format("b") + " || ' B' WHEN b < 1048576 THEN " + _SHORT.format("b / 1024")
    + " || ' KB' WHEN b < 1073741824 THEN " + _SHORT.format("b / 1048576") + " || ' MB' ELSE "
    + _SHORT.format("b / 1073741824") + " || ' GB' END AS size_text, CASE WHEN e IS NULL THEN 'N/A'"
    " WHEN e < 1 THEN printf('%.0fms', e * 1000) WHEN e < 60 THEN printf('%.1fs', e) WHEN e < 3600"
    " THEN floor(e / 60)::int || 'm ' || (e - floor(e / 60) * 60)::int || 's' ELSE"
    " floor(e / 3600)::int || 'h ' || floor((e % 3600) / 60)::int || 'm' END AS duration_text"
    " FROM (SELECT id, (file_size_bytes * (id % 3) // 3)::double AS b, floor(exposure_time_seconds"
    " * (1 + id % 40))::double AS e FROM images)",
)
def j15(spark, sf_dir):
    size = F.floor(F.col("file_size_bytes") * (F.col("id") % 3) / 3)
    seconds = F.floor(F.col("exposure_time_seconds") * (1 + F.col("id") % 40)).cast("double")
    return view(spark, sf_dir, "images").select(
        "id",
        text.bytes_display(size).alias("size_text"),
        text.exposure_display(seconds).alias("duration_text"),
    )


@registry.query(
    "j16_thumbnail_name",
    duck("images") + "SELECT id, md5(file_path)[:8] AS hash, regexp_replace(file_name, '\\.[^.]+$',"
    " '') || '_' || md5(file_path)[:8] || '_thumb.jpg' AS thumb FROM images",
)
def j16(spark, sf_dir):
    return view(spark, sf_dir, "images").select(
        "id",
        text.path_hash("file_path").alias("hash"),
        text.thumbnail_name("file_path").alias("thumb"),
    )


@registry.query(
    "j17_parent_folder",
    duck("images") + "SELECT id, CASE WHEN id % 2 = 0 THEN f ELSE replace(f, '/', '\\') END AS folder"
    " FROM (SELECT id, file_path[:length(file_path) - length(file_name) - 1] AS f FROM images)",
)
def j17(spark, sf_dir):
    path = F.when(F.col("id") % 2 == 0, F.col("file_path")).otherwise(
        F.replace("file_path", F.lit("/"), F.lit("\\"))
    )
    return view(spark, sf_dir, "images").select("id", text.parent_folder(path).alias("folder"))


@registry.query(
    "j18_subtype_label",
    duck("images") + "SELECT id, CASE subtype WHEN 'SUB_FRAME' THEN 'Sub Frame' WHEN"
    " 'INTEGRATION_MASTER' THEN 'Integration Master' WHEN 'PLANETARY' THEN 'Planetary' ELSE"
    " 'Unclassified' END AS label FROM images",
)
def j18(spark, sf_dir):
    shown = F.when(F.col("subtype") != "INTEGRATION_DEPRECATED", F.col("subtype"))
    return view(spark, sf_dir, "images").select("id", text.subtype_label(shown).alias("label"))


@registry.query(
    "j19_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents"
)
def j19(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.content_hash(F.encode("text", "UTF-8")).alias("file_hash")
    )


@registry.query(
    "j20_safe_path",
    duck("images") + "SELECT id, (starts_with(p, '/data/mount1') OR starts_with(p, '/data/mount3'))"
    " AND NOT contains(p, '..') AS safe FROM (SELECT id, CASE WHEN id % 5 = 0 THEN file_path ||"
    " '/../x' ELSE file_path END AS p FROM images)",
)
def j20(spark, sf_dir):
    path = F.when(F.col("id") % 5 == 0, F.concat("file_path", F.lit("/../x"))).otherwise(
        F.col("file_path")
    )
    return view(spark, sf_dir, "images").select(
        "id", text.is_safe_path(path, ["/data/mount1", "/data/mount3"]).alias("safe")
    )
