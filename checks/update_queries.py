"""Registered queries for sections C, K4, K6, K7, K11-K13, E8-E13, L and M."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.fixtures import duck, table, view
from checks.registry import Registry
from checks.search_queries import images
from skyframe.functions.text import content_hash
from skyframe.operators import crossmatch, pixels, quality, updates
from skyframe.operators.filters import ImageFilter
from skyframe.plans import ingest
from skyframe.sources import files

registry = Registry()


@registry.query(
    "c1_reclassify",
    duck("images") + "SELECT id, CASE WHEN s THEN 'PLANETARY' ELSE subtype END AS subtype,"
    " s AS selected, s AND subtype <> 'PLANETARY' AS changed FROM (SELECT *, coalesce(camera_name"
    " ILIKE '%zwo%' AND rating >= 2, false) AS s FROM images)",
)
def c1(spark, sf_dir):
    flt = ImageFilter(camera="zwo", rating=2)
    return updates.reclassify(images(spark, sf_dir), flt, "PLANETARY").select(
        "id", "subtype", "selected", "changed"
    )


@registry.query(
    "c1_reclassify_report",
    duck("images") + "SELECT count(*) AS updated_count, count(*) FILTER (subtype <> 'PLANETARY') AS"
    " changed_count FROM images WHERE dec_center_degrees BETWEEN -91 AND -84 AND degrees(2 *"
    " asin(sqrt(least(1.0, pow(sin(radians(dec_center_degrees + 89) / 2), 2) +"
    " cos(radians(dec_center_degrees)) * cos(radians(-89)) * pow(sin(radians(ra_center_degrees - 20)"
    " / 2), 2))))) <= 5 + 1e-9",
)
def c1_report(spark, sf_dir):
    flt = ImageFilter(ra=20, dec=-89, radius=5)
    return updates.reclassify_report(
        updates.reclassify(images(spark, sf_dir), flt, "PLANETARY")
    )


@registry.query(
    "c2_reclassify_by_path",
    duck("images") + "SELECT id, CASE WHEN file_path LIKE '%/data/mount3/Planetary%' THEN 'PLANETARY'"
    " WHEN file_path LIKE '/data/mount2/%' THEN 'INTEGRATION_MASTER' ELSE subtype END AS subtype"
    " FROM images",
)
def c2(spark, sf_dir):
    return updates.reclassify_by_path(images(spark, sf_dir)).select("id", "subtype")


@registry.query(
    "c3_patch",
    duck("images") + "SELECT id, CASE WHEN id % 8 = 0 AND id % 16 = 0 THEN 5 ELSE rating END AS"
    " rating, CASE WHEN id % 8 = 0 THEN 'SUB_FRAME' ELSE subtype END AS subtype, CASE WHEN id % 8 ="
    " 0 THEN true ELSE rating_manually_edited END AS rating_manually_edited FROM images",
)
def c3(spark, sf_dir):
    table_ = images(spark, sf_dir)
    changes = table_.filter("id % 8 = 0").select(
        "id",
        F.when(F.col("id") % 16 == 0, F.lit(5).cast("long")).alias("rating"),
        F.lit("SUB_FRAME").alias("subtype"),
        F.lit(True).alias("rating_manually_edited"),
    )
    return updates.patch_images(table_, changes).select(
        "id", "rating", "subtype", "rating_manually_edited"
    )


@registry.query(
    "c4_solver_results",
    duck("images", "headers", "solver_results") + "SELECT i.id, CASE WHEN s.id IS NOT NULL THEN s.ra"
    " ELSE ra_center_degrees END AS ra_center_degrees, CASE WHEN s.id IS NOT NULL THEN s.radius ELSE"
    " field_radius_degrees END AS field_radius_degrees, CASE WHEN s.id IS NOT NULL THEN s.orientation"
    " ELSE rotation_degrees END AS rotation_degrees, is_plate_solved OR s.id IS NOT NULL AS"
    " is_plate_solved, CASE WHEN s.id IS NOT NULL THEN 'SOLVED' ELSE astrometry_status END AS"
    " astrometry_status, CASE WHEN s.id IS NOT NULL THEN 'SOLVER' ELSE plate_solve_source END AS"
    " plate_solve_source, s.parity::varchar AS header_parity, 'http://solver/status/' ||"
    " s.submission_id AS astrometry_url, json_extract_string(header_json, '$.INSTRUME') AS camera"
    " FROM images i JOIN headers USING (id) LEFT JOIN solver_results s ON s.id = i.id",
)
def c4(spark, sf_dir):
    headers = view(spark, sf_dir, "headers").select(
        "id", F.from_json("header_json", "map<string,string>").alias("raw_header")
    )
    solved = updates.apply_solver_results(
        images(spark, sf_dir).join(headers, "id"),
        view(spark, sf_dir, "solver_results"),
        "http://solver/status/",
    )
    return solved.select(
        "id", "ra_center_degrees", "field_radius_degrees", "rotation_degrees", "is_plate_solved",
        "astrometry_status", "plate_solve_source",
        F.try_element_at("raw_header", F.lit("astrometry_parity")).alias("header_parity"),
        "astrometry_url", F.col("raw_header")["INSTRUME"].alias("camera"),
    )


@registry.query(
    "c5_normalise_designations",
    duck("matches") + "SELECT DISTINCT image_id, catalog_type, replace(catalog_designation, ' ', '')"
    " AS catalog_designation FROM matches",
)
def c5(spark, sf_dir):
    """Every match twice, with and without blanks; they merge into one."""
    key = ["image_id", "catalog_type", "catalog_designation"]
    found = crossmatch.field_match(view(spark, sf_dir, "images"), view(spark, sf_dir, "catalog"), cap=50, keep_cells=True)
    kept = [c for c in (*crossmatch.CELL_KEYS, "_spread") if c in found.columns]
    # Both forms of a match come from the task that found it; a union would find all matches twice.
    both = F.explode(F.array("catalog_designation", F.regexp_replace("catalog_designation", " ", "")))
    found = found.select(*key[:2], both.alias("catalog_designation"), *kept)
    return updates.normalise_designations(found, "catalog_designation", key)


@registry.query(
    "c6_expire_stuck",
    duck("images") + "SELECT id, CASE WHEN e THEN 'FAILED' ELSE astrometry_status END AS"
    " astrometry_status, e AS expired FROM (SELECT *, astrometry_status IN ('SUBMITTED',"
    " 'PROCESSING') AND updated_at < TIMESTAMP '1996-06-01 00:30:00' - to_minutes(5) AS e"
    " FROM images)",
)
def c6(spark, sf_dir):
    return updates.expire_stuck(images(spark, sf_dir), dt.datetime(1996, 6, 1, 0, 30)).select(
        "id", "astrometry_status", "expired"
    )


@registry.query(
    "c7_ratings_to_flush",
    duck("images") + "SELECT id, file_path AS path, rating, contains('<xmp:Rating>' || rating ||"
    " '</xmp:Rating>', rating::varchar) AS written FROM images WHERE rating_manually_edited AND"
    " rating IS NOT NULL",
)
def c7(spark, sf_dir):
    from skyframe.sources.sidecars import xmp_rating

    flushed = updates.ratings_to_flush(images(spark, sf_dir))
    return flushed.select(
        "id", "path", "rating", (xmp_rating("document") == F.col("rating")).alias("written")
    )


@registry.query(
    "c7_mark_flushed",
    duck("images") + "SELECT id, false AS rating_manually_edited, CASE WHEN rating_manually_edited"
    " THEN TIMESTAMP '2025-01-02 03:04:05' END AS rating_flushed_at FROM images",
)
def c7_mark(spark, sf_dir):
    return updates.mark_flushed(images(spark, sf_dir), dt.datetime(2025, 1, 2, 3, 4, 5)).select(
        "id", "rating_manually_edited", "rating_flushed_at"
    )


# --- files --------------------------------------------------------------------------------------

_IS_IMAGE = "regexp_matches(lower(path), '\\.(fits|fit|xisf|jpe?g|png|cr2|tiff?)$')"
_ANNOTATED = "regexp_matches(path, '_Annotated\\.[^.]+$')"


@registry.query(
    "a1_image_files",
    duck("inventory") + "SELECT path, size, mtime, upper(regexp_extract(path, '\\.([^./]+)$', 1)) AS"
    f" file_format FROM inventory WHERE {_IS_IMAGE}",
)
def a1(spark, sf_dir):
    return files.image_files(view(spark, sf_dir, "inventory"))


@registry.query(
    "a2_file_format",
    duck("inventory") + "SELECT path, CASE WHEN path LIKE '%.txt' THEN 'JPG' ELSE"
    " upper(regexp_extract(path, '\\.([^./]+)$', 1)) END AS file_format FROM inventory",
)
def a2(spark, sf_dir):
    return view(spark, sf_dir, "inventory").select(
        "path", files.file_format("path").alias("file_format")
    )


@registry.query(
    "e8_new_files",
    duck("inventory") + f"SELECT path, size, mtime FROM inventory WHERE {_IS_IMAGE} AND NOT"
    f" {_ANNOTATED} AND path NOT IN (SELECT file_path FROM images)",
)
def e8(spark, sf_dir):
    return files.new_files(view(spark, sf_dir, "inventory"), images(spark, sf_dir))


@registry.query(
    "e9_vanished_files",
    duck("inventory") + "SELECT id, file_path FROM images WHERE starts_with(file_path, '/data') AND"
    " file_path NOT IN (SELECT path FROM inventory)",
)
def e9(spark, sf_dir):
    inventory = view(spark, sf_dir, "inventory")
    return files.vanished_files(images(spark, sf_dir), inventory, "/data").select(
        "id", "file_path"
    )


@registry.query(
    "e10_annotation_pairs",
    duck("inventory") + "SELECT a.path, b.path AS annotation_path FROM inventory a JOIN inventory b"
    " ON b.path = regexp_replace(a.path, '(\\.[^./]+)$', '_Annotated\\1') WHERE"
    f" NOT regexp_matches(a.path, '_Annotated\\.[^.]+$') AND {_IS_IMAGE.replace('path', 'a.path')}",
)
def e10(spark, sf_dir):
    return files.annotation_pairs(view(spark, sf_dir, "inventory"))


@registry.query(
    "e12_shared_values",
    duck("images") + "SELECT id, thumbnail_path FROM images WHERE thumbnail_path IN (SELECT"
    " thumbnail_path FROM images WHERE thumbnail_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1)",
)
def e12(spark, sf_dir):
    return quality.shared_value_rows(images(spark, sf_dir), "thumbnail_path").select(
        "id", "thumbnail_path"
    )


@registry.query(
    "e13_folder_counts",
    duck("images") + "SELECT folder, count(*) AS image_count FROM (SELECT unnest(['/data',"
    " '/data/mount' || (id % 3 + 1), '/data/mount' || (id % 3 + 1) || CASE WHEN id % 7 = 0 THEN"
    " '/Planetary' ELSE '/DeepSky' END]) AS folder FROM images) GROUP BY 1",
)
def e13(spark, sf_dir):
    return files.folder_counts(images(spark, sf_dir))


@registry.query(
    "e13_child_folders",
    duck("images") + "SELECT '/data/mount2/' || split_part(file_path, '/', 4) AS folder, count(*) AS"
    " image_count FROM images WHERE starts_with(file_path, '/data/mount2/') GROUP BY 1",
)
def e13_child(spark, sf_dir):
    return files.child_folder_counts(images(spark, sf_dir), "/data/mount2")


@registry.query(
    "k12_fill_file_dates",
    duck("inventory") + "SELECT id, coalesce(file_last_modified, mtime) AS file_last_modified FROM"
    " images LEFT JOIN inventory ON path = file_path",
)
def k12(spark, sf_dir):
    inventory = view(spark, sf_dir, "inventory")
    return files.fill_file_dates(images(spark, sf_dir), inventory).select(
        "id", "file_last_modified"
    )


@registry.query(
    "k13_scan_report",
    duck("inventory") + "SELECT '/data' AS directory, (SELECT count(*) FROM inventory WHERE"
    f" {_IS_IMAGE}) AS files_found, (SELECT count(*) FROM inventory WHERE {_IS_IMAGE} AND NOT"
    f" {_ANNOTATED} AND path NOT IN (SELECT file_path FROM images)) AS files_queued, (SELECT count(*)"
    " FROM images WHERE file_path NOT IN (SELECT path FROM inventory)) AS files_removed",
)
def k13(spark, sf_dir):
    return files.scan_report(view(spark, sf_dir, "inventory"), images(spark, sf_dir), "/data")


@registry.query(
    "l1_content_duplicates",
    "SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id::varchar) AS first_path"
    " FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def l1(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select(
        content_hash(F.encode("text", "UTF-8")).alias("file_hash"),
        F.col("doc_id").cast("string").alias("path"),
    )
    return quality.content_duplicates(hashed)


# --- ingest -------------------------------------------------------------------------------------


_UPSERTED = [
    "id", "file_path", "file_name", "file_size_bytes", "subtype", "is_plate_solved",
    "plate_solve_source", "ra_center_degrees", "dec_center_degrees", "rotation_degrees",
    "width_pixels", "capture_date", "rating", "thumbnail_path", "astrometry_status",
]


def _upsert_sql() -> str:
    def sol(c: str) -> str:
        return (
            f"CASE WHEN n.file_path IS NOT NULL AND i.astrometry_status <> 'SOLVED' THEN n.{c}"
            f" ELSE i.{c} END AS {c}"
        )

    def plain(c: str, new: str | None = None) -> str:
        return f"CASE WHEN n.file_path IS NOT NULL THEN {new or 'n.' + c} ELSE i.{c} END AS {c}"

    date = "coalesce(n.capture_date, n.file_last_modified)"
    updated = [
        "i.id", "i.file_path", "i.file_name", plain("file_size_bytes"), "i.subtype",
        sol("is_plate_solved"), sol("plate_solve_source"), sol("ra_center_degrees"),
        sol("dec_center_degrees"), sol("rotation_degrees"), plain("width_pixels"),
        plain("capture_date", date), plain("rating"),
        "coalesce(n.thumbnail_path, i.thumbnail_path) AS thumbnail_path", "i.astrometry_status",
    ]
    added = [
        "('0x' || substr(md5(file_path), 1, 15))::BIGINT", "file_path", "file_name", "file_size_bytes",
        "subtype", "is_plate_solved",
        "plate_solve_source", "ra_center_degrees", "dec_center_degrees", "rotation_degrees",
        "width_pixels", "coalesce(capture_date, file_last_modified)", "rating", "thumbnail_path",
        "'NONE'",
    ]
    return (
        f"SELECT {', '.join(updated)} FROM images i LEFT JOIN incoming_images n USING (file_path)"
        f" UNION ALL SELECT {', '.join(added)} FROM incoming_images WHERE file_path NOT IN"
        " (SELECT file_path FROM images)"
    )


@registry.query("k4_upsert_images", duck("images", "incoming_images") + _upsert_sql())
def k4(spark, sf_dir):
    incoming = view(spark, sf_dir, "incoming_images")
    return ingest.upsert_images(images(spark, sf_dir), incoming).select(*_UPSERTED)


_QUEUE = (
    "CASE WHEN subtype = 'PLANETARY' THEN 'SKIPPED' WHEN is_plate_solved AND astrometry_status <>"
    " 'SOLVED' THEN CASE WHEN {busy} THEN 'SKIPPED' ELSE 'PRIORITY' END WHEN {retry} THEN 'STANDARD'"
    " ELSE 'SKIPPED' END"
)


def _queue_query(name: str, force: bool) -> None:
    busy = "false" if force else "astrometry_status IN ('SUBMITTED', 'PROCESSING')"
    retry = (
        "true"
        if force
        else "(NOT is_plate_solved AND astrometry_status NOT IN ('SUBMITTED', 'PROCESSING',"
        " 'SOLVED')) OR astrometry_status = 'FAILED'"
    )

    def build(spark, sf_dir):
        return ingest.solve_queue(images(spark, sf_dir), "/data/mount", force).select(
            "id", "queue"
        )

    sql = f"SELECT id, {_QUEUE.format(busy=busy, retry=retry)} AS queue FROM images"
    registry.add(name, build, duck("images") + sql)


_queue_query("k6_solve_queue", False)
_queue_query("k6_solve_queue_forced", True)


@registry.query(
    "k6_work_list",
    duck("images") + "SELECT id, queue FROM (SELECT id, file_path, "
    + _QUEUE.format(busy="astrometry_status IN ('SUBMITTED', 'PROCESSING')",
                    retry="(NOT is_plate_solved AND astrometry_status NOT IN ('SUBMITTED',"
                    " 'PROCESSING', 'SOLVED')) OR astrometry_status = 'FAILED'")
    + " AS queue FROM images) WHERE queue <> 'SKIPPED' AND starts_with(file_path, '/data/mount1')",
)
def k6_list(spark, sf_dir):
    return ingest.work_list(images(spark, sf_dir), "/data/mount1").select("id", "queue")


@registry.query(
    "k7_solver_hints",
    duck("images") + "SELECT id, CASE WHEN p THEN ra_center_degrees END AS center_ra, CASE WHEN p THEN"
    " coalesce(nullif(field_radius_degrees, 0), 5.0) END AS radius, round_even(CASE WHEN"
    " astrometry_status <> 'FAILED' THEN pixel_scale_arcsec * 0.9 END, 9) AS scale_lower,"
    " round_even(CASE WHEN astrometry_status <> 'FAILED' THEN pixel_scale_arcsec * 1.1 END, 9) AS"
    " scale_upper FROM (SELECT *, astrometry_status <> 'FAILED' AND ra_center_degrees IS NOT NULL AS"
    " p FROM images)",
)
def k7(spark, sf_dir):
    return ingest.solver_hints(images(spark, sf_dir)).select(
        "id", "hints.center_ra", "hints.radius",
        F.bround("hints.scale_lower", 9).alias("scale_lower"),
        F.bround("hints.scale_upper", 9).alias("scale_upper"),
    )


@registry.query(
    "k11_backfill",
    duck("images") + "SELECT id, CASE WHEN l AND coalesce(gain, 0) = 0 THEN 77 ELSE gain END AS gain,"
    " CASE WHEN l AND exposure_time_seconds IS NULL AND id % 2 = 1 THEN 30 ELSE"
    " exposure_time_seconds END AS exposure_time_seconds, CASE WHEN l AND camera_name IS NULL THEN"
    " 'Found' ELSE camera_name END AS camera_name FROM (SELECT *, exposure_time_seconds IS NULL OR"
    " camera_name IS NULL AS l FROM images)",
)
def k11(spark, sf_dir):
    table_ = images(spark, sf_dir)
    extracted = table_.select(
        "file_path",
        F.lit(77.0).alias("gain"),
        # Even ids offer zero, which is no value.
        (F.col("id") % 2 * 30).cast("double").alias("exposure_time_seconds"),
        F.lit("Found").alias("camera_name"),
    )
    return ingest.backfill(
        table_, extracted, ["gain", "exposure_time_seconds", "camera_name"]
    ).select("id", "gain", "exposure_time_seconds", "camera_name")


# --- pixels -------------------------------------------------------------------------------------

_STRETCH = (
    ", n AS (SELECT *, (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0)"
    " AS v FROM pixels WINDOW w AS (PARTITION BY image_id)), m AS (SELECT image_id, median(v) AS med"
    " FROM n GROUP BY 1), d AS (SELECT image_id, any_value(med) AS med, median(abs(v - med)) AS mad"
    " FROM n JOIN m USING (image_id) GROUP BY 1), c AS (SELECT *, greatest(0, med - 1.25::double *"
    " mad) AS c0 FROM d), t AS (SELECT n.*, (greatest(v, c0) - c0) / (1 - c0) AS t FROM n JOIN c"
    " USING (image_id)), x AS (SELECT image_id, median(t) AS x FROM t GROUP BY 1), b AS (SELECT"
    " image_id, CASE WHEN x > 0 AND x < 1 AND x <> 0.25 THEN x * 0.75::double / (x + 0.25::double -"
    " 2 * x * 0.25::double) ELSE 0.5 END AS m FROM x) SELECT image_id, pixel_ix, level, count(*) AS"
    " pixel_count FROM (SELECT image_id, pixel_ix, cast(trunc(greatest(0, least(1, CASE WHEN m = 0.5"
    " THEN t ELSE (m - 1) * t / ((2 * m - 1) * t - m) END)) * 255) AS int) AS level FROM t JOIN b"
    " USING (image_id)) GROUP BY ALL"
)


@registry.query("m1_auto_stretch", duck("pixels") + _STRETCH)
def m1(spark, sf_dir):
    return (
        pixels.stretch(view(spark, sf_dir, "pixels"))
        .groupBy("image_id", "pixel_ix", "level")
        .agg(F.count(F.lit(1)).alias("pixel_count"))
    )


@registry.query(
    "m2_linear_stretch",
    duck("pixels") + "SELECT image_id, level, count(*) AS pixel_count FROM (SELECT image_id,"
    " cast(trunc((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 255) AS int)"
    " AS level FROM pixels WINDOW w AS (PARTITION BY image_id)) GROUP BY 1, 2",
)
def m2(spark, sf_dir):
    return (
        pixels.linear_stretch(view(spark, sf_dir, "pixels"))
        .groupBy("image_id", "level")
        .agg(F.count(F.lit(1)).alias("pixel_count"))
    )


@registry.query(
    "m3_clean_values",
    "SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN"
    " 1.7976931348623157e308 WHEN 2 THEN -1.7976931348623157e308 ELSE l_extendedprice END::double AS"
    " \"value\" FROM lineitem",
)
def m3(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    dirty = (
        F.when(n == 0, F.lit(float("nan")))
        .when(n == 1, F.lit(float("inf")))
        .when(n == 2, F.lit(float("-inf")))
        .otherwise(F.col("l_extendedprice"))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("n"),
        pixels.clean_values(dirty).alias("value"),
    )
