"""Registered queries for section F and the statistics joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import duck, view
from checks.match_queries import exposed_matches, matches
from checks.registry import Registry
from checks.search_queries import images
from skyframe.operators import crossmatch, quality, stats

registry = Registry()

_HOURS = "round_even(coalesce(sum(exposure_time_seconds), 0) / 3600, 1)"


@registry.query(
    "f1_overview",
    duck("images") + f"SELECT count(*) AS total_images, {_HOURS} AS total_exposure_hours,"
    " round_even(100.0::double * count(*) FILTER (r AND is_plate_solved) / count(*) FILTER (r), 1)"
    " AS plate_solved_percentage, count(*) FILTER (r AND is_plate_solved) AS total_plate_solved,"
    " round_even(sum(file_size_bytes)::double / 1073741824, 2) AS total_file_size_gb,"
    " sum(file_size_bytes)::bigint AS storage_used_bytes FROM (SELECT *, subtype IN ('SUB_FRAME',"
    " 'INTEGRATION_MASTER') AS r FROM images)",
)
def f1(spark, sf_dir):
    return stats.archive_overview(images(spark, sf_dir))


@registry.query(
    "f2_object_counts",
    duck("matches") + "SELECT count(DISTINCT catalog_designation) AS unique_objects_imaged,"
    " count(DISTINCT catalog_designation) FILTER (catalog_type = 'MESSIER') AS messier_coverage,"
    " count(DISTINCT catalog_designation) FILTER (catalog_type = 'NGC') AS ngc_coverage"
    " FROM matches",
)
def f2(spark, sf_dir):
    return stats.object_coverage(matches(spark, sf_dir))


@registry.query(
    "f3_by_month",
    duck("images") + "SELECT strftime(capture_date, '%Y-%m') AS month, count(*) AS image_count,"
    f" {_HOURS} AS exposure_hours FROM images WHERE capture_date IS NOT NULL GROUP BY 1"
    " ORDER BY 1 DESC LIMIT 12",
)
def f3(spark, sf_dir):
    return stats.by_month(images(spark, sf_dir))


@registry.query(
    "f4_by_subtype",
    duck("images") + f"SELECT subtype, count(*) AS image_count, {_HOURS} AS total_exposure_hours"
    " FROM images GROUP BY 1",
)
def f4(spark, sf_dir):
    return stats.by_subtype(images(spark, sf_dir))


@registry.query(
    "f5_by_format",
    duck("images") + "SELECT file_format, count(*) AS image_count, round_even(count(*) /"
    " sum(count(*)) OVER () * 100, 1) AS percentage FROM images GROUP BY 1",
)
def f5(spark, sf_dir):
    return stats.by_format(images(spark, sf_dir))


_PER_OBJECT = (
    f"SELECT catalog_designation, catalog_type, count(*) AS image_count, {_HOURS} AS"
    " total_exposure_hours FROM matches m JOIN images i ON i.id = m.image_id GROUP BY 1, 2"
)


@registry.query(
    "f6_top_objects",
    duck("matches") + _PER_OBJECT + " ORDER BY image_count DESC, catalog_designation, catalog_type"
    " LIMIT 10",
)
def f6(spark, sf_dir):
    return stats.top_objects(exposed_matches(spark, sf_dir))


@registry.query("e3_match_image_join", duck("matches") + _PER_OBJECT)
def e3(spark, sf_dir):
    return stats.object_exposure(exposed_matches(spark, sf_dir))


@registry.query(
    "f7_analytics_overview",
    duck("images") + "SELECT count(*) AS total_images, round_even(sum(exposure_time_seconds) / 3600,"
    " 6) AS total_exposure_hours, round_even(avg(exposure_time_seconds), 6) AS"
    " average_exposure_seconds, count(*) FILTER (subtype = 'SUB_FRAME') AS total_subs FROM images"
    " WHERE camera_name ILIKE '%zwo%' AND capture_date >= TIMESTAMP '1995-01-01'",
)
def f7(spark, sf_dir):
    from skyframe.operators.filters import analytics_filter

    found = analytics_filter(images(spark, sf_dir), date_from="1995-01-01", cameras=["ZWO"])
    return stats.analytics_overview(found).withColumns(
        {
            "total_exposure_hours": F.bround("total_exposure_hours", 6),
            "average_exposure_seconds": F.bround("average_exposure_seconds", 6),
        }
    )


@registry.query(
    "f9_detected_objects",
    duck("matches") + "SELECT image_id, array_to_string(list_sort(list_distinct(list("
    "catalog_designation))), ', ') AS detected_objects FROM matches GROUP BY 1",
)
def f9(spark, sf_dir):
    return stats.detected_objects(matches(spark, sf_dir))


_MOUNT = (
    "SELECT nullif(regexp_extract(file_path, '^/[^/]+/[^/]+'), '') AS mount, count(*) AS"
    " file_count, sum(file_size_bytes)::bigint AS size_bytes FROM images GROUP BY 1"
)


@registry.query("f10_usage_by_mount", duck("images") + _MOUNT)
def f10(spark, sf_dir):
    return stats.usage_by_mount(images(spark, sf_dir))


@registry.query(
    "e11_mounts_with_usage",
    duck("images") + f", u AS ({_MOUNT}) SELECT 'mount:/data/mount' || m AS category,"
    " coalesce(file_count, 0) AS file_count, coalesce(size_bytes, 0)::bigint AS size_bytes FROM"
    " range(1, 5) t(m) LEFT JOIN u ON u.mount = '/data/mount' || m",
)
def e11(spark, sf_dir):
    mounts = spark.range(1, 5).select(F.concat(F.lit("/data/mount"), "id").alias("mount"))
    return stats.mount_usage(mounts, stats.usage_by_mount(images(spark, sf_dir)))


_STATUS = (
    "SELECT count(*) AS total, count(*) FILTER (astrometry_status = 'SOLVED') AS solved,"
    " count(*) FILTER (astrometry_status = 'NONE' AND is_plate_solved) AS imported,"
    " count(*) FILTER (astrometry_status = 'NONE' AND NOT is_plate_solved) AS unsolved,"
    " count(*) FILTER (astrometry_status = 'FAILED') AS failed,"
    " count(*) FILTER (astrometry_status = 'SUBMITTED') AS submitted,"
    " count(*) FILTER (astrometry_status = 'PROCESSING') AS processing FROM images"
)


@registry.query("f11_status_breakdown", duck("images") + _STATUS)
def f11(spark, sf_dir):
    return stats.status_breakdown(images(spark, sf_dir))


@registry.query(
    "f11_status_map",
    duck("images") + f", b AS ({_STATUS}), classes AS (UNPIVOT b ON solved, imported, unsolved,"
    " failed, submitted, processing INTO NAME c VALUE n)"
    " SELECT upper(c) AS status, n FROM classes WHERE n > 0",
)
def f11_map(spark, sf_dir):
    totals = stats.status_map(stats.status_breakdown(images(spark, sf_dir)))
    return totals.select(F.explode("statuses").alias("status", "n"))


@registry.query(
    "f12_equipment_usage",
    duck("images") + "SELECT field, name, count(*) AS n FROM (SELECT 'camera_name' AS field,"
    " camera_name AS name FROM images UNION ALL SELECT 'telescope_name', telescope_name FROM images"
    " UNION ALL SELECT 'filter_name', filter_name FROM images) WHERE name IS NOT NULL GROUP BY 1, 2",
)
def f12(spark, sf_dir):
    return stats.usage(images(spark, sf_dir), ["camera_name", "telescope_name", "filter_name"])


_TOP_OTHER = (
    ", ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS rn FROM counts)"
    " SELECT CASE WHEN rn <= {n} THEN name ELSE 'Other' END AS name, sum(n)::bigint AS n"
    " FROM ranked GROUP BY rn <= {n}, 1"
)


@registry.query(
    "f13_top_and_other",
    "WITH counts AS (SELECT cast(o_custkey as varchar) AS name, count(*) AS n FROM orders GROUP BY 1)"
    + _TOP_OTHER.format(n=10),
)
def f13(spark, sf_dir):
    """Top ten owners and the rest: a field with many values, so that there is a rest."""
    counts = stats.usage(images(spark, sf_dir), ["custkey"]).select("name", "n")
    return stats.top_n_other(counts, "name", 10)


_CANONICAL = (
    "CASE WHEN filter_name IS NULL OR filter_name = '' THEN 'Unknown'"
    " WHEN p IN ('r','red') THEN 'Red' WHEN p IN ('g','green') THEN 'Green'"
    " WHEN p IN ('b','blue') THEN 'Blue'"
    " WHEN p IN ('l','lum','luminance','uvircut','lpro') THEN 'Luminance'"
    " WHEN p IN ('h','ha','halpha','h_alpha') THEN 'H-Alpha'"
    " WHEN p IN ('o','o3','oiii','oxygen3') THEN 'OIII'"
    " WHEN p IN ('s','s2','sii','sulfur2') THEN 'SII' WHEN p = 'dark' THEN 'Dark'"
    " WHEN p = 'flat' THEN 'Flat' WHEN p IN ('bias','offset') THEN 'Bias'"
    " ELSE upper(filter_name[1]) || filter_name[2:] END"
)
CANONICAL_CTE = (
    f", named AS (SELECT *, {_CANONICAL} AS name FROM (SELECT *, regexp_replace(lower(filter_name),"
    " '[^a-z0-9]', '', 'g') AS p FROM images))"
)


@registry.query(
    "f14_filter_usage",
    duck("images") + CANONICAL_CTE + ", counts AS (SELECT name, count(*) AS n FROM named WHERE"
    " filter_name IS NOT NULL GROUP BY 1)" + _TOP_OTHER.format(n=3),
)
def f14(spark, sf_dir):
    return stats.filter_usage(images(spark, sf_dir), n=3)


@registry.query(
    "f15_exposure_histogram",
    duck("images") + "SELECT CASE b WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 120 ELSE 300"
    " END::double AS bin_start, CASE b WHEN 0 THEN 60 WHEN 1 THEN 120 WHEN 2 THEN 300 ELSE 99999"
    " END::double AS bin_end, count(*) AS n FROM (SELECT CASE WHEN exposure_time_seconds < 60 THEN"
    " 0 WHEN exposure_time_seconds < 120 THEN 1 WHEN exposure_time_seconds < 300 THEN 2 ELSE 3 END"
    " AS b FROM images) GROUP BY b",
)
def f15(spark, sf_dir):
    return stats.exposure_histogram(images(spark, sf_dir))


@registry.query(
    "f16_rotation_histogram",
    duck("images") + "SELECT s::double AS bin_start, (s + 15)::double AS bin_end, count(id) AS n"
    " FROM range(0, 360, 15) t(s) LEFT JOIN images ON rotation_degrees >= s"
    " AND rotation_degrees < s + 15 GROUP BY s",
)
def f16(spark, sf_dir):
    return stats.rotation_histogram(images(spark, sf_dir))


@registry.query(
    "f17_pixel_scale_histogram",
    duck("images") + "SELECT lo AS bin_start, hi AS bin_end, count(*) AS n FROM images JOIN (VALUES"
    " (0.0::double, 0.5::double), (0.5, 1), (1, 1.5), (1.5, 2), (2, 3), (3, 5), (5, 999)) b(lo, hi)"
    " ON pixel_scale_arcsec >= lo AND pixel_scale_arcsec < hi GROUP BY 1, 2",
)
def f17(spark, sf_dir):
    return stats.pixel_scale_histogram(images(spark, sf_dir))


@registry.query(
    "f19_collision_count",
    duck("images") + "SELECT coalesce(sum(n), 0)::bigint AS collisions FROM (SELECT count(*) AS n"
    " FROM images WHERE thumbnail_path IS NOT NULL GROUP BY thumbnail_path HAVING count(*) > 1)",
)
def f19(spark, sf_dir):
    return quality.collision_count(images(spark, sf_dir), "thumbnail_path")


@registry.query(
    "f20_duration_summary",
    duck("request_log") + "SELECT level, task, count(*) AS n, round_even(avg(latency), 9) AS mean_s,"
    " median(latency) AS median_s, min(latency) AS min_s, max(latency) AS max_s,"
    " round_even(60 / avg(latency) * level, 4) AS tasks_per_minute FROM request_log GROUP BY 1, 2",
)
def f20(spark, sf_dir):
    log = view(spark, sf_dir, "request_log")
    return stats.duration_summary(log, ["level", "task"], "latency", "level").withColumns(
        {
            "mean_s": F.bround("mean_s", 9),
            "tasks_per_minute": F.bround("tasks_per_minute", 4),
        }
    )


@registry.query(
    "f21_latency_summary",
    duck("request_log") + "SELECT level, count(*) AS total_requests, count(*) FILTER (success) AS"
    " successes, round_even(count(*) FILTER (success) / count(*) * 100, 2) AS success_rate,"
    " round_even(avg(latency), 2) AS avg_latency, round_even(list_sort(list(latency))[cast(floor("
    "count(*) * 0.95::double) as bigint) + 1], 2) AS p95_latency, round_even(max(latency), 2) AS"
    " max_latency FROM request_log GROUP BY 1",
)
def f21(spark, sf_dir):
    return stats.latency_summary(view(spark, sf_dir, "request_log"), "level", "latency", "success")


@registry.query(
    "f22_row_counts",
    duck("images", "catalog") + "SELECT 'images' AS table_name, count(*) AS n FROM images UNION ALL"
    " SELECT 'messier_catalog', count(*) FROM catalog WHERE catalog_type = 'MESSIER' UNION ALL"
    " SELECT 'ngc_catalog', count(*) FROM catalog WHERE catalog_type = 'NGC'",
)
def f22(spark, sf_dir):
    catalog = view(spark, sf_dir, "catalog")
    return stats.row_counts(
        {
            "images": images(spark, sf_dir),
            "messier_catalog": catalog.filter("catalog_type = 'MESSIER'"),
            "ngc_catalog": catalog.filter("catalog_type = 'NGC'"),
        }
    )


@registry.query(
    "f23_active_submissions",
    duck("images") + "SELECT count(*) AS active FROM images WHERE astrometry_status IN ('SUBMITTED',"
    " 'PROCESSING')",
)
def f23(spark, sf_dir):
    return stats.active_submissions(images(spark, sf_dir))


@registry.query(
    "f24_bulk_match_summary",
    duck("images") + "SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (NOT"
    " is_plate_solved) AS skipped, 0::bigint AS errors FROM images WHERE starts_with(file_path, '/data/mount1')",
)
def f24(spark, sf_dir):
    return stats.bulk_match_summary(images(spark, sf_dir), "/data/mount1")


@registry.query(
    "f24_bulk_match_errors",
    duck("matches") + "SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (NOT is_plate_solved) AS skipped,"
    " count(*) FILTER (is_plate_solved AND (id % 50 = 0 OR id % 70 = 0)) AS errors, count(n) AS matched,"
    " coalesce(sum(n), 0)::bigint AS matches FROM images i LEFT JOIN (SELECT image_id, count(*) AS n FROM matches GROUP BY 1) m"
    " ON m.image_id = i.id WHERE starts_with(file_path, '/data/mount2')",
)
def f24_errors(spark, sf_dir):
    """Some centres lie beyond the pole, others are not numbers."""
    spoilt = images(spark, sf_dir).withColumns({
        "dec_center_degrees": F.when(F.col("id") % 50 == 0, 90.5).otherwise(F.col("dec_center_degrees")),
        "ra_center_degrees": F.when(F.col("id") % 70 == 0, float("nan")).otherwise(F.col("ra_center_degrees")),
    })
    return stats.bulk_match_summary(spoilt, "/data/mount2", matches(spark, sf_dir))


@registry.query(
    "d11_sky_density",
    duck("images") + "SELECT *, round_even(image_count / max(image_count) OVER (), 6) AS density"
    " FROM (SELECT cast(floor(ra_center_degrees / 5) as bigint) AS ra_bin,"
    " cast(floor(dec_center_degrees / 5) as bigint) AS dec_bin, count(*) AS image_count FROM images"
    " WHERE ra_center_degrees IS NOT NULL GROUP BY 1, 2)",
)
def d11(spark, sf_dir):
    return crossmatch.sky_density(images(spark, sf_dir)).withColumn(
        "density", F.bround("density", 6)
    )


@registry.query(
    "h7_progress_rate",
    duck("status_events") + ", s AS (SELECT status, date_trunc('hour', ts) AS ts, count(*) AS n FROM"
    " status_events GROUP BY 1, 2) SELECT status, ts, n, lag(n) OVER w - n AS"
    " fixed, round_even((lag(n) OVER w - n) / (epoch(ts) - epoch(lag(ts) OVER w)), 9) AS rate"
    " FROM s WINDOW w AS (PARTITION BY status ORDER BY ts)",
)
def h7(spark, sf_dir):
    samples = (
        view(spark, sf_dir, "status_events")
        .groupBy("status", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return stats.progress_rate(samples, "ts", "n", ["status"]).withColumn("rate", F.bround("rate", 9))


@registry.query(
    "h8_carry_forward",
    duck("request_log") + "SELECT event_id, last_value(CASE WHEN task = 'signup' THEN latency END"
    " IGNORE NULLS) OVER (PARTITION BY level ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND CURRENT ROW) AS last_signup FROM request_log",
)
def h8(spark, sf_dir):
    log = view(spark, sf_dir, "request_log").select(
        "event_id", "level", F.when(F.col("task") == "signup", F.col("latency")).alias("signup")
    )
    block = F.floor(F.col("event_id") / 5000)
    return stats.carry_forward(log, ["level"], "event_id", block, {"signup": "last_signup"}).select(
        "event_id", "last_signup"
    )
