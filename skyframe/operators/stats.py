"""Archive statistics: overviews, breakdowns, histograms and log summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.text import canonical_filter
from skyframe.operators.order_stats import null_safe_join, order_statistics

COUNTED_SUBTYPES = ("SUB_FRAME", "INTEGRATION_MASTER")


def _hours(column: str = "exposure_time_seconds") -> Column:
    """Summed exposure in hours to one decimal, 0 for nothing."""
    return F.bround(F.coalesce(F.sum(column), F.lit(0.0)) / 3600, 1)


def _rows() -> Column:
    return F.count(F.lit(1))


def archive_overview(images: DataFrame) -> DataFrame:
    """One row: counts, hours, solved share of subs and masters, storage; a single pass."""
    counted = F.col("subtype").isin(*COUNTED_SUBTYPES)
    totals = images.agg(
        _rows().alias("total_images"),
        _hours().alias("total_exposure_hours"),
        F.count_if(counted).alias("_relevant"),
        F.count_if(counted & F.col("is_plate_solved")).alias("total_plate_solved"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0).cast("long")).alias("storage_used_bytes"),
    )
    share = F.try_divide(F.col("total_plate_solved"), F.col("_relevant")) * 100
    return totals.select(
        "total_images",
        "total_exposure_hours",
        F.bround(F.coalesce(share, F.lit(0.0)), 1).alias("plate_solved_percentage"),
        "total_plate_solved",
        F.bround(F.col("storage_used_bytes") / float(1024**3), 2).alias("total_file_size_gb"),
        "storage_used_bytes",
    )


def object_coverage(matches: DataFrame) -> DataFrame:
    """Distinct designations: all, Messier, NGC.

    The (type, designation) pairs are made distinct first, so the three counts share one shuffle
    of small rows.
    """
    names = matches.select("catalog_type", "catalog_designation").distinct()
    kind, name = F.col("catalog_type"), F.col("catalog_designation")
    return names.agg(
        F.countDistinct(name).alias("unique_objects_imaged"),
        F.count_if(kind == "MESSIER").alias("messier_coverage"),
        F.count_if(kind == "NGC").alias("ngc_coverage"),
    )


def by_month(images: DataFrame, months: int = 12) -> DataFrame:
    """Images and hours per month for the latest months that have data, oldest first."""
    latest = (
        images.filter(F.col("capture_date").isNotNull())
        .groupBy(F.date_format("capture_date", "yyyy-MM").alias("month"))
        .agg(_rows().alias("image_count"), _hours().alias("exposure_hours"))
        .orderBy(F.col("month").desc())
        .limit(months)
    )
    return latest.orderBy("month")


def by_subtype(images: DataFrame) -> DataFrame:
    return images.groupBy("subtype").agg(
        _rows().alias("image_count"), _hours().alias("total_exposure_hours")
    )


def by_format(images: DataFrame) -> DataFrame:
    """Count and share per format; the window runs over the handful of formats."""
    counts = images.groupBy("file_format").agg(_rows().alias("image_count"))
    share = F.col("image_count") / F.sum("image_count").over(Window.partitionBy()) * 100
    return counts.withColumn("percentage", F.bround(share, 1))


#: What ``with_exposure`` adds to an image, for its matches to carry.
EXPOSURE = ("image_rows", "image_exposure")


def with_exposure(images: DataFrame) -> DataFrame:
    """Images with the number and summed exposure of the rows that share their id.

    Matches that carry these columns (``field_match(..., keep=EXPOSURE)``) need not meet the images again.
    """
    same = Window.partitionBy("id")
    return images.withColumns(
        {"image_rows": F.count(F.lit(1)).over(same), "image_exposure": F.sum("exposure_time_seconds").over(same)}
    )


def object_exposure(matches: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Matches and summed exposure per object; without ``images``, matches carry what ``with_exposure`` adds."""
    if images is None:
        return (
            matches.filter("image_id IS NOT NULL")
            .groupBy("catalog_designation", "catalog_type")
            .agg(
                F.sum("image_rows").alias("image_count"),
                _hours("image_exposure").alias("total_exposure_hours"),
            )
        )
    exposure = images.select(F.col("id").alias("image_id"), "exposure_time_seconds")
    return (
        matches.select("image_id", "catalog_type", "catalog_designation")
        .join(exposure, "image_id")
        .groupBy("catalog_designation", "catalog_type")
        .agg(_rows().alias("image_count"), _hours().alias("total_exposure_hours"))
    )


def top_objects(matches: DataFrame, images: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The objects on the most images; ties go by designation and type."""
    return (
        object_exposure(matches, images)
        .orderBy(F.col("image_count").desc(), "catalog_designation", "catalog_type")
        .limit(n)
    )


def analytics_overview(images: DataFrame) -> DataFrame:
    return images.agg(
        _rows().alias("total_images"),
        (F.coalesce(F.sum("exposure_time_seconds"), F.lit(0.0)) / 3600).alias(
            "total_exposure_hours"
        ),
        F.coalesce(F.avg("exposure_time_seconds"), F.lit(0.0)).alias("average_exposure_seconds"),
        F.count_if(F.col("subtype") == "SUB_FRAME").alias("total_subs"),
    )


def detected_objects(matches: DataFrame) -> DataFrame:
    """Sorted distinct designations per image, joined with commas."""
    return matches.groupBy("image_id").agg(
        F.array_join(F.array_sort(F.collect_set("catalog_designation")), ", ").alias(
            "detected_objects"
        )
    )


# Fixed value: the first two levels of a path.
MOUNT_PATTERN = "^/[^/]+/[^/]+"


def usage_by_mount(images: DataFrame) -> DataFrame:
    """Files and bytes per first two path levels; NULL for paths without them."""
    return (
        images.filter(F.col("file_path").isNotNull())
        .groupBy(F.regexp_substr("file_path", F.lit(MOUNT_PATTERN)).alias("mount"))
        .agg(
            _rows().alias("file_count"),
            F.coalesce(F.sum("file_size_bytes"), F.lit(0).cast("long")).alias("size_bytes"),
        )
    )


def mount_usage(mounts: DataFrame, usage: DataFrame) -> DataFrame:
    """Every configured mount with its usage, zeros where it has no images."""
    zero = F.lit(0).cast("long")
    return (
        mounts.join(usage, "mount", "left")
        .select(
            F.concat(F.lit("mount:"), F.col("mount")).alias("category"),
            F.coalesce("file_count", zero).alias("file_count"),
            F.coalesce("size_bytes", zero).alias("size_bytes"),
        )
    )


def status_breakdown(images: DataFrame) -> DataFrame:
    """Solver states in one pass; images the solver never saw count by their own solved flag."""
    status, solved = F.col("astrometry_status"), F.col("is_plate_solved")
    untouched = F.coalesce(status, F.lit("NONE")) == "NONE"
    return images.agg(
        _rows().alias("total"),
        F.count_if(status == "SOLVED").alias("solved"),
        F.count_if(untouched & solved).alias("imported"),
        F.count_if(untouched & ~solved).alias("unsolved"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(status == "SUBMITTED").alias("submitted"),
        F.count_if(status == "PROCESSING").alias("processing"),
    )


STATUS_CLASSES = ("solved", "imported", "unsolved", "failed", "submitted", "processing")


def status_map(breakdown: DataFrame) -> DataFrame:
    """The breakdown as a map that leaves out empty classes."""
    pairs = [part for name in STATUS_CLASSES for part in (F.lit(name.upper()), F.col(name))]
    return breakdown.select(
        "total", F.map_filter(F.create_map(*pairs), lambda _, n: n > 0).alias("statuses")
    )


def active_submissions(images: DataFrame) -> DataFrame:
    return images.agg(
        F.count_if(F.col("astrometry_status").isin("SUBMITTED", "PROCESSING")).alias("active")
    )


# --- usage -----------------------------------------------------------------------------------


def usage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-NULL value counts of several columns as (field, name, n), in one scan.

    Each row is turned into one row per column and aggregated before the shuffle.
    """
    stacked = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("name")) for c in columns]
    )
    return (
        df.select(F.inline(stacked))
        .filter(F.col("name").isNotNull())
        .groupBy("field", "name")
        .agg(_rows().alias("n"))
    )


def top_n_other(counts: DataFrame, key: str, n: int = 10, value: str = "n") -> DataFrame:
    """The n largest groups by name, the rest summed as "Other" (left out when empty).

    The top groups come from a top-k, so the groups themselves are never gathered in one task;
    n bounds the broadcast side.
    """
    top = (
        counts.orderBy(F.col(value).desc(), key).limit(n).select(key, F.lit(True).alias("_top"))
    )
    folded = F.when(F.col("_top"), F.col(key)).otherwise(F.lit("Other"))
    return (
        counts.join(F.broadcast(top), key, "left")
        .groupBy(F.coalesce("_top", F.lit(False)).alias("_top"), folded.alias(key))
        .agg(F.sum(value).alias(value))
        .drop("_top")
    )


def filter_usage(images: DataFrame, n: int = 10) -> DataFrame:
    """Images per canonical filter name, top n and the rest."""
    counts = (
        images.filter(F.col("filter_name").isNotNull())
        .groupBy("filter_name")
        .agg(_rows().alias("n"))
        .groupBy(canonical_filter("filter_name").alias("name"))
        .agg(F.sum("n").alias("n"))
    )
    return top_n_other(counts, "name", n)


# --- histograms ------------------------------------------------------------------------------


def histogram(
    df: DataFrame,
    col: str,
    edges: Sequence[float],
    null_policy: str = "drop",
    zero_fill: bool = False,
    below: str = "first",
    above: str = "last",
) -> DataFrame:
    """Counts per half-open bin [edges[i], edges[i+1]) as (bin_start, bin_end, n).

    ``below``/``above`` say where values outside the edges go: into the "first"/"last" bin or
    nowhere ("drop"). ``null_policy`` "last" counts NULLs in the last bin. With ``zero_fill``
    empty bins are listed too.
    """
    value, last = F.col(col), len(edges) - 2
    index = F.when(value.isNull(), F.lit(last) if null_policy == "last" else F.lit(None))
    index = index.when(value < edges[0], F.lit(0) if below == "first" else F.lit(None))
    for i, high in enumerate(edges[1:]):
        index = index.when(value < high, F.lit(i))
    index = index.otherwise(F.lit(last) if above == "last" else F.lit(None))
    counts = (
        df.select(index.cast("int").alias("_bin"))
        .filter(F.col("_bin").isNotNull())
        .groupBy("_bin")
        .agg(_rows().alias("n"))
    )
    bins = F.array(
        *[
            F.struct(F.lit(float(a)).alias("bin_start"), F.lit(float(b)).alias("bin_end"))
            for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
    )
    if zero_fill:
        spark = df.sparkSession
        every = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("_bin"))
        counts = every.join(counts, "_bin", "left").withColumn(
            "n", F.coalesce("n", F.lit(0).cast("long"))
        )
    return counts.select(F.get(bins, F.col("_bin")).alias("b"), "n").select("b.*", "n")


def exposure_histogram(images: DataFrame) -> DataFrame:
    """Bins <60, <120, <300 and the rest; NULL exposures count in the last bin."""
    return histogram(
        images, "exposure_time_seconds", [0, 60, 120, 300, 99999], null_policy="last"
    )


def rotation_histogram(images: DataFrame) -> DataFrame:
    """24 bins of 15 degrees, all listed; angles outside [0, 360) are left out."""
    return histogram(
        images, "rotation_degrees", list(range(0, 361, 15)), zero_fill=True, below="drop",
        above="drop",
    )


def pixel_scale_histogram(images: DataFrame) -> DataFrame:
    return histogram(images, "pixel_scale_arcsec", [0, 0.5, 1, 1.5, 2, 3, 5, 999])


# --- log summaries ---------------------------------------------------------------------------


def duration_summary(durations: DataFrame, keys: Sequence[str], seconds: str, workers: str):
    """Count, mean, exact median, extremes and theoretical tasks per minute per group.

    The median comes from :func:`order_statistics`, so no task gathers a whole group.
    """
    plain = durations.groupBy(*keys).agg(
        F.count(seconds).alias("n"),
        F.avg(seconds).alias("mean_s"),
        F.min(seconds).alias("min_s"),
        F.max(seconds).alias("max_s"),
    )
    medians = order_statistics(durations, keys, seconds, {"median_s": "median"})
    capacity = F.when(F.col("mean_s") > 0, 60 / F.col("mean_s") * F.col(workers).try_cast("int"))
    return null_safe_join(plain, medians, list(keys)).withColumn(
        "tasks_per_minute", F.coalesce(capacity, F.lit(0.0))
    )


def latency_summary(log: DataFrame, key: str, latency: str, success: str) -> DataFrame:
    """Requests, success rate, mean, 95th percentile and maximum per load level.

    The percentile is the exact element at position int(n * 0.95) of the sorted latencies.
    """
    plain = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col(success)).alias("successes"),
        F.bround(F.avg(latency), 2).alias("avg_latency"),
        F.bround(F.max(latency), 2).alias("max_latency"),
    )
    p95 = order_statistics(log, [key], latency, {"p95_latency": 0.95})
    return (
        null_safe_join(plain, p95, [key])
        .withColumn("p95_latency", F.bround("p95_latency", 2))
        .withColumn(
            "success_rate", F.bround(F.col("successes") / F.col("total_requests") * 100, 2)
        )
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        counted = one if counted is None else counted.unionAll(one)
    return counted


def bulk_match_summary(
    images: DataFrame, prefix: str, matches: DataFrame | None = None
) -> DataFrame:
    """Images below a path prefix, how many a match run skips as unsolved, and how many it cannot place.

    ``errors`` counts solved images whose centre is given but no place on the sky: not a number, infinite,
    or a declination beyond the poles. With the match table, ``matched`` counts the images with a match
    and ``matches`` all their matches; both sides meet on the image id, and matches are counted per image
    before they do.
    """
    found = images.filter(F.col("file_path").startswith(prefix))
    ra, dec = F.col("ra_center_degrees").cast("double"), F.col("dec_center_degrees").cast("double")
    # NaN sorts above every number.
    nowhere = (F.abs(ra) == float("inf")) | F.isnan(ra) | (F.abs(dec) > 90)
    columns = [
        F.count(F.lit(1)).alias("total"),
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~F.coalesce("is_plate_solved", F.lit(False))).alias("skipped"),
        F.count_if(F.col("is_plate_solved") & nowhere).alias("errors"),
    ]
    if matches is not None:
        per_image = matches.groupBy("image_id").agg(F.count(F.lit(1)).alias("_matches"))
        found = found.join(per_image, found["id"] == per_image["image_id"], "left")
        columns.append(F.count("_matches").alias("matched"))
        columns.append(F.coalesce(F.sum("_matches"), F.lit(0)).alias("matches"))
    return found.agg(*columns)


# --- ordered series --------------------------------------------------------------------------


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, block: Column, columns: dict[str, str]):
    """Last non-NULL value so far of ``columns`` (source -> output) along ``order`` per key.

    ``block`` maps the order column to consecutive stretches. Values are carried inside each
    stretch first and then across the far fewer stretch ends, so a key that holds most of the
    rows is still spread over many tasks.
    """
    cut = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "_block").agg(
        *[
            F.max_by(src, F.when(F.col(src).isNotNull(), F.col(order))).alias(f"_end_{out}")
            for src, out in columns.items()
        ]
    )
    starts = ends.select(
        *keys,
        "_block",
        *[
            F.last(f"_end_{out}", ignorenulls=True).over(before).alias(f"_start_{out}")
            for out in columns.values()
        ],
    )
    filled = cut.withColumns(
        {
            f"_in_{out}": F.last(src, ignorenulls=True).over(so_far)
            for src, out in columns.items()
        }
    )
    joined = null_safe_join(filled, starts, [*keys, "_block"])
    for out in columns.values():
        joined = joined.withColumn(out, F.coalesce(f"_in_{out}", f"_start_{out}")).drop(
            f"_in_{out}", f"_start_{out}"
        )
    return joined.drop("_block")


def progress_rate(
    samples: DataFrame, ts: str, value: str, keys: Sequence[str] = (), block_seconds: int = 86_400
) -> DataFrame:
    """Change against the previous sample of the same series and the change per second.

    ``samples`` is a monitoring series, or one per ``keys``: one row per sampling moment, already
    aggregated. Series are cut into blocks of time; the last sample of each block is the one before the
    first of the next, so a window holds the samples of a block, or one row for each block of a series.
    Rows without a time stand before all others.
    """
    keys = list(keys)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = samples.withColumn("_s", seconds).withColumn("_block", F.coalesce(F.floor(F.col("_s") / block_seconds), F.lit(-(1 << 62))))
    # Plain rows have no series of their own; the constant keeps their blocks together.
    rows = rows.withColumn("_series", F.struct(*keys) if keys else F.lit(0))
    here = F.struct(F.col("_s"), F.col(value).alias("_value"))
    ends = rows.groupBy("_series", "_block").agg(F.max(here).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy("_series").orderBy("_block"))
    ends = ends.select(F.col("_series").alias("_of"), F.col("_block").alias("_at"), before.alias("_before"))
    inside = F.lag(here).over(Window.partitionBy("_series", "_block").orderBy(ts))
    rows = rows.withColumn("_last", inside).join(
        ends, F.col("_series").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at"))
    )
    rows = rows.withColumn("_last", F.coalesce("_last", "_before"))
    step = F.col("_last._value") - F.col(value)
    elapsed = F.col("_s") - F.col("_last._s")
    return (
        rows.withColumn("fixed", step)
        .withColumn("rate", F.when(elapsed > 0, step / elapsed).when(elapsed.isNotNull(), F.lit(0.0)))
        .drop("_s", "_block", "_series", "_of", "_at", "_before", "_last")
    )
