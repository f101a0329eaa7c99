"""Catalogue sources and the loads that turn them into catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.text import (
    catalog_dec,
    catalog_ra,
    designation_number,
    to_float,
    without_blanks,
)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column layouts of the catalogue files.
MESSIER_CSV = _strings(
    "id", "alpha", "delta", "magnitude", "diameter", "axisRatio", "posAngle", "Common name",
    "NGC/IC", "PGC",
)
NGC_CSV = _strings(
    "Name", "Type", "RA", "Dec", "Const", "MajAx", "MinAx", "PosAng", "B-Mag", "V-Mag", "SurfBr",
    "Hubble", "Redshift", "M", "IC", "Common names", "OpenNGC notes",
)
STAR_CSV = _strings(
    "id", "alpha", "delta", "magnitude", "HIP", "HD", "Common name", "Spectral type"
)
MESSIER_JSON = T.StructType(
    [
        T.StructField("messier_number", T.IntegerType()),
        T.StructField("designation", T.StringType()),
        T.StructField("common_name", T.StringType()),
        T.StructField("ngc", T.StringType()),
        T.StructField("ra", T.DoubleType()),
        T.StructField("dec", T.DoubleType()),
        T.StructField("type", T.StringType()),
        T.StructField("const", T.StringType()),
        T.StructField("mag", T.DoubleType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Catalogue file as text columns; the loads below parse the numbers.

    Columns are taken by their header name, so files may have more columns or another order.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    have = {c.strip(): c for c in raw.columns}
    return raw.select(
        *[
            (F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None).cast("string")).alias(f.name)
            for f in schema.fields
        ]
    )


def read_messier_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MESSIER_CSV)


def read_ngc_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, NGC_CSV, sep=";")


def read_star_csv(spark: SparkSession, path: str) -> DataFrame:
    """Star rows with their position in the file, which decides between duplicates."""
    return read_csv(spark, path, STAR_CSV).withColumn("line_no", F.monotonically_increasing_id())


def read_messier_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Array of objects; with ``multi_line`` off, files of one array per line."""
    return spark.read.schema(MESSIER_JSON).option("multiLine", multi_line).json(path)


def filled(value) -> Column:
    """Text, with blank meaning NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.trim(value) != "", value)


def enrich_by_number(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Attach details by Messier number, or else by designation; adds ``_meta``.

    Of details that are listed more than once for a number or designation the smallest row counts, so
    no row of the catalogue is ever multiplied.
    """
    details = extra.select(F.struct(*extra.columns).alias("_m"))

    def one_for(key: str, name: str) -> DataFrame:
        return details.groupBy(F.col(f"_m.{key}").alias(key)).agg(F.min("_m").alias(name)).where(F.col(key).isNotNull())

    by_number, by_name = one_for("messier_number", "_by_no"), one_for("designation", "_by_name")
    return (
        rows.join(by_number, "messier_number", "left")
        .join(by_name, "designation", "left")
        .withColumn("_meta", F.coalesce("_by_no", "_by_name"))
        .drop("_by_no", "_by_name")
    )


def load_messier(csv: DataFrame, extra: DataFrame) -> DataFrame:
    """Messier table from the CSV with type and constellation from the JSON details.

    CSV values win where they are not blank; rows without coordinates or number are skipped.
    """
    rows = csv.select(
        F.col("id").alias("designation"),
        F.substr("id", F.lit(2)).try_cast("int").alias("messier_number"),
        filled("`Common name`").alias("_name"),
        filled("`NGC/IC`").alias("_ngc"),
        to_float("alpha").alias("ra_degrees"),
        to_float("delta").alias("dec_degrees"),
        to_float("magnitude").alias("apparent_magnitude"),
        F.col("diameter").alias("angular_size_arcmin"),
        to_float("axisRatio").alias("axis_ratio"),
        to_float("posAngle").alias("position_angle"),
        F.col("PGC").alias("pgc_designation"),
    ).filter(
        F.col("messier_number").isNotNull()
        & F.col("ra_degrees").isNotNull()
        & F.col("dec_degrees").isNotNull()
    )
    return enrich_by_number(rows, extra).select(
        "designation",
        "messier_number",
        F.coalesce("_name", "_meta.common_name").alias("common_name"),
        F.coalesce("_ngc", "_meta.ngc").alias("ngc_designation"),
        "ra_degrees",
        "dec_degrees",
        F.coalesce("_meta.type", F.lit("Deep Sky Object")).alias("object_type"),
        F.col("_meta.const").alias("constellation"),
        "apparent_magnitude",
        "angular_size_arcmin",
        "axis_ratio",
        "position_angle",
        "pgc_designation",
    )


def upsert_catalog(current: DataFrame, loaded: DataFrame, key: str = "designation") -> DataFrame:
    """Loaded rows replace current ones of the same key; all others stay."""
    kept = current.join(loaded.select(key), key, "left_anti")
    return loaded.unionByName(kept, allowMissingColumns=True)


def load_ngc(csv: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """NGC/IC table; rows already in ``existing`` are skipped.

    Designations are normalised before the comparison, so a second load adds nothing.
    """
    rows = csv.select(
        without_blanks("Name").alias("designation"),
        designation_number("Name").alias("ngc_number"),
        F.col("`Common names`").alias("common_name"),
        F.when(F.col("M") != "", F.concat(F.lit("M"), "M")).alias("messier_designation"),
        F.when(F.col("IC") != "", F.concat(F.lit("IC"), without_blanks("IC"))).alias(
            "ic_designation"
        ),
        catalog_ra("RA").alias("ra_degrees"),
        catalog_dec("Dec").alias("dec_degrees"),
        F.col("Type").alias("object_type"),
        F.col("Hubble").alias("hubble_type"),
        F.col("Const").alias("constellation"),
        F.coalesce(to_float("`V-Mag`"), to_float("`B-Mag`")).alias("apparent_magnitude"),
        to_float("`B-Mag`").alias("b_magnitude"),
        to_float("SurfBr").alias("surface_brightness"),
        to_float("MajAx").alias("major_axis_arcmin"),
        to_float("MinAx").alias("minor_axis_arcmin"),
        to_float("PosAng").alias("position_angle"),
        to_float("Redshift").alias("redshift"),
        F.col("`OpenNGC notes`").alias("notes"),
    )
    if existing is None:
        return rows
    return rows.join(existing.select(without_blanks("designation").alias("designation")),
                     "designation", "left_anti")


def first_of_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key; only one candidate per key and task is shuffled."""
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n <= 1").drop("_n")


def load_stars(csv: DataFrame, order: str = "line_no") -> DataFrame:
    """Named-star table: first row per designation, blanks NULL, missing coordinates 0."""
    rows = csv.filter(F.col("id").isNotNull() & (F.col("id") != ""))
    return first_of_duplicates(rows, "id", order).select(
        F.col("id").alias("designation"),
        filled("`Common name`").alias("common_name"),
        F.coalesce(to_float("alpha"), F.lit(0.0)).alias("ra_degrees"),
        F.coalesce(to_float("delta"), F.lit(0.0)).alias("dec_degrees"),
        to_float("magnitude").alias("magnitude"),
        F.col("`Spectral type`").alias("spectral_type"),
        filled("HD").alias("hd_id"),
        filled("HIP").alias("hip_id"),
    )


def union_catalog(messier: DataFrame, ngc: DataFrame, stars: DataFrame) -> DataFrame:
    """One catalogue for matching: type, designation, coordinates and display columns."""

    def part(df: DataFrame, kind: str, magnitude: str, number: str | None) -> DataFrame:
        constellation = F.col("constellation") if "constellation" in df.columns else F.lit(None)
        return df.select(
            F.lit(kind).alias("catalog_type"),
            "designation",
            "ra_degrees",
            "dec_degrees",
            "common_name",
            constellation.cast("string").alias("constellation"),
            F.col(magnitude).alias("magnitude"),
            (F.col(number) if number else F.lit(None)).cast("long").alias("number"),
        )

    return (
        part(messier, "MESSIER", "apparent_magnitude", "messier_number")
        .unionByName(part(ngc, "NGC", "apparent_magnitude", "ngc_number"))
        .unionByName(part(stars, "NAMED_STAR", "magnitude", None))
    )
