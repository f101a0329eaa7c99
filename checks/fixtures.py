"""Domain views over the driver tables, as one text for Spark SQL and DuckDB.

Each view is a SELECT written once; the few spellings that differ between the engines are filled
in from a dialect. ``spark_view`` gives a DataFrame, ``duck`` a WITH clause for an oracle query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def hours(self, n: str) -> str:
        return f"make_interval(0,0,0,0,{n},0,0)" if self.spark else f"to_hours({n})"

    def minutes(self, n: str) -> str:
        return f"make_interval(0,0,0,0,0,{n},0)" if self.spark else f"to_minutes({n})"

    def double(self, x: str) -> str:
        return f"cast({x} as double)"

    def string(self, x: str) -> str:
        return f"cast({x} as string)" if self.spark else f"cast({x} as varchar)"

    def pad2(self, x: str) -> str:
        return f"lpad({self.string(x)}, 2, '0')"

    def null(self, kind: str) -> str:
        return f"cast(NULL as {kind if not (kind == 'string' and not self.spark) else 'varchar'})"

    def ntz(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'" if self.spark else f"TIMESTAMP '{text}'"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def _images(d: Dialect) -> str:
    s = d.string
    folder = "CASE WHEN k % 7 = 0 THEN '/Planetary/' ELSE '/DeepSky/' END"
    name = (
        f"'img_' || {s('k')} || CASE WHEN k % 29 = 0 THEN '_Annotated' ELSE '' END"
        " || '.' || lower(file_format)"
    )
    return f"""
SELECT k AS id,
  '/data/mount' || {s('k % 3 + 1')} || {folder} || {name} AS file_path,
  {name} AS file_name,
  file_format,
  cast(floor(o_totalprice * 100) as bigint) AS file_size_bytes,
  CASE k % 10 WHEN 0 THEN 'INTEGRATION_MASTER' WHEN 1 THEN 'INTEGRATION_DEPRECATED'
    WHEN 2 THEN 'PLANETARY' ELSE 'SUB_FRAME' END AS subtype,
  k % 17 <> 0 AS is_plate_solved,
  CASE WHEN k % 17 = 0 THEN CASE k % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'FAILED'
    WHEN 2 THEN 'SUBMITTED' ELSE 'PROCESSING' END
    WHEN k % 2 = 0 THEN 'SOLVED' ELSE 'NONE' END AS astrometry_status,
  CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'SOLVER' ELSE 'HEADER' END END
    AS plate_solve_source,
  CASE WHEN k % 17 <> 0 THEN ((k * 7919) % 36000) / {d.double('100')} END AS ra_center_degrees,
  CASE WHEN k % 17 <> 0 THEN ((k * 104729) % 18001) / {d.double('100')} - 90 END
    AS dec_center_degrees,
  CASE WHEN k % 19 <> 0 THEN {d.double('0.25')} * (1 + k % 8) END AS field_radius_degrees,
  (50 + (k * 31) % 550) / {d.double('100')} AS pixel_scale_arcsec,
  2000 + (k % 5) * 500 AS width_pixels,
  1500 + (k % 4) * 500 AS height_pixels,
  ((k * 53) % 3600) / {d.double('10')} AS rotation_degrees,
  cast(CASE WHEN k % 5 = 0 THEN -1 ELSE 1 END as int) AS parity,
  CASE WHEN k % 11 <> 0 THEN o_totalprice / {d.double('1000')} END AS exposure_time_seconds,
  CASE WHEN k % 23 <> 0 THEN o_orderdate + {d.hours('cast(k % 24 as int)')} END AS capture_date,
  CASE k % 6 WHEN 0 THEN 'ZWO ASI2600MC Pro' WHEN 1 THEN 'ZWO ASI6200MM Pro'
    WHEN 2 THEN 'Canon EOS Ra' WHEN 3 THEN 'QHY268M' WHEN 4 THEN 'Nikon D810A' END AS camera_name,
  CASE k % 4 WHEN 0 THEN 'Esprit 100ED' WHEN 1 THEN 'RC8 Carbon' WHEN 2 THEN 'EdgeHD 11' END
    AS telescope_name,
  CASE k % 9 WHEN 0 THEN 'Ha 6nm' WHEN 1 THEN 'H_alpha' WHEN 2 THEN 'OIII' WHEN 3 THEN 'O3'
    WHEN 4 THEN 'L-Pro' WHEN 5 THEN 'red' WHEN 6 THEN 'SII' WHEN 7 THEN 'Dark' END AS filter_name,
  CASE WHEN k % 14 <> 0 THEN {d.double('k % 300')} END AS gain,
  CASE WHEN k % 7 <> 6 THEN k % 7 END AS rating,
  k % 12 = 0 AS rating_manually_edited,
  CASE WHEN k % 13 = 0 THEN 'M ' || {s('(k % 100) * 3')} END AS object_name,
  CASE WHEN k % 9 <> 4 THEN '/thumbs/t' || {s('k - k % 5 * (1 - k % 2)')} || '.jpg' END
    AS thumbnail_path,
  CASE WHEN k % 21 <> 0 THEN o_orderdate + {d.minutes('cast(k % 90 as int)')} END
    AS file_last_modified,
  o_orderdate + {d.minutes('cast(k % 60 as int)')} AS updated_at,
  o_custkey AS custkey
FROM (SELECT o_orderkey AS k, o_totalprice, o_orderdate, o_custkey,
  CASE o_orderkey % 8 WHEN 0 THEN 'FITS' WHEN 1 THEN 'FIT' WHEN 2 THEN 'CR2' WHEN 3 THEN 'JPG'
    WHEN 4 THEN 'JPEG' WHEN 5 THEN 'TIF' WHEN 6 THEN 'XISF' ELSE 'PNG' END AS file_format
  FROM orders) base"""


def _catalog(d: Dialect) -> str:
    s = d.string
    return f"""
SELECT CASE p_partkey % 3 WHEN 0 THEN 'MESSIER' WHEN 1 THEN 'NGC' ELSE 'NAMED_STAR' END
    AS catalog_type,
  CASE p_partkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'NGC' ELSE 'STAR ' END || {s('p_partkey')}
    AS designation,
  ((p_partkey * 15485863) % 36000) / {d.double('100')} AS ra_degrees,
  ((p_partkey * 32452843) % 18001) / {d.double('100')} - 90 AS dec_degrees,
  CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS common_name,
  p_type AS constellation,
  CASE WHEN p_partkey % 6 <> 0 THEN p_size / {d.double('5')} END AS magnitude,
  p_partkey AS number
FROM part"""


def _headers(d: Dialect) -> str:
    s = d.string
    return f"""
SELECT o_orderkey AS id,
  '{{"INSTRUME":"CAM' || {s('o_orderkey % 6')} || '","GAIN":"' || {s('o_orderkey % 300')}
  || CASE WHEN o_orderkey % 8 = 0 THEN ' e' ELSE '' END
  || '","EXPTIME":"' || {s('o_orderkey % 600')} || '.5'
  || '","DATE-OBS":"2024-0' || {s('1 + o_orderkey % 9')} || '-1' || {s('o_orderkey % 10')}
  || 'T2' || {s('o_orderkey % 4')} || ':30:' || CASE WHEN o_orderkey % 6 = 0 THEN '60'
     ELSE '15' END
  || '","OBJCTRA":"' || {d.pad2('o_orderkey % 24')} || ' ' || {d.pad2('o_orderkey % 60')}
  || ' 30.5","OBJCTDEC":"' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END
  || {d.pad2('o_orderkey % 90')} || ':' || {d.pad2('o_orderkey % 60')} || ':15.0'
  || '","FILTER":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"F' || {s('o_orderkey % 9')}
     || '"' END
  || CASE WHEN o_orderkey % 3 = 0 THEN ',"CCD-TEMP":"-10.0"' ELSE ',"SET-TEMP":"-5"' END
  || CASE WHEN o_orderkey % 4 = 0 THEN ',"NAXIS1":"3000","NAXIS2":"2000"' ELSE '' END
  || CASE WHEN o_orderkey % 8 = 0 THEN ',"PIXSCALE":"1.5"'
     WHEN o_orderkey % 8 = 1 THEN ',"FOCALLEN":"800","XPIXSZ":"3.76"' ELSE '' END
  || '}}' AS header_json
FROM orders"""


def _wcs_headers(d: Dialect) -> str:
    s, pad = d.string, d.pad2
    tan = '"CTYPE1":"RA---TAN","CTYPE2":"DEC--TAN",'
    center = (
        f"""'"CRVAL1":"' || {s('(o_orderkey * 37) % 360')} || '.' || {pad('o_orderkey % 100')}"""
        f""" || '","CRVAL2":"' || {s('(o_orderkey * 53) % 160 - 80')} || '.' """
        f"""|| {pad('o_orderkey % 97')} || '"'"""
    )
    return f"""
SELECT o_orderkey AS id,
  '{{"NAXIS1":"3000","NAXIS2":"2000",' || CASE o_orderkey % 4
  WHEN 0 THEN '{tan}' || {center} || ',"CRPIX1":"1500.5","CRPIX2":"1000.5","CD1_1":"-0.0003",'
    || '"CD1_2":"0.0001","CD2_1":"0.0001","CD2_2":"0.0003"'
  WHEN 1 THEN '{tan}' || {center} || ',"CRPIX1":"1500","CRPIX2":"1000","CDELT1":"-0.0004",'
    || '"CDELT2":"0.0004","CROTA2":"' || {s('o_orderkey % 90')} || '"'
  WHEN 2 THEN {center} || ',"PIXSCALE":"1.5","ROTATION":"15"'
  ELSE '"RA":"' || {s('o_orderkey % 360')} || '.5","DEC":"-' || {s('o_orderkey % 90')}
    || ' 30 00"' END || '}}' AS header_json,
  CASE WHEN o_orderkey % 10 = 0 THEN '{{{tan}"CRVAL1":"100.25","CRVAL2":"45.5",'
    || '"CRPIX1":"10","CRPIX2":"20","CD1_1":"0.001","CD1_2":"0","CD2_1":"0","CD2_2":"-0.001"}}'
    END AS wcs_json
FROM orders"""


def _pixels(d: Dialect) -> str:
    return """
SELECT l_orderkey % 50 AS image_id, l_orderkey * 10 + l_linenumber AS pixel_ix,
  l_extendedprice AS value
FROM lineitem"""


def _status_events(d: Dialect) -> str:
    return """
SELECT event_id, user_id AS image_id, ts,
  CASE event_type WHEN 'signup' THEN 'SUBMITTED' WHEN 'view' THEN 'PROCESSING'
    WHEN 'purchase' THEN 'SOLVED' WHEN 'error' THEN 'FAILED' ELSE 'NONE' END AS status
FROM events"""


def _request_log(d: Dialect) -> str:
    return """
SELECT event_id, user_id % 5 AS level, ts, value AS latency, event_type <> 'error' AS success,
  event_type AS task
FROM events"""


def _inventory(d: Dialect) -> str:
    s = d.string
    base = d.ntz("2024-01-01 00:00:00")
    return f"""
SELECT file_path AS path, file_size_bytes AS size,
  {base} + {d.minutes('cast(id % 1000 as int)')} AS mtime
FROM images WHERE id % 37 <> 0
UNION ALL
SELECT '/data/new/' || {s('p_partkey')} || CASE WHEN p_partkey % 20 = 0 THEN '.FITS' ELSE '.fits' END,
  cast(floor(p_retailprice) as bigint), {base}
FROM part WHERE p_partkey % 10 <> 1
UNION ALL
SELECT '/data/new/notes_' || {s('p_partkey')} || '.txt', cast(1 as bigint), {base}
FROM part WHERE p_partkey % 10 = 1
UNION ALL
SELECT '/data/mount' || {s('id % 3 + 1')} || CASE WHEN id % 7 = 0 THEN '/Planetary/'
    ELSE '/DeepSky/' END || 'img_' || {s('id')} || '_Annotated.' || lower(file_format),
  cast(10 as bigint), {base}
FROM images WHERE id % 31 = 0 AND id % 29 <> 0"""


def _catalog_raw(d: Dialect) -> str:
    s, pad = d.string, d.pad2
    number = f"lpad({s('p_partkey')}, cast(greatest(4, length({s('p_partkey')})) as int), '0')"
    return f"""
SELECT p_partkey AS line_no,
  CASE WHEN p_partkey % 3 = 0 THEN 'IC' ELSE 'NGC' END
    || CASE WHEN p_partkey % 25 = 0 THEN ' ' ELSE '' END || {number}
    || CASE WHEN p_partkey % 40 = 7 THEN 'A' ELSE '' END AS name,
  CASE WHEN p_partkey % 50 = 3 THEN '' WHEN p_partkey % 50 = 4 THEN 'bad'
    ELSE {pad('p_partkey % 24')} || ':' || {pad('p_partkey % 60')}
      || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE ':' || {pad('p_partkey % 59')} || '.5' END
    END AS ra_text,
  CASE WHEN p_partkey % 50 = 5 THEN '' ELSE CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END
    || {pad('p_partkey % 90')} || ':' || {pad('p_partkey % 60')} || ':' || {pad('p_partkey % 59')}
    END AS dec_text,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {s('p_size')} END AS v_mag,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE {s('p_size + 1')} END AS b_mag,
  CASE WHEN p_partkey % 7 = 0 THEN {s('p_partkey % 110')} ELSE '' END AS messier,
  CASE WHEN p_partkey % 11 = 0 THEN {s('p_partkey % 100')} || ' ' || 'x' ELSE '' END AS ic,
  p_name AS common_name, p_type AS obj_type, p_size AS size
FROM part"""


def _incoming(d: Dialect) -> str:
    return """
SELECT file_path, file_name, file_format, file_size_bytes + 7 AS file_size_bytes,
  'SUB_FRAME' AS subtype, id % 3 <> 0 AS is_plate_solved,
  CASE WHEN id % 3 <> 0 THEN 'HEADER' END AS plate_solve_source,
  CASE WHEN id % 3 <> 0 THEN cast(10.5 as double) END AS ra_center_degrees,
  CASE WHEN id % 3 <> 0 THEN cast(-20.25 as double) END AS dec_center_degrees,
  CASE WHEN id % 3 <> 0 THEN cast(0.5 as double) END AS field_radius_degrees,
  CASE WHEN id % 3 <> 0 THEN cast(1.25 as double) END AS pixel_scale_arcsec,
  CASE WHEN id % 3 <> 0 THEN cast(45 as double) END AS rotation_degrees,
  width_pixels + 1 AS width_pixels, height_pixels, exposure_time_seconds,
  CASE WHEN id % 4 <> 0 THEN capture_date END AS capture_date, camera_name, telescope_name,
  filter_name, gain, CASE WHEN id % 2 = 0 THEN rating END AS rating, object_name,
  CASE WHEN id % 15 = 0 THEN '/thumbs/new.jpg' END AS thumbnail_path, updated_at AS
  file_last_modified
FROM images WHERE id % 5 = 0
UNION ALL
SELECT '/incoming/' || file_name, file_name, file_format, file_size_bytes, 'SUB_FRAME',
  is_plate_solved, plate_solve_source, ra_center_degrees, dec_center_degrees,
  field_radius_degrees, pixel_scale_arcsec, rotation_degrees, width_pixels, height_pixels,
  exposure_time_seconds, capture_date, camera_name, telescope_name, filter_name, gain, rating,
  object_name, thumbnail_path, file_last_modified
FROM images WHERE id % 10 = 3"""


def _solver_results(d: Dialect) -> str:
    return """
SELECT id, cast(id % 360 as double) AS ra, cast(id % 90 as double) AS dec,
  cast(1.5 as double) AS radius, cast(2.5 as double) AS pixscale,
  cast(id % 180 as double) AS orientation, cast(CASE WHEN id % 4 = 0 THEN -1 ELSE 1 END as int)
  AS parity, id + 1000 AS submission_id
FROM images WHERE id % 6 = 0"""


_VIEWS = {
    "images": (_images, ()),
    "catalog": (_catalog, ()),
    "headers": (_headers, ()),
    "wcs_headers": (_wcs_headers, ()),
    "pixels": (_pixels, ()),
    "status_events": (_status_events, ()),
    "request_log": (_request_log, ()),
    "inventory": (_inventory, ("images",)),
    "catalog_raw": (_catalog_raw, ()),
    "incoming_images": (_incoming, ("images",)),
    "solver_results": (_solver_results, ("images",)),
}

# DuckDB only: the library computes these with its own operators.
SEPARATION = (
    "degrees(2 * asin(CASE WHEN {dec1} + {dec2} + {ra1} + {ra2} IS NOT NULL THEN sqrt(least("
    "1.0::double, pow(sin(radians({dec2} - {dec1}) / 2), 2) + cos(radians({dec1}))"
    " * cos(radians({dec2})) * pow(sin(radians({ra2} - {ra1}) / 2), 2))) END))"
)


def separation_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    return SEPARATION.format(ra1=ra1, dec1=dec1, ra2=ra2, dec2=dec2)


_CIRCLE = f"""
SELECT * FROM (
  SELECT i.id, c.catalog_type, c.designation, c.ra_degrees, c.dec_degrees, i.ra_center_degrees,
    i.dec_center_degrees, i.pixel_scale_arcsec, i.width_pixels, i.height_pixels,
    i.rotation_degrees, i.parity, i.r,
    {separation_sql('i.ra_center_degrees', 'i.dec_center_degrees', 'c.ra_degrees',
                    'c.dec_degrees')} AS separation
  FROM (SELECT *, coalesce(nullif(field_radius_degrees, 0), 1.0) AS r FROM images
        WHERE is_plate_solved) i
  JOIN catalog c ON abs(c.dec_degrees - i.dec_center_degrees) <= i.r + 1e-9) p
WHERE separation <= r + 1e-9"""

PROJECTED = """
SELECT *,
  cos(radians(dec_degrees)) * sin(radians(ra_degrees - ra_center_degrees)) / dd AS xi_r,
  (cos(radians(dec_center_degrees)) * sin(radians(dec_degrees)) - sin(radians(dec_center_degrees))
   * cos(radians(dec_degrees)) * cos(radians(ra_degrees - ra_center_degrees))) / dd AS eta_r
FROM (SELECT *, CASE WHEN dr > 0 THEN dr END AS dd FROM (SELECT *,
  sin(radians(dec_degrees)) * sin(radians(dec_center_degrees)) + cos(radians(dec_degrees))
  * cos(radians(dec_center_degrees)) * cos(radians(ra_degrees - ra_center_degrees)) AS dr
  FROM {source}))"""

PIXELS = """
SELECT *,
  (cos(radians(rotation_degrees)) * degrees(xi_r) + sin(radians(rotation_degrees))
   * degrees(eta_r)) / (-pixel_scale_arcsec / 3600 * parity) + width_pixels / 2 - 1 AS px,
  (-sin(radians(rotation_degrees)) * degrees(xi_r) + cos(radians(rotation_degrees))
   * degrees(eta_r)) / (-pixel_scale_arcsec / 3600) + height_pixels / 2 - 1 AS py
FROM {source}"""

_DUCK_VIEWS = {
    "circle": (_CIRCLE, ("images", "catalog")),
    "circle_capped": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, catalog_type"
        " ORDER BY round(separation, 9), designation) AS rn FROM circle)"
        " WHERE catalog_type = 'MESSIER' OR rn <= 50",
        ("circle",),
    ),
    "circle_plane": (PROJECTED.format(source="circle_capped"), ("circle_capped",)),
    "circle_px": (PIXELS.format(source="circle_plane"), ("circle_plane",)),
    "matches": (
        "SELECT id AS image_id, catalog_type, designation AS catalog_designation, separation,"
        " 1 - separation / 5.0 AS confidence, px AS x, py AS y, true AS is_in_field,"
        " 'AUTOMATIC' AS source FROM circle_px WHERE dr > 0"
        " AND px BETWEEN -100 AND width_pixels + 100 AND py BETWEEN -100 AND height_pixels + 100",
        ("circle_px",),
    ),
}


def duck(*views: str) -> str:
    """WITH clause defining the given views and all they need, ready for a SELECT to follow."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs = _VIEWS[name][1] if name in _VIEWS else _DUCK_VIEWS[name][1]
        for need in needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)

    def text(name: str) -> str:
        return _VIEWS[name][0](DUCK) if name in _VIEWS else _DUCK_VIEWS[name][0]

    return "WITH " + ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in ('matches', 'circle') else ''}({text(name)})"
        for name in ordered
    ) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOURCES = {
    "images": "orders",
    "catalog": "part",
    "headers": "orders",
    "wcs_headers": "orders",
    "pixels": "lineitem",
    "status_events": "events",
    "request_log": "events",
    "inventory": "part",
    "catalog_raw": "part",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the driver's Parquet files."""
    build, needs = _VIEWS[name]
    inputs = {need: view(spark, sf_dir, need) for need in needs}
    if name in _SOURCES:
        inputs[_SOURCES[name]] = table(spark, sf_dir, _SOURCES[name])
    text = build(SPARK).replace("{", "{{").replace("}", "}}")
    # Table names are passed as DataFrame arguments, so no temporary views are left behind.
    for need in inputs:
        text = text.replace(f"FROM {need}", f"FROM {{{need}}}")
    return spark.sql(text, **inputs)


def stream_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same view over a stream of the driver's file; only for views of a single table."""
    source = _SOURCES.get(name, "orders")
    schema = table(spark, sf_dir, source).schema
    # A pattern, because the file source of a stream expects folders or patterns.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{source}.parque[t]")
    text = _VIEWS[name][0](SPARK).replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: stream})
