import math
import random

import pytest
from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.operators import crossmatch
from skyframe.operators import matches as match_tables

IMAGE = (
    "id long, is_plate_solved boolean, ra_center_degrees double, dec_center_degrees double,"
    " field_radius_degrees double, pixel_scale_arcsec double, width_pixels int, height_pixels int,"
    " rotation_degrees double, parity int"
)
OBJECT = "catalog_type string, designation string, ra_degrees double, dec_degrees double"


def image(i, ra, dec, radius, solved=True, scale=None, w=None, h=None, rot=None, parity=None):
    return (i, solved, ra, dec, radius, scale, w, h, rot, parity)


@pytest.fixture(scope="module")
def sky(spark):
    """Random circles of all sizes, with clusters at both poles and around RA 0."""
    rng = random.Random(3)
    images, objects = [], []
    for i in range(400):
        ra, dec = rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        if i % 5 == 0:
            dec = rng.choice([-1, 1]) * rng.uniform(85, 90)
        if i % 5 == 1:
            ra = rng.choice([rng.uniform(359, 360), rng.uniform(0, 1), 0.0, 359.99999])
        radius = rng.choice([0.1, 0.25, 0.5, 1.0, 3.0, 11.0, 40.0, 95.0, 180.0, None, 0.0])
        images.append(image(i, ra, dec, radius))
    for j in range(700):
        ra, dec = rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))
        if j % 6 == 0:
            dec = rng.choice([-1, 1]) * rng.uniform(86, 90)
        if j % 6 == 1:
            ra = rng.choice([rng.uniform(359.5, 360), rng.uniform(0, 0.5)])
        objects.append((["MESSIER", "NGC", "NAMED_STAR"][j % 3], f"O{j}", ra, dec))
    objects.append(("NGC", "NORTH", 12.0, 90.0))
    objects.append(("NGC", "SOUTH", 200.0, -90.0))
    return (
        spark.createDataFrame(images, IMAGE).cache(),
        spark.createDataFrame(objects, OBJECT).cache(),
    )


def brute(images, objects):
    def radius(r):
        return 1.0 if not r else r

    pairs = set()
    objs = objects.collect()
    for i in images.collect():
        d0, a0 = math.radians(i.dec_center_degrees), math.radians(i.ra_center_degrees)
        for o in objs:
            d1, a1 = math.radians(o.dec_degrees), math.radians(o.ra_degrees)
            s = (
                math.sin((d1 - d0) / 2) ** 2
                + math.cos(d0) * math.cos(d1) * math.sin((a1 - a0) / 2) ** 2
            )
            if math.degrees(2 * math.asin(min(1, math.sqrt(s)))) <= radius(
                i.field_radius_degrees
            ) + 1e-9:
                pairs.add((i.id, o.designation))
    return pairs


@pytest.mark.parametrize("options", [
    {"strategy": "broadcast"},
    {"strategy": "shuffle"},
    {"strategy": "shuffle", "rows_per_task": 7},
], ids=lambda o: "-".join(str(v) for v in o.values()))
def test_circle_join_equals_brute_force(sky, options):
    images, objects = sky
    rows = crossmatch.circle_join(images, objects, **options).select("id", "designation").collect()
    got = [(r.id, r.designation) for r in rows]
    assert len(got) == len(set(got)), "a pair was found twice"
    assert set(got) == brute(images, objects)


def test_one_hot_cell_is_split(spark):
    """A third of all images and objects at one spot: pairs stay whole and unique."""
    images = spark.range(600).select(
        "id", F.lit(True).alias("is_plate_solved"),
        F.when(F.col("id") % 3 == 0, 83.0).otherwise(F.col("id") * 0.6).alias("ra_center_degrees"),
        F.when(F.col("id") % 3 == 0, -5.0).otherwise(F.col("id") * 0.1).alias("dec_center_degrees"),
        F.lit(0.5).alias("field_radius_degrees"),
    )
    objects = spark.range(150).select(
        F.lit("NGC").alias("catalog_type"), F.concat(F.lit("N"), "id").alias("designation"),
        F.when(F.col("id") % 3 == 0, 83.1).otherwise(F.col("id") * 2.4).alias("ra_degrees"),
        F.when(F.col("id") % 3 == 0, -5.1).otherwise(F.col("id") * 0.3).alias("dec_degrees"),
    )
    split = crossmatch.circle_join(images, objects, strategy="shuffle", rows_per_task=20)
    plain = crossmatch.circle_join(images, objects, strategy="broadcast")
    assert split.count() == plain.count() >= 200 * 50
    assert split.select("id", "designation").distinct().count() == plain.count()


def test_unusable_coordinates_never_match(spark):
    images = spark.createDataFrame(
        [image(1, float("nan"), 1.0, 5.0), image(2, None, 1.0, 5.0), image(3, 1.0, 1.0, 5.0)], IMAGE
    )
    objects = spark.createDataFrame(
        [("NGC", "A", 1.0, 1.0), ("NGC", "B", float("nan"), 1.0), ("NGC", "C", 1.0, None)], OBJECT
    )
    rows = crossmatch.circle_join(images, objects).collect()
    assert [(r.id, r.designation) for r in rows] == [(3, "A")]


def test_no_nested_loop_and_cap_before_shuffle(sky):
    images, objects = sky
    for strategy in ("broadcast", "shuffle"):
        plan = crossmatch.field_match(images, objects, cap=50, strategy=strategy)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
        assert "WindowGroupLimit" in text


def test_cap_keeps_nearest_but_not_for_messier(spark):
    images = spark.createDataFrame([image(1, 10.0, 0.0, 5.0)], IMAGE)
    objects = spark.createDataFrame(
        [(t, f"{t}{i:02d}", 10.0, 0.01 * (i // 2)) for t in ("MESSIER", "NGC") for i in range(20)],
        OBJECT,
    )
    kept = crossmatch.nearest_per_type(crossmatch.circle_join(images, objects), 5).collect()
    ngc = sorted(r.designation for r in kept if r.catalog_type == "NGC")
    assert ngc == ["NGC00", "NGC01", "NGC02", "NGC03", "NGC04"]
    assert sum(r.catalog_type == "MESSIER" for r in kept) == 20


def test_frame_test_and_its_margin(spark):
    frame = dict(scale=3.6, w=1000, h=1000, rot=0.0, parity=1)
    images = spark.createDataFrame(
        [image(1, 10.0, 0.0, 5.0, **frame), image(2, 10.0, 0.0, 5.0), image(3, 10.0, 0.0, 5.0, False)],
        IMAGE,
    )
    # 0.001 degrees per pixel: the frame ends at +-0.5, with margin at about +-0.6 degrees.
    objects = spark.createDataFrame(
        [("NGC", "IN", 10.0, 0.4), ("NGC", "MARGIN", 10.0, 0.59), ("NGC", "OUT", 10.0, 0.62)], OBJECT
    )
    rows = crossmatch.field_match(images, objects).collect()
    assert {(r.image_id, r.catalog_designation) for r in rows} == {
        (1, "IN"), (1, "MARGIN"), (2, "IN"), (2, "MARGIN"), (2, "OUT"),
    }
    first = next(r for r in rows if (r.image_id, r.catalog_designation) == (1, "IN"))
    assert first.confidence == pytest.approx(1 - 0.4 / 5) and first.source == "AUTOMATIC"
    assert crossmatch.in_frame  # exact bounds are inclusive:
    exact = spark.range(1).select(
        crossmatch.in_frame(F.lit(-100.0), F.lit(1100.0), F.lit(1000), F.lit(1000)).alias("on"),
        crossmatch.in_frame(F.lit(-100.5), F.lit(0.0), F.lit(1000), F.lit(1000)).alias("off"),
    )
    assert tuple(exact.first()) == (True, False)


def test_zero_coordinates_only_skipped_in_strict_mode(spark):
    images = spark.createDataFrame([image(1, 0.0, 5.0, 1.0)], IMAGE)
    objects = spark.createDataFrame([("NGC", "A", 0.1, 5.0)], OBJECT)
    assert crossmatch.field_match(images, objects).count() == 1
    assert crossmatch.field_match(images, objects, strict_reference=True).count() == 0


def test_refresh_is_idempotent(sky):
    images, objects = sky
    found = crossmatch.field_match(images, objects).cache()
    manual = found.limit(20).withColumn("source", F.lit("MANUAL"))
    once = match_tables.refresh_matches(manual.unionByName(found.limit(100)), images, found)
    twice = match_tables.refresh_matches(once, images, found)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert once.select(*match_tables.MATCH_KEY).distinct().count() == once.count()
    assert once.filter("source = 'MANUAL'").count() == 20


def test_unmatched_images_keep_their_rows(spark):
    old = spark.createDataFrame(
        [(1, "NGC", "A", "AUTOMATIC"), (2, "NGC", "A", "AUTOMATIC")],
        "image_id long, catalog_type string, catalog_designation string, source string",
    )
    images = spark.createDataFrame([image(1, 1.0, 1.0, 1.0, False), image(2, 1.0, 1.0, 1.0)], IMAGE)
    kept = match_tables.refresh_matches(old, images, old.limit(0)).collect()
    assert [r.image_id for r in kept] == [1]


def test_cells_cover_every_position(spark):
    """Each object falls into a cell that the circle around it lists, at every level."""
    points = spark.range(0, 2000).select(
        F.col("id"), (F.col("id") * 0.18).alias("ra"), (F.col("id") * 0.09 - 90).alias("dec")
    )
    for level in range(geo.MAX_LEVEL + 1):
        radius = geo.BASE_HEIGHT * 2**level
        circles = crossmatch.image_cells(points.withColumn("r", F.lit(float(radius))), "ra", "dec", "r")
        levels = spark.range(geo.MAX_LEVEL + 1).select(F.col("id").cast("int").alias("_level"))
        own = crossmatch.catalog_cells(points, "ra", "dec", levels).select("id", "cell_id")
        assert circles.join(own, ["id", "cell_id"], "left_semi").select("id").distinct().count() == 2000


def test_pairs_of_an_image_meet_in_one_task(sky, monkeypatch):
    images, objects = sky
    monkeypatch.setattr(crossmatch, "PAIRS_PER_TASK", 1000)
    plan = crossmatch.field_match(images, objects, cap=50)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("SortMergeJoin")[0]
    assert "WindowGroupLimit" in above and "Exchange" not in above


def test_nearest_of_split_cells_and_repeated_images(sky, monkeypatch):
    images, objects = sky
    moved = images.withColumn("dec_center_degrees", -F.col("dec_center_degrees")).filter("id % 2 = 0")
    twice = images.unionAll(moved)
    pairs = crossmatch.circle_join(twice, objects).select("id", "catalog_type", "designation", "separation")
    want = sorted(map(tuple, crossmatch.nearest_per_type(pairs, 3).collect()))
    for limit, tested in ((20, 1000), (500_000, 1000), (500_000, 20_000_000)):
        monkeypatch.setattr(crossmatch, "PAIRS_PER_TASK", tested)
        found = crossmatch.circle_join(twice, objects, rows_per_task=limit, keep_cells=True)
        near = crossmatch.nearest_per_type(found, 3).select(*pairs.columns)
        assert sorted(map(tuple, near.collect())) == want


def test_coverage_of_carried_exposure_equals_the_join(sky, monkeypatch):
    from skyframe.operators import search, stats

    images, objects = sky
    images = images.withColumn("exposure_time_seconds", F.when(F.col("id") % 7 > 0, F.col("id") * 1.5))
    moved = images.withColumn("dec_center_degrees", -F.col("dec_center_degrees")).filter("id % 9 = 0")
    odd = images.withColumn("id", F.when(F.col("id") % 11 > 0, F.col("id")))
    objects = objects.unionAll(objects.filter("designation < 'O2'"))
    for tested in (20_000_000, 1000):
        monkeypatch.setattr(crossmatch, "PAIRS_PER_TASK", tested)
        for rows in (images, odd.unionAll(moved).unionAll(images.filter("id % 4 = 0"))):
            plain = crossmatch.field_match(rows, objects)
            carried = crossmatch.field_match(
                stats.with_exposure(rows), objects, keep=stats.EXPOSURE, keep_cells=True
            )
            for one, other in (
                (search.coverage(plain, rows), search.coverage(carried)),
                (stats.object_exposure(plain, rows), stats.object_exposure(carried)),
            ):
                values = [
                    sorted([tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in d.select(one.columns).collect()])
                    for d in (one, other)
                ]
                assert values[0] == values[1] and values[0]


def test_carried_exposure_shuffles_totals_only(sky, monkeypatch):
    from skyframe.operators import search, stats

    monkeypatch.setattr(crossmatch, "PAIRS_PER_TASK", 1000)
    images, objects = sky
    images = images.withColumn("exposure_time_seconds", F.lit(1.0))
    found = crossmatch.field_match(
        stats.with_exposure(images), objects, cap=50, keep=stats.EXPOSURE, keep_cells=True
    )
    plan = search.coverage(found)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert plan.count("Exchange") == 1
