"""Physical plans: what must and must not be in them."""

import pytest

from checks.fixtures import table, view
from checks.match_queries import matches
from skyframe.operators import filters, search, stats
from skyframe.operators.filters import ImageFilter

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = f"{tmp_path}/images"
    view(spark, SF, "images").write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(stored):
    flt = ImageFilter(
        subtype="SUB_FRAME", format="FIT", rating=3, exposure_min=1, path="/data/mount1",
        start_date="1995-01-01", solve_state="solved",
    )
    text = plan(flt.apply(stored).select("id"))
    for part in (
        "EqualTo(subtype,SUB_FRAME)", "In(file_format, [FIT,FITS])", "GreaterThanOrEqual(rating,3)",
        "GreaterThanOrEqual(exposure_time_seconds,1.0)", "StringStartsWith(file_path,/data/mount1)",
        "GreaterThanOrEqual(capture_date", "EqualTo(astrometry_status,SOLVED)",
    ):
        assert part in text.replace("[FITS,FIT]", "[FIT,FITS]"), part


def test_declination_band_of_the_cone_reaches_the_scan(stored):
    text = plan(ImageFilter(ra=10, dec=20, radius=2).apply(stored).select("id"))
    assert "GreaterThanOrEqual(dec_center_degrees" in text


def test_only_needed_columns_are_read(stored):
    text = plan(stats.by_subtype(stored))
    assert "ReadSchema: struct<subtype:string,exposure_time_seconds:double>" in text


def test_pages_are_top_k_not_sorts(stored):
    page, _ = search.search_page(stored, ImageFilter(), page=3, size=20)
    text = plan(page)
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_object_search_does_not_multiply_images(spark, stored):
    stars = view(spark, SF, "catalog").filter("catalog_type = 'NAMED_STAR'")
    found = ImageFilter(object_name="red rod").apply(stored, matches(spark, SF), stars)
    assert found.select("id").distinct().count() == found.count()
    assert "LeftSemi" in plan(found)


def test_library_queries_stay_in_the_jvm(spark):
    import __spark_entry__ as driver

    allowed = {"n3_stuck_submissions"}
    for name, build in driver.queries().items():
        if name[0] in "fbhe" and name not in allowed:
            text = plan(build(spark, SF))
            assert "Python" not in text and "InPandas" not in text, name
            assert "CartesianProduct" not in text, name


def test_usage_counts_in_one_scan(spark):
    images = view(spark, SF, "images")
    text = plan(stats.usage(images, ["camera_name", "telescope_name", "filter_name"]))
    assert text.count("FileScan") == 1


def test_header_browser(spark):
    rows = table(spark, SF, "orders").limit(3).selectExpr("o_orderkey AS id", "map('A', 'x', 'B', null) AS h")
    assert filters.header_entries(rows, "h", ["id"], "nul").count() == 3
    assert filters.header_entries(rows, "h", ["id"]).count() == 6
