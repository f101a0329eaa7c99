"""Global ranks, neighbours across ranges, and keyset pages against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from skyframe.operators import ranks, search


def frame(spark, n, seed=3):
    rng = random.Random(seed)
    # One rating holds a third of all rows, some have none.
    rows = [(k, rng.choice([5, 5, None, rng.randint(0, 4), rng.randint(0, 4), 1])) for k in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, rating int").repartition(7)


def by_hand(rows, order):
    sign = 1 if order == "asc" else -1
    return sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))


@pytest.mark.parametrize("n", [0, 1, 2, 500])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_ranks_and_neighbours(spark, n, order):
    rows, df = frame(spark, n)
    ids = [i for i, _ in by_hand(rows, order)]
    keys = search.image_order(df, "rating", order)
    got = {r.id: r for r in ranks.neighbours(df, keys).collect()}
    assert len(got) == n
    for k, i in enumerate(ids):
        want = (ids[k - 1] if k else None, ids[k + 1] if k + 1 < n else None, k + 1, n)
        assert (got[i].prev_id, got[i].next_id, got[i].position, got[i].total) == want
    ranked = ranks.ranked(df, keys).collect()
    assert sorted((r.position, r.id, r.rating, r.total) for r in ranked) == [(k + 1, i, v, n) for k, (i, v) in enumerate(by_hand(rows, order))]


def test_several_ranges_are_used(spark):
    """With ranges that are not put together, a hot value is spread and neighbours cross the borders."""
    rows, df = frame(spark, 400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = search.image_order(df, "rating", "asc")
        pieces = ranks._pieces(df, keys)
        assert pieces.select("_piece").distinct().count() == 4
        got = {r.id: (r.prev_id, r.next_id) for r in ranks.neighbours(df, keys).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [i for i, _ in by_hand(rows, "asc")]
    assert got == {i: (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None) for k, i in enumerate(ids)}


@pytest.mark.parametrize("page", [1, 7, 20, 99])
def test_a_page_at_any_depth(spark, page):
    rows, df = frame(spark, 300)
    got = ranks.page_at(df, search.image_order(df, "rating", "desc"), page, 15).orderBy("position").collect()
    assert [r.id for r in got] == [i for i, _ in by_hand(rows, "desc")][(page - 1) * 15 : page * 15]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_going_on_from_page_to_page(spark, order):
    rows, df = frame(spark, 60)
    df, shown, after = df.coalesce(1).cache(), [], None
    while part := search.page_after(df, "rating", order, after, 13).collect():
        shown += [r.id for r in part]
        after = (part[-1].rating, part[-1].id)
    assert shown == [i for i, _ in by_hand(rows, order)]


def test_deep_pages_have_no_single_task_sort(spark):
    _, df = frame(spark, 50)
    plan = ranks.page_at(df, [F.col("id")], 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
