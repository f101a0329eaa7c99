"""Template windows, slots and leaks, also against a plain search."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyframe.llm import decontaminate as D

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, window string, template long, item_id long"

ITEM = (
    "A farmer called Alice sells 12 apples at 3.50 dollars each while Bob sells 40 pears, and later Alice "
    "gives 7 kg of plums to Bob without asking anything in return for them."
)
OTHER = ITEM.replace("Alice", "Mary").replace("Bob", "Zoë").replace("12", "1,300").replace("3.50", "9").replace("7 kg", "88 lb")
MIXED = OTHER.replace("later Mary", "later Zoë")  # the same template, but names are used otherwise
FILL = "some words that were written before and have nothing to do with any of it"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], SCHEMA)


def found(spark, rows, items, **options):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.leaks(frame(spark, rows), benchmark, **options).collect()}


def test_words_and_slots(spark):
    text = "Alice met Bob. He had 1,200.5 km (30%) to go, and $5 for Tom's 3kg — Über 7 x. Eve"
    words = spark.createDataFrame([(text,)], "text string").select(D._words(F.col("text")).alias("w")).first().w
    shown = " ".join(words).replace(D.NAME, "n:").replace(D.NUMBER, "d:").replace(D.UNIT, "u:")
    assert shown == "alice met n:bob he had d:1,200.5 u:km d:30 u:% to go and d:5 for n:tom s d:3 u:kg n:über d:7 x eve"


def test_leaks_and_lookalikes(spark):
    rows = [
        (1, ITEM), (2, f"{FILL}. {ITEM} {FILL}"), (3, f"{FILL} {OTHER} {FILL}"), (4, f"{FILL} {MIXED}"), (5, FILL),
        (6, ITEM.upper()), (7, ITEM[:60]), (8, None), (9, ""), (10, f"{FILL} {OTHER} {MIXED}"), (None, ITEM),
        (11, "w " * 100_000 + ITEM), (12, ITEM.replace(" pears", " ripe pears").replace(",", " ;")),
    ]
    got = found(spark, rows, [(1, ITEM), (2, ITEM), (3, OTHER), (4, MIXED), (5, None), (6, "Bob 12"), (7, FILL)])
    by_item = defaultdict(set)
    for doc, item in got:
        by_item[item].add(doc)
    # In capitals the literal windows are left, which are those of the item itself.
    assert by_item[1] == by_item[2] == {1, 2, 3, 6, 10, 11, 12, None}
    assert by_item[3] == by_item[1] - {6}
    assert by_item[4] == {4, 10}
    assert by_item[7] == {2, 3, 4, 5, 10}
    assert set(by_item) == {1, 2, 3, 4, 7}
    assert got[1, 3].similarity == 1 and got[3, 1].similarity == 0.96  # "A" is a name after an unfinished sentence


GAMES = (
    "The red team scored 12 points in the first game, scored 15 points in the second game, scored 9 points in the third "
    "game and scored 20 points in the last game, so how many points per game did the red team score on average over the whole season?"
)
STEPS = "Now " + " then ".join(f"add {n} to the sum" for n in (3, 8, 3, 5, 8, 2)) + " and say what the sum is at the end of it all."


def test_templates_that_repeat_themselves(spark):
    """Verbatim, with words added, with other values used alike, and with one value used otherwise."""
    other = STEPS.replace("3", "71").replace("8", "64")
    rows = [
        (1, f"{FILL}. {GAMES} {FILL}"), (2, GAMES.replace("game and", "game of all and")), (3, GAMES.replace("15", "31").replace("9", "7")),
        (4, f"{FILL}. {STEPS} {FILL}"), (5, other), (6, f"{FILL}. {STEPS} {STEPS}"), (7, FILL),
        (8, f"{GAMES} In the new year the red team scored 30 points in the first game, scored 31 points in the second game."),
    ]
    got = found(spark, rows, [(1, GAMES), (2, STEPS)])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (8, 1), (4, 2), (5, 2), (6, 2)}
    assert all(got[k].similarity == 1 for k in [(1, 1), (4, 2), (6, 2), (8, 1)])


def test_literal_windows(spark):
    """Other capitals, passages inside a sentence, and items that have no window of three plain words."""
    named = (
        "When Alice meets Bob near the old bridge they count 14 boats while Carol and Dave sit on the wall and wait for the rain to stop."
    )
    capital, sums, people = "What is the capital city of this country", "12 + 15 + 18 - 20 = 25", "Then Alice Bob 12 Carol Dave 13 Eve"
    clauses, loud = "一年有多少天，一天有多少小时？", "WHO HAS THE LAST WORD IN ALL OF THIS"
    rows = [
        (1, named.lower()), (2, f"{FILL}. {named.upper()}"), (3, f"we then asked {capital}"), (4, f"{FILL} {sums} {FILL}"),
        (5, f"{FILL}. {people.lower()} {FILL}"), (6, f"{FILL}. {clauses}{FILL}"), (7, loud), (8, f"{FILL}. {loud.lower()}"),
        (9, "12 + 15 + 18 - 20 = 26 and 15 + 18 - 20 = 25"), (10, "一年有三天，一天有多少分钟？"), (11, f"{FILL} {people[5:20]} {FILL}"),
        (12, named.replace("Alice", "Zoë").replace("14", "15")), (13, named.replace("Alice", "Zoë").lower()), (14, named.title()),
    ]
    got = found(spark, rows, [(1, named), (2, capital), (3, sums), (4, people), (5, clauses), (6, loud)])
    assert set(got) == {(1, 1), (2, 1), (12, 1), (13, 1), (14, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 6)}
    assert all(got[k].similarity == 1 for k in [(1, 1), (2, 1), (12, 1), (14, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 6)])


def test_slices_change_nothing(spark):
    rows = [(1, ITEM), (2, OTHER), (3, MIXED), (4, FILL)]
    items = [(1, ITEM), (2, MIXED), (3, FILL)]
    assert found(spark, rows, items) == found(spark, rows, items, slice_rows=5)


def test_short_texts_are_one_window(spark):
    items = [(1, "three plain words"), (2, "two words"), (3, "one two three four")]
    got = found(spark, [(1, "Three, plain words!"), (2, "two words"), (3, "with three plain words here"), (4, "one two three four")], items)
    assert set(got) == {(1, 1), (4, 3)}


def test_repeated_ids_stand_each_for_itself(spark):
    half = len(ITEM) // 2
    cut = ITEM.index(" ", half)
    got = found(spark, [(1, ITEM[:cut]), (1, ITEM[cut - 40 :]), (2, ITEM[:cut]), (3, ITEM), (3, ITEM), (3, FILL)], [(1, ITEM)])
    assert set(got) == {(3, 1)}


@pytest.mark.parametrize("rows, items", [([], [(1, ITEM)]), ([(1, ITEM)], []), ([], [])])
def test_empty_tables(spark, rows, items):
    assert found(spark, rows, items) == {}


def test_against_a_plain_search(spark):
    """The given benchmark has no digits, and capital letters only where sentences begin: no slots."""
    docs, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found) for r in D.leaks(docs, benchmark).collect()}

    def windows(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    items = {r.item_id: windows(r.text) for r in benchmark.collect()}
    want = {}
    for r in docs.collect():
        mine = windows(r.text)
        for item, theirs in items.items():
            if (n := len(mine & theirs)) >= 0.8 * len(theirs):
                want[r.doc_id, item] = (len(theirs), n)
    assert set(got) == set(want) and len(want) > 20
    # The first word of a passage that stands inside a sentence passes for a name: up to one window less.
    assert all(n == want[k][0] and 0 <= want[k][1] - m <= 1 for k, (n, m) in got.items())


def test_capitals_and_rows_of_one_id(spark):
    """Copies in capitals are found wherever they stand; halves of an item in two rows of one id are not a copy."""
    story = "The old lighthouse keeper told his sister Margaret about the storm that sank three ships in November"
    half = story.index(" about")
    rows = [
        (1, story), (2, story.lower()), (3, story.upper()), (4, f"QUIZ: {story.upper()} END"), (5, f"{FILL}. {story.upper()} {FILL}"),
        (6, story[:half]), (6, story[half:]), (None, story[:half]), (None, story[half:]), (7, FILL), (7, story), (8, "Bob 12"), (9, "bob 13"),
    ]
    got = found(spark, rows, [(1, story), (2, "Bob 12")])
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 1), (8, 2)}
    assert all(r.similarity == 1 for r in got.values())
