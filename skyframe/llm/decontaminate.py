"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Names (capitalised words inside a sentence), numbers and units after a number are slots: a template
keeps a typed placeholder in their place, and each slot keeps its value beside it. Windows of five
template words are hashed; the windows of all documents meet those of the benchmark in a hash join.
A window counts only if at least three of its words are no slots. Texts of fewer than five words are
one window of their own length. In scripts that set no blanks every character is a word.

Beside its typed form a window has a literal one, its lower-case words without types, in the same join;
a window is found in either form. So it does not matter which capitals a copy has kept or gained. Items
without a window of three plain words are found where all their words stand one after another.

A re-parameterised question has the same template with other values, used alike: whatever fills a
slot of the item in one place must fill it in all places of that occurrence. Where it does not, the
occurrence loses the windows that hold this slot. A document leaks an item if it has four fifths of the
item's windows.

Only the benchmark is broadcast, in slices of ``slice_rows`` windows, each joined alike; a benchmark
of any size works. No two documents are ever compared, and hits are counted within a document before
they are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.common import saved, text_or_empty

WINDOW = 5
MIN_LITERALS = 3
SIMILARITY = 0.8
#: Windows of the benchmark that are broadcast at a time: about 30 MB.
SLICE_ROWS = 1_000_000

#: Marks of the slot types, from the private-use area; texts lose such characters first.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
_AFTER_MARKS = "\ue003"

#: Scripts without blanks: Thai, Lao, Burmese, Khmer, Kana and Han.
_UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"

# Units that are recognised after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "pound pounds lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents degree degrees mph kmh km/h hz khz mhz ghz "
    "w kw mw v a kb mb gb tb"
).split()


def _annotated(text: Column) -> Column:
    """Lower-case words in which each slot is its mark followed by its value."""
    plain = F.regexp_replace(text, f"[{NAME}-{UNIT}]", " ")
    plain = F.regexp_replace(plain, rf"{_UNSPACED}\p{{M}}*", " $0 ")
    # A capitalised word inside a sentence: after a word, a comma or a dash, and a blank.
    names = F.regexp_replace(plain, r"\p{Lu}(?<=[\p{L}\p{N},\u2013\u2014-] .)[\p{L}\p{M}]*", NAME + "$0")
    numbers = F.regexp_replace(F.lower(names), r"[0-9]+(?:[.,:/][0-9]+)*", " " + NUMBER + "$0 ")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return F.regexp_replace(numbers, rf"({NUMBER}\S+) +(%|(?:{units})(?![\p{{L}}/]))", f"$1 {UNIT}$2 ")


def _words(text: Column) -> Column:
    """The annotated words; all but letters, digits and what joins digits parts them."""
    parted = r"(?:[^\p{L}\p{M}\p{N}%/.,:" + NAME + NUMBER + UNIT + r"]|(?<![0-9])[/.,:]|[/.,:](?![0-9])|(?<!" + UNIT + r")%)+"
    return F.filter(F.split(_annotated(text), parted), lambda w: w != "")


def _is_slot(word: Column) -> Column:
    return (word >= NAME) & (word < _AFTER_MARKS)


def _filled_up(codes: Column) -> Column:
    """Short texts are filled up with 0."""
    missing = F.when(F.size(codes) > 0, F.greatest(F.lit(WINDOW) - F.size(codes), F.lit(0))).otherwise(0)
    return F.concat(codes, F.array_repeat(F.lit(0).cast("long"), missing))


def _code(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 1)


def _codes(words: Column) -> Column:
    """1 to 3 for the slot types, a large number for each plain word, and 0 to fill up short texts."""

    def code(w: Column) -> Column:
        slot = F.when(w < NUMBER, 1).when(w < UNIT, 2).otherwise(3).cast("long")
        return F.when(_is_slot(w), slot).otherwise(_code(w))

    return _filled_up(F.transform(words, code))


def _literal_codes(words: Column) -> Column:
    """The same with slots as plain words."""
    value = lambda w: F.when(_is_slot(w), F.substr(w, F.lit(2))).otherwise(w)
    return _filled_up(F.transform(words, lambda w: _code(value(w))))


def _window(codes: Column, at: Column) -> Column:
    """The hash of the window that begins ``at``; NULL with fewer than three plain words."""
    parts = [F.get(codes, at + k) for k in range(WINDOW)]
    plain = reduce(lambda a, b: a + b, [(p > 3).cast("int") for p in parts])
    return F.when(plain >= MIN_LITERALS, F.xxhash64(*parts))


def _literal_window(literals: Column, at: Column) -> Column:
    """The hash of the literal window that begins ``at``."""
    return F.xxhash64(*(F.get(literals, at + k) for k in range(WINDOW)))


def _starts(codes: Column) -> Column:
    """Where windows begin."""
    return F.when(F.size(codes) >= WINDOW, F.sequence(F.lit(0), F.size(codes) - WINDOW))


def _slot_starts(codes: Column) -> Column:
    """Where windows begin that hold a slot; all others are alike in both forms."""
    slots = F.array_compact(F.transform(codes, lambda c, k: F.when((c > 0) & (c <= 3), k)))
    last = F.size(codes) - WINDOW
    return F.array_distinct(F.flatten(F.transform(slots, lambda k: F.sequence(F.greatest(k - WINDOW + 1, F.lit(0)), F.least(k, last)))))


def _slots(words: Column, at: Column) -> Column:
    """The slots of the window that begins ``at``, as marks with values."""
    return F.filter(F.slice(words, at + 1, WINDOW), _is_slot)


def _coded(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep.., codes, literals, slot_starts`` of the column ``words``."""
    # One projection for each step: inside one expression the words would be cut out anew at each use.
    rows = rows.select(*keep, _codes(F.col("words")).alias("codes"), _literal_codes(F.col("words")).alias("literals"))
    return rows.withColumn("slot_starts", _slot_starts(F.col("codes")))


def _both_forms(make) -> Column:
    """``make(at, window)`` for each typed window and for each literal one that holds a slot."""
    typed = F.transform(_starts(F.col("codes")), lambda at: make(at, _window(F.col("codes"), at)))
    literal = lambda at: make(at, _literal_window(F.col("literals"), at))
    return F.concat(typed, F.transform("slot_starts", literal))


def benchmark_templates(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``template, item_id`` and ``template, words``; items with the same words share a template."""
    items = benchmark.select(F.col(id_col).alias("item_id"), _words(text_or_empty(text_col)).alias("words"))
    shapes = saved(items.select("words").distinct().withColumn("template", F.monotonically_increasing_id()), "templates")
    return items.join(shapes, "words").select("template", "item_id").distinct(), shapes


def benchmark_windows(templates: DataFrame) -> DataFrame:
    """``window, template, unit, item_at, item_slots, literal, exact``: every form of every window.

    ``unit`` is what is counted, the typed window. Templates without one are ``exact``: their units are
    the literal windows, and their slots are not compared.
    """
    at, literals = F.col("item_at"), F.col("literals")
    rows = _coded(templates, "template", "words").withColumn("item_at", F.explode(_starts(F.col("codes"))))
    rows = rows.select(
        "template",
        "item_at",
        _window(F.col("codes"), at).alias("typed"),
        _literal_window(literals, at).alias("folded"),
        _slots(F.col("words"), at).alias("item_slots"),
    )
    rows = saved(rows, "benchmark-places")
    whole = rows.groupBy("template").agg(F.count("typed").alias("n_typed"))
    rows = rows.join(whole, "template").withColumn("exact", F.col("n_typed") == 0)
    rows = rows.where(F.col("exact") | F.col("typed").isNotNull())
    unit = F.when(F.col("exact"), F.col("folded")).otherwise(F.col("typed")).alias("unit")
    slots = F.when(~F.col("exact"), F.col("item_slots")).otherwise(F.array().cast("array<string>")).alias("item_slots")
    # Without a slot both forms are one.
    parts = [
        rows.where(F.col(c).isNotNull() & (~F.lit(literal) | F.col("exact") | (F.size("item_slots") > 0))).select(
            F.col(c).alias("window"), "template", unit, "item_at", slots, F.lit(literal).alias("literal"), "exact"
        )
        for c, literal in (("typed", False), ("folded", True))
    ]
    return reduce(DataFrame.unionByName, parts)


def _meet(windows: DataFrame, items: DataFrame, slices: int) -> DataFrame:
    """The join on ``window``, with one slice of the benchmark broadcast at a time."""
    parts = [windows.join(F.broadcast(items.where(F.pmod("window", F.lit(slices)) == k)), "window") for k in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def _consistent(hits: DataFrame, similarity: float) -> DataFrame:
    """The ``hits`` of each occurrence without those that hold a slot of the item that is filled in two ways.

    A shift is the distance of a place in the document from its place in the item, and every shift that
    is met is the middle of an occurrence: words that were added or left out shift what follows a little.
    Of the hits around it, those count that are nearest to it both for their place in the document and
    for their place in the item, so a template that repeats itself is compared place by place.
    """
    key = ["doc", "template", "middle"]
    reach = F.floor((1 - F.lit(similarity)) * F.col("n_windows") + 1)
    hits = hits.withColumn("shift", F.col("at") - F.col("item_at")).withColumn("reach", reach)
    cell = F.floor(F.col("shift") / (F.col("reach") + 1))
    middles = hits.select("doc", "template", cell.alias("cell"), F.col("shift").alias("middle")).distinct()
    around = hits.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(middles, ["doc", "template", "cell"])
    around = around.withColumn("off", F.abs(F.col("shift") - F.col("middle"))).where("off <= reach")
    for place in ("at", "item_at"):
        around = around.withColumn(f"least_{place}", F.min("off").over(Window.partitionBy(*key, place)))
    near = around.where("off = least_at AND off = least_item_at").select(*key, "unit", "at", "item_at", "item_slots", "slots")
    near = saved(near, "slot-places")
    filled = near.select(*key, "at", "item_at", F.inline(F.arrays_zip("item_slots", "slots")))
    clashes = filled.groupBy(*key, "item_slots").agg((F.min("slots") != F.max("slots")).alias("clash")).where("clash")
    clashing = filled.join(clashes, [*key, "item_slots"], "left_semi").select(*key, "at", "item_at").distinct()
    return near.join(clashing, [*key, "at", "item_at"], "left_anti")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    slice_rows: int = SLICE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_windows, n_found, similarity`` for every document that holds an item.

    ``n_windows`` are the distinct windows of the item and ``n_found`` those of them that the document
    has. Items without a window of three plain words must be there word by word, those of fewer words than
    a window as the whole document. Capitals make no difference to literal windows. NULL texts count as
    empty and hold nothing. Rows that repeat an id, NULL ids too, stand each for itself: they give a row
    each, or one if their texts are equal. Other columns are ignored.
    """
    of_items, templates = benchmark_templates(benchmark)
    items = saved(benchmark_windows(templates), "benchmark-windows")
    sizes = items.groupBy("template").agg(
        F.count_distinct("unit").alias("n_windows"), F.count_distinct("item_at").alias("n_places"), F.max("exact").alias("exact")
    )
    slices = max(1, math.ceil(items.count() / slice_rows))
    share = F.when(F.col("exact"), 1.0).otherwise(similarity)
    enough = F.col("n_found") >= F.ceil(share * F.col("n_windows") - 1e-9)
    by_place = (F.size("item_slots") > 0) | F.col("exact")

    # Inside a struct a NULL id is equal to itself, also as a key of the joins below; the text parts rows of one id.
    text = text_or_empty(text_col)
    worded = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key")).alias("doc"), _words(text).alias("words")
    )
    found = _coded(worded, "doc").select("doc", F.explode(_both_forms(lambda at, window: window)).alias("window"))
    found = found.where("window IS NOT NULL")
    found = _meet(found, items.select("window", "template", "unit", by_place.alias("by_place")).distinct(), slices)
    found = found.groupBy("doc", "template").agg(
        F.count_distinct("unit").alias("n_found"),
        F.count_distinct(F.when(~F.col("by_place"), F.col("unit"))).alias("n_plain"),
    )
    found = saved(found.join(sizes, "template").where(enough), "template-hits")

    # What fills the slots is compared in the documents that are left.
    held = saved(found.where("n_found > n_plain").select("doc", "template", "n_windows", "n_places"), "slot-hits")
    suspects = worded.join(held.select("doc").distinct(), "doc", "left_semi")
    place = lambda at, window: F.struct(at.alias("at"), window.alias("window"), _slots(F.col("words"), at).alias("slots"))
    suspects = _coded(suspects, "doc", "words").select("doc", F.inline(_both_forms(place))).where("window IS NOT NULL")
    hits = _meet(suspects, items.where(by_place), slices).join(held, ["doc", "template"])
    # Literal windows fill every slot with its own value.
    hits = saved(hits.withColumn("slots", F.when(F.col("literal"), F.col("item_slots")).otherwise(F.col("slots"))), "slot-windows")
    good = _consistent(hits.where("NOT exact"), similarity).groupBy("doc", "template").agg(F.count_distinct("unit").alias("n_good"))
    runs = hits.where("exact").groupBy("doc", "template", "n_windows", "n_places", F.col("at") - F.col("item_at"))
    runs = runs.agg(F.count_distinct("item_at").alias("n")).where("n = n_places")
    good = good.unionByName(runs.select("doc", "template", F.col("n_windows").alias("n_good")).distinct())

    found = found.join(good, ["doc", "template"], "left")
    found = found.withColumn("n_found", F.col("n_plain") + F.coalesce("n_good", F.lit(0))).where(enough)
    return found.join(of_items, "template").select(
        "doc.doc_id", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("similarity")
    )
