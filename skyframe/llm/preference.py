"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common turn prefix of the two is the prompt and is rendered once; what follows it are the
two completions. Each completion comes with the mask of what a loss may count: the character ranges of
its assistant turns, end mark included, from and to counted in the completion, to exclusive.

A conversation becomes one row, as its rendered text is one; conversations meet one to one by their place
in the order of ids, so no group of them is ever gathered, however many say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import ranked, saved

START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Marks inside a text are broken up, so that no text can pass for a turn."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def conversations(turns: DataFrame) -> DataFrame:
    """``conv, turns``: an array of ``role, text`` in the order of ``turn``.

    NULL roles are ``unknown`` and NULL texts empty. Turns that repeat a number stand in the order of
    role and text; NULL numbers come first. NULL is a conversation of its own.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.struct("conv_id").alias("conv"), turn.alias("said"))
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))


def render(turns: Column) -> Column:
    """The turns as one text."""
    each = F.transform(turns, lambda t: F.concat(F.lit(START), _safe(t.role), F.lit("\n"), _safe(t.text), F.lit(END + "\n")))
    return F.array_join(each, "")


def mask(turns: Column) -> Column:
    """``start, end`` of the assistant turns in the rendered text, without the header, with the end mark."""
    head = lambda t: F.char_length(_safe(t.role)) + (len(START) + 1)
    size = lambda t: head(t) + F.char_length(_safe(t.text)) + (len(END) + 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    span = lambda a, t: F.array(F.struct((a.at + head(t)).alias("start"), (a.at + size(t) - 1).alias("end")))
    return F.aggregate(
        turns,
        empty,
        lambda a, t: F.struct(
            (a.at + size(t)).alias("at"),
            F.when(t.role == "assistant", F.concat(a.spans, span(a, t))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_id, status, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, trailing`` for each pair.

    ``pairs`` has ``pair_id`` and the turns of both sides, ``chosen_turns`` and ``rejected_turns``, as
    :func:`conversations` makes them, and may have ``trailing_turns``, which belong to neither side and
    are rendered in ``trailing`` (else NULL). ``n_common`` turns are common and make the prompt; equal turns
    have equal roles and texts. Status: ``ok``; ``identical`` if nothing follows the prompt on either side;
    ``unpaired`` if a side is NULL: the side that exists is then rendered whole, with its mask, and what
    the other side and the prompt would be is NULL.
    """
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    trailing = F.col("trailing_turns") if "trailing_turns" in pairs.columns else F.lit(None).cast(pairs.schema["chosen_turns"].dataType)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")
    rows = pairs.select(
        "pair_id", a, b, trailing.alias("trailing"), F.when(a.isNotNull() & b.isNotNull(), common).alias("n_common")
    )
    n, skipped = F.col("n_common"), F.coalesce("n_common", F.lit(0))
    rest = [F.slice(side, skipped + 1, F.greatest(F.size(side) - skipped, F.lit(0))) for side in (a, b)]
    rows = rows.select(
        "pair_id", "n_common", F.slice(a, 1, n).alias("common"), rest[0].alias("a"), rest[1].alias("b"), "trailing"
    )
    status = F.when(n.isNull(), "unpaired").when((F.size("a") == 0) & (F.size("b") == 0), "identical").otherwise("ok")
    return rows.select(
        "pair_id",
        status.alias("status"),
        "n_common",
        render(F.col("common")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        render(F.col("b")).alias("rejected"),
        F.when(F.col("a").isNotNull(), mask(F.col("a"))).alias("chosen_mask"),
        F.when(F.col("b").isNotNull(), mask(F.col("b"))).alias("rejected_mask"),
        render(F.col("trailing")).alias("trailing"),
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs for :func:`format_pairs`: each conversation against itself with a neighbour's replies.

    Conversations that reply are taken in the order of their ids (NULL first, gaps mean nothing) and paired
    two by two; the last one of an odd number is paired with the one before it. Chosen is the conversation
    up to its last assistant turn. Rejected parts from it at one of its assistant turns, number ``id modulo
    how many it has``, and goes on with as many assistant turns of the neighbour, or all if it has fewer,
    from the neighbour's first on, with the turns between them: replies that do not belong. What follows the
    last assistant turn is ``trailing_turns``. A conversation that never replies has no chosen side, and all
    its turns trail; the only one that replies has no rejected side. One pair for each conversation.
    """
    said = conversations(turns)
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.element_at("turns", k).role == "assistant")
    said = saved(said.withColumn("replies", replies), "conversations")
    has = F.size("replies") > 0
    place = ranked(said.where(has).select("conv", F.lit(0).alias("all")), "all", ["conv"]).select("conv", "pos", "n")
    rows = said.join(place, "conv", "left")
    pos, n = F.col("pos"), F.col("n")
    alone = (pos == n - 1) & (pos % 2 == 0)
    neighbour = F.when(alone, pos - 1).otherwise(pos.bitwiseXOR(F.lit(1).cast("long")))
    nth = F.pmod(F.coalesce(F.col("conv.conv_id"), F.lit(0)), F.size("replies")).cast("int")
    rows = rows.withColumn("neighbour", neighbour).withColumn("nth", F.when(has, nth))
    other = rows.where("pos IS NOT NULL").select(
        F.col("pos").alias("neighbour"), F.col("turns").alias("theirs"), F.col("replies").alias("their_replies")
    )
    rows = rows.join(other, "neighbour", "left")
    last = F.get("replies", F.size("replies") - 1)
    wanted = F.least(F.size("replies") - F.col("nth"), F.size("their_replies"))
    first, until = F.get("their_replies", F.lit(0)), F.get("their_replies", wanted - 1)
    kept = F.slice("turns", F.lit(1), F.get("replies", F.col("nth")) - 1)
    after = F.coalesce(last, F.lit(0))
    return rows.select(
        F.col("conv.conv_id").alias("pair_id"),
        F.slice("turns", F.lit(1), last).alias("chosen_turns"),
        F.concat(kept, F.slice("theirs", first, until - first + 1)).alias("rejected_turns"),
        F.slice("turns", after + 1, F.size("turns") - after).alias("trailing_turns"),
    )


def mask_text(mask: Column) -> Column:
    """A mask as ``start:end`` ranges joined by commas."""
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m.start, m.end)), ",")


_RENDERED = (
    "array_to_string(['<|im_start|>' || replace(t.role, '<|', '< |') || chr(10)"
    " || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10) FOR t IN {0}], '')"
)
_HEADS = "[length(replace(t.role, '<|', '< |')) + 13 FOR t IN {0}]"
_SIZES = "[length(replace(t.role, '<|', '< |')) + 13 + length(replace(t.text, '<|', '< |')) + 11 FOR t IN {0}]"
_MASK = (
    "array_to_string([(coalesce(list_sum({0}_z[1:k - 1]), 0) + {0}_h[k])::BIGINT || ':'"
    " || (list_sum({0}_z[1:k]) - 1)::BIGINT FOR k IN range(1, len({0}) + 1) IF {0}[k].role = 'assistant'], ',')"
)


def _text_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NOT NULL THEN coalesce({_RENDERED.format(name)}, '') END"


def _mask_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NOT NULL THEN coalesce({_MASK.format(name)}, '') END"


ORACLE = f"""
WITH said AS (
    SELECT conv_id,
           list({{'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}}
                ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS turns
    FROM conversations GROUP BY conv_id
), known AS (
    SELECT conv_id, turns, [k FOR k IN range(1, len(turns) + 1) IF turns[k].role = 'assistant'] AS r FROM said
), replying AS (
    SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
    FROM known WHERE len(r) > 0
), placed AS (
    SELECT *, CASE WHEN pos = n - 1 AND pos % 2 = 0 THEN pos - 1 ELSE xor(pos, 1) END AS neighbour,
           (((coalesce(conv_id, 0) % len(r)) + len(r)) % len(r))::BIGINT AS nth
    FROM replying
), pairs AS (
    SELECT p.conv_id AS pair_id, p.turns[1:p.r[len(p.r)]] AS a,
           CASE WHEN o.pos IS NOT NULL
                THEN p.turns[1:p.r[p.nth + 1] - 1] || o.turns[o.r[1]:o.r[least(len(p.r) - p.nth, len(o.r))]] END AS b,
           p.turns[p.r[len(p.r)] + 1:] AS rest
    FROM placed p LEFT JOIN placed o ON o.pos = p.neighbour
    UNION ALL SELECT conv_id, NULL, NULL, turns FROM known WHERE len(r) = 0
), cut AS (
    SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL
           THEN coalesce(list_position([a[k] IS NOT DISTINCT FROM b[k] FOR k IN range(1, greatest(len(a), len(b)) + 1)], false) - 1,
                         len(a)) END AS n_common
    FROM pairs
), parts AS (
    SELECT pair_id, n_common, a[1:n_common] AS p, a[coalesce(n_common, 0) + 1:] AS a, b[coalesce(n_common, 0) + 1:] AS b, rest
    FROM cut
), sized AS (
    SELECT pair_id, n_common, CASE WHEN n_common IS NOT NULL THEN p END AS p, a, b, rest,
           {_HEADS.format("a")} AS a_h, {_SIZES.format("a")} AS a_z, {_HEADS.format("b")} AS b_h, {_SIZES.format("b")} AS b_z
    FROM parts
)
SELECT pair_id,
       CASE WHEN n_common IS NULL THEN 'unpaired' WHEN len(a) = 0 AND len(b) = 0 THEN 'identical' ELSE 'ok' END AS status,
       n_common::INTEGER AS n_common,
       {_text_sql("p")} AS prompt, {_text_sql("a")} AS chosen, {_text_sql("b")} AS rejected,
       {_mask_sql("a")} AS chosen_mask, {_mask_sql("b")} AS rejected_mask, {_text_sql("rest")} AS trailing
FROM sized
"""
