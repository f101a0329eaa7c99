"""Conversation prefix trie by time-forward processing.

Every distinct sequence of first turns is a node. Nodes are told apart by a digest of their path, which
is an XOR over the digests of place and turn, so it comes from running sums over blocks of turns and no
conversation has to be in one piece. What a subtree adds up to is passed from the deepest nodes towards
the root: nodes are put in order by falling depth with Spark's external sort, and a node sends its totals
forward in time to its parent through a priority queue that spills to disk.

Shards are subtrees. A node whose subtree may hold more than the square root of all turns is heavy; the
first node below the heavy ones is the root of a shard. Shards run side by side, what their roots send is
summed by parent, and the same pass over the few heavy nodes ends it. A turn that a third of the
conversations begin with is heavy, so what follows it is spread over many shards.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.common import bucket_count, crc32_sql, ranked, saved

#: A word, as conversations are counted in.
WORD = r"[^\x20\x09-\x0D]+"
ROOT = "0" * 30
#: Turns of a conversation whose digests are summed up in one run.
BLOCK_TURNS = 1024


def ordered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, n, said, words``: the place of each turn in its conversation, which has ``n`` turns.

    Turns ascend by ``turn``, NULL first; those that share one stand in the order of the digest of role and
    text. NULL roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left
    out; other columns are ignored. ``said`` is the digest of role and text, ``words`` counts the text's.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", said.alias("said"), words.alias("words"))
    return ranked(rows, "conv_id", ["turn", "said"]).drop("turn")


def rebuilt(own: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their block: ``conv_id, depth, said, words`` and ``conv_id, length``.

    ``own`` is as :func:`ordered` makes it. The first h turns of conversation c come from conversation
    ``c - c % block``, or as many as it has, and c's own turns after its first h follow; h is the CRC-32
    of the decimal id modulo ``heads``. All conversations are in the second table, turnless ones too.
    """
    convs = own.where("pos = 0").select(
        "conv_id",
        "n",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % block).alias("base"),
    )
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "n", "h", taken.alias("taken"))
    convs = saved(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    first = own.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "taken").join(first, "base").where("pos < taken")
    first = first.select("conv_id", (F.col("pos") + 1).alias("depth"), "said", "words")
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "said", "words")
    return first.unionByName(rest), convs.select("conv_id", "length")


def _half(digest: Column, first: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")


def _key(*halves: str | Column) -> Column:
    return F.concat(*(F.lpad(F.hex(h), 15, "0") for h in halves))


def paths(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, depth, key, parent, words, length`` for each prefix of each conversation, the empty one included."""
    place = F.sha2(F.concat("depth", F.lit(":"), "said").cast("binary"), 256)
    run = F.floor((F.col("depth") - 1) / block_turns).alias("run")
    rows = turns.join(convs, "conv_id").select("conv_id", "depth", run, place.alias("place"), "words", "length")
    rows = rows.select("conv_id", "depth", "run", "words", "length", *(_half(F.col("place"), 1 + 15 * k).alias(f"own{k}") for k in (0, 1)))
    rows = saved(rows, "trie-turns")
    along = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv_id", "run").agg(*(F.bit_xor(f"own{k}").alias(f"all{k}") for k in (0, 1)))
    runs = runs.select("conv_id", "run", *(F.coalesce(F.bit_xor(f"all{k}").over(along), F.lit(0)).alias(f"before{k}") for k in (0, 1)))
    upto = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"in{k}": F.bit_xor(f"own{k}").over(upto) for k in (0, 1)}).join(runs, ["conv_id", "run"])
    inside = inside.withColumns({f"key{k}": F.col(f"in{k}").bitwiseXOR(F.col(f"before{k}")) for k in (0, 1)})
    inside = inside.select(
        "conv_id",
        "depth",
        _key("key0", "key1").alias("key"),
        _key(*(F.col(f"key{k}").bitwiseXOR(F.col(f"own{k}")) for k in (0, 1))).alias("parent"),
        "words",
        "length",
    )
    none = F.lit(None).cast("string")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), none.alias("parent"), F.lit(0).cast("long").alias("words"), "length")
    return inside.unionByName(root)


class SpillingQueue:
    """Messages ``(-depth, key, leaves, saved)`` in the order of ``-depth`` and ``key``.

    At most ``limit`` messages are in memory. Beyond that the later half, which is needed last, goes to a
    sorted run in a file that the task alone sees and that ends with it; ``fan`` runs are merged into one.
    """

    def __init__(self, limit: int = 200_000, fan: int = 32) -> None:
        self.limit, self.fan, self.heap, self.runs = max(2, limit), fan, [], []

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        file.seek(0)
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _spill(self, messages) -> None:
        file, page = tempfile.TemporaryFile(), []
        for message in messages:
            page.append(message)
            if len(page) == 1024:
                pickle.dump(page, file)
                page = []
        pickle.dump(page, file)
        rest = self._read(file)
        self.runs.append((next(rest), len(self.runs), rest))
        heapq.heapify(self.runs)

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self.heap.sort()
            later = self.heap[self.limit // 2 :]
            del self.heap[self.limit // 2 :]
            self._spill(later)
            if len(self.runs) > self.fan:
                runs, self.runs = self.runs, []
                self._spill(heapq.merge(*(_chain(first, rest) for first, _, rest in runs)))

    def pop(self, place: tuple[int, str]) -> list[tuple]:
        """The messages to the node at ``place``, which no later node precedes."""
        out = []
        while self.heap and self.heap[0][:2] == place:
            out.append(heapq.heappop(self.heap))
        while self.runs and self.runs[0][0][:2] == place:
            first, number, rest = self.runs[0]
            out.append(first)
            following = next(rest, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, rest))
        return out


def _chain(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


_TOTALS = "key string, shard string, parent string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _forward(limit: int):
    """Adds up what nodes send to their parents; nodes come by falling depth, then key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue = SpillingQueue(limit)
        for batch in batches:
            totals = []
            columns = ("key", "shard", "parent", "depth", "n_children", "n_leaves", "saved_tokens")
            for key, shard, parent, depth, children, leaves, tokens in zip(*(batch[c] for c in columns), strict=True):
                for _, _, more_leaves, more_tokens in queue.pop((-depth, key)):
                    children, leaves, tokens = children + 1, leaves + more_leaves, tokens + more_tokens
                leaves = leaves if children else 1
                totals.append((children, leaves, tokens))
                if key != shard:
                    queue.push((1 - depth, parent, leaves, tokens))
            yield batch.assign(**{c: [t[k] for t in totals] for k, c in enumerate(("n_children", "n_leaves", "saved_tokens"))})

    return run


def _in_time_order(nodes: DataFrame) -> DataFrame:
    return nodes.sortWithinPartitions(F.desc("depth"), "key")


def subtree_totals(nodes: DataFrame, rows: DataFrame, heavy_weight: int, queue_limit: int) -> DataFrame:
    """``nodes`` with ``n_children, n_leaves, saved_tokens`` over their subtrees."""
    heavy = nodes.where(F.col("weight") > heavy_weight)
    # Weights fall along a path, so the first node that is not heavy is the root of the shard of all below it.
    light = rows.join(heavy.select("key", F.lit(True).alias("heavy")), "key", "left").where("heavy IS NULL")
    shards = light.groupBy("conv_id").agg(F.min(F.struct("depth", "key")).getField("key").alias("shard"))
    start = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves")]
    columns = ["key", "shard", "parent", "conv_id", "depth", "n_convs"]
    within = nodes.where(F.col("weight") <= heavy_weight).join(shards, "conv_id").select(*columns, *start, "saved_tokens")
    within = saved(_in_time_order(within.repartition("shard")).mapInPandas(_forward(queue_limit), _TOTALS), "trie-shards")
    sent = within.where("key = shard").groupBy(F.col("parent").alias("key"))
    sent = sent.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("tokens"))
    got = lambda c: F.coalesce(c, F.lit(0))
    across = heavy.join(sent, "key", "left").select(
        "key",
        F.lit(ROOT).alias("shard"),
        "parent",
        "conv_id",
        "depth",
        "n_convs",
        got("children").alias("n_children"),
        got("leaves").alias("n_leaves"),
        (F.col("saved_tokens") + got("tokens")).alias("saved_tokens"),
    )
    across = _in_time_order(across.repartition(1)).mapInPandas(_forward(queue_limit), _TOTALS)
    return within.unionByName(across)


#: Characters of a piece of a list of ids.
PIECE = 65_536


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one node, comma-joined in pieces of bounded length; ids come in order."""
    now, first, ids, length = None, None, [], 0
    for batch in batches:
        out = []
        for key, conv in zip(batch["key"], batch["conv_id"], strict=True):
            if key != now or length > PIECE:
                if ids:
                    out.append((now, first, ",".join(ids)))
                now, first, ids, length = key, conv, [], 0
            ids.append(str(conv))
            length += len(ids[-1]) + 1
        yield pd.DataFrame(out, columns=["key", "first", "ids"])
    if ids:
        yield pd.DataFrame([(now, first, ",".join(ids))], columns=["key", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest for each node, fed piece by piece."""
    now, digest = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch["key"], batch["ids"], strict=True):
            if key != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if digest:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["key", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """``key, ends_sha256``: of the ids that end at a node, ascending and comma-joined.

    A digest is sequential, so a node's pieces meet in one task, but as a stream of strings, never as rows
    of single ids and never at once.
    """
    ends = rows.where("depth = length").select("key", "conv_id")
    ends = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = saved(ends.mapInPandas(_pieces, "key string, first long, ids string"), "trie-ends")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "first")
    return pieces.mapInPandas(_hashed, "key string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block_turns: int = BLOCK_TURNS, queue_limit: int = 200_000, heavy_weight: int | None = None) -> DataFrame:
    """One row per node of the trie over ``turns(conv_id, depth, said, words)`` of ``convs(conv_id, length)``.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (NULL for the root), ``n_convs``
    the members, ``n_children, n_leaves`` and ``saved_tokens`` are over the subtree, the node included:
    each node saves its turn's words for all members but one. ``ends_sha256`` is the digest of the
    members that end here. Equal turns have equal ``said``; ids must be unique in ``convs`` and depths
    gapless from 1. No conversations, no nodes; conversations without turns are members of the root.

    ``queue_limit`` bounds the messages that a task holds in memory; ``heavy_weight`` is the weight beyond
    which a node belongs to no shard (the square root of the turns if not given); neither changes a row.
    """
    rows = saved(paths(turns, convs, block_turns), "trie-paths")
    nodes = rows.groupBy("key").agg(
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        ((F.count("*") - 1) * F.max("words")).alias("saved_tokens"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    nodes = saved(nodes, "trie-nodes")
    limit = bucket_count(rows.count()) if heavy_weight is None else heavy_weight
    totals = saved(subtree_totals(nodes, rows, limit, queue_limit), "trie-totals")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nobody = F.lit(hashlib.sha256().hexdigest())
    return (
        totals.join(parents, "parent", "left")
        .join(end_digests(rows), "key", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
        )
    )


ORACLE = rf"""
WITH said AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || t)) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT DISTINCT conv_id, {crc32_sql("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM said
), rebuilt AS (
    SELECT c.conv_id, s.pos AS k, s.r, s.t FROM convs c JOIN said s ON s.conv_id = c.base AND s.pos < c.h
    UNION ALL
    SELECT c.conv_id, s.pos + 4, s.r, s.t FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.pos >= c.h
), sequences AS (
    SELECT c.conv_id, coalesce(list({{'r': b.r, 't': b.t}} ORDER BY b.k) FILTER (b.k IS NOT NULL), []) AS turns
    FROM convs c LEFT JOIN rebuilt b ON b.conv_id = c.conv_id GROUP BY c.conv_id
), members AS (
    SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM sequences)
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(path[d].t, '{WORD}')) ELSE 0 END AS own,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY path, d
), children AS (
    SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), sums AS (
    SELECT path[1:above] AS path, count(*) FILTER (leaf) AS n_leaves, sum(own)::BIGINT AS saved_tokens
    FROM (SELECT n.path, n.own, c.n IS NULL AS leaf, unnest(range(n.d + 1)) AS above
          FROM nodes n LEFT JOIN children c ON c.path = n.path)
    GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN children c ON c.path = n.path
     LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
