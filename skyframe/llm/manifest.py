"""Merkle dataset manifest over concatenated-level strings.

Leaves stand in order within their group. Every aligned block of ``fanout ** levels`` leaves becomes one
row that holds each of its levels as one string of hexadecimal digests; the digests of the next level are
hashes of substrings of a fixed width, so a block is folded by SQL functions alone. The tops of the blocks
are the leaves of the next round, until a group has a single one, its subroot, and the subroots make a tree
of the same kind. On the way back a node's siblings are what flanks it in its run: two substrings of the
level's string.

No group is in one task: places come from sorted ranges, a block holds 512 rows, and a round leaves a
512th of the rows. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import crc32_sql, key_of, ranked, saved

#: Hexadecimal digits of a digest.
DIGITS = 64
FANOUT, LEVELS = 8, 3


def digest_of(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if NULL, else UTF-8 length, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return digest_of(*(F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` leads to along ``proof``, an array of ``left, right``."""
    return F.aggregate(proof, leaf, lambda node, s: digest_of(s.left, node, s.right))


def siblings_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s.left, s.right)), "")


def _parents(level: Column, fanout: int) -> Column:
    """The next level of a block: hashes of its runs."""
    width = DIGITS * fanout
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda k: digest_of(F.substring(level, k * width + 1, F.lit(width)))), "")


def _flanks(run: Column, place: Column) -> Column:
    """What stands left and right of the node at ``place`` in its run."""
    at = (place * DIGITS).cast("int")
    left, right = F.substring(run, F.lit(1), at), F.substring(run, at + (DIGITS + 1), F.length(run))
    return F.named_struct(F.lit("left"), left, F.lit("right"), right)


def _steps_taken(level: int, fanout: int) -> Column:
    """A level is folded as long as more than one node remains."""
    return F.col("n") > fanout**level


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Blocks of ``nodes(grp, pos, n, digest, item)``, then blocks of their tops, and so on.

    Rows: ``grp, block, n``, the ``items`` of the block in order, ``level0`` and on (NULL where a level
    is not folded) and ``top``.
    """
    size, out = fanout**levels, []
    while True:
        said = F.array_sort(F.collect_list(F.struct("pos", "digest", "item")))
        blocks = nodes.groupBy("grp", "n", F.floor(F.col("pos") / size).alias("block")).agg(said.alias("said"))
        blocks = blocks.withColumns(
            {"items": F.transform("said", lambda x: x["item"]), "level0": F.array_join(F.transform("said", lambda x: x.digest), "")}
        ).drop("said")
        for k in range(levels):
            blocks = blocks.withColumn(f"level{k + 1}", F.when(_steps_taken(k, fanout), _parents(F.col(f"level{k}"), fanout)))
        top = F.coalesce(*(f"level{k}" for k in range(levels, -1, -1)))
        out.append(saved(blocks.withColumn("top", top), "merkle-blocks"))
        wide = out[-1].where(F.col("n") > size)
        if wide.isEmpty():
            return out
        nodes = wide.select(
            "grp",
            F.col("block").alias("pos"),
            F.ceil(F.col("n") / size).alias("n"),
            F.col("top").alias("digest"),
            F.lit(None).cast("int").alias("item"),
        )


def _with_paths(blocks: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``grp, pos, digest, item, path, subroot, root`` for each node; ``above`` has the path of each block."""
    rows = blocks.join(above.withColumnRenamed("pos", "block"), ["grp", "block"])
    width = DIGITS * fanout
    runs = F.sequence(F.lit(0), F.floor((F.length("level0") - 1) / width).cast("int"))
    rows = rows.withColumn("run", F.explode(runs))
    none = F.array().cast("array<struct<left:string,right:string>>")
    path = F.col("path")
    for k in range(levels - 1, 0, -1):
        place = F.floor(F.col("run") / fanout ** (k - 1)).cast("int")
        peers = F.substring(f"level{k}", F.floor(place / fanout).cast("int") * width + 1, F.lit(width))
        path = F.concat(F.when(_steps_taken(k, fanout), F.array(_flanks(peers, place % fanout))).otherwise(none), path)
    rows = rows.select(
        "grp",
        "n",
        (F.col("block") * fanout**levels + F.col("run") * fanout).alias("first"),
        F.substring("level0", F.col("run") * width + 1, F.lit(width)).alias("peers"),
        path.alias("path"),
        "subroot",
        "root",
        F.posexplode(F.slice("items", F.col("run") * fanout + 1, fanout)).alias("place", "item"),
    )
    own = F.when(_steps_taken(0, fanout), F.array(_flanks(F.col("peers"), F.col("place")))).otherwise(none)
    return rows.select(
        "grp",
        (F.col("first") + F.col("place")).alias("pos"),
        F.substring("peers", F.col("place") * DIGITS + 1, F.lit(DIGITS)).alias("digest"),
        "item",
        F.concat(own, F.col("path")).alias("path"),
        "subroot",
        "root",
    )


def _descend(rounds: list[DataFrame], crown: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes of the first round with their paths; ``crown(grp, path, subroot, root)`` is what is above each group."""
    size, above = fanout**levels, None
    for k in range(len(rounds) - 1, -1, -1):
        # A group whose nodes fit into one block ends with this round.
        ended = rounds[k].where(F.col("n") <= size).select("grp", F.col("block").alias("pos")).join(crown, "grp")
        above = ended if above is None else above.unionByName(ended)
        rows = _with_paths(rounds[k], above, fanout, levels)
        if k:
            above = saved(rows.select("grp", "pos", "path", "subroot", "root"), "merkle-paths")
    return rows


def commit(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``grp, pos, digest, item, proof, subroot, root`` for each of ``leaves(grp, ord, digest, item)``.

    Leaves ascend by ``ord`` in their group and groups bytewise; ``item`` is any value that travels along.
    While a group has more than one node, every ``fanout`` consecutive ones (the last run may be shorter)
    become the digest of their concatenated digests; what remains is the subroot, and the subroots lead
    to the root likewise. ``proof`` lists the siblings of the leaf from level to level. Leaves with equal
    ``ord`` stand in the order of their digests; an empty table gives an empty result. A block of
    ``fanout ** levels`` digests is one row.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a block needs a fanout of two and one level at least")
    nodes = ranked(leaves, "grp", ["ord", "digest"]).select("grp", "pos", "n", "digest", "item")
    rounds = _rounds(nodes, fanout, levels)
    size = fanout**levels
    subroots = [r.where(F.col("n") <= size).select("grp", F.col("top").alias("digest")) for r in rounds]
    tops = subroots[0]
    for more in subroots[1:]:
        tops = tops.unionByName(more)
    # The tree of the subroots is one group of its own.
    tops = ranked(tops.select(F.lit("").alias("all"), "grp", "digest"), "all", ["grp"])
    crowns = _rounds(tops.select(F.col("all").alias("grp"), "pos", "n", "digest", F.col("grp").alias("item")), fanout, levels)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = crowns[-1].where(F.col("n") <= size).select("grp", none.alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    crown = _descend(crowns, root, fanout, levels)
    crown = saved(crown.select(F.col("item").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), "merkle-crown")
    return _descend(rounds, crown, fanout, levels).withColumnRenamed("path", "proof")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, presented: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: ``doc_id, lang, leaf, shown, subroot, root, proof``.

    ``leaf`` is the digest of ``fields``. ``shown`` is the digest of the same row with the columns in
    ``presented`` in place of the stored ones, as a copy of the data set would show it: ``fold`` it along
    ``proof`` and compare with ``root``. Groups are languages, NULL first, then bytewise; leaves ascend by
    ``doc_id``, NULL first, rows that repeat an id by their digest, and equal rows are leaves of their own.
    NULL, empty and long texts need no care; other columns are ignored; no documents, no rows.
    """
    presented = presented or {}
    rows = docs.select(
        key_of("lang").alias("grp"),
        F.col("doc_id").alias("ord"),
        leaf_digest(*(F.col(f) for f in fields)).alias("digest"),
        F.struct(
            "doc_id", "lang", leaf_digest(*(presented.get(f, F.col(f)) for f in fields)).alias("shown")
        ).alias("item"),
    )
    return commit(rows).select(
        "item.doc_id", "item.lang", F.col("digest").alias("leaf"), "item.shown", "subroot", "root", "proof"
    )


def checked(rows: DataFrame) -> DataFrame:
    """The digest form of :func:`manifest`: proofs as their SHA-256, and whether the shown row leads to the root."""
    rows = rows.withColumn("folded_root", fold(F.col("shown"), F.col("proof")))
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest_of(siblings_text(F.col("proof"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_text() -> Column:
    """The text with A-Z in lower case where 3 divides the checksum of the decimal id; a row without id stays as it is."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def _field(expression: str) -> str:
    return f"coalesce(strlen(({expression})::VARCHAR) || ':' || ({expression})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if f == "text" else f) for f in FIELDS) + ")"


#: Levels by recursion, then the siblings of each leaf by level, then the shown leaf folded along them.
ORACLE = f"""
WITH RECURSIVE checksums AS MATERIALIZED (
    SELECT *, {crc32_sql('doc_id::VARCHAR')} % 3 = 0 AS hit FROM documents
), leaves AS MATERIALIZED (
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf('text')}) - 1 AS place,
           {_leaf('text')} AS leaf, {_leaf(f"CASE WHEN hit THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS shown
    FROM checksums
), tree AS (
    SELECT lang, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
    UNION ALL
    SELECT lang, any_value(level) + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 7) // 8)
    FROM tree WHERE n > 1 GROUP BY lang, place // 8
), subroots AS MATERIALIZED (
    SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
    FROM tree WHERE n = 1
), crown AS (
    SELECT 0 AS level, place, subroot AS node, count(*) OVER () AS n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 7) // 8)
    FROM crown WHERE n > 1 GROUP BY place // 8
), steps AS MATERIALIZED (
    SELECT l.lang, l.place, t.level,
           coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place < l.place // (8 ** t.level)::BIGINT), '') AS lefts,
           coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (t.place > l.place // (8 ** t.level)::BIGINT), '') AS rights
    FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1
         AND t.place // 8 = l.place // (8 ** (t.level + 1))::BIGINT
    GROUP BY ALL
    UNION ALL
    SELECT l.lang, l.place, s.height + c.level,
           coalesce(string_agg(c.node, '' ORDER BY c.place) FILTER (c.place < s.place // (8 ** c.level)::BIGINT), ''),
           coalesce(string_agg(c.node, '' ORDER BY c.place) FILTER (c.place > s.place // (8 ** c.level)::BIGINT), '')
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
         JOIN crown c ON c.n > 1 AND c.place // 8 = s.place // (8 ** (c.level + 1))::BIGINT
    GROUP BY l.lang, l.place, s.height, c.level
), folded AS (
    SELECT lang, place, 0 AS level, shown AS node FROM leaves
    UNION ALL
    SELECT f.lang, f.place, f.level + 1, sha256(s.lefts || f.node || s.rights)
    FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.place = f.place AND s.level = f.level
), ends AS (
    SELECT lang, place, arg_max(node, level) AS folded_root FROM folded GROUP BY ALL
), proofs AS (
    SELECT lang, place, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY ALL
)
SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       e.folded_root, e.folded_root = r.node AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
     JOIN crown r ON r.n = 1
     JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.place = l.place
     LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place
"""
