"""Secret scan with a random forest that takes out false positives, in DataFrame functions only.

Every run of 16 or more key characters in a text is a candidate; '.' may join its parts and '=' only pad
its end. What is assigned to a secret's name is one from four characters on, whatever they are. Features are the length, how often
the character class changes and how even the characters are spread, the share of letters that common
syllables and words cover, whether it stands in a path or an address, and the words on both sides.
The forest is trained on labelled findings, at most ``max_labelled`` of them; without any at hand,
:func:`weak_labels` labels the clear cases of the corpus, and the forest judges all the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import hash_sample, saved, text_or_empty

KEY_CHARS = "A-Za-z0-9_+/=-"
SHORTEST = 16
#: What is assigned to a secret's name may be as short as this.
SHORTEST_NAMED = 4
#: Characters on either side that are looked at.
CONTEXT = 48

# Words before a secret, words before other long values, and syllables of common words.
SECRET_WORDS = "token secret password passwd pwd apikey api_key access_key private_key credential bearer auth key"
OTHER_WORDS = "sha sha1 sha256 md5 digest checksum commit hash uuid guid etag id ref build version example sample test dummy"
SYLLABLES = (
    "tion ment ing ness able ible ough ight and the for that with this from have which their there about would "
    "ern est ent ant ial ous ive ful less ship ward like over under inter trans super "
    "sch ung heit keit lich isch ver ein der die das und auf aus ich cht eau eux elle ier ait oir que "
    "cion mente dad ado ada idad los las del para por esta ando iendo res con per pro str er an on in en es "
    "re st ti he nd nt th ha or to ed it is at of ea ou sh wh ly"
).split()

FEATURES = (
    "length", "classes", "class_changes", "distinct", "digits", "capitals", "hexadecimal", "vowels", "covered",
    "slashes", "in_path", "in_address", "quoted", "assigned", "secret_word", "other_word", "word_before", "word_after",
)


_KEY = KEY_CHARS.replace("=", "")
_NAMED = rf"(?i:{'|'.join(SECRET_WORDS.split())})[\"']?[ \t]{{0,4}}[:=]>?[ \t]{{0,4}}"
#: A first look at what comes right before, as most places fail it.
_ASSIGNED = r"(?<=[:=>\"'`][ \t]{0,4})"
_PLAIN = r"""[^\s"'`,;&<>(){}\[\]|\\]"""


def _token(shortest: int) -> str:
    """A run of key characters with dots inside and '=' at the end, all counted."""
    part = rf"(?:[{_KEY}]|\.(?=[{_KEY}]))"
    lengths = "|".join(f"{part}{{{shortest - k}}}{'=' * k}{'(?![=' + _KEY + '])' if k else ''}" for k in range(3))
    return rf"(?=[{_KEY}])(?={lengths})[{_KEY}]++(?:\.[{_KEY}]++)*+(?:={{1,2}}(?![={_KEY}]))?+"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, value, before, after`` of all long runs of key characters, '=' among them."""
    run = f"(?<![{KEY_CHARS}])[{KEY_CHARS}]{{{SHORTEST},}}"
    return _cut_out(docs, run, f"[{KEY_CHARS}]{{{SHORTEST}}}", id_col, text_col)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of what is judged: what is assigned to a secret's name, quoted or not, and long tokens."""
    quoted = rf"{_ASSIGNED}(?<={_NAMED}[\"'`])[^\s\"'`]{{{SHORTEST_NAMED},}}+(?=[\"'`])"
    named = rf"{_ASSIGNED}(?<={_NAMED}[\"'`]?){_PLAIN}{{{SHORTEST_NAMED},}}(?<![.:?])"
    token = rf"(?<![{_KEY}]){_token(SHORTEST)}"
    some = rf"[.{KEY_CHARS}]{{{SHORTEST}}}|{_NAMED}[\"'`]?[^\s\"'`]"
    return _cut_out(docs, f"(?:{quoted}|{named}|{token})", some, id_col, text_col)


def _cut_out(docs: DataFrame, run: str, some: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, start, end, value, before, after``; offsets in characters, ``end`` exclusive.

    One pass cuts a text into gaps and candidates; the offsets are running sums of their lengths.
    """
    pattern = rf"([\s\S]*?)({run}|\z)"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # Texts without a candidate need not be cut up.
    rows = rows.where(F.col("text").rlike(some))
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("gaps"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("runs"),
    )
    empty = F.array().cast("array<struct<start:int,gap:int>>")
    ends = F.aggregate(
        F.zip_with("gaps", "runs", lambda g, r: F.struct(F.char_length(g).alias("gap"), F.char_length(r).alias("run"))),
        F.struct(F.lit(0).alias("at"), empty.alias("starts")),
        lambda a, x: F.struct(
            (a.at + x.gap + x.run).alias("at"),
            F.concat(a.starts, F.array(F.struct((a.at + x.gap).alias("start"), x.gap.alias("gap")))).alias("starts"),
        ),
        lambda a: a.starts,
    )
    rows = rows.withColumn("starts", ends)
    # A name before a value may be a candidate itself.
    around = lambda name, k: F.when(k >= 0, F.coalesce(F.get(name, k), F.lit(""))).otherwise("")
    every = F.transform(
        F.sequence(F.lit(0), F.size("runs") - 1),
        lambda k: F.struct(
            F.get("starts", k).start.alias("start"),
            F.get("runs", k).alias("value"),
            F.substring(F.concat(around("runs", k - 1), F.get("gaps", k)), -CONTEXT, CONTEXT).alias("before"),
            F.substring(F.concat(around("gaps", k + 1), around("runs", k + 1)), 1, CONTEXT).alias("after"),
        ),
    )
    rows = rows.select("doc_id", F.inline(every)).where("value <> ''")
    return rows.select("doc_id", "start", (F.col("start") + F.char_length("value")).alias("end"), "value", "before", "after")


def _share(pattern: str, whole: Column) -> Column:
    """The share of the characters that are left when all but ``pattern`` is taken out."""
    return F.char_length(F.regexp_replace(whole, pattern, "")) / F.greatest(F.char_length(whole), F.lit(1))


def _has_word(words: str, text: Column) -> Column:
    return text.rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(words.split())})(?![a-z0-9])").cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the columns of :data:`FEATURES`."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    kinds = F.regexp_replace(kinds, "[^aB0]", "-")
    n = F.char_length(v)
    covered = 1 - F.char_length(F.regexp_replace(F.lower(v), "|".join(sorted(SYLLABLES, key=len, reverse=True)), "")) / n
    kind_count = reduce(lambda a, b: a + b, [F.contains(kinds, F.lit(k)).cast("double") for k in "aB0-"])
    last_word = F.regexp_extract(before, r"(\S*)\s*[\"'`:=(\[<]*\s*$", 1)
    columns = {
        "length": F.log1p(n),
        "classes": kind_count,
        "class_changes": (F.char_length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digits": _share("[^0-9]", v),
        "capitals": _share("[^A-Z]", v),
        "hexadecimal": _share("[^0-9a-fA-F]", v),
        "vowels": _share("[^aeiouAEIOU]", v),
        "covered": covered,
        "slashes": _share("[^/]", v),
        "in_path": (before.rlike(r"[\w.]/$|[A-Za-z]:\\\\$") | after.rlike(r"^\.[a-z]{1,4}\b") | v.rlike(r"\.[a-z]{1,4}$")).cast("double"),
        "in_address": (before.rlike(r"(?i)https?:\S*$|www\.\S*$") | v.rlike(r"(?i)^(?://)?www\.")).cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "assigned": before.rlike(r"[:=]>?\s*[\"'`]?$").cast("double"),
        "secret_word": _has_word(SECRET_WORDS, before),
        "other_word": _has_word(OTHER_WORDS, before),
        "word_before": F.log1p(F.char_length(last_word)),
        "word_after": F.log1p(F.char_length(F.regexp_extract(after, r"^\S*\s*(\S*)", 1))),
    }
    return found.withColumns({name: columns[name].cast("double") for name in FEATURES})


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 and 0 in the clear cases, else NULL.

    1: assigned to a secret's name and of letters and digits. 0: letters only, or after a word for
    another kind of value, or part of an address or a path, but for what a name in it is given.
    """
    v, before = F.col("value"), F.col("before")
    names = "|".join(SECRET_WORDS.split())
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    named = before.rlike(rf"(?i)(?:{names})[\"']?\s*[:=]>?\s*[\"'`]?$")
    other = before.rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(OTHER_WORDS.split())})[\"']?\s*[:=]?\s*[\"'`]?$")
    placed = before.rlike(r"(?i)https?:\S*$|[\w.]/$")
    label = F.when(other | ~v.rlike("[^A-Za-z.-]"), 0).when(named & mixed, 1).when(placed, 0)
    return found.withColumn("label", label.cast("double"))


def train(labelled: DataFrame, max_labelled: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 3) -> PipelineModel | None:
    """A forest fitted on at most ``max_labelled`` findings with a ``label`` of 0 or 1; None if one kind is missing.

    Of more findings those with the smallest hash of the value and its neighbourhood are taken, half of
    them of each label; each label counts as much as the other.
    """
    known = labelled.where("label IN (0, 1)").select("doc_id", "value", "before", "after", "start", "label")
    columns = ("value", "before", "after", "doc_id", "start")
    parts = [hash_sample(known.where(F.col("label") == k), max_labelled // 2, *columns) for k in (0, 1)]
    sample = saved(parts[0].unionByName(parts[1]).coalesce(1), "labelled-findings")
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    weight = F.when(F.col("label") == 1, sum(counts.values()) / (2 * counts[1.0])).otherwise(sum(counts.values()) / (2 * counts[0.0]))
    rows = with_features(sample).withColumn("weight", weight)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", maxBins=32, cacheNodeIds=False)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def judge(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``found`` with ``score``, the forest's share for a secret; 0.5 without a forest."""
    if model is None:
        return found.withColumn("score", F.lit(0.5))
    names = found.columns
    return model.transform(with_features(found)).select(*names, vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """One row per candidate: ``doc_id, start, end, value_sha256, score, is_secret``.

    ``labelled`` (``doc_id, start, value, before, after, label``) defaults to the clear cases among the
    candidates themselves. NULL texts count as empty and hold none; repeated rows give repeated
    findings. Values are given as digests, so that the report holds no secrets. Other columns are ignored.
    Where one kind of label is missing and no forest is fitted, the clear cases count: score 1 for secrets.
    """
    found = saved(findings(docs), "secret-candidates")
    model = train(weak_labels(found) if labelled is None else labelled, **options)
    judged = judge(found, model)
    if model is None:
        judged = weak_labels(judged).withColumn("score", F.when(F.col("label") == 1, 1.0).otherwise(F.col("score")))
    return judged.select(
        "doc_id",
        "start",
        "end",
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "score",
        (F.col("score") > threshold).alias("is_secret"),
    )
