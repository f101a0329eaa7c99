"""URL filter over a sorted digest array.

Rules are texts such as ``example.org/en/1``: a host, and what the path starts with. Their xxhash64
digests are stored in ascending order in a flat file, together with the full texts. Executors fetch
the file once from the shared folder, map it into memory and probe it for whole batches by
vectorised binary search; a digest that is found counts only if the stored text is equal.

Rule tables of any length work: they are cut by digest into slices of a bounded size, each with a
file of its own, and every batch probes all slices. A lost executor fetches the files again.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skyframe.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest slice of rules that the driver sorts at a time.
SLICE_ROWS = 1_000_000


def url_host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def _layout(rules: list[tuple[str, str]]) -> bytes:
    """Counts, sorted digests, host digests, path lengths, host labels, text ends, verdicts, then the texts."""
    order = sorted((_digest(rule), rule, verdict == "allow") for rule, verdict in rules)
    texts = [rule.encode() for _, rule, _ in order]
    digests = np.array([d for d, _, _ in order], np.uint64)
    hosts = np.unique(np.array([_digest(r.partition("/")[0]) for _, r, _ in order], np.uint64))
    lengths = np.unique(np.array([len(r) - r.index("/") for _, r, _ in order], np.uint64))
    labels = np.unique(np.array([r.partition("/")[0].count(".") + 1 for _, r, _ in order], np.uint64))
    ends = np.cumsum([len(t) for t in texts], dtype=np.uint64)
    allow = np.array([a for _, _, a in order], np.uint64)
    head = np.array([len(digests), len(hosts), len(lengths), len(labels)], np.uint64)
    return b"".join(a.tobytes() for a in (head, digests, hosts, lengths, labels, ends, allow)) + b"".join(texts)


def publish(spark: SparkSession, rules: DataFrame, slice_rows: int = SLICE_ROWS) -> list[str]:
    """Sort and store ``rules(rule, verdict)``; returns the names under which executors find the slices.

    A rule needs a host and a path (``org/`` fits all paths); others, and NULLs, raise. Of a rule that
    is listed twice the block counts.
    """
    rules = rules.groupBy("rule").agg(F.min(F.col("verdict") != "block").alias("allow"))
    bad = rules.where("rule IS NULL OR NOT rule RLIKE '^[^/?#A-Z]+/' OR allow IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"not a rule: {bad[0]}")
    slices = max(1, math.ceil(rules.count() / slice_rows))
    rules = rules.withColumn("slice", F.pmod(F.xxhash64("rule"), F.lit(slices)))
    names, jvm = [], spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(slices):
        part = rules.where(F.col("slice") == k).select("rule", "allow").collect()
        name = f"url-rules-{uuid.uuid4().hex}.bin"
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
        files = path.getFileSystem(conf)
        out = files.create(path)
        out.write(bytearray(_layout([(r.rule, "allow" if r.allow else "block") for r in part])))
        out.close()
        spark.sparkContext.addFile(files.makeQualified(path).toString())
        names.append(name)
    return names


class _Slice:
    """One mapped file of sorted digests."""

    def __init__(self, path: str) -> None:
        self.raw = np.memmap(path, np.uint8, "r")
        n, hosts, lengths, labels = (int(x) for x in self.raw[:32].view(np.uint64))
        cuts = np.cumsum([32, 8 * n, 8 * hosts, 8 * lengths, 8 * labels, 8 * n, 8 * n])
        self.digests, self.hosts, self.lengths, self.labels, self.ends, self.allow = (
            self.raw[a:b].view(np.uint64) for a, b in zip(cuts, cuts[1:], strict=False)
        )
        self.texts, self.path_lengths, self.host_labels = int(cuts[-1]), self.lengths.tolist(), self.labels.tolist()

    def text(self, k: int) -> str:
        start = int(self.ends[k - 1]) if k else 0
        return self.raw[self.texts + start : self.texts + int(self.ends[k])].tobytes().decode()

    def has_host(self, digests: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hosts, digests)
        return (at < len(self.hosts)) & (self.hosts[np.minimum(at, len(self.hosts) - 1)] == digests)

    def find(self, keys: list[str]) -> list[int]:
        """For each key the place of the equal rule, else -1."""
        digests = np.fromiter(map(_digest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        near = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests))
        found = [-1] * len(keys)
        for i in near.tolist():
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == digests[i]:
                if self.text(k) == keys[i]:  # equal digests may stand for other texts
                    found[i] = k
                    break
                k += 1
        return found


@functools.lru_cache
def _opened(path: str) -> _Slice:
    return _Slice(path)


def _parents(host: str, labels: list[int]) -> Iterator[str]:
    """The host and those of its parents that have one of these numbers of labels, given in ascending order.

    The host is read from its end and no further than the longest wanted parent, so a host of any length
    costs what the rules ask for.
    """
    dots, cut = 0, len(host)
    for n in labels:
        while cut >= 0 and dots < n:
            cut = host.rfind(".", 0, cut)
            dots += 1
        if cut >= 0:
            yield host[cut + 1 :]
        elif dots == n:  # one dot less than wanted: the whole host
            yield host
            return
        else:
            return


def _judge(hosts: list[str], paths: list[str], slices: list[_Slice]) -> list[tuple[str, str] | None]:
    """The longest fitting rule and its verdict; of equally long ones the one with the longer host."""
    best: list[tuple | None] = [None] * len(hosts)
    for part in slices:
        if not len(part.digests):
            continue
        owned = [(i, parent) for i, host in enumerate(hosts) for parent in _parents(host, part.host_labels)]
        digests = np.fromiter((_digest(parent) for _, parent in owned), np.uint64, len(owned))
        rows, keys = [], []
        for j in np.flatnonzero(part.has_host(digests)).tolist():
            i, parent = owned[j]
            for n in part.path_lengths:
                if n > len(paths[i]):
                    break
                rows.append(j)
                keys.append(parent + paths[i][:n])
        for j, key, k in zip(rows, keys, part.find(keys), strict=True):
            if k >= 0:
                i, parent = owned[j]
                rank = (len(key), len(parent), key, "allow" if part.allow[k] else "block")
                best[i] = max(best[i], rank) if best[i] else rank
    return [b and (b[2], b[3]) for b in best]


def judge_urls(
    pages: DataFrame, names: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` under the published rules.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. No
    rule: ``rule`` is NULL and the verdict ``default``. NULL urls and those without ``://`` have an
    empty host and path, so no rule fits. Hosts and paths may be of any length: only as much of them is
    probed as the rules have. Other columns are ignored.
    """

    @pandas_udf("rule string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        slices = [_opened(SparkFiles.get(name)) for name in names]
        for hosts, paths in parts:
            found = _judge(hosts.tolist(), paths.tolist(), slices)
            yield pd.DataFrame(
                {"rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]}, dtype=object
            )

    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    return rows.withColumn("judged", judged("host", "path")).select(
        "page_id", "host", "path", "judged.rule", "judged.verdict"
    )
