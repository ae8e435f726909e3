"""URL rules in a sorted array of 64-bit digests.

A rule is a host and a path prefix, written ``host/path``. The xxhash64 keys of all rules lie sorted in
a file that every worker maps into memory; beside it lie the offsets of the full strings. A URL gives
one candidate for each suffix of its host at a dot and each length of path that any rule has; all
candidates of a batch are probed with one vectorised binary search, and the stored string is compared
with the candidate, so that a collision of digests matches nothing. The longest matching rule decides
(of equally long ones the smallest string), else the verdict is ``allow``.

A URL that is null or has no ``://`` has an empty host and path and fits no rule. Equal rows give equal
results; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import field, map_columns, share_file

#: Rules of more bytes than this are not shipped as a file: they are joined (see judge_urls).
INDEX_BYTES = 256_000_000
JUDGED = "host string, path string, rule string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column, both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def build_index(rules: list[tuple[str, str]]) -> bytes:
    """rules: (``host/path``, allow or block; of one rule's verdicts block). Counts, the longest host in labels and signs, keys, ends of strings, verdicts, path lengths, strings."""
    unique = dict(sorted(rules))
    held = sorted((xxhash.xxh64_intdigest(rule.encode()), rule.encode(), verdict == "block") for rule, verdict in unique.items())
    lengths = sorted({len(rule[rule.index(b"/") :].decode()) for _, rule, _ in held})
    strings = b"".join(rule for _, rule, _ in held)
    hosts = [rule[: rule.index(b"/")].decode() for _, rule, _ in held]
    parts = [
        np.array([len(held), len(lengths), max((h.count(".") + 1 for h in hosts), default=0), max(map(len, hosts), default=0)], "<u8"),
        np.array([key for key, _, _ in held], "<u8"),
        np.cumsum([0, *(len(rule) for _, rule, _ in held)]).astype("<u8"),
        np.array([block for _, _, block in held], "<u8"),
        np.array(lengths, "<u8"),
    ]
    return b"".join(p.tobytes() for p in parts) + strings


class DigestArray:
    """A file of build_index(), mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m, self.labels, self.signs = raw[:32].view("<u8").tolist()
        words = raw[32 : 32 + 8 * (n + n + 1 + n + m)].view("<u8")
        self.keys, self.ends, self.block, self.lengths = words[:n], words[n : 2 * n + 1], words[2 * n + 1 : 3 * n + 1], words[3 * n + 1 :].tolist()
        self.strings = raw[32 + 8 * len(words) :]

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """The place of each candidate, -1 where no stored string equals it."""
        keys = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(candidates), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.string(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()


def candidates(host: str, path: str, lengths: list[int], labels: int, signs: int) -> list[bytes]:
    """Rules that would fit, the longest first; of equal length the smallest string first. No rule's host has more labels or signs, so no longer suffix is tried."""
    suffixes, at = [], len(host)
    for _ in range(labels):
        dot = host.rfind(".", max(0, len(host) - signs - 1), at)
        if dot < 0:
            suffixes += [host] * (len(host) <= signs)
            break
        suffixes.append(host[dot + 1 :])
        at = dot
    found = {suffix + path[:n] for suffix in suffixes if suffix for n in lengths if n <= len(path)}
    return [c.encode() for c in sorted(found, key=lambda c: (-len(c), c))]


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each row: page_id, host, path, rule (null: none), verdict. rules: columns rule (``host/path``) and verdict."""
    host, path = split_url(field(url))
    urls = pages.select(field(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    size = rules.agg(F.sum(F.octet_length("rule") + 32)).first()[0] or 0
    if size > index_bytes:
        return _judged_by_join(urls, rules)
    data = build_index([(r[0], r[1]) for r in rules.select("rule", "verdict").toLocalIterator()])
    name = f"rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    share_file(pages.sparkSession, name, data)
    return map_columns(urls, _prober(name), JUDGED, urls.schema["page_id"])


def _prober(name: str):
    state: dict = {}

    def probe(batch: pa.RecordBatch) -> list:
        index = state.get("index") or state.setdefault("index", DigestArray(SparkFiles.get(name)))
        tried = [candidates(h, p, index.lengths, index.labels, index.signs) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        at = index.find([c for some in tried for c in some])
        rules, verdicts, k = [], [], 0
        for some in tried:
            hit = next((int(x) for x in at[k : k + len(some)] if x >= 0), -1)
            k += len(some)
            rules.append(index.string(hit).decode() if hit >= 0 else None)
            verdicts.append("block" if hit >= 0 and index.block[hit] else "allow")
        return [*batch.columns, rules, verdicts]

    return probe


def _judged_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rules of any number: each distinct host and path meets its rules by an equi-join on the full string."""
    rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = F.regexp_extract("rule", "^([^/]*)", 1)
    bounds = [F.collect_set(F.length(F.regexp_extract("rule", r"(?s)(/.*)$", 1))).alias("lengths"), F.max(F.size(F.split(host, "[.]"))).alias("labels")]
    lengths = rules.agg(*bounds)
    keys = urls.select("host", "path").distinct().crossJoin(F.broadcast(lengths))  # lengths is one row
    keys = keys.withColumn("parts", F.expr("split(substring_index(host, '.', -coalesce(labels, 0)), '[.]')"))  # no more labels than a rule has
    suffixes = "transform(sequence(1, size(parts)), i -> array_join(slice(parts, i, size(parts)), '.'))"
    tried = keys.select("host", "path", F.explode(F.expr(f"flatten(transform({suffixes}, h -> transform(filter(lengths, n -> n <= length(path)), n -> concat(h, substring(path, 1, n)))))")).alias("rule"))
    best = (
        tried.join(rules, "rule")
        .groupBy("host", "path")
        .agg(F.min(F.struct(-F.length("rule"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")
