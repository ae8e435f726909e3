"""Benchmark decontamination by Wu-Manber search over words.

Words are the runs of word bytes of the lower-cased UTF-8 text. Each item gives windows of ten
consecutive words (an item of fewer words is one window). For all windows of one length a table over
blocks of two words tells how far the search may jump; where the jump is 0, the bucket of the suffix
block, parted by the window's first word, selects the windows to compare, and comparing all their words
confirms an occurrence.

Null or empty texts have no words and no hits; an item without words has no window; an item id that is
null counts as the text ``null``; repeated item rows count once; every document row gives one row of
result. Columns besides the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import WORD_BYTES, field, map_columns

#: Bytes of item text that one set of search tables holds. More items are searched in several blocks.
BLOCK_BYTES = 2_000_000
WINDOW = 10
FOUND = "n_words bigint, hits array<array<bigint>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Windows of one length, each with the items that hold it."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = len(next(iter(windows)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                key = self._key(window, end)
                self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
            bucket = self.buckets.setdefault(self._key(window, self.length), {})
            bucket.setdefault(window[0], []).append((list(window), items))

    def _key(self, words, end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def search(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """Start and items of every occurrence."""
        m, n, shift, jump, two = self.length, len(words), self.shift.get, self.jump, self.block == 2
        end = m
        while end <= n:
            key = (words[end - 2], words[end - 1]) if two else words[end - 1]
            far = shift(key, jump)
            if far:
                end += far
                continue
            start = end - m
            for window, items in self.buckets[key].get(words[start], ()):
                if words[start:end] == window:
                    yield start, items
            end += 1


class Searcher:
    """One WuManber for each length of window that the items have."""

    def __init__(self, items: list[tuple[str, bytes]]):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            m = min(WINDOW, len(words))
            for i in range(len(words) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
        self.parts = [WuManber(windows) for _, windows in sorted(by_length.items())]

    def __call__(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Stretches of hit words (start and end, apart and in order), and the items found."""
        found, items = [], set()
        for part in self.parts:
            for start, names in part.search(words):
                found.append((start, start + part.length))
                items |= names
        return merged(found), items


def merged(spans: Iterable) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_searchers: dict[str, Searcher] = {}


def _searcher(items: list[tuple[str, bytes]]) -> Searcher:
    """Built once in each worker process; the last one stays."""
    key = hashlib.sha256(repr(items).encode()).hexdigest()
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(items)
    return _searchers[key]


def _search_block(docs: DataFrame, items: DataFrame) -> DataFrame:
    """items: of BLOCK_BYTES or so, that is why they may go to the driver and to all executors."""
    held = docs.sparkSession.sparkContext.broadcast(sorted({(r[0], bytes(r[1])) for r in items.toLocalIterator()}))
    state: dict = {}

    def scan(batch):
        if "search" not in state:
            state["search"] = _searcher(held.value)
        search, n_words, hits, found = state["search"], [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            spans, names = search(words)
            n_words.append(len(words))
            hits.append(spans)
            found.append(sorted(names))
        return [batch.column(0), n_words, hits, found]

    return map_columns(docs, scan, FOUND, docs.schema["doc_id"])


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each document row: doc_id, n_words, hits (stretches of words inside an occurrence), items (sorted)."""
    docs = docs.select(field(doc_id).alias("doc_id"), field(text).cast("binary").alias("text"))
    items = benchmark.select(F.coalesce(field(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(field(item_text).cast("binary"), F.lit(b"")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks == 1:
        return _search_block(docs, items)
    # Each block of items is searched in all documents. The parts of a row meet by its id and the hash of its text: rows that agree in both
    # have the same hits, and `rows` brings back as many of them as there were.
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
    union = None
    for k in range(blocks):
        part = _search_block(keyed, items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k))
        part = part.withColumn("first", F.lit(k == 0).cast("int"))
        union = part if union is None else union.unionByName(part)
    hits = F.expr(
        """aggregate(array_sort(spans), cast(array() as array<array<bigint>>), (acc, s) ->
             if(size(acc) > 0 and s[0] <= element_at(acc, -1)[1],
                concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], greatest(element_at(acc, -1)[1], s[1])))),
                concat(acc, array(s))))"""
    )
    return (
        union.groupBy("doc_id", "n_words")
        .agg(
            F.sum("first").cast("int").alias("rows"),
            F.flatten(F.collect_set("hits")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", hits.alias("hits"), "items", F.explode(F.array_repeat(F.lit(1), F.col("rows"))).alias("row"))
        .drop("row")
    )


def report(overlaps: DataFrame) -> DataFrame:
    """Counts and digests of find_overlaps()."""
    return overlaps.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of an item."""
    whole = docs.select(F.struct(*[field(c) for c in docs.columns]).alias("doc"), field(text).alias("text"))
    return find_overlaps(whole, benchmark, "doc").where(F.size("hits") == 0).select("doc_id.*")
