"""Language of texts by rank-order profiles.

A text is its words: letters (with their marks) in lower case, everything else is a gap. N-grams are one, two or
three signs around a letter, where a gap counts as a sign at the edge of a word, never within. A language's profile
is its PROFILE most frequent n-grams over all labelled rows, ranked. A text's own most frequent n-grams are ranked
alike and compared with each profile by the out-of-place distance: for each, how far its rank is from its rank in the
profile, or PROFILE where the profile lacks it. The nearest language wins. Ties of counts go to the smaller n-gram (by code points),
ties of distances to the language with more labelled rows, then the smaller name.

Training counts all labelled rows, each task for itself, then by a sum over tasks; only profiles come to the driver, so
many n-grams a language. Texts that are null or have no letter get 'und' and score 0, and so does every
text where nothing was learned. The score is how much nearer the best language is than the second: d2 / (d1 + d2), 0.5 to 1.
Whole texts are read, a part of bounded size at a time. Rows are treated by themselves, so repeated rows agree. A null id isn't held out, and isn't learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import field, map_columns, slices

#: N-grams of a profile, and of a text that are compared with it.
PROFILE = 300
#: Bytes of text, or one longer text, that a training task reads at a time; letters of a text that are counted at a time.
READ_BYTES, COUNT_LETTERS = 2_000_000, 500_000
#: Distinct n-grams of all languages that a training task holds before it hands them on.
HELD = 1_000_000
UNKNOWN = "und"
GAP = 32


@cache
def signs() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 2 for a letter, 1 for a mark, 0 else; and the code point that stands for it in n-grams (small, a gap if it is neither)."""
    kind, low = np.zeros(0x110000, np.uint8), np.full(0x110000, GAP, np.int64)
    for k in range(0x110000):
        group = unicodedata.category(chr(k))[0]
        if group in "LM":
            kind[k] = 2 if group == "L" else 1
            small = chr(k).lower()
            low[k] = ord(small) if len(small) == 1 else k
    return kind, low


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The signs of all texts with gaps between them; where letters and marks are; for each text, and the end, the first of these; whether each text has a letter."""
    kind, low = signs()
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(kind[points])
    starts = np.searchsorted(at, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    letters = np.concatenate([[0], np.cumsum(kind[points[at]] == 2)])[starts]
    return low[points], at, starts, np.diff(letters) > 0


def codes_at(sign: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The n-grams around these letters, each as its signs of 21 bits."""
    before, own, after = sign[at - 1], sign[at], sign[at + 1]
    pairs = (before << 21) | own
    return np.concatenate([own, pairs, (pairs << 21) | after, ((own << 21) | after)[after == GAP]])


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(which, np.concatenate(counts), len(found)).astype(np.int64)


def counted(sign: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams around these letters and their counts."""
    if len(at) <= COUNT_LETTERS:
        return np.unique(codes_at(sign, at), return_counts=True)
    some = [np.unique(codes_at(sign, at[k : k + COUNT_LETTERS]), return_counts=True) for k in range(0, len(at), COUNT_LETTERS)]
    return merged([c for c, _ in some], [n for _, n in some])


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, the smaller of equal counts first; codes come sorted."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


@dataclass
class Profiles:
    """codes (sorted), and for each its rank in each language's profile (or most, where it has none)."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    most: int

    def distances(self, own: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a text's ranked n-grams to each language."""
        spot = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where((self.codes[spot] == own)[:, None], self.ranks[spot], self.most)
        return np.where(ranks < self.most, np.abs(ranks - np.arange(len(own))[:, None]), self.most).sum(0)

    def judge(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        far = self.distances(own)
        best = int(far.argmin())
        rest = np.delete(far, best)
        second = int(rest.min()) if len(rest) else self.most * len(own)
        return self.langs[best], float(second / (far[best] + second)) if second else 0.5


def profiles_of(ranked_codes: dict[str, list[int]], most: int) -> Profiles:
    """From the ranked n-grams of each language, the language that wins ties first."""
    langs = list(ranked_codes)
    codes = np.array(sorted({c for own in ranked_codes.values() for c in own}), np.int64)
    ranks = np.full((len(codes), len(langs)), most, np.int64)
    for k, own in enumerate(ranked_codes.values()):
        ranks[np.searchsorted(codes, np.array(own, np.int64)), k] = np.arange(len(own))
    return Profiles(langs, codes, ranks, most)


def _texts(batch: pa.RecordBatch, column: int) -> tuple[list[int], list[str]]:
    """Rows with a text, and their texts."""
    values = batch.column(column).to_pylist()
    rows = [k for k, v in enumerate(values) if v]
    return rows, [values[k] for k in rows]


def gram_counts(rows: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram (its signs of 21 bits) and n over all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own[0][0]), pa.string()), *map(pa.array, own[0])], names=["lang", "gram", "n"])

        for batch in (some for whole in batches for some in slices(whole, None, READ_BYTES)):
            langs = batch.column(0).to_pylist()
            which, texts = _texts(batch, 1)
            sign, at, starts, _ = letters_of(texts)
            for name in {langs[k] for k in which}:
                own = np.concatenate([np.empty(0, np.int64), *(at[starts[i] : starts[i + 1]] for i, k in enumerate(which) if langs[k] == name)])
                if len(own):
                    parts = [*held.get(name, []), counted(sign, own)]
                    held[name] = [merged([c for c, _ in parts], [n for _, n in parts])]
            if sum(len(own[0][0]) for own in held.values()) > HELD:
                yield from told()
                held.clear()
        yield from told()

    own = rows.select(field(lang).cast("string").alias("lang"), field(text).alias("text")).where("lang is not null")
    return own.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", most: int = PROFILE) -> Profiles:
    """Profiles of all languages of the rows, over whole texts."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = gram_counts(rows, lang, text).withColumn("rank", place).where(F.col("rank") <= most).collect()
    sizes = rows.where(field(lang).isNotNull()).groupBy(field(lang).cast("string").alias("lang")).count().collect()
    order = [r["lang"] for r in sorted(sizes, key=lambda r: (-r["count"], r["lang"]))]
    found: dict[str, list[int]] = {name: [] for name in order}
    for r in sorted(top, key=lambda r: r["rank"]):
        found[r["lang"]].append(r["gram"])
    return profiles_of({name: own for name, own in found.items() if own}, most)


def identify(df: DataFrame, model: Profiles, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For every row doc (a struct of the columns to carry), lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*[field(c) for c in (df.columns if carry is None else carry)]).alias("doc"), field(text).alias("text"))

    def judged(batch: pa.RecordBatch) -> list:
        langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        which, texts = _texts(batch, 1)
        sign, at, starts, lettered = letters_of(texts)
        for i, k in enumerate(which):
            if lettered[i]:
                langs[k], scores[k] = shared.value.judge(ranked(*counted(sign, at[starts[i] : starts[i + 1]]), shared.value.most))
        return [batch.column(0), langs, scores]

    return map_columns(rows, judged, "lang_pred string, score double", rows.schema["doc"])


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string")) % by


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row: doc_id, held_out, lang_pred and score; learned from the rows that aren't held out."""
    known = docs.where(remainder(field(doc_id), 4) != 2)
    model = fit(known, lang, text)
    told = identify(docs, model, text, [doc_id])
    own = F.col("doc").getField(doc_id)
    return told.select(own.alias("doc_id"), F.coalesce(remainder(own, 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
