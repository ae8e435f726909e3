"""Alignment of two tokenizers' tokens over the same texts, by interval coalescing.

Both tokenizers read a space and the text. Each token has a range of bytes; all ranges of both are sorted by
their starts (lexsort), their ends are carried along as a running maximum (maximum.accumulate), and a group
breaks where a start reaches that maximum: there both have a token's end. Within groups, ranges that overlap
are expanded to links. A pair's count is the number of documents of the corpus that hold it linked.

A byte-level tokenizer never joins what is before a run of white space with the run, and the piece model never
joins words; so a text is cut before each space that follows a sign other than white space (both checked on the
files, else texts stay whole), tokens of both end there, and each distinct part of a task's texts is encoded and
aligned once. A part's token bytes must be the part; a text with a part where they differ has no tokens, as
null and empty texts have none (zeros, and '' for the digest). Special tokens' strings are plain text.

Rows are treated by themselves, so repeated rows agree, and ids may be null. Counts go back to documents by blocks:
neighbouring rows of bounded size of one task, with one row for each distinct pair of a block and its number of
documents there. So what is shuffled grows with the distinct pairs of blocks, and no pair is hot. Counts are sums over all blocks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from orrery.llm.common import field, map_columns, saved, slices
from orrery.llm.sentencepiece_codec import BYTE, MARKER, parse_model, read_model, splits_at_markers

#: Rows and bytes of text of a block.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 4_000_000
#: Bytes of new parts that are encoded in one call, and bytes of parts (and 200 a part) that a task keeps.
CALL_BYTES, KNOWN_BYTES = 200_000, 60_000_000
#: Distinct pairs in one row of a block.
PAIRS_A_ROW = 50_000
#: Bytes that may end a sign of white space: no cut behind them.
_WHITE_ENDS = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x80, *range(0x81, 0x8B), 0x85, 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
_MAY_CUT = np.ones(256, bool)
_MAY_CUT[_WHITE_ENDS] = False


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones stand for themselves, the others for 256 and on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each range's group, groups in the order of their starts."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all ranges of A and B that overlap; both sides are in order and none overlaps another of its side."""
    first = np.searchsorted(b_ends, a_starts, side="right")
    n = np.maximum(np.searchsorted(b_starts, a_ends, side="left") - first, 0)
    a = np.repeat(np.arange(len(a_starts)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _lists(starts: np.ndarray, values: np.ndarray | pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(values) if isinstance(values, np.ndarray) else values)


def _offsets(lists: pa.Array) -> np.ndarray:
    out = lists.offsets.to_numpy()
    return out - out[0]


def _raw(parts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each of some binaries starts in their bytes (and the end), and the bytes."""
    offsets = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset) if len(parts) else np.zeros(1, np.int64)
    return offsets, memoryview(parts.buffers()[2] or b"").cast("B")


@dataclass
class Parts:
    """What is known of parts: large lists a, b (ids), sizes (of A and B in each group, packed), links (tokens of the part, packed), pairs (ids, packed); groups as text, each with a closing semicolon."""

    good: np.ndarray
    a: pa.LargeListArray
    b: pa.LargeListArray
    sizes: pa.LargeListArray
    links: pa.LargeListArray
    pairs: pa.LargeListArray
    said: pa.LargeBinaryArray


def packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


class Aligner:
    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, spec, told = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model), parse_model(b_model), json.loads(a_json)
        self.a.encode_special_tokens = True
        signs, vocab = byte_signs(), {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = pa.array([bytes(signs[c] for c in vocab[i]) if i in vocab else b"" for i in range(max(vocab) + 1)], pa.large_binary())
        self.b_bytes = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in spec.pieces], pa.large_binary())
        self.b_lone = self.b.encode("a ")[len(self.b.encode("a")) :]  # what a last space adds
        rule = told.get("pre_tokenizer") or {}
        self.by_part = splits_at_markers(spec) and not told.get("normalizer") and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.width, self.said = most, pa.array([f"{i}{sep}".encode() for sep in ",|;" for i in range(most)], pa.large_binary())
        self.a_lengths, self.b_lengths = (pc.binary_length(t).to_numpy() for t in (self.a_bytes, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.size = 0
        self.known = self._aligned([])

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.LargeBinaryArray]:
        """How many parts each text has, and all parts; each starts with a space."""
        texts = pc.fill_null(texts.cast(pa.large_string()).cast(pa.large_binary()), b"")
        full = pc.greater(pc.binary_length(texts), 0)
        spaced = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), texts, pa.scalar(b"", pa.large_binary())), texts)
        offsets, data = _raw(spaced)
        sign = np.frombuffer(data, np.uint8)[: offsets[-1]]
        begins = np.zeros(len(sign), bool)
        if self.by_part and len(sign):
            begins[1:] = (sign[1:] == 32) & _MAY_CUT[sign[:-1]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.append(np.flatnonzero(begins), len(sign)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        return np.diff(np.searchsorted(at, offsets)), parts

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of A for each part: parts that may stand before a cut are encoded as one text, and told apart by their bytes."""
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if self.by_part and all(_MAY_CUT[p[-1]] for p in parts[:-1]):
            ids = np.array(self.a.encode_batch_fast([b"".join(parts).decode()], add_special_tokens=False)[0].ids, np.int64)
            at = np.searchsorted(np.cumsum(self.a_lengths[ids]), ends, side="right")
            return np.diff(at, prepend=0), ids
        made = [e.ids for e in self.a.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        return lengths, np.fromiter(chain.from_iterable(made), np.int64, int(lengths.sum()))

    def _encoded(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and ids of A and of B for each part; the parts come in the order of _aligned()."""
        out: list[list] = [[], [], [], []]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= CALL_BYTES and (_MAY_CUT[parts[end - 1][-1]] or not _MAY_CUT[parts[end][-1]])):
                size += len(parts[end])
                end += 1
            texts = [p.decode() for p in parts[at:end]]
            b = [self.b_lone if t == " " else ids for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]
            lengths = np.fromiter(map(len, b), np.int64, len(b))
            for column, values in zip(out, (*self._joined(parts[at:end]), lengths, np.fromiter(chain.from_iterable(b), np.int64, int(lengths.sum()))), strict=True):
                column.append(values)
            at = end
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in out)

    def _same(self, lengths: np.ndarray, ids: np.ndarray, table: pa.Array, parts: list[bytes]) -> np.ndarray:
        """Whether the bytes of each part's tokens are the part."""
        offsets, data = _raw(table.take(pa.array(ids)))
        if data[: offsets[-1]] == b"".join(parts) and (np.diff(offsets[_starts(lengths)]) == np.fromiter(map(len, parts), np.int64, len(parts))).all():
            return np.ones(len(parts), bool)
        at = offsets[_starts(lengths)].tolist()
        return np.fromiter((data[s:e] == p for s, e, p in zip(at[:-1], at[1:], parts, strict=True)), bool, len(parts))

    def _aligned(self, parts: list[bytes]) -> Parts:
        na, a, nb, b = self._encoded(parts)
        good = self._same(na, a, self.a_bytes, parts) & self._same(nb, b, self.b_bytes, parts)
        a, b = a[np.repeat(good, na)], b[np.repeat(good, nb)]
        na, nb = na * good, nb * good
        of_a, of_b = np.repeat(np.arange(len(parts)), na), np.repeat(np.arange(len(parts)), nb)
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])  # parts follow each other: both sides have the same bytes
        a_starts, b_starts = a_ends - self.a_lengths[a], b_ends - self.b_lengths[b]
        group = coalesce(np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends]))
        in_a, in_b = group[: len(a)], group[len(a) :]
        n_groups = int(group.max()) + 1 if len(group) else 0
        sizes = packed(np.bincount(in_a, minlength=n_groups), np.bincount(in_b, minlength=n_groups))
        of_group = np.zeros(n_groups, np.int64)
        of_group[in_a] = of_a
        x, y = overlaps(a_starts, a_ends, b_starts, b_ends)
        by_part = lambda of: _starts(np.bincount(of, minlength=len(parts)))
        first_a, first_b = _starts(na), _starts(nb)
        links = packed(x - first_a[of_a[x]], y - first_b[of_b[y]])
        # Groups as text: tokens by group and side, each with what stands behind it.
        side = np.concatenate([2 * in_a, 2 * in_b + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([a, b])[order], side[order]
        behind = np.full(len(ids), 2)
        behind[:-1] = np.where(side[1:] == side[:-1], 0, np.where(side[1:] // 2 == side[:-1] // 2, 1, 2))
        said = self.said.take(pa.array(behind * self.width + ids))
        offsets, data = _raw(said)
        text = pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(np.ascontiguousarray(offsets[_starts(na + nb)])), pa.py_buffer(data)])
        return Parts(good, _lists(first_a, a.astype(np.int32)), _lists(first_b, b.astype(np.int32)), _lists(by_part(of_group), sizes), _lists(by_part(of_a[x]), links), _lists(by_part(of_a[x]), packed(a[x], b[y])), text)

    def known_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many parts each text has; the distinct parts' numbers in known; for each part which of these it is."""
        counts, parts = self.cut(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.size > KNOWN_BYTES:  # bounded memory
            self._forget()
        if fresh := [p for p in distinct if p not in self.numbers]:
            fresh.sort(key=lambda p: not _MAY_CUT[p[-1]])
            new = self._aligned(fresh)
            self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh)), strict=True))
            self.size += sum(map(len, fresh)) + 200 * len(fresh)
            old = self.known
            self.known = Parts(np.concatenate([old.good, new.good]), *(pa.concat_arrays([getattr(old, k), getattr(new, k)]) for k in ("a", "b", "sizes", "links", "pairs", "said")))
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        return counts, numbers, coded.indices.to_numpy().astype(np.int64)

    def texts(self, texts: pa.Array) -> dict[str, pa.Array]:
        """For each text: a_ids, b_ids, groups (n_a, n_b) and links (a, b: numbers of tokens)."""
        counts, numbers, which = self.known_parts(texts)
        good = self._good(counts, numbers[which])
        which, counts = which[np.repeat(good, counts)], counts * good
        own = pa.array(numbers[which])
        ends = _starts(counts)
        whole = lambda lists, values: _lists(_offsets(lists)[ends], values)
        a, b, sizes, links = (x.take(own) for x in (self.known.a, self.known.b, self.known.sizes, self.known.links))
        first = lambda lists: (_offsets(lists)[:-1] - np.repeat(_offsets(lists)[ends][:-1], counts))  # noqa: E731  tokens of the text before each part
        n = np.diff(_offsets(links))
        x = links.flatten().to_numpy()
        pair = lambda high, low, names: pa.StructArray.from_arrays([pa.array(high.astype(np.int32)), pa.array(low.astype(np.int32))], names)
        moved = pair((x >> 32) + np.repeat(first(a), n), (x & 0xFFFFFFFF) + np.repeat(first(b), n), ["a", "b"])
        g = sizes.flatten().to_numpy()
        return {"a_ids": whole(a, a.flatten()), "b_ids": whole(b, b.flatten()), "groups": whole(sizes, pair(g >> 32, g & 0xFFFFFFFF, ["n_a", "n_b"])), "links": whole(links, moved)}

    def _good(self, counts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        bad = _starts(~self.known.good[numbers])[_starts(counts)]
        return np.diff(bad) == 0

    def block(self, texts: pa.Array) -> tuple[list, np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and the digest; the block's distinct pairs; for each text which of them it holds, and how often; in how many texts each is."""
        counts, numbers, which = self.known_parts(texts)
        good = self._good(counts, numbers[which])
        which, counts = which[np.repeat(good, counts)], counts * good
        ends, own = _starts(counts), pa.array(numbers[which])
        sums = [np.diff(_starts(np.diff(_offsets(lists))[numbers[which]])[ends]) for lists in (self.known.a, self.known.b, self.known.sizes, self.known.links)]
        at, data = _raw(self.known.said.take(own))
        at = at[ends].tolist()
        digests = [hashlib.sha256(data[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1], at[1:], strict=True)]
        # Pairs get numbers within the block, on its distinct parts; a part's pairs are then those of all its places.
        used, which = np.unique(which, return_inverse=True)
        held = self.known.pairs.take(pa.array(numbers[used]))
        pairs, number = np.unique(held.flatten().to_numpy(), return_inverse=True)
        places = _lists(_offsets(held), number.astype(np.int64)).take(pa.array(which.astype(np.int64)))
        text = np.repeat(np.arange(len(texts)), np.diff(_offsets(places)[ends]))
        key, n = np.unique(text * max(len(pairs), 1) + places.flatten().to_numpy(), return_counts=True)
        spot = key % max(len(pairs), 1)
        lists = np.searchsorted(key, np.arange(len(texts) + 1) * max(len(pairs), 1))
        texts_with = np.bincount(spot, minlength=len(pairs))
        return [*sums, digests], pairs, _lists(lists, spot.astype(np.int32)), _lists(lists, n.astype(np.int32)), texts_with


def _aligner(df: DataFrame, a_path: str | None, b_path: str | None):
    """What makes the aligner, once in each task."""
    with open(a_path or default_a(), encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast((f.read(), read_model(b_path)))
    state: dict[str, Aligner] = {}

    def get() -> Aligner:
        return state.get("aligner") or state.setdefault("aligner", Aligner(*shared.value))

    return get


def align(df: DataFrame, text: str = "text", carry: list[str] | None = None, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """For every row doc (a struct of the columns to carry), a_ids, b_ids, groups (n_a, n_b: tokens of each) and links (a, b: numbers of tokens that overlap)."""
    get = _aligner(df, a_path, b_path)
    rows = df.select(F.struct(*[field(c) for c in (df.columns if carry is None else carry)]).alias("doc"), field(text).alias("text"))

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), *get().texts(batch.column(1)).values()]

    return map_columns(rows, run, "a_ids array<int>, b_ids array<int>, groups array<struct<n_a:int,n_b:int>>, links array<struct<a:int,b:int>>", rows.schema["doc"])


def _blocks(docs: DataFrame, doc_id: str, text: str, a_path: str | None, b_path: str | None) -> DataFrame:
    """A row for each document (block, doc_id, counts, digest, spots, n) and rows for the pairs of each block (block, pairs)."""
    get = _aligner(docs, a_path, b_path)
    rows = docs.select(field(doc_id).alias("doc_id"), field(text).alias("text"))
    ddl = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, spots array<int>, n array<int>, pairs array<struct<at:int,pair:bigint,held:int>>"
    schema = StructType([StructField("block", StructType.fromDDL("b bigint")["b"].dataType), rows.schema["doc_id"], *StructType.fromDDL(ddl)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in (some for whole in batches for some in slices(whole, BLOCK_ROWS, BLOCK_BYTES)):
            told, pairs, spots, n, held = get().block(batch.column(1))
            size = batch.num_rows
            columns = [pa.array(np.full(size, block)), batch.column(0), *map(pa.array, told), spots, n, pa.nulls(size, arrow.field("pairs").type)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
            for at in range(0, len(pairs), PAIRS_A_ROW):
                own = slice(at, at + PAIRS_A_ROW)
                struct = pa.StructArray.from_arrays([pa.array(np.arange(at, at + len(pairs[own])), pa.int32()), pa.array(pairs[own]), pa.array(held[own], pa.int32())], ["at", "pair", "held"])
                columns = [pa.array([block]), *(pa.nulls(1, t) for t in arrow.types[1:-1]), _lists(np.array([0, len(struct)]), struct)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
            block += 1
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def _counted(spots: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no pair of its A id is held by more)."""
    counts = saved(spots.groupBy("pair").agg(F.sum("held").alias("n")))
    own = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(own).agg(F.max("n").alias("most"))
    return counts.withColumn("a", own).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _spots(blocks: DataFrame) -> DataFrame:
    return blocks.where("pairs is not null").select("block", F.inline("pairs"))


def pair_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Every pair of ids that is linked somewhere: a, b, n (documents that hold it) and best."""
    counted = _counted(_spots(saved(_blocks(docs, doc_id, text, a_path, b_path))))
    return counted.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n", "best")


def alignment_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each row: doc_id, n_a, n_b, n_groups, n_links, n_best (links of a best pair), count_sum (over links) and groups_sha256."""
    blocks = saved(_blocks(docs, doc_id, text, a_path, b_path))
    spots = _spots(blocks)
    found = spots.join(_counted(spots), "pair").select(F.col("block").alias("of_block"), "at", "n", "best")
    rows = blocks.where("pairs is null").drop("pairs")
    told = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")])
    arrow = to_arrow_schema(schema)

    def summed(own: pa.Table, pairs: pa.Table) -> pa.Table:
        counts, best = np.zeros((2, pairs.num_rows), np.int64)
        at = pairs.column("at").to_numpy()
        counts[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
        own = own.combine_chunks()
        lists = [x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (own.column("spots"), own.column("n"))]
        spot, n = (x.flatten().to_numpy() for x in lists)
        ends = _offsets(lists[0]) if own.num_rows else np.zeros(1, np.int64)
        of = lambda values: pa.array(np.diff(_starts(values[spot] * n)[ends]))
        return pa.Table.from_arrays([own.column("doc_id"), *(own.column(c) for c in told), of(best), of(counts), own.column("groups_sha256")], schema=arrow)

    return rows.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(summed, schema)
