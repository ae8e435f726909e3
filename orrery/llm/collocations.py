"""Phrase collocations on a weighted de Bruijn graph of words.

Texts are cut into pieces and words. Nodes are three neighbouring words of a piece, edges four: each edge joins the nodes
of its first and its last three words, and its weight is how often the four words stand together. Only the longest n-grams, the edges,
are counted in texts. Shorter counts come from the flow through nodes: what starts with a node's words goes on over one of its
edges, or ends a piece there, so a count is the sum of the outgoing weights and of the piece ends; the same step leads from
three words to two and from two to one.

A phrase can't be more frequent than its words and its pairs of words, so pieces are also cut at words of fewer than ``least``
occurrences and between words whose pair is rarer than that, which changes no count of a frequent phrase. For the first, words get numbers:
neighbouring rows of a task and a language are a block, with the block's distinct words and its text as their places; the words of all blocks are
counted, the frequent ones numbered and joined back to blocks. For the second, pairs are counted and the frequent ones put into a Bloom
filter of bounded size, the one thing that is broadcast: it knows all frequent pairs, and what else it takes for one only
stays uncut, so results are exact however full it is. Tasks make graphs of their blocks, and unary paths (nodes with one edge in, one out and
nothing that starts or ends there) are compacted to one row with one weight; the corpus' graph is the sum over the compacted ones.

Everything is per language; a null language is 'und', a null text has no words. All counts are exact; products are decimals of 38 digits.
Repeated rows count again. No frequent words, or no rows, give no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orrery.llm.common import field, saved, slices

LEAST, PERCENT, TOP = 30, 80, 2_000
#: Rows and bytes of text that make blocks together.
BLOCK_ROWS, BLOCK_BYTES = 10_000, 4_000_000
#: Words of blocks that a task takes together.
WORDS_AT_ONCE = 2_000_000
#: Bits of a pair in the filter of frequent pairs, and the filter's greatest size (16 MB).
FILTER_BITS, MOST_BITS = 4, 1 << 27
#: Parts that a language is ranked in first.
PARTS = 64
UNKNOWN = "und"
_END = b"\xff"  # a byte that no text holds
#: A-Z become a-z, a tab a space, what ends a piece the end.
_PLAIN = bytes(255 if b == 255 or b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the texts, and the texts as numbers of words from 1, with 0 where a piece ends."""
    sign = np.frombuffer(_END.join([b"", *texts, b""]).translate(_PLAIN), np.uint8)
    kept = sign != 32
    begins = kept.copy()
    begins[1:] &= (sign[:-1] == 32) | (sign[:-1] == 255) | (sign[1:] == 255)  # an end is a word of its own
    at = np.append((np.cumsum(kept) - 1)[begins], np.count_nonzero(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(sign[kept]))])
    coded = words.dictionary_encode()  # the first is an end, so that is number 0
    return coded.dictionary[1:].cast(pa.large_string()), coded.indices.to_numpy().astype(np.int32)


def _blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """block, lang, words (word, n) and stream (32-bit numbers as bytes)."""
    schema = StructType.fromDDL("block bigint, lang string, words array<struct<word:string,n:bigint>>, stream binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in (some for whole in batches for some in slices(whole, BLOCK_ROWS, BLOCK_BYTES)):
            by_lang: dict[str, list[bytes]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value.is_valid:
                    by_lang.setdefault(name, []).append(value.as_buffer().to_pybytes())
            for name, texts in by_lang.items():
                words, stream = split(texts)
                counts = np.bincount(stream, minlength=len(words) + 1)[1:]
                pairs = pa.StructArray.from_arrays([words, pa.array(counts)], ["word", "n"])
                columns = [pa.array([block]), pa.array([name]), pa.LargeListArray.from_arrays(pa.array([0, len(pairs)]), pairs), pa.array([stream.tobytes()])]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
                block += 1
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.coalesce(field(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), field(text).alias("text"))
    return rows.mapInArrow(run, schema)


def _numbered(words: DataFrame, least: int) -> DataFrame:
    """The frequent words of all languages, with numbers from 0."""
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent = saved(frequent.select("lang", "word", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")))
    sizes = {r["part"]: r["count"] for r in frequent.groupBy("part").count().collect()}  # a row for each partition
    first, before = [], 0
    for part in sorted(sizes):
        first.append((part, before))
        before += sizes[part]
    if before >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    offsets = words.sparkSession.createDataFrame(first, "part int, first bigint")
    return frequent.join(offsets, "part").select("lang", "word", (F.col("row") + F.col("first")).cast("int").alias("id"))


def _distinct(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, which of them each row is, and the sum of the weights of each."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which, np.bincount(which, weights, int(new.sum())).astype(np.int64)


def compact(edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary paths of a graph of distinct edges (rows of four words): how many words each path has, their words, and its weight."""
    n = len(edges)
    if not n:
        return np.empty(0, np.int64), np.empty(0, edges.dtype), weights
    _, node, _ = _distinct(np.concatenate([edges[:, :3], edges[:, 1:]]))
    tail, head, nodes = node[:n], node[n:], int(node.max()) + 1
    flow = lambda of: np.bincount(of, weights, nodes)
    unary = (np.bincount(head, minlength=nodes) == 1) & (np.bincount(tail, minlength=nodes) == 1) & (flow(head) == flow(tail))
    into = np.empty(nodes, np.int64)
    into[head] = np.arange(n)
    own = np.arange(n)
    first = np.where(unary[tail], into[tail], own)  # each edge's first edge on its path, by doubling
    far = (first != own).astype(np.int64)
    for _ in range(int(n).bit_length()):
        if not (first[first] != first).any():
            break
        far = far + far[first]
        first = first[first]
    ring = unary[tail[first]]  # a path that runs into itself stays in single edges
    first, far = np.where(ring, own, first), np.where(ring, 0, far)
    order = np.lexsort((far, first))
    begins = np.flatnonzero(far[order] == 0)
    edges_of = np.diff(begins, append=n)
    lengths = edges_of + 3
    ends = np.cumsum(lengths)
    words = np.empty(int(ends[-1]), edges.dtype)
    at = ends - lengths
    for k in range(3):
        words[at + k] = edges[order[begins], k]
    words[np.arange(n) + 3 * np.repeat(np.arange(1, len(begins) + 1), edges_of)] = edges[order, 3]
    return lengths, words, weights[order[begins]]


def paths_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a text of word numbers, with -1 where a run ends, as rows: lengths, words and weights of its compacted paths, and of the last one, two and three words of runs."""
    good = numbers >= 0
    held = [good]  # whether k + 1 words end here
    for k in range(1, 4):
        held.append(held[-1].copy())
        held[-1][:k] = False
        held[-1][k:] &= good[:-k]
    last = np.ones(len(good), bool)
    last[:-1] = ~good[1:]
    windows = lambda at, k: np.stack([numbers[at - (k - 1 - j)] for j in range(k)], 1) if k else None
    edges, _, weights = _distinct(windows(np.flatnonzero(held[3]), 4))
    out = [compact(edges, weights)]
    for k in (3, 2, 1):
        rows, _, n = _distinct(windows(np.flatnonzero(held[k - 1] & last), k))
        out.append((np.full(len(rows), k), rows.reshape(-1), n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(blocks: DataFrame, numbered: DataFrame) -> DataFrame:
    """stream: the texts of each block as numbers of frequent words (32 bits, as bytes), with -1 where a run of them ends."""
    spots = blocks.select(F.col("block").alias("of_block"), "lang", F.posexplode("words").alias("at", "word")).select("of_block", "lang", "at", "word.word")
    ids = spots.join(numbered, ["lang", "word"]).select("of_block", "at", "id")
    schema = StructType.fromDDL("stream binary")
    arrow = to_arrow_schema(schema)

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        found = []
        for value in own.column("stream"):
            stream = np.frombuffer(value.as_buffer(), np.int32)
            of = np.full(int(stream.max(initial=0)) + 1, -1, np.int32)
            of[words.column("at").to_numpy() + 1] = words.column("id").to_numpy()
            numbers = of[stream]
            kept = numbers >= 0
            kept[1:] |= kept[:-1]  # one end behind each run
            found.append(numbers[kept].tobytes())
        return pa.Table.from_arrays([pa.array(found, arrow.types[0])], schema=arrow)

    return blocks.select("block", "stream").groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(run, schema)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Streams of neighbouring blocks as one, of so many words at a time."""
    held, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            held += [np.frombuffer(value.as_buffer().to_pybytes(), np.int32), np.array([-1], np.int32)]
            size += len(held[-2])
            if size >= WORDS_AT_ONCE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _pairs_of(numbers: np.ndarray) -> np.ndarray:
    """Each two neighbouring numbers as one, at the place of the first; -1 where a run ends."""
    a, b = numbers[:-1].astype(np.int64), numbers[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), (a << 32) | b, -1)


def _places(pairs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits of pairs in a filter of size bits, a power of two."""
    x = pairs.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # fixed values: the steps of splitmix64
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(FILTER_BITS):
        yield (low + np.uint64(i) * high) & np.uint64(size - 1)


def frequent_pairs(runs: DataFrame, least: int) -> np.ndarray:
    """A Bloom filter of the pairs of words that stand together at least `least` times: of a size that their number says, MOST_BITS at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers in _together(batches):
            pairs = _pairs_of(numbers)
            p, n = np.unique(pairs[pairs >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["p", "n"])

    pairs = saved(runs.mapInArrow(count, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("p"))
    size = min(max(1 << 10, 1 << (12 * pairs.count()).bit_length()), MOST_BITS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), size):
                np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        cells = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(words[cells])], names=["cell", "bits"])

    merged = pairs.mapInArrow(bits, "cell bigint, bits bigint").groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[merged.column("cell").to_numpy()] = merged.column("bits").to_numpy()
    return out.view(np.uint8)


def cut_at_rare_pairs(numbers: np.ndarray, held: np.ndarray) -> np.ndarray:
    """numbers with -1 between words whose pair isn't in the filter."""
    pairs = _pairs_of(numbers)
    inside = pairs >= 0
    known = np.ones(int(inside.sum()), bool)
    for at in _places(pairs[inside], 8 * len(held)):
        known &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return np.insert(numbers, np.flatnonzero(inside)[~known] + 1, -1)


def _graph(runs: DataFrame, held: np.ndarray) -> DataFrame:
    """n, and path (word numbers of a path of four words and more) or k, p, q (the last words of runs, see _key())."""
    shared = runs.sparkSession.sparkContext.broadcast(held)
    schema = StructType.fromDDL("path array<int>, k int, p bigint, q bigint, n bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers in _together(batches):
            lengths, path, n = paths_of(cut_at_rare_pairs(numbers, shared.value))
            first, short = np.cumsum(lengths) - lengths, lengths < 4
            at, size = first[short], lengths[short]
            word = lambda i: np.where(size > i, path[np.minimum(at + i, len(path) - 1)], 0).astype(np.int64) if len(at) else at  # noqa: B023, E731
            ends = [size, np.where(size == 1, word(0), (word(0) << 32) | word(1)), word(2)]
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths[~short])).astype(np.int64)), pa.array(path[np.repeat(~short, lengths)].astype(np.int32)))
            some = [lists, *(pa.nulls(len(lists), t) for t in arrow.types[1:4]), pa.array(n[~short].astype(np.int64))]
            rest = [pa.nulls(len(at), arrow.types[0]), *map(pa.array, ends), pa.array(n[short].astype(np.int64))]
            for columns in (some, rest):
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return runs.mapInArrow(run, schema)


def _pack(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint"))


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _low(x: Column) -> Column:
    return x.bitwiseAND(0xFFFFFFFF)


def _word(i: int) -> Column:
    """Word i (from 0) of a phrase of k words in p and q."""
    k, p, q = F.col("k"), F.col("p"), F.col("q")
    return [F.when(k == 1, p).otherwise(_high(p)), _low(p), F.when(k == 3, q).otherwise(_high(q)), _low(q)][i]


def _key(words: list[Column]) -> tuple[Column, Column]:
    """p and q of a phrase of these words."""
    zero = F.lit(0).cast("bigint")
    w = [x.cast("bigint") for x in words]
    return (w[0], zero) if len(w) == 1 else (_pack(w[0], w[1]), zero if len(w) == 2 else w[2] if len(w) == 3 else _pack(w[2], w[3]))


def flow_counts(graph: DataFrame, least: int) -> DataFrame:
    """k, p, q, n of all phrases of one to four words with n of at least least: edges are summed, then each node from its edges and ends."""
    at = lambda i: F.get("path", i)
    windows = F.transform(F.sequence(F.lit(0), F.size("path") - 4), lambda i: F.struct(_pack(at(i), at(i + 1)).alias("p"), _pack(at(i + 2), at(i + 3)).alias("q")))
    rows = graph.where("path is not null").select("n", F.inline(windows)).select(F.lit(4).alias("k"), "p", "q", "n").groupBy("k", "p", "q").agg(F.sum("n").alias("n"))
    shorter = {3: ("p", "shiftright(q, 32)"), 2: ("p", "0L"), 1: ("shiftright(p, 32)", "0L")}  # without the last word
    for k, (p, q) in shorter.items():
        # each frequent phrase goes on as it is; each of k + 1 words also adds to its first k
        both = rows.select(F.expr(f"stack(2, k, p, q, n, {k}, {p}, {q}, if(k = {k + 1}, n, 0L)) AS (k, p, q, n)"))
        more = both.where(((F.col("k") > k) & (F.col("n") >= least)) | ((F.col("k") == k) & (F.col("n") > 0)))
        ends = graph.where(F.col("k") == k).select("k", "p", "q", "n")
        rows = more.union(ends).groupBy("k", "p", "q").agg(F.sum("n").alias("n"))
    return rows.where(F.col("n") >= least)


def _parts(counts: DataFrame) -> DataFrame:
    """For each phrase of several words, its two parts at each cut: k, p, q, a, cut, right, and key (k, p, q of the part)."""
    made = []
    for k in (2, 3, 4):
        words = [_word(i) for i in range(k)]
        for cut in range(1, k):
            for right, part in ((False, words[:cut]), (True, words[cut:])):
                p, q = _key(part)
                key = F.struct(F.lit(len(part)).alias("k"), p.alias("p"), q.alias("q"))
                made.append(F.when(F.col("k") == k, F.struct(F.lit(cut).alias("cut"), F.lit(right).alias("right"), key.alias("key"))))
    some = F.filter(F.array(*made), lambda x: x.isNotNull())
    return counts.where("k > 1").select("k", "p", "q", F.col("n").alias("a"), F.inline(some))


def scored(counts: DataFrame, percent: int) -> DataFrame:
    """k, p, q, a, l, r and score of the phrases that stay: the least of all cuts, and none that is nearly always part of a longer one."""
    parts = _parts(counts)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    sizes = counts.select(F.struct("k", "p", "q").alias("key"), F.col("n").alias("f"))
    sums = parts.join(sizes, "key").groupBy("k", "p", "q", "a", "cut").agg(F.max(F.when(~F.col("right"), F.col("f"))).alias("l"), F.max(F.when(F.col("right"), F.col("f"))).alias("r"))
    sums = sums.withColumn("score", F.expr("CAST((CAST(2000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)"))
    least = sums.groupBy("k", "p", "q", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    # A phrase in a longer one is also in one of one word more, which is as frequent as the longer one at least.
    longer = parts.where(F.col("key.k") == F.col("k") - 1).where("key.k > 1").groupBy("key").agg(F.max("a").alias("longer"))
    longer = longer.select("key.k", "key.p", "key.q", "longer")
    stays = F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * percent)
    return least.join(longer, ["k", "p", "q"], "left").where(stays).select("k", "p", "q", "a", "least.l", "least.r", "least.score")


def with_words(phrases: DataFrame, numbered: DataFrame) -> DataFrame:
    """phrases with lang and phrase in place of k, p and q."""
    kept = [c for c in phrases.columns if c not in ("k", "p", "q")]
    places = F.filter(F.array(*[F.when(F.col("k") > i, F.struct(F.lit(i).alias("at"), _word(i).cast("int").alias("id"))) for i in range(4)]), lambda x: x.isNotNull())
    words = phrases.select("*", F.inline(places)).join(numbered, "id")
    said = words.groupBy("k", "p", "q", *kept).agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    return said.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), *kept)


def _prepared(docs: DataFrame, text: str, lang: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words of all blocks (lang, word, n), the numbered words, and the counts of frequent phrases."""
    blocks = saved(_blocks(docs, text, lang))
    words = blocks.select("lang", F.inline("words"))
    numbered = saved(_numbered(words, least))
    runs = saved(_runs(blocks, numbered))
    graph = saved(_graph(runs, frequent_pairs(runs, least)))
    return words, numbered, saved(flow_counts(graph, least))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, phrase, words and n of every phrase of one to four words with n of at least least."""
    _, numbered, counts = _prepared(docs, text, lang, least)
    return with_words(counts.withColumn("size", F.col("k")), numbered).select("lang", "phrase", F.col("size").alias("words"), "n")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language) and score: the first phrases of each language by score, a and phrase."""
    words, numbered, counts = _prepared(docs, text, lang, least)
    found = saved(with_words(scored(counts, percent), numbered))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    some = found.select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
