"""Near duplicates by SetSketch registers.

A document's set is that of its distinct word shingles (as 64-bit hashes). Its sketch has ``bands * rows``
registers: register i holds the smallest of exponentially distributed hash values of the set's elements,
truncated to a whole power of the base, so that sketches of parts merge by maximum and two sketches agree
in a register about as often as the sets overlap.

Documents of one set form a class; only classes go on. A band of equal registers puts two classes into
one bucket. In each bucket every class is paired with the bucket's smallest class only, which keeps the
pairs linear in the bucket's size; the joint likelihood of both registers (greater, less, equal) drops
pairs whose overlap is clearly below the threshold, and the full sets of the rest are compared. Links are
contracted to components by alternating large and small stars. Then all buckets that still hold more than
one component are gone through again: their cross-component pairs are estimated in blocks of bounded size
and the likely ones verified, so no pair of a bucket is left out. A pair of similarity 0.8 shares none
of 28 bands of 4 registers with a probability below 1e-6.

Words are runs of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z in lower case. A text of fewer words than a
shingle has one element, the whole sequence. Null texts and texts without words have an empty set, are
linked with nothing and keep their own id. Rows that repeat an id are rows of their own: links go by
text. A null id counts as larger than any other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import LOWER_BYTES, field, map_columns, saved

BANDS, ROWS = 28, 4
#: Base of the registers, rate of the exponential values (elements expected at most), and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Pairs stay while the likelihood at the threshold is within e^-DOUBT of the best: about five standard deviations.
DOUBT = 12.5
#: Classes of one bucket that are compared in one group. Larger buckets are dealt into pairs of such blocks.
BLOCK = 1_024
#: Sets wanted by pairs up to this many are found by a broadcast of their keys, more by a shuffle.
BROADCAST_KEYS = 500_000

_M1, _M2, _MUL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:  # bounded memory
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, size: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    tokens = text.translate(LOWER_BYTES).split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - size + 1)
    out = np.full(n, min(size, len(tokens)), np.uint64)
    for i in range(min(size, len(tokens))):
        out = out * _MUL + hashes[i : i + n]
    return np.unique(_mixed(out))


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    base = _mixed(np.arange(1, 2 * m + 1, dtype=np.uint64) * _MUL)
    return (base[:m] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (base[m:] >> np.uint64(32)).astype(np.uint32)


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row for each set, none of them empty: floor(1 - log_base(smallest value)) for each register, kept within 0 and TOP."""
    mul, add = seeds(m)
    low = (np.concatenate(sets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((m, len(sets)), np.uint32)
    h, shifted = np.empty_like(low), np.empty_like(low)
    for i in range(m):
        np.bitwise_xor(low, add[i], out=h)
        np.multiply(h, mul[i], out=h)
        np.right_shift(h, np.uint32(15), out=shifted)
        np.bitwise_xor(h, shifted, out=h)
        np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
        least[i] = np.minimum.reduceat(h, starts)
    value = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def in_chunks(sets: list[np.ndarray], m: int) -> list[bytes | None]:
    """The sketches of any sets, made for as many at a time as stay in a CPU's cache; None for an empty set."""
    out: list[bytes | None] = [None] * len(sets)
    held: list[int] = []
    total = 0
    for i, elements in enumerate(sets):
        if len(elements):
            held.append(i)
            total += len(elements)
        if held and (total > 50_000 or i == len(sets) - 1):
            for k, row in zip(held, registers([sets[k] for k in held], m), strict=True):
                out[k] = row.tobytes()
            held, total = [], 0
    return out


def likely(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of the threshold or more is likely enough, by the joint likelihood of the sketches (rows of a and b)."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)  # by the sizes alone

    def side(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def logged(j: np.ndarray) -> np.ndarray:
        p, q = np.maximum(side(u - v * j), 1e-9), np.maximum(side(v - u * j), 1e-9)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-9))

    best = np.full(u.shape, -np.inf)
    for j in np.linspace(0, 1, 41):
        best = np.maximum(best, np.where(j <= most, logged(np.full(u.shape, j)), -np.inf))
    above = np.full(u.shape, -np.inf)
    for j in np.linspace(threshold, 1, 9):
        above = np.maximum(above, np.where(j <= most + 1e-9, logged(np.full(u.shape, j)), -np.inf))
    return above >= best - DOUBT


def key_of(elements: np.ndarray) -> bytes | None:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n, key (of the set, null if it is empty) and sketch of every row."""
    state: dict = {}

    def run(batch: pa.RecordBatch) -> list:
        words = state.setdefault("words", _WordHashes())
        sets = [shingle_set(text.as_py(), size, words) for text in batch.column(1)]
        return [batch.column(0), [len(s) for s in sets], [key_of(s) for s in sets], in_chunks(sets, bands * rows)]

    return map_columns(docs, run, "n bigint, key binary, sketch binary", docs.schema["doc_id"])


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """A row for each class and band: bucket (number of the band and hash of its registers) and key."""
    width = 2 * rows
    band = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring("sketch", 1 + width * i, width)).alias("value")) for i in range(bands)])
    return classes.select("key", F.explode(band).alias("bucket"))


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of class keys that are likely to reach the threshold."""
    of = classes.select("key", "n", "sketch")
    a, b = (of.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batch: pa.RecordBatch) -> list:
        if not batch.num_rows:
            return [batch.column(0), batch.column(1)]
        n = [batch.column(i).to_numpy().astype(float) for i in (2, 3)]
        s = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5)]
        good = pa.array(likely(*n, *s, threshold))
        return [batch.column(0).filter(good), batch.column(1).filter(good)]

    return map_columns(both, run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key and full set of the wanted classes. A row of the class is looked up by its id; the set is made of its text and must have the key."""
    one = saved(wanted.select("key", "doc_id"))
    small = one.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = docs.join(F.broadcast(one) if small else one, docs["doc_id"].eqNullSafe(one["doc_id"])).select("key", "text")
    state: dict = {}

    def run(batch: pa.RecordBatch) -> list:
        words = state.setdefault("words", _WordHashes())
        keys, sets = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            elements = shingle_set(text.as_py(), size, words)
            if key_of(elements) == key:
                keys.append(key)
                sets.append(elements.tobytes())
        return [keys, sets]

    return map_columns(texts, run, "key binary, elements binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("key").alias("a"), F.col("elements").alias("e_a"))
    b = sets.select(F.col("key").alias("b"), F.col("elements").alias("e_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "e_a", "e_b")

    def run(batch: pa.RecordBatch) -> list:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            least, most = sorted((len(x), len(y)))
            if 100 * least < percent * most:
                good.append(False)
                continue
            common = least + most - len(np.union1d(x, y))
            good.append(100 * common >= percent * (least + most - common))
        good = pa.array(good, pa.bool_())
        return [batch.column(0).filter(good), batch.column(1).filter(good)]

    return map_columns(both, run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """key and root (the smallest key reachable) of every key in links (a, b): alternating large and small stars."""
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = saved(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
        before = now


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets with several components, but for a bucket's smallest class, which all were tried against.

    bucket, key, root, inside (whether the root is that of the bucket's largest component), n_in (members of that one) and n_out (of all others).
    """
    known = saved(members.where("n > 2").join(roots, "key", "left").select("bucket", "key", "pivot", F.coalesce("root", "key").alias("root")))
    sizes = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = F.max(F.struct("size", "root"))
    several = sizes.groupBy("bucket").agg(largest.getField("root").alias("top"), largest.getField("size").alias("n_in"), (F.sum("size") - F.max("size")).alias("n_out"))
    several = saved(several.where("n_out > 0"))
    return known.join(several, "bucket").where("key <> pivot").select("bucket", "key", "root", (F.col("root") == F.col("top")).alias("inside"), "n_in", "n_out")


def _links_across(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, bands: int) -> DataFrame:
    """Verified links (a, b) between components inside the open buckets.

    Members outside of a bucket's largest component are compared with each other and with that component's, whose own members have
    no need to meet again. Both lots are dealt into blocks; each pair of blocks is a group of its own, so no group exceeds two blocks or so.
    """
    full = rows.join(classes.select("key", "sketch").join(sets, "key"), "key")
    outer, inner = (F.greatest(F.ceil(F.col(n) / BLOCK).cast("int"), F.lit(1)) for n in ("n_out", "n_in"))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("inside"), inner).otherwise(outer)).cast("int")
    # j counts outer blocks, and inner ones behind them: (-1 - block)
    with_outer = F.transform(F.sequence(F.lit(0), outer - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    with_inner = F.transform(F.sequence(F.lit(0), inner - 1), lambda k: F.struct(own.alias("i"), (-1 - k).alias("j")))
    from_inner = F.transform(F.sequence(F.lit(0), outer - 1), lambda k: F.struct(k.alias("i"), (-1 - own).alias("j")))
    squares = full.withColumn("square", F.explode(F.when(F.col("inside"), from_inner).otherwise(F.concat(with_outer, with_inner))))
    squares = squares.select(F.col("bucket.band").alias("band"), F.col("bucket.value").alias("value"), "square.i", "square.j", F.when(F.col("inside"), -1 - own).otherwise(own).alias("own"), "key", "root", "sketch", "elements")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright, as the work is in comparing and not in the bytes
    group = ["band", "value", "i", "j"]
    laid = squares.repartition(parts, *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            if held.num_rows:
                last = int(_groups(held, group)[-1])  # the last group may go on in the next batch
                if last:
                    yield _links_in_groups(held.slice(0, last), group, percent, bands)
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield _links_in_groups(held, group, percent, bands)

    return laid.mapInArrow(run, "a binary, b binary")


def _groups(rows: pa.Table, by: list[str]) -> np.ndarray:
    """First rows of the groups."""
    same = np.ones(rows.num_rows - 1, bool)
    for c in by:
        values = rows.column(c).to_numpy()
        same &= values[1:] == values[:-1]
    return np.concatenate([[0], np.flatnonzero(~same) + 1])


def _likely_pairs(rows: pa.Table, by: list[str], size: np.ndarray, threshold: float, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of likely pairs of different roots: row k meets row k + 1, then k + 2, as far as its group goes, all rows at once."""
    n = rows.num_rows
    starts = _groups(rows, by)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    own, i, j, band = (rows.column(c).to_numpy() for c in ("own", "i", "j", "band"))
    root = np.unique(np.array([r.hex() for r in rows.column("root").to_pylist()]), return_inverse=True)[1]
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(n, bands, -1)
    m = sketch.shape[1] * sketch.shape[2]
    least = threshold * m - 5 * np.sqrt(m * threshold * (1 - threshold))  # a pair of the threshold has so many equal registers
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    k, step = np.arange(n), 1
    while len(k := k[k + step < ends[k]]):
        meet = np.where(j[k] < 0, (own[k] < 0) != (own[k + step] < 0), (i[k] == j[k]) | (own[k] != own[k + step]))
        x = k[(root[k] != root[k + step]) & meet]
        x = x[np.minimum(size[x], size[x + step]) >= threshold * np.maximum(size[x], size[x + step])]
        for at in range(0, len(x), 20_000):
            a = x[at : at + 20_000]
            equal = sketch[a] == sketch[a + step]
            good = (equal.sum((1, 2)) >= least) & (equal.all(2).argmax(1) == band[a])  # in the first bucket that they share
            a = a[good]
            a = a[likely(size[a], size[a + step], sketch[a].reshape(len(a), m), sketch[a + step].reshape(len(a), m), threshold)]
            found_a.append(a)
            found_b.append(a + step)
        step += 1
    return np.concatenate(found_a), np.concatenate(found_b)


def _links_in_groups(rows: pa.Table, by: list[str], percent: int, bands: int) -> pa.RecordBatch:
    keys = rows.column("key").to_pylist()
    sets = [np.frombuffer(e, np.uint64) for e in rows.column("elements").to_pylist()]
    size = np.array([len(e) for e in sets], np.int64)
    a, b = _likely_pairs(rows, by, size.astype(float), percent / 100, bands)
    out: list[tuple[bytes, bytes]] = []
    if len(a):
        # Each element is a number; the set of one row is marked, and the marks are summed over the sets of its partners.
        elements, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        marks = np.zeros(len(elements), np.int8)
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                x = above[x] = above.get(above[x], above[x])
            return x

        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.flatnonzero(np.diff(a, prepend=-1))
        for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
            x, others = int(a[at]), b[at:end]
            own = numbers[begin[x] : begin[x + 1]]
            marks[own] = 1
            for some in np.array_split(others, max(1, int(size[others].sum() // 2_000_000))):
                lengths = size[some]
                places = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                common = np.add.reduceat(marks[numbers[places]], np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64)
                linked = 100 * common >= percent * (size[x] + lengths - common)
                for y in some[linked].tolist():
                    if (p := top(x)) != (q := top(y)):
                        above[p] = q
                        out.append((max(keys[x], keys[y]), min(keys[x], keys[y])))
            marks[own] = 0
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id (smallest id of all linked rows), kept (whether that is its own)."""
    docs = docs.select(field(doc_id).alias("doc_id"), field(text).cast("binary").alias("text"))
    threshold = percent / 100
    all_rows = saved(sketches(docs, size, bands, rows))
    classes = saved(
        all_rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    )
    buckets = _buckets(classes, bands, rows)
    heads = saved(buckets.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"))  # a table, so that a bucket of very many classes can be split in the join
    members = saved(buckets.join(heads, "bucket"))
    tried = members.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    likely_pairs = saved(_estimated(tried, classes, threshold))

    def sets_of(keys: DataFrame) -> DataFrame:
        return saved(_sets(docs, keys.select("key").distinct().join(classes.select("key", "doc_id"), "key"), size))

    links = saved(_verified(likely_pairs, sets_of(likely_pairs.select(F.explode(F.array("a", "b")).alias("key"))), percent))
    roots = components(links)
    open_rows = saved(_open_buckets(members, roots))
    if not open_rows.isEmpty():
        more = saved(_links_across(open_rows, classes, sets_of(open_rows), percent, bands))
        if not more.isEmpty():
            roots = components(roots.select(F.col("key").alias("a"), F.col("root").alias("b")).union(more))  # stars so far, and what joins them
    own = classes.select("key", "doc_id").join(roots, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = own.join(least, "root").select("key", "component_id")
    joined = all_rows.select("doc_id", "n", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
