"""Contiguous shards of near equal bytes that keep equal texts together.

The rows are laid out in order of a hash of the text, then their id, over range partitions. The
bytes and rows of each partition are summed, the running sums of these few totals give every partition
its global offset, and within a partition a cumulative sum gives each row its place. A group is all rows of
one text (one hash of it); of each partition's first and last group the totals tell how far it goes in others. The shard of
a group is the one of ``shards`` equal stretches of all bytes that holds the group's middle byte, so cuts lie
at the boundary of a group that is nearest the target. Only a group larger than a stretch is split, by the
middle bytes of its rows. Law: ``bytes``.

A null text has no bytes, size 1 and checksum 0, and is of one group with empty texts; equal rows get neighbouring
slots; an empty table gives no rows. A group of any size is dealt over partitions by id and a running number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm.common import field, saved

PLACED = "size bigint, text_crc32 bigint, shard int, row bigint"
EDGES = "part int, bytes bigint, rows bigint, first bigint, first_bytes bigint, last bigint, last_bytes bigint"


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    data = field(text).cast("binary")
    return docs.select(
        field(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64(F.coalesce(data, F.lit(b""))).alias("group"),
        F.monotonically_increasing_id().alias("number"),
    )


def _edges(laid: DataFrame) -> list[dict]:
    """One row for each partition with rows, in order: its totals, and the bytes of its first and last group in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, size, group = batch.column(0)[0].as_py(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if out is None:
                out = {"part": part, "bytes": 0, "rows": 0, "first": int(group[0]), "first_bytes": 0, "last": int(group[0]), "last_bytes": 0}
            out["first_bytes"] += int(size[group == out["first"]].sum())
            out["last_bytes"] = int(size[group == group[-1]].sum()) + (out["last_bytes"] if out["last"] == group[-1] else 0)
            out |= {"last": int(group[-1]), "bytes": out["bytes"] + int(size.sum()), "rows": out["rows"] + len(size)}
        if out is not None:
            yield pa.RecordBatch.from_pylist([out], pa.schema([(k, pa.int32() if k == "part" else pa.int64()) for k in out]))

    return [r.asDict() for r in laid.select("part", "size", "group").mapInArrow(run, EDGES).orderBy("part").collect()]


def _offsets(edges: list[dict]) -> dict[int, tuple[int, int, int, int, int]]:
    """For each partition: its first byte and row, where its first group begins, and where its first and last group end, in other partitions if need be."""
    at = row = 0
    for k, e in enumerate(edges):
        joined = k and edges[k - 1]["last"] == e["first"]
        before = edges[k - 1] if joined else None
        e |= {"at": at, "row": row, "begin": (before["begin"] if before["first"] == before["last"] else at - before["last_bytes"]) if joined else at}
        at, row = at + e["bytes"], row + e["rows"]
    for k in range(len(edges) - 1, -1, -1):
        e, after = edges[k], edges[k + 1] if k + 1 < len(edges) else None
        e["last_end"] = after["first_end"] if after and after["first"] == e["last"] else e["at"] + e["bytes"]
        e["first_end"] = e["last_end"] if e["first"] == e["last"] else e["at"] + e["first_bytes"]
    return {e["part"]: (e["at"], e["row"], e["begin"], e["first_end"], e["last_end"]) for e in edges}


def shards_of(size: np.ndarray, group: np.ndarray, at: int, begin: int, first_end: int, last_end: int, shards: int, total: int) -> np.ndarray:
    """The shard of each row of a partition that starts at byte at."""
    end = at + np.cumsum(size)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    starts, ends = (end - size)[first], end[np.append(first[1:], len(size)) - 1]
    starts[0], ends[-1] = begin, last_end
    if len(first) > 1:
        ends[0] = first_end
    n = np.diff(np.append(first, len(size)))
    starts, ends = np.repeat(starts, n), np.repeat(ends, n)
    twice = np.where((ends - starts) * shards <= total, starts + ends, 2 * end - size)
    return np.minimum(twice * shards // (2 * total), shards - 1).astype(np.int32)


def assign_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, size, text_crc32, law, shard, slot (from 0 in each shard), grown_shard (null by this law)."""
    rows = saved(sized(docs, doc_id, text))  # the numbers stay as they are from now on
    order = ["group", "doc_id", "number"]
    # checkpoint() keeps the partitions as they are, so that a partition's number and its rows stay together.
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.withColumn("part", F.spark_partition_id()).checkpoint()
    edges = _edges(laid)
    total, offsets = max(1, sum(e["bytes"] for e in edges)), _offsets(edges)
    rows = laid.select("doc_id", "size", "text_crc32", "group", "part")
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL(PLACED).fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a partition's numbers, without texts
        if not held:
            return
        at, row, *ends = offsets[held[0].column(4)[0].as_py()]
        size, group = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (1, 3))
        shard, done = shards_of(size, group, at, *ends, shards, total), 0
        for b in held:
            own = slice(done, done + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shard[own]), pa.array(row + np.arange(own.start, own.stop))], names=schema.names)
            done += b.num_rows

    placed = rows.mapInArrow(place, schema)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
