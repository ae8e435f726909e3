"""Helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes that are no word byte become a space, A-Z become a-z; 0-9, a-z and all bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: A-Z become a-z, all else stays.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Rows that a worker turns into Python values at a time, and their bytes (or one longer row).
ROWS, BATCH_BYTES = 1_000, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def on_one_machine(master: str) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir. Only where all is one process (tests) may it be unset: then it is one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not on_one_machine(context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: Tables written by saved() that are still there.
_held: list[str] = []


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and a lost executor loses nothing. The table goes with saved_alone(), or else when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _file_system(df.sparkSession, path)
    files.deleteOnExit(at)
    _held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the order of saved tables, for saved_alone()."""
    return len(_held)


def saved_alone(df: DataFrame, since: int) -> DataFrame:
    """As saved(); all tables saved since mark() go: nothing else that was made of them may be read any more."""
    out = saved(df)
    for path in _held[since:-1]:
        files, at = _file_system(df.sparkSession, path)
        files.delete(at, True)
    del _held[since:-1]
    return out


def share_file(spark: SparkSession, name: str, data: bytes) -> None:
    """Lays data in the shared folder, from where every executor, also one that starts later, fetches it: SparkFiles.get(name) is its copy."""
    context = spark.sparkContext
    if any(f.rpartition("/")[2] == name for f in context.listFiles):
        return
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    context.addFile(f"{shared_folder(spark)}/{name}")


def map_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list], schema: str, keep: StructField | None = None) -> DataFrame:
    """mapInArrow: make gets ROWS rows or BATCH_BYTES at a time, which bounds a worker's memory, and returns their new columns in the order of schema.

    keep: a first column that goes through as it came, of any type and with fields of any names.
    """
    made = StructType.fromDDL(schema).fields
    types = [to_arrow_type(f.dataType) for f in made]
    names = [f.name for f in ([keep] if keep else []) + made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole)):
            columns = make(batch)
            kept, new = (columns[:1], columns[1:]) if keep else ([], columns)
            yield pa.RecordBatch.from_arrays(kept + [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(new, types, strict=True)], names=names)
        pa.default_memory_pool().release_unused()  # the worker goes on with other tasks

    return df.mapInArrow(run, StructType([keep, *made]) if keep else schema)


def slices(batch: pa.RecordBatch, rows: int | None = None, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of so many rows and bytes (of texts and binaries) at most, or one row of more bytes."""
    rows, most = rows or ROWS, most or BATCH_BYTES
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_struct(column.type):  # its texts count too
            for child in column.flatten():
                if pa.types.is_string(child.type) or pa.types.is_binary(child.type):
                    sizes += pc.fill_null(pc.binary_length(child), 0).to_numpy(zero_copy_only=False)
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        end = min(at + rows, max(at + 1, fit))
        yield batch.slice(at, end - at)
        at = end
