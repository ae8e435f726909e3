"""Reading record lists, the bucket layout, and writes that replace a table only when they are whole."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.schemas import RECORDS

BUCKET = 500_000


def read_records(spark: SparkSession, folder: str, name: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """One decoded record list: Parquet, JSON lines or CSV (with a header)."""
    reader = spark.read.schema(schema or RECORDS[name])
    reader = reader.option("header", True) if form == "csv" else reader
    return reader.format(form).load(f"{folder}/{name}")


def with_bucket(df: DataFrame, size: int = BUCKET, column: str = "ledger_sequence") -> DataFrame:
    return df.withColumn("ledger_bucket", F.floor(F.col(column) / size).cast("int"))


def prune(df: DataFrame, lo: int, hi: int, size: int = BUCKET, column: str = "ledger_sequence") -> DataFrame:
    """Rows of ledgers lo to hi; the predicate on the bucket lets the scan leave out other partitions."""
    return df.where(F.col("ledger_bucket").between(lo // size, hi // size) & F.col(column).between(lo, hi))


def write_bucketed(df: DataFrame, path: str, size: int = BUCKET, mode: str = "append", column: str = "ledger_sequence") -> None:
    """Partitioned by bucket, sorted by ledger in each file, so that row groups can be skipped; a bucket's rows are rebalanced over files of equal size."""
    rows = with_bucket(df, size, column)
    rows.hint("rebalance", "ledger_bucket").sortWithinPartitions("ledger_bucket", column).write.mode(mode).partitionBy("ledger_bucket").parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, in the session's spark.checkpoint.dir; only where all is one process (tests) may that be unset."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{root or tempfile.mkdtemp(prefix='spark-')}/{uuid.uuid4().hex}"
    p, fs = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def listed(spark: SparkSession, path: str) -> list:
    """What lies in a folder, as file statuses in the order of names; nothing where there is no folder."""
    p, fs = _fs(spark, path)
    return sorted(fs.listStatus(p), key=lambda f: f.getPath().getName()) if fs.exists(p) else []


def rebuild_and_swap(df: DataFrame, target: str, dry_run: bool = False) -> int:
    """Builds df beside the target, counts it, then puts it in the target's place; dry run: the count only.

    The new table is whole before the old one is renamed away, so df may read the target itself. The target stays a plain
    folder, so between the two renames there is none; where readers run meanwhile, use publish_version().
    """
    spark = df.sparkSession
    if dry_run:
        return df.count()
    staging, old = f"{target}.staging-{uuid.uuid4().hex}", f"{target}.old-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    n = spark.read.schema(df.schema).parquet(staging).count()
    (to, fs), (new, _), (away, _) = (_fs(spark, p) for p in (target, staging, old))
    had = fs.exists(to)
    if had and not fs.rename(to, away):
        raise OSError(f"could not move {target} away")
    if not fs.rename(new, to):
        if had:
            fs.rename(away, to)
        raise OSError(f"could not put {staging} in place of {target}")
    if had:
        fs.delete(away, True)
    spark.catalog.refreshByPath(target)
    return n


#: Versions that stay readable, and how long a version without a pointer may still be in the making.
KEPT, IN_THE_MAKING_MS = 3, 24 * 3600 * 1000


def _pointers(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """Number and version of each pointer, the newest last."""
    names = [f.getPath().getName().split(".") for f in listed(spark, f"{target}/pointers")]
    return sorted((int(number), version) for number, version in names)


def publish_version(df: DataFrame, target: str, dry_run: bool = False, keep: int = KEPT) -> int:
    """Builds df as a new version of the table at target, counts it, then points to it; dry run: the count only.

    A version is a folder of its own, and a pointer is an empty file whose name holds its number and version: making it is the one step that changes
    what readers see. So there is no moment without a table, a job that dies before leaves the old version current, and df may read
    the table itself. The last `keep` versions stay for readers that are at work. Of two writers that publish at the same time at least one fails.
    """
    spark = df.sparkSession
    if dry_run:
        return df.count()
    before = _pointers(spark, target)
    version = uuid.uuid4().hex
    df.write.parquet(f"{target}/versions/{version}")
    n = spark.read.schema(df.schema).parquet(f"{target}/versions/{version}").count()
    number = before[-1][0] + 1 if before else 1
    p, fs = _fs(spark, f"{target}/pointers/{number:020d}.{version}")
    if _pointers(spark, target) != before or not fs.createNewFile(p):
        raise OSError(f"{target} was published by another job meanwhile")
    now = _pointers(spark, target)
    if now[-1] != (number, version) or len([k for k, _ in now if k == number]) > 1:
        fs.delete(p, False)
        raise OSError(f"{target} was published by another job at the same time")
    for k, old in now[:-keep]:
        fs.delete(_fs(spark, f"{target}/pointers/{k:020d}.{old}")[0], False)
    held = {v for _, v in now[-keep:]}
    for f in listed(spark, f"{target}/versions"):
        name = f.getPath().getName()
        lost = name not in {v for _, v in now} and f.getModificationTime() < time.time() * 1000 - IN_THE_MAKING_MS
        if name not in held and (lost or name in {v for _, v in now}):
            fs.delete(f.getPath(), True)
    return n


def read_version(spark: SparkSession, target: str, schema: str | None = None, back: int = 0) -> DataFrame:
    """The current version of a table that publish_version() writes, or the one `back` versions before it."""
    have = _pointers(spark, target)
    if len(have) <= back:
        raise FileNotFoundError(f"{target} has no such version")
    path = f"{target}/versions/{have[-1 - back][1]}"
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
