"""The live tail: ledger files in order up to the first gap, facts first and the commit marker last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.records import BUCKET, _fs, listed, with_bucket, write_bucketed

MARKER = "ledgers"
#: Folders beside the tables: what is written but not yet part of them, manifests, records that came too late.
STAGED, BATCHES, LATE = "_staged", "_batches", "_late"
#: Numbers of a stream's batches that are kept as done.
KEPT_EPOCHS = 10


def missing_ledgers(ledgers: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sequences of lo to hi that have no committed ledger."""
    return ledgers.sparkSession.range(lo, hi + 1).select(F.col("id").alias("sequence")).join(ledgers.select("sequence"), "sequence", "left_anti")


def progress_by_partition(ledgers: DataFrame, lo: int, hi: int, size: int = 64_000) -> DataFrame:
    """Expected, indexed and pending ledgers and the percentage of each partition of `size` sequences."""
    expected = ledgers.sparkSession.range(lo, hi + 1).select(F.col("id").alias("sequence"))
    done = ledgers.select("sequence", F.lit(1).alias("done")).dropDuplicates(["sequence"])
    grouped = expected.join(done, "sequence", "left").groupBy(F.floor(F.col("sequence") / size).alias("part")).agg(F.count(F.lit(1)).alias("expected"), F.count("done").alias("indexed"))
    return grouped.select("part", "expected", "indexed", (F.col("expected") - F.col("indexed")).alias("pending"), F.round(F.col("indexed") * 100 / F.col("expected"), 4).alias("percent"))


def contiguous(batch: DataFrame, head: int) -> DataFrame:
    """Rows of ledgers that follow the head without a gap: those before the first sequence whose successor is missing."""
    own = batch.select("sequence").where(F.col("sequence") > head).distinct()
    known = own.union(own.sparkSession.range(head, head + 1).select(F.col("id").alias("sequence")))
    before = own.select((F.col("sequence") - 1).alias("sequence"))
    last = known.join(before, "sequence", "left_anti").agg(F.min("sequence").alias("last_"))  # one row
    return batch.where(F.col("sequence") > head).join(F.broadcast(last), F.col("sequence") <= F.col("last_")).drop("last_")


def ingestion_lag(ledgers: DataFrame, now: str | None = None) -> DataFrame:
    """Seconds from close to now, not below 0. Works on a stream as on a table. now: a timestamp, else the clock."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    lag = F.unix_timestamp(at) - F.unix_timestamp(F.col("closed_at").cast("timestamp"))
    return ledgers.select("sequence", F.greatest(F.lit(0), lag).alias("lag_seconds"))


def write_ledger_batch(tables: dict[str, DataFrame], root: str, size: int = BUCKET, replace: bool = False, epoch: int | None = None) -> None:
    """One batch of ledgers, whole or not at all: tables need ledger_sequence (ledgers: sequence), readers go by `ledgers`.

    All tables are written to a staging folder, by bucket and sorted by ledger; then a manifest that lists their files is renamed into place: from
    there on the batch counts. Its files are moved to the tables, those of `ledgers` last. A job that dies before the manifest leaves a staging folder, which the
    next call drops; one that dies later leaves a manifest, which the next call carries out to its end. So a retry never meets half a
    ledger. Moves are of single files, which suits file systems that rename; one job writes at a time.

    Ledgers that are committed stay as they are, so a replay adds nothing. replace: the batch's ledgers are written anew,
    in place of all their rows; a reader may see both for a moment, never none. Rows of ledgers that the batch's `ledgers` lacks aren't written.
    epoch: the number of a stream's batch, kept as done.
    """
    spark = tables[MARKER].sparkSession
    finish_batches(spark, root)
    own = tables[MARKER].select("sequence").distinct()
    have = _committed(spark, f"{root}/{MARKER}", "sequence")
    if have is not None and not replace:
        lo, hi = own.agg(F.min("sequence"), F.max("sequence")).first()  # the scan of what is there is pruned to the batch's buckets
        near = have.where(F.col("ledger_bucket").between((lo or 0) // size, (hi or 0) // size))
        own = own.join(near.select("sequence").distinct(), "sequence", "left_anti")
    batch = uuid.uuid4().hex
    steps = []
    for name in [t for t in tables if t != MARKER] + [MARKER]:
        column = "sequence" if name == MARKER else "ledger_sequence"
        ledgers = own.select(F.col("sequence").alias(column))
        rows, old = tables[name].join(ledgers, column, "left_semi"), []
        if replace and (kept := _committed(spark, f"{root}/{name}", None)) is not None:
            buckets = [r[0] for r in with_bucket(ledgers, size, column).select("ledger_bucket").distinct().collect()]  # the batch's buckets
            here = kept.where(F.col("ledger_bucket").isin(buckets))
            rows = here.join(ledgers, column, "left_anti").drop("ledger_bucket").unionByName(rows, allowMissingColumns=True)
            old = [f"{name}/ledger_bucket={b}/{f.getPath().getName()}" for b in buckets for f in listed(spark, f"{root}/{name}/ledger_bucket={b}")]
        write_bucketed(rows, f"{root}/{STAGED}/{batch}/{name}", size, "errorifexists", column)
        new = [(f"{name}/{d.getPath().getName()}", f.getPath().getName()) for d in listed(spark, f"{root}/{STAGED}/{batch}/{name}") if d.isDirectory() for f in listed(spark, d.getPath().toString())]
        steps.append({"add": [[folder, file] for folder, file in new if file.endswith(".parquet")], "remove": old})
    _write_text(spark, f"{root}/{BATCHES}/{batch}.json", json.dumps({"epoch": epoch, "steps": steps}))
    _carry_out(spark, root, batch)


def finish_batches(spark: SparkSession, root: str) -> None:
    """Carries out the manifests that are there, then drops what is staged without one."""
    for f in listed(spark, f"{root}/{BATCHES}"):
        if f.getPath().getName().endswith(".json"):
            _carry_out(spark, root, f.getPath().getName().removesuffix(".json"))
    p, fs = _fs(spark, f"{root}/{STAGED}")
    fs.delete(p, True)


def epoch_done(spark: SparkSession, root: str, epoch: int) -> bool:
    p, fs = _fs(spark, f"{root}/{BATCHES}/epochs/{epoch:020d}")
    return fs.exists(p)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole."""
    (new, fs), (to, _) = _fs(spark, f"{path}.part"), _fs(spark, path)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(new, to):
        raise OSError(f"could not write {path}")


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _carry_out(spark: SparkSession, root: str, batch: str) -> None:
    """Every step may have been taken before."""
    path = f"{root}/{BATCHES}/{batch}.json"
    told = json.loads(_read_text(spark, path))
    for step in told["steps"]:
        for folder, file in step["add"]:
            (at, fs), (to, _) = _fs(spark, f"{root}/{STAGED}/{batch}/{folder}/{file}"), _fs(spark, f"{root}/{folder}/{batch}-{file}")
            if fs.exists(at):
                fs.mkdirs(to.getParent())
                if not fs.rename(at, to):
                    raise OSError(f"could not move {at} to {to}")
            elif not fs.exists(to):
                raise FileNotFoundError(f"{at} is lost")
        for file in step["remove"]:
            p, fs = _fs(spark, f"{root}/{file}")
            fs.delete(p, False)
    if told["epoch"] is not None:
        done, fs = _fs(spark, f"{root}/{BATCHES}/epochs/{told['epoch']:020d}")
        fs.mkdirs(done.getParent())
        fs.createNewFile(done)
        for f in listed(spark, f"{root}/{BATCHES}/epochs")[:-KEPT_EPOCHS]:
            fs.delete(f.getPath(), False)
    p, fs = _fs(spark, path)
    fs.delete(p, False)
    p, fs = _fs(spark, f"{root}/{STAGED}/{batch}")
    fs.delete(p, True)
    for name in {folder.partition("/")[0] for step in told["steps"] for folder, _ in step["add"]}:
        spark.catalog.refreshByPath(f"{root}/{name}")


def _committed(spark: SparkSession, path: str, column: str | None) -> DataFrame | None:
    """What is in a table, or one of its columns; None where there is none."""
    if not any(f.isDirectory() for f in listed(spark, path)):
        return None
    have = spark.read.parquet(path)
    return have if column is None else have.select(column, "ledger_bucket")


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [str(f.getPath()) for f in listed(spark, path) if f.isDirectory()]


def head_of(spark: SparkSession, root: str, before: int = 0) -> int:
    have = _committed(spark, f"{root}/{MARKER}", "sequence")
    return before if have is None else (have.agg(F.max("sequence")).first()[0] or before)


def live_tail(
    spark: SparkSession, source: str, root: str, schema: str, fold: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, start: int = 0, size: int = BUCKET, files_per_batch: int = 1_000, form: str = "json"
):
    """A running query that takes new ledger files, keeps what is past a gap for later, and writes the tables that `fold` makes of each run.

    A ledger may have any number of rows, all in files of one batch; rows that repeat in all columns (a file sent twice) count once.
    Records past a gap wait in `<root>/_waiting` until their ledger's turn: each batch writes what still waits to a new folder there
    and then removes the older ones, so they hold what is past the head only. The cursor is the highest committed
    ledger. A batch that is tried again changes nothing. Records of ledgers that were committed before their batch came aren't
    written to the tables: they lie in `<root>/_late`, a folder for each batch that has some, see late_records(). Returns the StreamingQuery.
    """
    waiting = f"{root}/_waiting"

    def take(batch: DataFrame, epoch: int) -> None:
        finish_batches(spark, root)
        head = head_of(spark, root, start)
        if not epoch_done(spark, root, epoch):  # else what is below the head may be of this very batch
            late = batch.where(F.col("sequence") <= head)
            if not late.isEmpty():
                late.write.mode("overwrite").parquet(f"{root}/{LATE}/epoch={epoch}")
        old = _folders(spark, waiting)
        held = batch if not old else batch.unionByName(spark.read.schema(batch.schema).parquet(*old))
        whole = held.where(F.col("sequence") > head).distinct()
        run = contiguous(whole, head)
        if not run.isEmpty():
            write_ledger_batch(fold(run), root, size, epoch=epoch)
            head = head_of(spark, root, start)
        # what still waits, of this batch and of those before it, is one folder; only then do the others go
        whole.where(F.col("sequence") > head).write.parquet(f"{waiting}/{uuid.uuid4().hex}")
        for path in old:
            p, fs = _fs(spark, path)
            fs.delete(p, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_records(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records that came after their ledger was committed, with the number of their batch."""
    if not _folders(spark, f"{root}/{LATE}"):
        return spark.createDataFrame([], f"{schema}, epoch bigint")
    return spark.read.schema(f"{schema}, epoch bigint").parquet(f"{root}/{LATE}")
