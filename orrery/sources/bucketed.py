"""Reads of tables that lie in ledger buckets, which touch few of them: pages by descent."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.versioned import beyond, keyset_page
from orrery.sources.records import BUCKET, listed


def buckets_of(spark: SparkSession, path: str) -> list[int]:
    """The buckets of a table, by its folders; no file is read."""
    names = [f.getPath().getName() for f in listed(spark, path) if f.isDirectory()]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("ledger_bucket="))


def bucket_page(
    facts: DataFrame,
    buckets: Sequence[int],
    key: Sequence[str],
    limit: int,
    cursor: Sequence | None = None,
    backward: bool = False,
    descending: bool = True,
    size: int = BUCKET,
    build: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """keyset_page() over build(facts), with the ledger first in the key, reading only the buckets that hold the page.

    From the cursor's bucket (or the outermost one) it goes on in the page's direction, one bucket, then two, four and so on, until limit + 1 rows are found; each
    step stops at that number. build must make a ledger's rows from facts of its own bucket: joins with other tables, filters, copies removed.
    """
    build = build or (lambda df: df)
    falling = descending != backward
    order = sorted(buckets, reverse=falling)
    if cursor is not None:
        edge = int(cursor[0]) // size
        order = [b for b in order if (b <= edge if falling else b >= edge)]
    at, step, found = 0, 1, 0
    while at < len(order) and found <= limit:
        some = build(facts.where(F.col("ledger_bucket").isin(order[at : at + step])))
        rows = some if cursor is None else some.where(beyond(some, key, cursor, falling))
        found += rows.limit(limit + 1 - found).count()
        at, step = at + step, 2 * step
    return keyset_page(build(facts.where(F.col("ledger_bucket").isin(order[:at]))), key, limit, cursor, backward, descending)
