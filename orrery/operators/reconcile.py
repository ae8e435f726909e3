"""Comparison of tables with an outside copy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.versioned import top_n_by


def table_diff(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], every: int = 1) -> DataFrame:
    """Rows of (key, field, left, right) where two tables differ; field `missing` tells on which side a key is absent.

    every: only keys whose hash is divisible by it, as a sample of both sides alike; 1 compares all.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df if every == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(every)) == 0)
        return rows.select(F.struct(*key).alias("key_"), F.lit(True).alias(f"in_{name}"), *[F.col(f).cast("string").alias(f"{name}_{f}") for f in fields])

    both = side(left, "l").join(side(right, "r"), "key_", "full_outer")
    absent = F.col("in_l").isNull() | F.col("in_r").isNull()
    missing = F.when(absent, F.struct(F.lit("missing").alias("field"), F.when(F.col("in_l").isNull(), "left").alias("left"), F.when(F.col("in_r").isNull(), "right").alias("right")))
    differs = [F.when(~absent & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left"), F.col(f"r_{f}").alias("right"))) for f in fields]
    found = both.select("key_", F.explode(F.array_compact(F.array(missing, *differs))).alias("d"))
    return found.select(F.concat_ws(":", *[F.col(f"key_.{k}").cast("string") for k in key]).alias("key"), "d.field", "d.left", "d.right")


def diff_counts(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def order_diff(stored: DataFrame, applied: DataFrame) -> DataFrame:
    """Whether the operations of each transaction are stored in the order they were applied in; else the first place that differs.

    Both: transaction_id, application_order, type.
    """

    def laid(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("transaction_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("application_order", "type"))), lambda x: x.type).alias(name))

    both = laid(stored, "a").join(laid(applied, "b"), "transaction_id", "full_outer")
    size = F.greatest(F.size("a"), F.size("b"))
    wrong = F.filter(F.sequence(F.lit(0), size - 1), lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i)))
    at = F.when(F.col("a").isNull() | F.col("b").isNull(), 0).otherwise(F.get(wrong, 0))
    types = F.coalesce("a", "b")
    counts = F.transform(F.array_distinct(types), lambda t: F.struct(F.size(F.filter(types, lambda x: x == t)).alias("n"), (-t).alias("type")))
    return both.select("transaction_id", F.size(types).alias("operations"), (-F.array_max(counts).type).alias("main_type"), at.isNull().alias("match"), at.alias("first_difference"))


def order_rates(diffs: DataFrame, transactions: DataFrame, band: int) -> DataFrame:
    """Share of matches by number of operations, band of ledgers and main type."""
    tx = transactions.select(F.col("id").alias("transaction_id"), (F.floor(F.col("ledger_sequence") / band) * band).alias("ledgers"))
    size = F.when(F.col("operations") == 1, "1").when(F.col("operations") <= 3, "2-3").otherwise("4+")
    return diffs.join(tx, "transaction_id").groupBy(size.alias("size"), "ledgers", "main_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("match").alias("matches"))


def volume_gate(amounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pools and ledgers where the amounts that trades moved of the first leg don't sum to the snapshot's gross volume."""
    moved = amounts.where("leg = 'A' and flag = 'A'").groupBy("pool_id", "ledger_sequence").agg(F.sum(F.abs("amount")).alias("moved"))
    stated = snapshots.where("gross_volume_a is not null").select("pool_id", "ledger_sequence", F.col("gross_volume_a").alias("stated"))
    return moved.join(stated, ["pool_id", "ledger_sequence"], "full_outer").where(~F.col("moved").eqNullSafe(F.col("stated")))


def row_count_parity(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias(name)).select(F.lit(t).alias("table"), name) for t, df in tables.items()])

    return counts(before, "rows_before").join(counts(after, "rows_after"), "table", "full_outer").withColumn("same", F.col("rows_before").eqNullSafe(F.col("rows_after")))


COUNTS = ("transaction_count", "operation_count")
#: Differing ledgers of the whole draw, in percent, from which on the gate is shut.
LIMIT_PERCENT = 0.01


def _drawn(ours: DataFrame, theirs: DataFrame, bucket: int, n: int, seed: int) -> DataFrame:
    """For each bucket n ledgers in a seeded order, with whether each count (of those that both have) differs from the outside copy."""
    counts = [c for c in COUNTS if c in ours.columns and c in theirs.columns]
    drawn = top_n_by(ours.withColumn("bucket", F.floor(F.col("sequence") / bucket)), ["bucket"], [F.xxhash64("sequence", F.lit(seed)), F.col("sequence")], n)
    both = drawn.join(theirs.select("sequence", *[F.col(c).alias(f"{c}_other") for c in counts]), "sequence", "left")
    return both.select("bucket", *[(~F.col(c).eqNullSafe(F.col(f"{c}_other"))).alias(c) for c in counts])


def stratified_compare(ours: DataFrame, theirs: DataFrame, bucket: int, n: int = 100, seed: int = 0) -> DataFrame:
    """For each bucket, n ledgers in a seeded order: how many differ in a count from the outside copy, and the ratio. Rows: sequence, transaction_count and, if both have it, operation_count; then each count's differences are told apart."""
    both = _drawn(ours, theirs, bucket, n, seed)
    counts = [c for c in COUNTS if c in both.columns]
    wrong = F.count_if(reduce(Column.__or__, [F.col(c) for c in counts]))
    apart = [F.count_if(c).alias(f"{c}s_different") for c in counts] if len(counts) > 1 else []
    return both.groupBy("bucket").agg(F.count(F.lit(1)).alias("drawn"), wrong.alias("different"), F.round(wrong / F.count(F.lit(1)), 6).alias("ratio"), *apart)


def stratified_gate(ours: DataFrame, theirs: DataFrame, bucket: int, n: int = 100, seed: int = 0, percent: float = LIMIT_PERCENT) -> DataFrame:
    """One row over all strata for each count: ledgers drawn, differing ones, their percentage, and whether that is within the limit. Nothing drawn passes nothing."""
    strata = stratified_compare(ours, theirs, bucket, n, seed)
    names = [c for c in COUNTS if f"{c}s_different" in strata.columns]
    each = [F.struct(F.lit(c).alias("count"), F.col(f"{c}s_different").alias("different")) for c in names] or [F.struct(F.lit(COUNTS[0]).alias("count"), "different")]
    rows = strata.select("drawn", F.inline(F.array(*each))).groupBy("count").agg(F.sum("drawn").alias("drawn"), F.sum("different").alias("different"))
    share = F.col("different") * 100 / F.col("drawn")
    return rows.select("count", "drawn", "different", F.round(share, 6).alias("percent"), (share <= percent).alias("passed"))
