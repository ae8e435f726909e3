"""Exact percentiles with bounded memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.records import scratch_folder


def null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """A join by keys of which null is one."""
    side = right.select(*[F.col(c).alias(f"{c}_by_") if c in by else F.col(c) for c in right.columns])
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_by_")) for c in by])
    return left.join(side, on, how).drop(*[f"{c}_by_" for c in by])


def exact_percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], partitions: int | None = None) -> DataFrame:
    """by, and a column for each percentile of at (name to fraction), interpolated between neighbouring values; nulls don't count.

    Equal values are counted first, each task for itself, then the counts are laid out by ranges of key and value: a key with very many values is in many
    ranges, each of the size of one partition. Sums of ranges (a row for each range and key) say in which ranges a rank lies; only in these are running sums
    taken. So no task holds more than its range, and none holds a key's distinct values.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value_")).agg(F.count(F.lit(1)).alias("n_"))
    ranges = (*by, "value_") if partitions is None else (partitions, *by, "value_")
    path = scratch_folder(spark)
    counts.repartitionByRange(*ranges).withColumn("part_", F.spark_partition_id()).write.parquet(path)  # written, so that ranges stay as they are
    laid = spark.read.parquet(path)
    sums = laid.groupBy(*by, "part_").agg(F.sum("n_").alias("sum_"))
    w = Window.partitionBy(*by)
    sums = sums.withColumns({"before_": F.sum("sum_").over(w.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), "all_": F.sum("sum_").over(w)})
    place = {name: F.lit(q) * (F.col("all_") - 1) for name, q in at.items()}
    ranks = [f(p).cast("bigint").alias("rank_") for p in place.values() for f in (F.floor, F.ceil)]
    sums = sums.withColumns({"before_": F.coalesce("before_", F.lit(0)), "ranks_": F.array_distinct(F.array(*ranks))})
    held = F.filter("ranks_", lambda r: (r >= F.col("before_")) & (r < F.col("before_") + F.col("sum_")))
    needed = sums.withColumn("ranks_", held).where(F.size("ranks_") > 0)
    rows = null_safe(laid, needed, [*by, "part_"], "inner")
    upto = F.col("before_") + F.sum("n_").over(Window.partitionBy(*by, "part_").orderBy("value_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto_", upto).withColumn("rank_", F.explode(F.filter("ranks_", lambda r: (r >= F.col("upto_") - F.col("n_")) & (r < F.col("upto_")))))
    picked = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank_", "value_"))).alias("picked_"), F.max("all_").alias("all_"))

    def between(p: Column) -> Column:
        low, high = (F.try_element_at("picked_", f(p).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (p - F.floor(p))

    return picked.select(*by, *[between(p).alias(name) for name, p in place.items()])
