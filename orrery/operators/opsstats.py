"""Figures about running the service: latencies, query costs, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.percentiles import exact_percentiles, null_safe


def latency_summary(log: DataFrame, exact: bool = True) -> DataFrame:
    """Requests, errors and latency percentiles of each endpoint. Exact ones come from exact_percentiles(); else from a sketch of bounded size, in one pass."""
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    errors = F.count_if(F.col("status") >= 400)
    figures = [F.count(F.lit(1)).alias("requests"), errors.alias("errors"), F.round(errors * 100 / F.count(F.lit(1)), 4).alias("error_percent"), F.max("duration_ms").alias("max")]
    if not exact:
        return log.groupBy("endpoint").agg(*figures, *[F.round(F.percentile_approx("duration_ms", q, 10_000), 6).alias(name) for name, q in at.items()])
    ranks = exact_percentiles(log, ["endpoint"], "duration_ms", at)
    return null_safe(log.groupBy("endpoint").agg(*figures), ranks, ["endpoint"]).withColumns({name: F.round(name, 6) for name in at})


def query_cost_by_endpoint(log: DataFrame) -> DataFrame:
    """Costs by the first part of the tag. log: tag, rows_read, bytes_read, duration_ms."""
    rows = log.withColumn("endpoint", F.split_part("tag", F.lit("-"), F.lit(1)))
    grouped = rows.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("queries"), F.count_distinct("tag").alias("requests"), F.round(F.avg("rows_read"), 4).alias("avg_rows"), F.max("rows_read").alias("max_rows"),
        F.round(F.avg("bytes_read"), 4).alias("avg_bytes"), F.max("bytes_read").alias("max_bytes"), F.sum("rows_read").alias("total_rows"),
    )
    joined = null_safe(grouped, exact_percentiles(rows, ["endpoint"], "duration_ms", {"p95": 0.95}), ["endpoint"])
    return joined.withColumn("p95", F.round("p95", 6)).orderBy(F.desc("total_rows"), "endpoint")


def query_cost_by_request(log: DataFrame) -> DataFrame:
    return log.groupBy("tag").agg(F.count(F.lit(1)).alias("queries"), F.sum("rows_read").alias("rows_read"), F.sum("bytes_read").alias("bytes_read"))


def join_client_server(client: DataFrame, costs: DataFrame) -> DataFrame:
    """The client's log with the server's cost of each request."""
    return client.join(costs, "tag", "left").withColumn("matched", F.col("queries").isNotNull())


def match_rate(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count(F.lit(1)).alias("requests"), F.round(F.count_if("matched") / F.count(F.lit(1)), 6).alias("rate"))


def enrichment_coverage(candidates: DataFrame, enrichment: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Candidates, rows tried, and how many have a real value or the sentinel '' in each column."""
    joined = candidates.select(*key).distinct().join(enrichment.withColumn("tried", F.lit(True)), key, "left")
    aggregates = [F.count(F.lit(1)).alias("candidates"), F.count("tried").alias("rows")]
    for c in columns:
        aggregates += [F.count_if(F.col(c) != "").alias(f"{c}_real"), F.count_if(F.col(c) == "").alias(f"{c}_sentinel")]
    real = " or ".join(f"coalesce({c}, '') <> ''" for c in columns)
    return joined.agg(*aggregates, F.count_if(F.col("tried") & F.expr(f"({real})")).alias("rows_real"))
