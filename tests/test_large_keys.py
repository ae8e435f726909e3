"""Registered queries on tables whose keys and sizes are larger than those of the test data."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from orrery.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_rows_without_a_value_are_dealt_out(spark):
    """A join on a column that is null in nearly all rows brings no task more than its share, and gives the same marks."""
    from orrery.operators.quality import Rules, stacked

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("of"))
        rules = Rules(df, "t").foreign_key("known", "of", spark.range(0, 20_000, 200).toDF("k"), "k", "id", sparse="id")
        sizes = [r["count"] for r in rules.df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 7_000
        row = stacked([rules]).first()
        assert (row.violations, row["sample"].split(",")[:2]) == (100, ["100", "10100"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_keys_that_join_to_one_text_are_two(spark):
    from orrery.operators.quality import stacked, unique

    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "x"), ("x", None), ("d", None), ("d", None)], "p string, q string")
    row = stacked([unique(df, "t", "u", ["p", "q"])]).first()
    assert (row.table, row.check, row.violations, row["sample"]) == ("t", "u", 1, "d")


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with keys of orders far beyond a million, so that they weigh more than days."""
    import duckdb

    folder, connection = tmp_path_factory.mktemp("far"), duckdb.connect()
    for t, key in (("customer", None), ("supplier", None), ("part", None), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", None)):
        columns = f"* REPLACE ({key} * 1000003 AS {key})" if key else "*"
        connection.execute(f"COPY (SELECT {columns} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), connection


def rows_of_both(spark, far, name):
    folder, duck = far
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    return sorted(repr([r[c] for c in columns]) for r in df.collect()), sorted(repr([r[names.index(c)] for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["e3_account_state_merge", "s4_latest_by_version"])
def test_large_keys(spark, far, name):
    ours, theirs = rows_of_both(spark, far, name)
    assert ours == theirs


@pytest.mark.parametrize("name", ["e37_call_trace", "e18_net_settled", "q45_classify_tx"])
def test_operations_in_more_partitions(spark, far, name, monkeypatch):
    """The operations of a larger table stay in partitions of so many rows, and queries on them give the same."""
    from orrery.sources import views

    monkeypatch.setattr(views, "ROWS", 500, raising=False)
    assert views.Views(spark, far[0]).operations.rdd.getNumPartitions() >= 12
    ours, theirs = rows_of_both(spark, far, name)
    assert ours == theirs


@pytest.mark.parametrize("name", ["q40_pool_chart_daily", "q40_pool_chart_window"])
def test_charts_in_more_partitions(spark, far, name, monkeypatch):
    """Snapshots, prices and the as-of pass of a larger table go by partitions that grow in number."""
    from orrery.sources import views

    monkeypatch.setattr(views, "ROWS", 500)
    assert views.Views(spark, far[0]).partitions >= 12
    ours, theirs = rows_of_both(spark, far, name)
    assert ours == theirs


def test_rows_without_a_leg_are_priced_in_the_same_pass(spark):
    """They are dealt out, and what they come from is read once."""
    from orrery.operators.pools import with_prices

    rows = spark.range(4_000).select("id", F.when(F.col("id") % 4 == 0, F.lit("a")).alias("leg"), (F.col("id") * 3_600).alias("price_second"))
    prices = spark.createDataFrame([("a", "1970-01-01 05:00:00", 2.0), (None, "1970-01-01 00:00:00", 3.0)], "leg string, bucket string, close_usd double").withColumn("bucket", F.col("bucket").cast("timestamp"))
    found = with_prices(rows, prices, "hour", 7_200, partitions=8)
    assert found.count() == 4_000 and sorted(map(tuple, found.where("price is not null").select("id", "price").collect())) == [] and found.columns == ["id", "leg", "price_second", "price"]
    assert sorted(tuple(r) for r in with_prices(rows, prices, "hour", 4 * 3_600).where("price is not null").select("id", "price").collect()) == [(8, 2.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 4000") == 1


@pytest.mark.parametrize("name", ["v5_participants_damaged", "v12_balances"])
def test_rules_in_more_partitions(spark, name, monkeypatch):
    """Lines of unique keys go by partitions that grow in number, and rules count the same."""
    from orrery.sources import views

    before = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(views, "ROWS", 500)
    df, n = QUERIES[name](spark, SF), views.Views(spark, SF).partitions
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [rule" in plan and f"], {n}" in plan
    assert sorted(map(tuple, df.collect())) == before


def test_presence_is_laid_out_once(spark, far, monkeypatch):
    """What is seen and what was settled go by asset and transaction in partitions that grow in number, and are not shuffled again."""
    from orrery.sources import views

    monkeypatch.setattr(views, "ROWS", 500)
    n = views.Views(spark, far[0]).partitions
    assert n >= 12
    plan = QUERIES["e10_asset_presence"](spark, far[0])._jdf.queryExecution()
    assert len(re.findall(rf"RepartitionByExpression \[asset_id#\d+L?, transaction_id#\d+L?\], {n}\b", plan.optimizedPlan().toString())) == 2
    assert "ENSURE_REQUIREMENTS" not in "".join(line for line in plan.executedPlan().toString().splitlines(True) if "asset_id" in line)
    ours, theirs = rows_of_both(spark, far, "e10_asset_presence")
    assert ours == theirs


@pytest.mark.parametrize("name", ["b12_replay_amounts_only", "e17_balance_deltas"])
def test_amounts_stay_in_partitions_of_operations(spark, far, name, monkeypatch):
    """Amounts and deltas of a larger table are made in the partitions of its operations, and are the same."""
    from orrery.sources import views

    monkeypatch.setattr(views, "ROWS", 500)
    df = QUERIES[name](spark, far[0])
    assert "ENSURE_REQUIREMENTS" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() >= 12
    ours, theirs = rows_of_both(spark, far, name)
    assert ours == theirs


@pytest.mark.parametrize("name", ["b12_replay_amounts_only", "e12_lp_operation_amounts"])
def test_amounts_number_operations_once(spark, far, name, monkeypatch):
    """Trades, deposits and withdrawals come from one pass over the operations, so that a task sorts them once, and amounts are the same."""
    from orrery.sources import views

    monkeypatch.setattr(views, "ROWS", 500)
    plan = QUERIES[name](spark, far[0])._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Window \[row_number\(\)", plan)) == 1 and "Union" not in plan
    ours, theirs = rows_of_both(spark, far, name)
    assert ours == theirs


def test_amounts_of_operations_are_those_of_atoms_and_deltas(spark):
    from orrery.operators import ingest as I

    atom, delta = "struct<asset_bought: string, amount_bought: bigint, asset_sold: string, amount_sold: bigint>", "struct<asset_id: string, before: bigint, after: bigint>"
    rows = [(1, 1, 9, 1, [("usd", 5, "eur", 2), ("eur", 2, "usd", 4)], None), (1, 2, 9, 1, [("usd", 7, "eur", 3)], [("usd", 10, 4), ("xlm", 3, 3)]), (2, 1, 9, 1, None, [("usd", 1, 9), ("eur", None, 3)]), (2, 2, 9, 1, None, None), (2, 3, 9, 1, [], [])]
    df = spark.createDataFrame(rows, f"transaction_id int, application_order int, ledger_sequence int, pool_id int, atoms array<{atom}>, deltas array<{delta}>")
    apart = I.lp_operation_amounts(df.select(*df.columns[:4], F.inline("atoms")), df.select(*df.columns[:4], F.inline("deltas")))
    found = sorted(map(tuple, I.lp_amounts_of_operations(df).collect()))
    assert found == sorted(map(tuple, apart.collect())) == [(1, 1, 9, 1, "usd", 1), (1, 2, 9, 1, "eur", -3), (1, 2, 9, 1, "usd", 1), (2, 1, 9, 1, "usd", 8)]


@pytest.mark.parametrize("name", ["e17_balance_deltas", "e18_net_settled"])
def test_changes_are_sorted_once(spark, far, name, monkeypatch):
    """The window over an asset's changes and the grouping to deltas share one order."""
    from orrery.plans.ingest import entry_changes
    from orrery.sources import views

    monkeypatch.setattr(views, "ROWS", 500)
    plan = QUERIES[name](spark, far[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortAggregate\(.*\n[^\n]*\bSort \[", plan) and "SortAggregate" in plan
    v = views.Views(spark, far[0])
    ours, view = entry_changes(v), v.entry_changes
    assert ours.count() == view.count() and ours.exceptAll(view.select(*ours.columns)).isEmpty()
    assert rows_of_both(spark, far, name)[0] == rows_of_both(spark, far, name)[1]
