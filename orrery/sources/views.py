"""Ledger-shaped views over plain business tables, in SQL that Spark and other engines share.

``DAYS(x)`` stands for the days from 1994-12-31 to x, ``MINUTES(x)`` for the minutes from 2024-01-01, ``EACH(x, y)`` for
a row for each of the values; each engine has its own words for them. Natural integers serve as ids, since hash functions differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Assets of a pool's legs, by its id: the first is the smaller one.
LEG_A, LEG_B = "CAST(floor({0} / 2) AS BIGINT)", "(CAST(floor({0} / 2) AS BIGINT) + 1 + {0} % 2)"
BASE = ("orders", "lineitem", "customer", "supplier", "part", "events")
#: View: (what it reads, SQL).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_ledgers": (
        ("orders",),
        "SELECT CAST(DAYS(o_orderdate) AS BIGINT) AS sequence, o_orderdate AS closed_at, sha2(concat('ledger', CAST(DAYS(o_orderdate) AS STRING)), 256) AS hash, count(*) AS transaction_count, 100 AS base_fee, "
        "CAST(floor(DAYS(o_orderdate) / 500) AS BIGINT) AS bucket FROM orders GROUP BY o_orderdate",
    ),
    "v_transactions": (
        ("orders",),
        "SELECT o_orderkey AS id, sha2(concat('tx', CAST(o_orderkey AS STRING)), 256) AS hash, "
        "CASE WHEN o_orderkey % 10 = 0 THEN sha2(concat('in', CAST(o_orderkey AS STRING)), 256) END AS inner_tx_hash, "
        "CAST(DAYS(o_orderdate) AS BIGINT) AS ledger_sequence, "
        "CAST(row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS BIGINT) AS application_order, "
        "o_custkey AS source_id, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 END AS fee_source_id, CAST(floor(o_totalprice) AS BIGINT) AS fee_charged, o_orderstatus <> 'F' AS successful FROM orders",
    ),
    "v_operations": (
        ("lineitem", "orders"),
        "SELECT l_orderkey AS transaction_id, CAST(DAYS(o_orderdate) AS BIGINT) AS ledger_sequence, "
        "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS application_order, "
        "CAST(l_partkey % 27 AS INT) AS type, CASE WHEN l_linenumber % 2 = 0 THEN o_custkey END AS source_id, o_custkey AS tx_source_id, l_suppkey AS destination_id, "
        "CASE WHEN l_partkey % 27 = 24 THEN l_suppkey % 30 END AS contract_id, l_partkey AS asset_id, "
        "CASE WHEN l_partkey % 27 IN (2, 13, 22, 23) THEN l_partkey END AS pool_id, "
        "CAST(l_quantity AS BIGINT) AS quantity, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_returnflag AS flag, l_linestatus AS status "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "v_accounts_versions": (
        ("orders", "customer"),
        "SELECT o_custkey AS account_id, CAST(DAYS(o_orderdate) AS BIGINT) AS version, CASE WHEN o_custkey % 4 = 0 THEN c_mktsegment END AS home_domain, o_orderkey AS sequence_number "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "v_accounts": (
        ("v_accounts_versions",),
        "SELECT account_id, min(version) AS first_seen_ledger, max(version) AS last_seen_ledger, max(home_domain) AS home_domain, max(sequence_number) AS sequence_number "
        "FROM v_accounts_versions GROUP BY account_id",
    ),
    "v_assets": (
        ("part",),
        "SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN 0 ELSE 1 END AS asset_type, CASE WHEN p_partkey = 0 THEN '' ELSE concat(p_brand, 'P', CAST(p_partkey AS STRING)) END AS asset_code, p_partkey % 10 AS issuer_id, p_name AS name "
        "FROM part",
    ),
    "v_pools": (
        ("part",),
        f"SELECT p_partkey AS pool_id, {LEG_A.format('p_partkey')} AS asset_a, {LEG_B.format('p_partkey')} AS asset_b, 30 AS fee_bps FROM part",
    ),
    "v_lp_amounts": (
        ("v_operations",),
        "SELECT pool_id, ledger_sequence, transaction_id, application_order, tx_source_id, leg, "
        "CASE WHEN leg = 'A' THEN CASE WHEN flag = 'R' THEN -quantity ELSE quantity END ELSE CASE WHEN flag = 'N' THEN price ELSE -price END END AS amount, flag "
        "FROM (SELECT *, EACH('A', 'B') AS leg FROM v_operations WHERE pool_id IS NOT NULL) o",
    ),
    "v_pool_snapshots": (
        ("v_lp_amounts",),
        "SELECT pool_id, ledger_sequence, 10000000 + CAST(sum(a) OVER w AS BIGINT) AS reserve_a, 10000000 + CAST(sum(b) OVER w AS BIGINT) AS reserve_b, v AS gross_volume_a, 1000000 + CAST(sum(s) OVER w AS BIGINT) AS total_shares FROM ("
        "SELECT pool_id, ledger_sequence, sum(CASE WHEN leg = 'A' THEN amount ELSE 0 END) AS a, sum(CASE WHEN leg = 'B' THEN amount ELSE 0 END) AS b, "
        "CAST(sum(CASE WHEN leg = 'A' AND flag = 'A' THEN abs(amount) END) AS BIGINT) AS v, sum(CASE WHEN leg = 'A' AND flag <> 'A' THEN amount ELSE 0 END) AS s "
        "FROM v_lp_amounts GROUP BY pool_id, ledger_sequence) g WINDOW w AS (PARTITION BY pool_id ORDER BY ledger_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
    "v_positions": (
        ("v_lp_amounts",),
        "SELECT pool_id, tx_source_id AS account_id, CAST(greatest(sum(amount), 0) AS BIGINT) AS shares, min(ledger_sequence) AS first_deposit_ledger, max(ledger_sequence) AS last_updated_ledger "
        "FROM v_lp_amounts WHERE leg = 'A' AND flag <> 'A' GROUP BY pool_id, tx_source_id",
    ),
    "v_prices_1d": (
        ("lineitem",),
        "SELECT l_partkey AS asset_id, CAST(DAYS(l_shipdate) AS BIGINT) AS bucket, CAST(floor(max(l_extendedprice / l_quantity)) AS DOUBLE) AS close_usd FROM lineitem GROUP BY l_partkey, CAST(DAYS(l_shipdate) AS BIGINT)",
    ),
    "v_balances": (
        ("v_operations",),
        "SELECT tx_source_id AS holder_id, asset_id, CAST(greatest(sum(CASE WHEN status = 'O' THEN quantity ELSE -quantity END), 0) AS BIGINT) AS amount, max(ledger_sequence) AS last_updated_ledger "
        "FROM v_operations GROUP BY tx_source_id, asset_id",
    ),
    "v_events": (
        ("events",),
        "SELECT event_id AS transaction_id, event_id % 7 AS event_index, user_id % 30 AS contract_id, CAST(MINUTES(ts) AS BIGINT) AS ledger_sequence, user_id, "
        "CASE event_type WHEN 'purchase' THEN 'transfer' WHEN 'signup' THEN 'mint' WHEN 'error' THEN 'burn' WHEN 'click' THEN 'clawback' ELSE 'other' END AS signature, props AS data, value FROM events",
    ),
    "v_invocations": (
        ("events",),
        "SELECT event_id AS transaction_id, user_id % 30 AS contract_id, CAST(MINUTES(ts) AS BIGINT) AS ledger_sequence, CASE WHEN user_id % 2 = 0 THEN user_id END AS caller_id, event_id % 5 AS invocation_index "
        "FROM events WHERE event_type IN ('view', 'click')",
    ),
    "v_nft_ownership": (
        ("events",),
        "SELECT contract_id, token_id, ledger_sequence, CAST(row_number() OVER (PARTITION BY contract_id, token_id, ledger_sequence ORDER BY transaction_id) - 1 AS BIGINT) AS event_order, owner_id, event_type, transaction_id FROM ("
        "SELECT user_id % 30 AS contract_id, user_id % 40 AS token_id, CAST(MINUTES(ts) AS BIGINT) AS ledger_sequence, CASE WHEN event_type <> 'error' THEN event_id % 97 END AS owner_id, "
        "CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS event_type, event_id AS transaction_id FROM events WHERE event_type IN ('signup', 'purchase', 'error')) e",
    ),
    "v_entry_changes": (
        ("v_lp_amounts",),
        f"SELECT transaction_id, tx_source_id AS holder_id, CASE WHEN leg = 'A' THEN {LEG_A.format('pool_id')} ELSE {LEG_B.format('pool_id')} END AS asset_id, 2 * application_order + CASE WHEN leg = 'A' THEN 0 ELSE 1 END AS change_index, "
        "CAST(1000000 - sum(amount) OVER w + amount AS BIGINT) AS before, CAST(1000000 - sum(amount) OVER w AS BIGINT) AS after FROM v_lp_amounts "
        f"WINDOW w AS (PARTITION BY transaction_id, tx_source_id, CASE WHEN leg = 'A' THEN {LEG_A.format('pool_id')} ELSE {LEG_B.format('pool_id')} END ORDER BY application_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
    "v_contracts": (
        ("v_events",),
        "SELECT contract_id, CASE contract_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS contract_type, min(ledger_sequence) AS deployed_at_ledger, min(user_id) AS deployer_id, concat('Contract ', CAST(contract_id AS STRING)) AS name, "
        "CASE WHEN contract_id % 5 > 0 THEN sha2(concat('code', CAST(contract_id % 9 AS STRING)), 256) END AS code_hash FROM v_events GROUP BY contract_id",
    ),
    "v_request_log": (
        ("events",),
        "SELECT event_type AS endpoint, concat(event_type, '-', CAST(event_id AS STRING)) AS tag, event_id, user_id, value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events",
    ),
}


def _needed(names) -> list[str]:
    """Views that these need, in order of building."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for below in VIEWS[name][0]:
                add(below)
            out.append(name)

    for name in names:
        add(name)
    return out


def with_clause(sql: str) -> str:
    """sql with the views that it names as common table expressions, in the words of an outside engine."""
    needed = _needed(dict.fromkeys(re.findall(r"\bv_\w+", sql)))
    ctes = ", ".join(f"{name} AS ({_outside(VIEWS[name][1])})" for name in needed)
    if not ctes:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {head[1] or ''}{ctes}, {sql[head.end():]}" if head else f"WITH {ctes} {sql}"


def _outside(sql: str) -> str:
    sql = re.sub(r"DAYS\((\w+)\)", r"date_diff('day', DATE '1994-12-31', CAST(\1 AS DATE))", sql)
    sql = re.sub(r"MINUTES\((\w+)\)", r"floor((epoch(\1) - 1704067200) / 60)", sql)
    sql = re.sub(r"EACH\(([^()]*)\)", r"unnest([\1])", sql)
    sql = re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", sql)
    return sql.replace("AS STRING", "AS VARCHAR")


def _spark(sql: str) -> str:
    sql = re.sub(r"EACH\(([^()]*)\)", r"explode(array(\1))", sql)
    sql = re.sub(r"DAYS\((\w+)\)", r"datediff(\1, DATE '1994-12-31')", sql)
    return re.sub(r"MINUTES\((\w+)\)", r"timestampdiff(MINUTE, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", sql)


#: Rows of lineitem that a partition of the operations view should hold. Many views and queries sort, number and join its rows one
#: after the other in one task, so that partitions of the usual size take twenty times that size in memory.
ROWS = 1 << 18


class Views:
    """The views over one directory of tables, made when they are asked for: views.ledgers is v_ledgers, views.table('orders') a table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if f"v_{name}" in VIEWS:
                reads, sql = VIEWS[f"v_{name}"]
                frames = {r: getattr(self, r.removeprefix("v_")) if r in VIEWS else self.table(r) for r in reads}
                if name == "operations":
                    frames = self._laid(frames)
                if name == "pool_snapshots" and (n := self.partitions):  # grouped and summed up by pool
                    frames = {"v_lp_amounts": frames["v_lp_amounts"].repartition(n, "pool_id")}
                for r in reads:
                    sql = re.sub(rf"\b(FROM|JOIN) {r}\b", rf"\1 {{{r}}}", sql)
                self._made[name] = self.spark.sql(_spark(sql), **frames)
            elif name in BASE:
                self._made[name] = self.table(name)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _laid(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """lineitem and orders laid out alike by the order's key, in partitions that grow in number and not in size; small tables are left to the optimizer."""
        n = self._blocks(frames["lineitem"])
        if n <= self.spark.sparkContext.defaultParallelism:
            return frames
        return {"lineitem": frames["lineitem"].repartition(n, "l_orderkey"), "orders": frames["orders"].repartition(n, "o_orderkey")}

    def _blocks(self, lineitem: DataFrame) -> int:
        return -(-lineitem.count() // ROWS)  # the files' footers have it

    @property
    def partitions(self) -> int | None:
        """Partitions of what has about as many rows as lineitem, growing with it; None for small tables."""
        n = self._blocks(self.lineitem)
        return None if n <= self.spark.sparkContext.defaultParallelism else max(n, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
