"""Damaged copies for the rules that nothing breaks in the other checks, each with SQL for its broken rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import quality as V
from orrery.plans.checks import CODE_ROWS, check_sql, counted, declared, held_assets, key_of, pools_with_creation
from orrery.plans.reads import HASH_INDEX, PARTICIPANTS, TOKENS, hash_index, participants, tokens
from orrery.plans.reads import code as interfaces


def twice(df, where):
    return df.unionByName(df.where(where))


def changed(df, column, where, value):
    return df.withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))


def rows_twice(key, of, broken, copies):
    """SQL of the broken rows of a table whose `copies` are there twice."""
    return f"SELECT {key} FROM {of} WHERE {broken} UNION ALL SELECT {key} FROM {of} WHERE ({broken}) AND {copies}"


def entry(make, table, rules):
    """A report of these rules only. rules: (check, SQL of the broken rows' keys)."""
    names = [check for check, _ in rules]
    return lambda v: make(v).where(F.col("check").isin(names)), check_sql([(table, check, sql) for check, sql in rules])


CUT = f"(SELECT CASE WHEN transaction_id % 33 = 0 THEN substr(hash, 1, 40) ELSE hash END AS hash, transaction_id FROM {HASH_INDEX} h) i"
P = f"{PARTICIPANTS} p"
T = f"{TOKENS} t"
TOKEN = "concat(contract_id, ':', token_id)"
MORE = "(SELECT pool_id, account_id, CASE WHEN account_id % 20 = 0 THEN -1 ELSE shares END AS shares, CASE WHEN account_id % 30 = 0 THEN last_updated_ledger + 1 ELSE first_deposit_ledger END AS first_deposit_ledger, last_updated_ledger FROM v_positions) p"


def positions(v):
    rows = changed(v.positions, "shares", "account_id % 20 = 0", F.lit(-1).cast("bigint"))
    return twice(changed(rows, "first_deposit_ledger", "account_id % 30 = 0", F.col("last_updated_ledger") + 1), "account_id % 40 = 0")


PLANS = {
    "v2_transactions_damaged": entry(
        lambda v: V.check_transactions(twice(changed(declared(v), "inner_tx_hash", "id % 20 = 0", F.substring("inner_tx_hash", 1, 20)), "id % 90 = 0"), v.operations, v.ledgers, v.accounts),
        "transactions",
        [("hash_unique", "SELECT hash FROM v_transactions WHERE id % 90 = 0"), ("inner_hash_shape", rows_twice("id", "v_transactions", "id % 20 = 0", "id % 90 = 0"))],
    ),
    "v3_hash_index_damaged": entry(
        lambda v: V.check_hash_index(twice(changed(hash_index(v), "hash", "transaction_id % 33 = 0", F.substring("hash", 1, 40)), "transaction_id % 70 = 0"), v.transactions),
        "hash_index",
        [("hash_unique", f"SELECT hash FROM {CUT} WHERE transaction_id % 70 = 0"), ("hash_shape", rows_twice("hash", CUT, "transaction_id % 33 = 0", "transaction_id % 70 = 0"))],
    ),
    "v4_operations_damaged": entry(
        lambda v: V.check_operations(counted(twice(changed(v.operations, "source_id", "transaction_id % 45 = 0", F.lit(-1).cast("bigint")), "transaction_id % 90 = 0")), v.transactions, v.accounts, v.pools),
        "operations",
        [("source_exists", rows_twice("transaction_id", "v_operations", "transaction_id % 45 = 0", "transaction_id % 90 = 0")), ("place_unique", "SELECT concat(transaction_id, ':', application_order) FROM v_operations WHERE transaction_id % 90 = 0")],
    ),
    "v5_participants_damaged": entry(
        lambda v: V.check_participants(twice(participants(v), "account_id % 50 = 0"), v.transactions.where("id % 60 <> 0"), v.accounts, v.partitions),
        "participants",
        [("transaction_exists", rows_twice("transaction_id", P, "transaction_id % 60 = 0", "account_id % 50 = 0")), ("triple_unique", f"SELECT concat(account_id, ':', ledger_sequence, ':', transaction_id) FROM {P} WHERE account_id % 50 = 0")],
    ),
    "v6_contracts_damaged": entry(
        lambda v: V.check_contracts(
            twice(changed(changed(v.contracts, "contract_type", "contract_id % 12 = 5", F.lit(9)), "code_hash", "contract_id % 10 = 4 AND code_hash IS NOT NULL", F.lit("zz")).withColumn("contract_key", key_of("C", F.col("contract_id"), F.lit(False))), "contract_id % 10 = 3"),
            v.accounts, interfaces(v),
        ),
        "contracts",
        [("contract_unique", "SELECT contract_id FROM v_contracts WHERE contract_id % 10 = 3"), ("type_range", rows_twice("contract_id", "v_contracts", "contract_id % 12 = 5", "contract_id % 10 = 3")), ("hash_shape", "SELECT contract_id FROM v_contracts WHERE contract_id % 10 = 4 AND code_hash IS NOT NULL")],
    ),
    "v7_code_damaged": entry(
        lambda v: V.check_code(changed(twice(interfaces(v), "code_hash < '8'"), "code_hash", "code_hash >= 'a'", F.substring("code_hash", 1, 10))),
        "code",
        [("hash_unique", f"SELECT code_hash FROM {CODE_ROWS} c WHERE code_hash < '8'"), ("hash_shape", f"SELECT substr(code_hash, 1, 10) FROM {CODE_ROWS} c WHERE code_hash >= 'a'")],
    ),
    "v9_invocations_damaged": entry(
        lambda v: V.check_invocations(counted(v.invocations), v.transactions, v.contracts.where("contract_id % 6 <> 1"), v.accounts, v.events), "invocations", [("contract_exists", "SELECT contract_id FROM v_invocations WHERE contract_id % 6 = 1")]
    ),
    "v10_assets_damaged": entry(
        lambda v: V.check_assets(changed(held_assets(v), "asset_type", "id % 14 IN (1, 2) OR id = 5", F.when(F.col("id") == 5, 0).when(F.col("id") % 14 == 1, 7).otherwise(3)), v.accounts, v.contracts),
        "assets",
        [("type_range", "SELECT id FROM v_assets WHERE id % 14 = 1"), ("one_native", "SELECT count(*) FROM v_assets WHERE id = 5 OR (asset_type = 0 AND id % 14 NOT IN (1, 2)) HAVING count(*) <> 1"), ("contract_exists", "SELECT id FROM v_assets WHERE id % 14 = 2 AND id NOT IN (SELECT contract_id FROM v_contracts)")],
    ),
    "v11_accounts_damaged": entry(
        lambda v: V.check_accounts(twice(changed(v.accounts, "sequence_number", "account_id % 35 = 0", F.lit(-5).cast("bigint")).withColumn("account_key", key_of("G", F.col("account_id"), F.lit(False))), "account_id % 45 = 0"), v.transactions),
        "accounts",
        [("account_unique", "SELECT account_id FROM v_accounts WHERE account_id % 45 = 0"), ("sequence_not_negative", rows_twice("account_id", "v_accounts", "account_id % 35 = 0", "account_id % 45 = 0"))],
    ),
    "v12_balances_damaged": entry(lambda v: V.check_balances(v.balances, v.accounts.where("account_id % 25 <> 0"), v.assets, v.partitions), "balances", [("account_exists", "SELECT holder_id FROM v_balances WHERE holder_id % 25 = 0")]),
    "v13_nfts_damaged": entry(
        lambda v: V.check_nfts(twice(changed(tokens(v), "last_seen_ledger", "token_id = 9", F.col("minted_at_ledger") - 1), "token_id % 13 = 4"), v.contracts.where("contract_id <> 6"), v.accounts, v.nft_ownership),
        "nfts",
        [("token_unique", f"SELECT {TOKEN} FROM {T} WHERE token_id % 13 = 4"), ("contract_exists", rows_twice("contract_id", T, "contract_id = 6", "token_id % 13 = 4")), ("minted_before_seen", f"SELECT token_id FROM {T} WHERE token_id = 9 AND minted_at_ledger IS NOT NULL")],
    ),
    "v14_nft_ownership_damaged": entry(
        lambda v: V.check_nft_ownership(changed(changed(v.nft_ownership, "event_type", "transaction_id % 40 = 0", F.lit(9)), "event_order", "transaction_id % 50 = 0", F.lit(-1).cast("bigint")), tokens(v), v.transactions, v.accounts),
        "nft_ownership",
        [("type_range", f"SELECT {TOKEN} FROM v_nft_ownership WHERE transaction_id % 40 = 0"), ("order_not_negative", f"SELECT {TOKEN} FROM v_nft_ownership WHERE transaction_id % 50 = 0")],
    ),
    "v15_pools_damaged": entry(lambda v: V.check_pools(twice(pools_with_creation(v).withColumn("created_at_ledger", F.coalesce("created_ledger", F.lit(0))), "pool_id % 30 = 7"), v.assets), "pools", [("pool_unique", "SELECT pool_id FROM v_pools WHERE pool_id % 30 = 7")]),
    "v16_snapshots_damaged": entry(
        lambda v: V.check_snapshots(changed(v.pool_snapshots, "gross_volume_a", "pool_id % 40 = 2", F.lit(-1).cast("bigint")), v.pools, v.ledgers.where("sequence % 55 <> 0")),
        "pool_snapshots",
        [("volume_not_negative", "SELECT pool_id FROM v_pool_snapshots WHERE pool_id % 40 = 2"), ("ledger_exists", "SELECT ledger_sequence FROM v_pool_snapshots WHERE ledger_sequence % 55 = 0")],
    ),
    "v17_positions_damaged": entry(
        lambda v: V.check_positions(positions(v), v.pools.where("pool_id % 9 <> 4"), v.accounts.where("account_id % 50 <> 0"), v.pool_snapshots),
        "positions",
        [
            ("pool_exists", rows_twice("pool_id", MORE, "pool_id % 9 = 4", "account_id % 40 = 0")), ("account_exists", rows_twice("account_id", MORE, "account_id % 50 = 0", "account_id % 40 = 0")),
            ("shares_not_negative", rows_twice("account_id", MORE, "account_id % 20 = 0", "account_id % 40 = 0")), ("ledgers_in_order", rows_twice("account_id", MORE, "account_id % 30 = 0", "account_id % 40 = 0")),
            ("holder_unique", "SELECT concat(pool_id, ':', account_id) FROM v_positions WHERE account_id % 40 = 0"),
        ],
    ),
}
