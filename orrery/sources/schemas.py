"""Schemas of the decoded record lists; readers always get one, nothing is inferred."""

from __future__ import annotations

RECORDS: dict[str, str] = {
    "ledgers": "sequence int, hash string, closed_at bigint, protocol_version int, transaction_count int, base_fee int",
    "transactions": "hash string, inner_tx_hash string, ledger_sequence int, source_account string, fee_source string, fee_charged bigint, successful boolean, result_code string, memo_type string, memo string, "
    "created_at bigint, parse_error boolean, ledger_deltas array<struct<account: string, asset: string, delta: decimal(38,0)>>",
    "events": "transaction_hash string, event_type string, source string, contract_id string, topics string, data string, event_index int, op_index int, stage string, ledger_sequence int, created_at bigint",
    "invocations": "transaction_hash string, contract_id string, caller_account string, function_name string, function_args string, return_value string, successful boolean, invocation_index int, depth int, ledger_sequence int, created_at bigint",
    "interfaces": "wasm_hash string, functions array<struct<name: string, doc: string, inputs: array<struct<name: string, type_name: string>>, outputs: array<string>>>, wasm_byte_len int, upgradeable boolean",
    "nft_events": "transaction_hash string, contract_id string, event_kind string, token_id string, `from` string, `to` string, ledger_sequence int, created_at bigint",
    "entry_changes": "transaction_hash string, change_type string, entry_type string, key string, data string, change_index int, operation_index int, ledger_sequence int, created_at bigint, token_metadata string",
    "contract_metadata": "contract_id string, metadata struct<name: string, symbol: string, decimals: int>, ledger int",
    "contract_balances": "contract_id string, holder string, balance decimal(38,0), ledger int",
    "deployments": "contract_id string, wasm_hash string, deployer_account string, deployed_at_ledger int, contract_type int, is_sac boolean, sac_asset string",
    "account_states": "account_id string, first_seen_ledger int, last_seen_ledger int, sequence_number bigint, balances string, removed_trustlines array<string>, home_domain string, created_at bigint",
    "pools": "pool_id string, asset_a string, asset_b string, fee_bps int, reserves string, total_shares string, tvl string, volume string, fee_revenue string, ledger int, created_at bigint",
    "assets": "asset_type int, asset_code string, issuer_address string, contract_id string, sac_contract_id string, sac_deployed boolean",
    "nfts": "contract_id string, token_id string, owner_account string, minted_at_ledger int, last_seen_ledger int",
    "positions": "pool_id string, account_id string, shares string, first_deposit_ledger int, last_updated_ledger int",
    "operations": "transaction_hash string, operation_index int, op_type string, source_account string, details string, asset_appearances array<string>, counterparties array<string>",
}
