"""Queries of the read models over the ledger views, each with SQL for an outside engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import exprs as X
from orrery.functions import versioned as S
from orrery.operators import pools as P
from orrery.operators import reads as R

#: Days and minutes of the views' clock.
NOW_DAY, NOW_MINUTE, WEEK_MINUTES = 2406, 43_200, 10_080


def joined(df, column):
    """An array column as text."""
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ","))


def hashes(v):
    """Hashes asked for: the outer ones of every 40th transaction, the inner ones of every 60th."""
    t = v.transactions
    return t.where("id % 40 = 0").select("hash").union(t.where("id % 60 = 0").select(F.col("inner_tx_hash").alias("hash")))


HASHES = "(SELECT hash FROM v_transactions WHERE id % 40 = 0 UNION SELECT inner_tx_hash FROM v_transactions WHERE id % 60 = 0)"
HASH_INDEX = "(SELECT hash, id AS transaction_id, ledger_sequence FROM v_transactions UNION ALL SELECT inner_tx_hash, id, ledger_sequence FROM v_transactions WHERE inner_tx_hash IS NOT NULL)"


def hash_index(v):
    t = v.transactions
    outer = t.select("hash", F.col("id").alias("transaction_id"), "ledger_sequence")
    return outer.union(t.where("inner_tx_hash is not null").select("inner_tx_hash", "id", "ledger_sequence"))


def enrichment(v):
    """Names found on the web for even assets; '' where there was nothing to find."""
    return v.assets.where("id % 2 = 0").select(F.col("id").alias("asset_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("Web "), F.col("name"))).otherwise("").alias("name"), F.when(F.col("id") % 6 == 0, F.lit("icon")).otherwise("").alias("icon"))


ENRICHMENT = "(SELECT id AS asset_id, CASE WHEN id % 4 = 0 THEN concat('Web ', name) ELSE '' END AS name, CASE WHEN id % 6 = 0 THEN 'icon' ELSE '' END AS icon FROM v_assets WHERE id % 2 = 0)"


def metadata(v):
    return v.assets.where("id % 3 = 0").select(F.col("id").alias("asset_id"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"), (F.col("id") % 10).cast("int").alias("decimals"), (F.col("id") * 10).alias("deployed_at_ledger"))


METADATA = "(SELECT id AS asset_id, concat('S', CAST(id AS VARCHAR)) AS symbol, CAST(id % 10 AS INT) AS decimals, id * 10 AS deployed_at_ledger FROM v_assets WHERE id % 3 = 0)"


def facets(v):
    """Two partial rows of each wrapper: its contract, and whether it is deployed. Every third asset has no wrapper."""
    a = v.assets.where("id % 3 <> 2")
    return a.select(F.col("id").alias("asset_id"), F.col("id").alias("contract_id"), F.lit(0).alias("deployed")).union(a.where("id % 2 = 0").select("id", F.lit(None).cast("bigint"), F.lit(1)))


def wrappers(v):
    """Wrapper contracts of assets, with the ledger of their deployment and the icon of the asset."""
    own = facets(v).where("contract_id is not null").select("asset_id", "contract_id").join(v.contracts.select("contract_id", "deployed_at_ledger"), "contract_id", "left")
    return own.join(enrichment(v).select("asset_id", "icon"), "asset_id", "left")


WRAPPERS = f"(SELECT a.id AS asset_id, a.id AS contract_id, deployed_at_ledger, icon FROM v_assets a LEFT JOIN v_contracts c ON c.contract_id = a.id LEFT JOIN {ENRICHMENT} e ON e.asset_id = a.id WHERE a.id % 3 <> 2)"


def updated_pools(v):
    """Pools with the ledger of their last update: that of the last snapshot, or one of its own."""
    last = v.pool_snapshots.groupBy("pool_id").agg(F.max("ledger_sequence").alias("last"))
    return v.pools.join(last, "pool_id", "left").withColumn("last_updated_ledger", F.coalesce("last", F.col("pool_id") + 1)).drop("last")


def identities(v):
    """Assets by the identity that prices are kept by."""
    return v.assets.select(F.col("id"), X.price_leg(F.col("asset_type"), F.col("asset_code"), F.col("issuer_id"), F.lit(None).cast("bigint")).alias("leg"))


def priced_pools(v):
    a, b = (identities(v).select(F.col("id").alias(f"asset_{s}"), F.col("leg").alias(f"leg_{s}")) for s in "ab")
    return v.pools.join(a, "asset_a").join(b, "asset_b").select("pool_id", "leg_a", "leg_b", "fee_bps")


def price_series(v):
    """Closes by identity and day."""
    day = F.expr("CAST(date_add(DATE '1994-12-31', CAST(bucket AS INT)) AS TIMESTAMP)")
    return v.prices_1d.join(identities(v), F.col("id") == F.col("asset_id")).select("leg", day.alias("bucket"), "close_usd")


def chart(v, interval, **how):
    return P.pool_chart(priced_pools(v), v.pool_snapshots, v.ledgers, price_series(v), interval, 48 * 3600, partitions=v.partitions, **how)


#: A chart from a day to a moment of another, whose own bucket of prices is still open.
CHART_FROM, CHART_TO = "TIMESTAMP '1997-03-01 00:00:00'", "TIMESTAMP '1998-02-08 12:00:00'"


def minute_ledgers(v):
    """Ledgers of the events, one a minute; some twice."""
    own = v.events.select(F.col("ledger_sequence").alias("sequence")).distinct()
    return own.union(own.where("sequence % 10 = 0")).withColumn("closed_at", F.timestamp_seconds(1_704_067_200 + 60 * F.col("sequence")))


def code(v):
    """Interfaces of contract code, as JSON."""
    c = v.contracts.where("code_hash is not null").select("code_hash", (F.col("contract_id") % 9).alias("k")).distinct()
    text = F.when(F.col("k") % 3 == 0, '{"functions":["owner_of"],"upgradeable":true}').when(F.col("k") % 3 == 1, '{"functions":["decimals"],"upgradeable":false}').otherwise('{"note":1}')
    return c.select("code_hash", text.alias("interface"))


CODE = """(SELECT DISTINCT code_hash, CASE contract_id % 9 % 3 WHEN 0 THEN '{"functions":["owner_of"],"upgradeable":true}' WHEN 1 THEN '{"functions":["decimals"],"upgradeable":false}' ELSE '{"note":1}' END AS interface FROM v_contracts WHERE code_hash IS NOT NULL)"""


def tokens(v):
    own = v.nft_ownership
    last = F.max_by("owner_id", F.struct("ledger_sequence", "event_order"))
    return own.groupBy("contract_id", "token_id").agg(last.alias("owner_id"), F.min(F.when(F.col("event_type") == 0, F.col("ledger_sequence"))).alias("minted_at_ledger"), F.max("ledger_sequence").alias("last_seen_ledger"))


TOKENS = "(SELECT contract_id, token_id, arg_max_null(owner_id, ledger_sequence * 100000 + event_order) AS owner_id, min(CASE WHEN event_type = 0 THEN ledger_sequence END) AS minted_at_ledger, max(ledger_sequence) AS last_seen_ledger FROM v_nft_ownership GROUP BY ALL)"


def token_enrichment(v):
    return tokens(v).where("token_id % 2 = 0").select("contract_id", "token_id", F.concat(F.lit("Token "), F.col("token_id").cast("string")).alias("token_name"), F.when(F.col("contract_id") % 2 == 0, F.concat(F.lit("Set "), F.col("contract_id").cast("string"))).otherwise("").alias("collection_name"))


TOKEN_ENRICHMENT = f"(SELECT contract_id, token_id, concat('Token ', CAST(token_id AS VARCHAR)) AS token_name, CASE WHEN contract_id % 2 = 0 THEN concat('Set ', CAST(contract_id AS VARCHAR)) ELSE '' END AS collection_name FROM {TOKENS} WHERE token_id % 2 = 0)"


def participants(v):
    to = F.when(F.col("signature") == "transfer", F.col("user_id") + 1).when(F.col("signature") == "mint", F.col("user_id"))
    ends = v.events.where("signature <> 'other'").withColumns({"from_id": F.when(F.col("signature") != "mint", F.col("user_id")), "to_id": to})
    return R.participants(v.transactions, v.operations, ends, v.invocations)


ENDS = "FROM v_events WHERE transaction_id IN (SELECT transaction_id FROM v_operations WHERE type IN (24, 25, 26)) AND signature"
PARTICIPANTS = (
    "(SELECT source_id AS account_id, ledger_sequence, id AS transaction_id FROM v_transactions UNION SELECT fee_source_id, ledger_sequence, id FROM v_transactions WHERE fee_source_id IS NOT NULL "
    "UNION SELECT source_id, ledger_sequence, transaction_id FROM v_operations WHERE source_id IS NOT NULL UNION SELECT destination_id, ledger_sequence, transaction_id FROM v_operations "
    f"UNION SELECT user_id, ledger_sequence, transaction_id {ENDS} <> 'other' UNION SELECT user_id + 1, ledger_sequence, transaction_id {ENDS} = 'transfer' "
    "UNION SELECT caller_id, ledger_sequence, transaction_id FROM v_invocations WHERE caller_id IS NOT NULL)"
)


def json_events(v):
    """Events with topics as JSON: lists, single values and broken text."""
    sym = F.concat(F.lit('{"type":"sym","value":"'), F.col("signature"), F.lit('"}'))
    topics = F.when(F.col("transaction_id") % 3 == 0, F.concat(F.lit("["), sym, F.lit(","), sym, F.lit("]"))).when(F.col("transaction_id") % 3 == 1, sym).otherwise("not json {")
    return v.events.withColumn("topics", topics)


TXL = "id, t.hash, t.ledger_sequence, application_order, source_id, successful, closed_at FROM v_transactions t JOIN v_ledgers l ON l.sequence = t.ledger_sequence"
LABEL = "(CASE " + " ".join(f"WHEN type = {k} THEN '{x}'" for k, x in enumerate(X.OP_TYPES)) + " ELSE concat('UNKNOWN_', CAST(type AS VARCHAR)) END)"
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY ledger_sequence DESC) AS rn FROM v_pool_snapshots) s WHERE rn = 1"
CLOSES = f"SELECT asset_id, max(bucket) AS bucket, max_by(close_usd, bucket) AS close_usd FROM v_prices_1d WHERE close_usd > 0 AND bucket < {NOW_DAY} AND bucket >= {NOW_DAY} - 400 GROUP BY asset_id"
VOLUME = f"SELECT pool_id, CAST(sum(gross_volume_a) AS BIGINT) AS volume FROM v_pool_snapshots WHERE ledger_sequence > {NOW_DAY} - 100 GROUP BY pool_id"
SWAPS = "'PATH_PAYMENT_STRICT_RECEIVE', 'PATH_PAYMENT_STRICT_SEND'"


def pool_list_sql(where: str = "") -> str:
    return f"""WITH last AS ({LATEST})
SELECT p.pool_id, p.asset_a, p.asset_b, p.fee_bps, coalesce(last.ledger_sequence, p.pool_id + 1) AS last_updated_ledger, coalesce(f.created_ledger, p.pool_id + 1) AS created_ledger, last.ledger_sequence AS snapshot_ledger, l.closed_at AS snapshot_at,
reserve_a, reserve_b, total_shares, coalesce(h.n, 0) AS participants, CASE WHEN p.asset_a <> 0 THEN wa.contract_id END AS contract_a, CASE WHEN p.asset_a <> 0 THEN nullif(wa.icon, '') END AS icon_a, wb.contract_id AS contract_b, nullif(wb.icon, '') AS icon_b
FROM v_pools p LEFT JOIN {WRAPPERS} wa ON wa.asset_id = p.asset_a LEFT JOIN {WRAPPERS} wb ON wb.asset_id = p.asset_b LEFT JOIN (SELECT pool_id, min(ledger_sequence) AS created_ledger FROM v_pool_snapshots GROUP BY pool_id) f ON f.pool_id = p.pool_id
LEFT JOIN last ON last.pool_id = p.pool_id LEFT JOIN v_ledgers l ON l.sequence = last.ledger_sequence LEFT JOIN (SELECT pool_id, count(*) AS n FROM v_positions WHERE shares > 0 GROUP BY pool_id) h ON h.pool_id = p.pool_id {where}"""


IDENTITY = "CASE WHEN {0}.asset_type = 0 THEN 'native' ELSE concat('credit:', {0}.asset_code, ':', {0}.issuer_id) END"


def chart_sql(interval: str, grain: str, priced: str = "true", charted: str = "true") -> str:
    """Each snapshot at the close of its ledger, priced at the last close of its own price bucket or before, at most 48 hours old."""
    side = "SELECT {1}.*, CASE WHEN date_diff('second', price.bucket, {1}.price_bucket) <= 172800 THEN close_usd END AS price_{0} FROM {1} ASOF LEFT JOIN price ON {1}.leg_{0} = price.leg AND {1}.price_bucket >= price.bucket"
    return f"""WITH price AS (SELECT {IDENTITY.format('a')} AS leg, CAST(DATE '1994-12-31' + CAST(bucket AS INT) AS TIMESTAMP) AS bucket, close_usd FROM v_prices_1d p JOIN v_assets a ON a.id = p.asset_id WHERE close_usd > 0 AND {priced}),
s AS (SELECT s.*, fee_bps, {IDENTITY.format('a')} AS leg_a, {IDENTITY.format('b')} AS leg_b, date_trunc('{grain}', CAST(closed_at AS TIMESTAMP)) AS price_bucket, date_trunc('{interval}', CAST(closed_at AS TIMESTAMP)) AS bk
  FROM v_pool_snapshots s JOIN v_pools p ON s.pool_id = p.pool_id JOIN v_assets a ON a.id = p.asset_a JOIN v_assets b ON b.id = p.asset_b JOIN v_ledgers l ON l.sequence = s.ledger_sequence WHERE {charted}),
pa AS ({side.format('a', 's')}), pb AS ({side.format('b', 'pa')}),
x AS (SELECT *, reserve_a * price_a + reserve_b * price_b AS tvl, gross_volume_a * price_a AS worth FROM pb),
g AS (SELECT pool_id, bk, round(max_by(tvl, ledger_sequence) FILTER (tvl IS NOT NULL), 4) AS tvl_usd, CASE WHEN count(*) FILTER (gross_volume_a IS NOT NULL AND price_a IS NULL) = 0 THEN round(sum(worth), 4) END AS volume_usd,
  max(fee_bps) AS fee_bps, count(*) AS samples FROM x GROUP BY pool_id, bk)
SELECT pool_id, strftime(bk, '%Y-%m-%d %H:%M:%S') AS bucket, tvl_usd, volume_usd, round(volume_usd * fee_bps / 10000, 4) AS fee_usd, samples FROM g"""


PLANS = {
    "s4_latest_by_version": (lambda v: R.account_detail(v.accounts_versions, F.col("version") * 1_000_000 + F.col("sequence_number")), "SELECT account_id, max(version) AS version, max(home_domain) AS home_domain, max_by(sequence_number, version * 1000000 + sequence_number) AS sequence_number FROM v_accounts_versions GROUP BY account_id"),
    "s5_dedup_by_key": (lambda v: S.dedup_by_key(v.ledgers.unionByName(v.ledgers), ["sequence"]), "SELECT * FROM v_ledgers"),
    "s6_top_n_by": (lambda v: S.top_n_by(v.transactions, ["source_id"], [F.desc("ledger_sequence"), F.desc("id")], 3).select("source_id", "id"), "SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ledger_sequence DESC, id DESC) AS rn FROM v_transactions) t WHERE rn <= 3"),
    "s7_merge_facets": (lambda v: S.merge_facets(facets(v), ["asset_id"]), "SELECT id AS asset_id, id AS contract_id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS deployed FROM v_assets WHERE id % 3 <> 2"),
    "s9_resolve_ids": (lambda v: S.resolve_ids(v.operations.select("transaction_id", "application_order", "source_id", "tx_source_id"), {"source_id": "source", "tx_source_id": "tx_source"}, v.customer, "c_custkey", "c_name"),
        "SELECT transaction_id, application_order, source_id, tx_source_id, a.c_name AS source, b.c_name AS tx_source FROM v_operations LEFT JOIN customer a ON a.c_custkey = source_id LEFT JOIN customer b ON b.c_custkey = tx_source_id"),
    "s10_lookup_hash": (lambda v: S.lookup_hash(hashes(v), hash_index(v)), f"SELECT i.hash, transaction_id, ledger_sequence FROM {HASH_INDEX} i JOIN {HASHES} h ON h.hash = i.hash"),
    "q1_network_stats": (lambda v: R.network_stats(v.ledgers, v.accounts, v.contracts, 30 * 86_400),
        "WITH h AS (SELECT max(sequence) AS head, max(epoch(closed_at)) AS last FROM v_ledgers) SELECT max(head) AS head, coalesce(sum(transaction_count) / nullif(max(epoch(closed_at)) - min(epoch(closed_at)), 0), 0.0)::DOUBLE AS tps, (SELECT count(DISTINCT account_id) FROM v_accounts) AS accounts, (SELECT count(DISTINCT contract_id) FROM v_contracts) AS contracts FROM v_ledgers, h WHERE epoch(closed_at) >= last - 2592000"),
    "q2_ledgers_with_success": (lambda v: R.ledgers_with_success(v.ledgers, v.transactions), "SELECT sequence, closed_at, transaction_count, coalesce(n, 0) AS successful FROM v_ledgers LEFT JOIN (SELECT ledger_sequence, count(*) FILTER (successful) AS n FROM v_transactions GROUP BY ledger_sequence) t ON ledger_sequence = sequence"),
    "q3_ledger_neighbours": (lambda v: R.ledger_neighbours(v.ledgers), "SELECT sequence, lag(sequence) OVER (ORDER BY sequence) AS previous, lead(sequence) OVER (ORDER BY sequence) AS next FROM v_ledgers"),
    "q4_ledger_transactions": (lambda v: R.ledger_transactions(v.transactions, v.ledgers).drop("inner_tx_hash", "fee_source_id"), "SELECT id, hash, ledger_sequence, application_order, source_id, fee_charged, successful FROM v_transactions"),
    "q5_tx_list": (lambda v: R.tx_list(v.transactions, v.ledgers), f"SELECT {TXL}"),
    "q5_tx_list_newest": (lambda v: R.tx_list(v.transactions, v.ledgers, limit=100, whole=True), f"SELECT {TXL} ORDER BY t.ledger_sequence DESC, application_order DESC LIMIT 100"),
    "q6_tx_list_by_op_type": (lambda v: R.tx_list_by_op_type(v.transactions, v.ledgers, v.operations, 13), f"SELECT {TXL} WHERE id IN (SELECT transaction_id FROM v_operations WHERE type = 13)"),
    "q7_tx_list_by_contract": (lambda v: R.tx_list_by_contract(v.transactions, v.ledgers, v.operations, v.invocations, v.events, 7), f"SELECT {TXL} WHERE id IN (SELECT transaction_id FROM v_operations WHERE contract_id = 7 UNION SELECT transaction_id FROM v_invocations WHERE contract_id = 7 UNION SELECT transaction_id FROM v_events WHERE contract_id = 7)"),
    "q8_tx_op_types": (lambda v: joined(R.tx_op_types(v.operations), "op_types"), f"SELECT transaction_id, string_agg(label, ',' ORDER BY label) AS op_types FROM (SELECT DISTINCT transaction_id, {LABEL} AS label FROM v_operations) o GROUP BY transaction_id"),
    "q9_tx_detail": (lambda v: R.tx_detail(v.transactions, hashes(v)).drop("inner_tx_hash", "fee_source_id"), f"SELECT id, t.hash, ledger_sequence, application_order, source_id, fee_charged, successful, h.hash AS asked FROM v_transactions t JOIN {HASHES} h ON h.hash = t.hash OR h.hash = t.inner_tx_hash"),
    "q10_tx_operations": (lambda v: R.tx_operations(v.operations, v.transactions, v.assets), f"SELECT transaction_id, o.application_order, {LABEL} AS type_name, coalesce(o.source_id, t.source_id) AS source_id, destination_id, contract_id, pool_id, asset_code, issuer_id FROM v_operations o JOIN v_transactions t ON t.id = transaction_id LEFT JOIN v_assets a ON a.id = o.asset_id"),
    "q11_tx_participants": (lambda v: joined(R.tx_participants(participants(v)), "accounts"), f"SELECT transaction_id, string_agg(CAST(account_id AS VARCHAR), ',' ORDER BY account_id) AS accounts FROM (SELECT DISTINCT transaction_id, account_id FROM {PARTICIPANTS} p) d GROUP BY transaction_id"),
    "q12_tx_event_contracts": (lambda v: joined(R.tx_event_contracts(v.events), "contracts"), "SELECT transaction_id, string_agg(DISTINCT CAST(contract_id AS VARCHAR), ',') AS contracts FROM v_events GROUP BY transaction_id"),
    "q13_tx_invocations": (lambda v: joined(joined(R.tx_invocations(v.invocations), "contracts"), "callers"), "SELECT transaction_id, string_agg(DISTINCT CAST(contract_id AS VARCHAR), ',') AS contracts, coalesce(string_agg(DISTINCT CAST(caller_id AS VARCHAR), ','), '') AS callers FROM v_invocations GROUP BY transaction_id"),
    "q14_accounts_recent": (lambda v: R.accounts_recent(v.accounts, v.balances, 0, True), "SELECT a.*, amount AS native_balance FROM v_accounts a LEFT JOIN v_balances b ON b.holder_id = a.account_id AND asset_id = 0 WHERE home_domain IS NOT NULL AND home_domain <> ''"),
    "q15_account_detail": (lambda v: R.account_detail(v.accounts_versions), "SELECT account_id, version, home_domain, sequence_number FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY version DESC, sequence_number DESC) AS rn FROM v_accounts_versions) a WHERE rn = 1"),
    "q16_deleted_accounts": (lambda v: R.deleted_accounts(v.accounts, v.operations, v.transactions), "SELECT * FROM v_accounts a WHERE EXISTS (SELECT 1 FROM v_operations o JOIN v_transactions t ON t.id = o.transaction_id WHERE successful AND type = 8 AND coalesce(o.source_id, t.source_id) = a.account_id AND o.ledger_sequence = a.last_seen_ledger)"),
    "q17_account_balances": (lambda v: R.account_balances(v.balances, v.assets, enrichment(v), metadata(v)), f"SELECT holder_id, b.asset_id, amount, asset_type, asset_code, issuer_id, coalesce(nullif(e.name, ''), a.name) AS name, symbol, coalesce(decimals, 7) AS decimals FROM v_balances b LEFT JOIN v_assets a ON a.id = b.asset_id LEFT JOIN {ENRICHMENT} e ON e.asset_id = b.asset_id LEFT JOIN {METADATA} m ON m.asset_id = b.asset_id WHERE amount <> 0"),
    "q18_account_transactions": (lambda v: R.account_transactions(participants(v), v.transactions, v.ledgers, 50), f"SELECT {TXL} WHERE id IN (SELECT transaction_id FROM {PARTICIPANTS} p WHERE account_id = 50)"),
    "q19_asset_list": (lambda v: R.asset_list(v.assets, 1, "e", facets(v).where("deployed = 1")), "SELECT * FROM v_assets WHERE asset_type = 1 AND (lower(asset_code) LIKE '%e%' OR lower(name) LIKE '%e%') AND id % 3 <> 2 AND id % 2 = 0"),
    "q20_asset_hydrate": (lambda v: R.asset_hydrate(v.assets, R.balance_aggregates(v.balances), enrichment(v), metadata(v), wrappers(v)), f"SELECT a.id, asset_type, asset_code, issuer_id, coalesce(supply, 0) AS supply, coalesce(holders, 0) AS holders, nullif(e.icon, '') AS icon, CASE WHEN asset_type = 0 THEN 'Stellar Lumens' ELSE coalesce(nullif(e.name, ''), a.name) END AS name, coalesce(decimals, 7) AS decimals, coalesce(m.deployed_at_ledger, w.deployed_at_ledger) AS deployed_at_ledger FROM v_assets a LEFT JOIN {WRAPPERS} w ON w.asset_id = a.id LEFT JOIN (SELECT asset_id, CAST(sum(amount) AS BIGINT) AS supply, count(*) FILTER (amount > 0) AS holders FROM v_balances GROUP BY asset_id) g ON g.asset_id = a.id LEFT JOIN {ENRICHMENT} e ON e.asset_id = a.id LEFT JOIN {METADATA} m ON m.asset_id = a.id"),
    "q21_asset_resolve": (lambda v: R.asset_resolve(v.assets, v.assets.select(F.when(F.col("id") == 0, "native").otherwise(F.concat_ws("-", "asset_code", F.col("issuer_id").cast("string"))).alias("text"))),
        "SELECT CASE WHEN id = 0 THEN 'native' ELSE concat(asset_code, '-', CAST(issuer_id AS VARCHAR)) END AS text, min(asset_type) AS asset_type, min(id) AS id FROM v_assets GROUP BY 1"),
    "q22_asset_transactions": (lambda v: R.asset_transactions(v.operations, v.invocations, facets(v).where("contract_id is not null")), "SELECT asset_id, transaction_id, max(ledger_sequence) AS ledger_sequence FROM (SELECT asset_id, transaction_id, ledger_sequence FROM v_operations UNION ALL SELECT contract_id, transaction_id, i.ledger_sequence FROM v_invocations i JOIN v_assets a ON a.id = contract_id AND a.id % 3 <> 2) x GROUP BY asset_id, transaction_id"),
    "q23_contract_list": (lambda v: R.contract_list(v.contracts, v.invocations, R.wrapped_asset(facets(v), v.assets), NOW_MINUTE, WEEK_MINUTES, text="1"), f"SELECT c.contract_id, contract_type, c.name, deployer_id, coalesce(n, 0) AS calls, CASE WHEN a.asset_type <> 0 THEN asset_code END AS asset_code, CASE WHEN a.asset_type <> 0 THEN issuer_id END AS issuer_id FROM v_contracts c LEFT JOIN (SELECT contract_id, count(*) AS n FROM v_invocations WHERE ledger_sequence > {NOW_MINUTE - WEEK_MINUTES} GROUP BY contract_id) i ON i.contract_id = c.contract_id LEFT JOIN v_assets a ON a.id = c.contract_id AND a.id % 3 <> 2 WHERE lower(c.name) LIKE '%1%'"),
    "q24_wrapped_asset": (lambda v: R.wrapped_asset(facets(v), v.assets), "SELECT id AS contract_id, CASE WHEN asset_type <> 0 THEN asset_code END AS asset_code, CASE WHEN asset_type <> 0 THEN issuer_id END AS issuer_id FROM v_assets WHERE id % 3 <> 2"),
    "q25_contract_detail": (lambda v: R.contract_detail(v.contracts, code(v)), f"SELECT c.*, CASE WHEN c.code_hash IS NULL THEN false WHEN contract_id % 9 % 3 = 0 THEN true WHEN contract_id % 9 % 3 = 1 THEN false END AS upgradeable FROM v_contracts c"),
    "q26_contract_stats": (lambda v: R.contract_stats(v.invocations, v.events, WEEK_MINUTES), f"WITH h AS (SELECT max(ledger_sequence) AS head FROM v_invocations), i AS (SELECT contract_id, count(*) AS calls, count(DISTINCT caller_id) AS callers FROM v_invocations, h WHERE ledger_sequence > head - {WEEK_MINUTES} GROUP BY contract_id), e AS (SELECT contract_id, count(*) AS events FROM v_events, h WHERE ledger_sequence > head - {WEEK_MINUTES} GROUP BY contract_id) SELECT contract_id, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(events, 0) AS events FROM i FULL JOIN e USING (contract_id)"),
    "q27_contract_interface": (lambda v: R.contract_interface(v.contracts, code(v)), f"SELECT contract_id, interface FROM v_contracts c JOIN {CODE} k ON k.code_hash = c.code_hash WHERE interface LIKE '%functions%'"),
    "q28_contract_invocations": (lambda v: R.contract_invocations(v.invocations, v.transactions), "SELECT contract_id, transaction_id, i.ledger_sequence, invocation_index, hash, successful, caller_id FROM v_invocations i JOIN v_transactions t ON t.id = transaction_id"),
    "q29_contract_events": (lambda v: R.contract_events(json_events(v), v.transactions), """SELECT contract_id, e.ledger_sequence, transaction_id, event_index, signature, CASE transaction_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_topics, CASE transaction_id % 3 WHEN 0 THEN concat('{"type":"sym","value":"', signature, '"}|{"type":"sym","value":"', signature, '"}') WHEN 1 THEN concat('{"type":"sym","value":"', signature, '"}') ELSE '' END AS topics, data, hash, successful FROM v_events e LEFT JOIN v_transactions t ON t.id = transaction_id"""),
    "q30_nft_list": (lambda v: R.nft_list(tokens(v), token_enrichment(v), v.contracts.where("contract_id % 3 = 0"), name="2", collection="1"), f"WITH c AS (SELECT contract_id, name FROM v_contracts WHERE contract_id % 3 = 0) SELECT t.contract_id, t.token_id, owner_id, minted_at_ledger, last_seen_ledger, token_name, coalesce(c.name, nullif(collection_name, '')) AS collection FROM {TOKENS} t LEFT JOIN {TOKEN_ENRICHMENT} e ON e.contract_id = t.contract_id AND e.token_id = t.token_id LEFT JOIN c ON c.contract_id = t.contract_id WHERE lower(token_name) LIKE '%2%' AND (lower(c.name) LIKE '%1%' OR lower(collection_name) LIKE '%1%')"),
    "q31_nft_detail": (lambda v: R.nft_list(tokens(v), token_enrichment(v), v.contracts.where("contract_id % 3 = 0"), contract=6), f"SELECT t.contract_id, t.token_id, owner_id, minted_at_ledger, last_seen_ledger, token_name, concat('Contract ', CAST(t.contract_id AS VARCHAR)) AS collection FROM {TOKENS} t LEFT JOIN {TOKEN_ENRICHMENT} e ON e.contract_id = t.contract_id AND e.token_id = t.token_id WHERE t.contract_id = 6"),
    "q32_nft_transfers": (lambda v: R.nft_transfers(v.nft_ownership), "SELECT contract_id, token_id, ledger_sequence, event_order, event_type, lead(owner_id) OVER (PARTITION BY contract_id, token_id ORDER BY ledger_sequence DESC, event_order DESC) AS from_id, CASE WHEN event_type <> 2 THEN owner_id END AS to_id FROM v_nft_ownership"),
    "q33_pool_list": (lambda v: P.pool_list(updated_pools(v), v.pool_snapshots, v.positions, v.ledgers, wrappers(v)), pool_list_sql()),
    "q34_pool_detail": (lambda v: P.pool_detail(updated_pools(v), v.pool_snapshots, v.positions, v.ledgers, wrappers(v), v.pools.where("pool_id % 3 = 1")), pool_list_sql("WHERE p.pool_id % 3 = 1")),
    "q35_pool_participants": (lambda v: P.pool_participants(v.positions, v.pool_snapshots, NOW_DAY, 400), f"WITH last AS ({LATEST}) SELECT p.pool_id, account_id, shares, round(CAST(shares AS DOUBLE) * 100 / CASE WHEN last.ledger_sequence >= {NOW_DAY} - 400 AND total_shares > 0 THEN total_shares END, 6) AS percentage, first_deposit_ledger, last_updated_ledger FROM v_positions p LEFT JOIN last ON last.pool_id = p.pool_id WHERE shares > 0"),
    "q36_pool_activity": (lambda v: P.pool_activity(v.lp_amounts, v.operations), "WITH g AS (SELECT pool_id, ledger_sequence, transaction_id, application_order, max(CASE WHEN leg = 'A' THEN amount END) AS amount_a, max(CASE WHEN leg = 'B' THEN amount END) AS amount_b FROM v_lp_amounts GROUP BY ALL) SELECT g.*, CASE WHEN amount_a IS NULL OR amount_b IS NULL THEN NULL WHEN amount_a > 0 AND amount_b > 0 THEN 'deposit' WHEN amount_a < 0 AND amount_b < 0 THEN 'withdrawal' ELSE 'trade' END AS kind, CAST(1 AS BIGINT) AS pools_crossed, coalesce(o.source_id, o.tx_source_id) AS source_id FROM g LEFT JOIN v_operations o ON o.transaction_id = g.transaction_id AND o.application_order = g.application_order"),
    "q37_pool_volume": (lambda v: P.pool_volume(v.pool_snapshots, NOW_DAY - 100), VOLUME),
    "q38_last_closes": (lambda v: P.last_closes(v.prices_1d, NOW_DAY, 400), CLOSES),
    "q39_pool_usd": (lambda v: P.pool_usd(v.pools, v.pool_snapshots, P.last_closes(v.prices_1d, NOW_DAY, 400), P.pool_volume(v.pool_snapshots, NOW_DAY - 100)),
        f"WITH last AS ({LATEST}), c AS ({CLOSES}), vol AS ({VOLUME}) SELECT p.pool_id, round(reserve_a * a.close_usd + reserve_b * b.close_usd, 4) AS tvl_usd, round(volume * a.close_usd, 4) AS volume_usd, round(volume * a.close_usd * fee_bps / 10000, 4) AS fee_usd FROM v_pools p JOIN last ON last.pool_id = p.pool_id LEFT JOIN vol ON vol.pool_id = p.pool_id LEFT JOIN c a ON a.asset_id = p.asset_a LEFT JOIN c b ON b.asset_id = p.asset_b"),
    "q37_pool_volume_by_close": (
        lambda v: P.pool_volume_by_close(v.pool_snapshots.unionByName(v.pool_snapshots.where("pool_id % 2 = 0")), v.ledgers.unionByName(v.ledgers.where("sequence % 3 = 0")), 200 * 86_400),
        "SELECT pool_id, CAST(sum(gross_volume_a) AS BIGINT) AS volume FROM v_pool_snapshots WHERE ledger_sequence > (SELECT max(sequence) FROM v_ledgers) - 200 GROUP BY pool_id",
    ),
    "q26_contract_stats_by_close": (
        lambda v: R.contract_stats_by_close(v.invocations, v.events, minute_ledgers(v)),
        "WITH h AS (SELECT max(ledger_sequence) - 10080 AS first FROM v_events), i AS (SELECT contract_id, count(*) AS calls, count(DISTINCT caller_id) AS callers FROM v_invocations, h WHERE ledger_sequence > first GROUP BY contract_id), "
        "e AS (SELECT contract_id, count(*) AS events FROM v_events, h WHERE ledger_sequence > first GROUP BY contract_id) SELECT contract_id, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(events, 0) AS events FROM i FULL JOIN e USING (contract_id)",
    ),
    "q40_pool_chart_window": (
        lambda v: chart(v, "1d", now=F.expr(CHART_TO), since=F.expr(CHART_FROM), until=F.expr(CHART_TO)),
        chart_sql("day", "day", f"DATE '1994-12-31' + CAST(bucket AS INT) < CAST({CHART_TO} AS DATE)", f"CAST(closed_at AS TIMESTAMP) >= {CHART_FROM} AND CAST(closed_at AS TIMESTAMP) < {CHART_TO}"),
    ),
    "q40_pool_chart": (lambda v: chart(v, "1w"), chart_sql("week", "day")),
    "q40_pool_chart_daily": (lambda v: chart(v, "1d"), chart_sql("day", "day")),
    "q40_pool_chart_hourly": (lambda v: chart(v, "1h"), chart_sql("hour", "hour")),
    "q41_keyset_page": (lambda v: S.keyset_page(v.transactions.select("id", "ledger_sequence", "application_order"), ["ledger_sequence", "application_order"], 25, (1200, 3)), "SELECT id, ledger_sequence, application_order, true AS has_next, true AS has_prev FROM v_transactions WHERE (ledger_sequence, application_order) < (1200, 3) ORDER BY ledger_sequence DESC, application_order DESC LIMIT 25"),
    "q41_keyset_page_back": (lambda v: S.keyset_page(v.transactions.select("id", "ledger_sequence", "application_order"), ["ledger_sequence", "application_order"], 25, (1200, 3), backward=True), "SELECT id, ledger_sequence, application_order, true AS has_next, true AS has_prev FROM v_transactions WHERE (ledger_sequence, application_order) > (1200, 3) ORDER BY ledger_sequence, application_order LIMIT 25"),
    "q42_balance_aggregates": (lambda v: R.balance_aggregates(v.balances), "SELECT asset_id, CAST(sum(amount) AS BIGINT) AS supply, count(*) FILTER (amount > 0) AS holders FROM v_balances GROUP BY asset_id"),
    "q43_coverage": (lambda v: R.coverage(v.ledgers), "SELECT count(DISTINCT sequence) AS ledgers, min(sequence) AS first, max(sequence) AS last, max(sequence) - min(sequence) + 1 AS expected, max(sequence) - min(sequence) + 1 - count(DISTINCT sequence) AS missing FROM v_ledgers"),
    "q44_events_by_tx_hash": (lambda v: R.events_by_tx_hash(v.events, hash_index(v).select("hash", "transaction_id"), hashes(v)), f"SELECT i.hash, e.transaction_id, event_index, contract_id, signature, data FROM v_events e JOIN {HASH_INDEX} i ON i.transaction_id = e.transaction_id JOIN {HASHES} h ON h.hash = i.hash"),
    "q45_classify_tx": (lambda v: R.tx_op_types(v.operations).join(v.operations.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")), "transaction_id").select("transaction_id", X.classify_tx(F.col("op_types"), F.col("n")).alias("story")),
        f"""WITH o AS (SELECT transaction_id, list(DISTINCT {LABEL}) AS t, count(*) AS n FROM v_operations GROUP BY transaction_id), m AS (SELECT *, CASE WHEN n > 1 THEN concat(' · ', CAST(n AS VARCHAR), ' ops') ELSE '' END AS x FROM o)
SELECT transaction_id, CASE WHEN list_contains(t, 'INVOKE_HOST_FUNCTION') THEN 'Contract call' WHEN list_has_all(['EXTEND_FOOTPRINT_TTL', 'RESTORE_FOOTPRINT'], t) THEN 'Contract maintenance'
WHEN list_has_any(t, [{SWAPS}]) THEN CASE WHEN list_has_all([{SWAPS}, 'CHANGE_TRUST'], t) THEN concat('Swap', x) END
WHEN t = ['PAYMENT'] THEN CASE WHEN n > 1 THEN concat('Payments · ', CAST(n AS VARCHAR)) ELSE 'Payment' END
WHEN list_has_all(['MANAGE_SELL_OFFER', 'MANAGE_BUY_OFFER', 'CREATE_PASSIVE_SELL_OFFER'], t) THEN concat('Trading', x) WHEN t = ['CHANGE_TRUST'] THEN concat('Trustline update', x)
WHEN list_contains(t, 'CREATE_ACCOUNT') AND list_has_all(['CREATE_ACCOUNT', 'BEGIN_SPONSORING_FUTURE_RESERVES', 'END_SPONSORING_FUTURE_RESERVES', 'REVOKE_SPONSORSHIP'], t) THEN concat('Account creation', x) END AS story FROM m"""),
}
