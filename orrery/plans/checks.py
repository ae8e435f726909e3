"""Queries of search, invariants, reconciliation, repair and service figures over the ledger views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from orrery.functions import exprs as X
from orrery.functions.versioned import latest_by_version
from orrery.operators import contracts as C
from orrery.operators import opsstats as O
from orrery.operators import pools as P
from orrery.operators import quality as V
from orrery.operators import reads as R
from orrery.operators import reconcile as D
from orrery.operators import repair as B
from orrery.operators import search as SE
from orrery.operators import search_tables as ST
from orrery.plans.ingest import AMOUNTS, pool_operations, raw_events
from orrery.plans.reads import HASH_INDEX, PARTICIPANTS, TOKENS, TOKEN_ENRICHMENT, enrichment, facets, hash_index, participants, token_enrichment, tokens
from orrery.plans.reads import code as interfaces

# --- search ---

LEG = "CASE WHEN {0}.asset_type = 0 THEN 'XLM' ELSE {0}.asset_code END"
KEY = "concat('{0}', translate(lpad(CAST({1} AS VARCHAR), 55, '0'), '0123456789', 'ABCDEFGHIJ'))"
CREATED = "LEFT JOIN (SELECT pool_id, min(ledger_sequence) AS created FROM v_pool_snapshots GROUP BY pool_id) f ON f.pool_id = p.pool_id"
TEXTS = ["brand#1/2", "1", "xlm", "token 1"]


def account_prefix(digits: int) -> str:
    """Prefix of account keys that ends with the first digits of three-digit ids from 10 on."""
    return "g" + "a" * 53 + "BCDEFGHIJ"[digits]


def pool_hits(text: str, where: str) -> str:
    a, b = LEG.format("a"), LEG.format("b")
    return f"SELECT '{text}' AS query, 'pool' AS kind, CAST(p.pool_id AS VARCHAR) AS route, concat({a}, ' / ', {b}) AS label, coalesce(-created, 0) AS rank FROM v_pools p JOIN v_assets a ON a.id = asset_a JOIN v_assets b ON b.id = asset_b {CREATED} WHERE {where.format(a=f'upper({a})', b=f'upper({b})')}"


POOL_HITS = pool_hits("brand#1/2", "({a} LIKE '%BRAND#1%' AND {b} LIKE '%2%') OR ({b} LIKE '%BRAND#1%' AND {a} LIKE '%2%')")
ACCOUNTS_FOUND = account_prefix(0)
ACCOUNT_HITS = f"SELECT '{ACCOUNTS_FOUND}' AS query, 'account' AS kind, {KEY.format('G', 'account_id')} AS route, coalesce(home_domain, '') AS label, 0 AS rank FROM v_accounts WHERE account_id BETWEEN 10 AND 19"
CONTRACT_HITS = f"SELECT '1' AS query, 'contract' AS kind, {KEY.format('C', 'contract_id')} AS route, name AS label, 0 AS rank FROM v_contracts WHERE lower(name) LIKE '%1%'"
ASSET_HITS = "SELECT 'xlm' AS query, 'asset' AS kind, CASE WHEN id % 3 <> 2 THEN CAST(id AS VARCHAR) WHEN asset_type = 0 THEN 'native' ELSE concat(asset_code, '-', issuer_id) END AS route, CASE WHEN asset_type = 0 THEN 'XLM' ELSE asset_code END AS label, 0 AS rank FROM v_assets WHERE lower(asset_code) LIKE '%xlm%' OR asset_type = 0"
NFT_HITS = f"SELECT 'token 1' AS query, 'nft' AS kind, concat(contract_id, '/', token_id) AS route, token_name AS label, 0 AS rank FROM {TOKEN_ENRICHMENT} t WHERE lower(token_name) LIKE '%token 1%'"
TX_HITS = "SELECT upper(sha256(concat('tx', 7))) AS query, 'transaction' AS kind, sha256(concat('tx', 7)) AS route, sha256(concat('tx', 7)) AS label, 0 AS rank FROM v_transactions WHERE id = 7"
#: All texts against all tables: each row's hits, by text.
ALL_HITS = " UNION ALL ".join(
    [pool_hits(t, f"({{a}} LIKE '%{t.upper()}%' OR {{b}} LIKE '%{t.upper()}%' OR CAST(p.pool_id AS VARCHAR) = '{t}')") for t in TEXTS[1:]]
    + [POOL_HITS, ASSET_HITS]
    + [f"SELECT '{t}' AS query, 'contract' AS kind, {KEY.format('C', 'contract_id')} AS route, name AS label, 0 AS rank FROM v_contracts WHERE lower(name) LIKE '%{t}%'" for t in TEXTS]
    + [f"SELECT '{t}' AS query, 'asset' AS kind, CASE WHEN id % 3 <> 2 THEN CAST(id AS VARCHAR) ELSE concat(asset_code, '-', issuer_id) END AS route, asset_code AS label, 0 AS rank FROM v_assets WHERE lower(asset_code) LIKE '%{t}%' AND asset_type = 1" for t in TEXTS if t != "xlm"]
    + [f"SELECT '{t}' AS query, 'nft' AS kind, concat(contract_id, '/', token_id) AS route, token_name AS label, 0 AS rank FROM {TOKEN_ENRICHMENT} t WHERE lower(token_name) LIKE '%{t}%'" for t in TEXTS]
)


def pool_creations(v):
    return v.pool_snapshots.groupBy("pool_id").agg(F.min("ledger_sequence").alias("created_ledger"))


def keyed_pools(v):
    return v.pools.withColumn("pool_key", F.sha2(F.concat(F.lit("pool"), F.col("pool_id").cast("string")), 256))


def pools_with_creation(v):
    return keyed_pools(v).join(pool_creations(v), "pool_id", "left")


def search_parts(v, texts=None):
    """Hits of one text for each kind, or of all texts in each kind."""
    import hashlib

    wrappers = facets(v).where("contract_id is not null")
    accounts = v.accounts.withColumn("account_key", key_of("G", F.col("account_id"), F.lit(False)))
    contracts = v.contracts.withColumn("contract_key", key_of("C", F.col("contract_id"), F.lit(False)))
    return {
        "transactions": SE.search_transactions(hash_index(v), texts or hashlib.sha256(b"tx7").hexdigest().upper()),
        "pools": SE.search_pools(pools_with_creation(v), v.assets, texts or "brand#1/2"),
        "accounts": SE.search_accounts(accounts, texts or ACCOUNTS_FOUND),
        "contracts": SE.search_contracts(contracts, texts or "1"),
        "assets": SE.search_assets(v.assets, texts or "xlm", wrappers),
        "nfts": SE.search_nfts(token_enrichment(v), texts or "token 1"),
    }


def asked_texts(v):
    """Hashes of every 500th transaction, keys and prefixes of every 60th account and each contract, codes and names in parts, pairs of codes, odd texts."""
    t = v.transactions.where("id % 500 = 0").select(F.upper("hash").alias("query"))
    k = v.accounts.where("account_id % 60 = 0").select(F.substring(key_of("G", F.col("account_id"), F.lit(False)), 1, 56).alias("query"))
    c = v.contracts.select(F.lower(key_of("C", F.col("contract_id"), F.lit(False))).alias("query"))
    n = v.contracts.select(F.concat(F.lit(" tract "), F.col("contract_id").cast("string")).alias("query"))
    a = v.assets.where("id % 20 = 0 AND id > 0").select(F.substring("asset_code", 3, 40).alias("query"))
    p = v.assets.where("id % 30 = 0 AND id > 0").select(F.concat(F.col("asset_code"), F.lit(" / p"), (F.col("id") + 1).cast("string")).alias("query"))
    odd = v.assets.where("id BETWEEN 1 AND 9").select(F.element_at(F.array(*[F.lit(x) for x in ("xlm", " Native", "7", "#4", "token 1", "no such thing", "17", "  ", "ga")]), F.col("id").cast("int")).alias("query"))
    return reduce(lambda x, y: x.union(y), [t, k, c, n, a, p, odd])


def searched_table(v):
    asked = ST.parsed(asked_texts(v))
    accounts, contracts = v.accounts.withColumn("account_key", key_of("G", F.col("account_id"), F.lit(False))), v.contracts.withColumn("contract_key", key_of("C", F.col("contract_id"), F.lit(False)))
    groups = [
        ST.search_transactions(hash_index(v), asked), ST.search_pools(keyed_pools(v), v.assets, asked, pool_creations(v)), ST.search_accounts(accounts, asked), ST.search_contracts(contracts, asked),
        ST.search_assets(v.assets, asked, facets(v).where("contract_id is not null")), ST.search_nfts(token_enrichment(v), asked),
    ]
    return SE.search_all(groups, 5)


ASKED = f"""(SELECT upper(hash) AS query FROM v_transactions WHERE id % 500 = 0 UNION SELECT {KEY.format('G', 'account_id')} FROM v_accounts WHERE account_id % 60 = 0 UNION SELECT lower({KEY.format('C', 'contract_id')}) FROM v_contracts
UNION SELECT concat(' tract ', contract_id) FROM v_contracts UNION SELECT substr(asset_code, 3) FROM v_assets WHERE id % 20 = 0 AND id > 0 UNION SELECT concat(asset_code, ' / p', id + 1) FROM v_assets WHERE id % 30 = 0 AND id > 0
UNION SELECT * FROM (VALUES ('xlm'), (' Native'), ('7'), ('#4'), ('token 1'), ('no such thing'), ('17'), ('ga')) o)"""
SEARCHED = f"""WITH q AS (SELECT query, CASE WHEN regexp_full_match(trim(query), '[0-9a-fA-F]{{64}}') THEN lower(trim(query)) END AS hash, CASE WHEN regexp_full_match(upper(trim(query)), '[GC][A-Z2-7]{{1,55}}') THEN upper(trim(query)) END AS prefix,
  lower(trim(query)) AS part, trim(split_part(upper(trim(query)), '/', 1)) AS c1, CASE WHEN contains(query, '/') THEN trim(split_part(upper(trim(query)), '/', 2)) ELSE '' END AS c2 FROM {ASKED} x),
legs AS (SELECT p.pool_id, {LEG.format('a')} AS a, {LEG.format('b')} AS b, coalesce(-created, 0) AS rank FROM v_pools p JOIN v_assets a ON a.id = asset_a JOIN v_assets b ON b.id = asset_b {CREATED}),
hits AS (
  SELECT DISTINCT query, 'transaction' AS kind, i.hash AS route, i.hash AS label, 0 AS rank FROM {HASH_INDEX} i JOIN q ON i.hash = q.hash
  UNION ALL SELECT query, 'pool', CAST(pool_id AS VARCHAR), concat(a, ' / ', b), rank FROM legs JOIN q ON CASE WHEN q.hash IS NOT NULL THEN sha256(concat('pool', pool_id)) = q.hash ELSE CAST(pool_id AS VARCHAR) = trim(query)
    OR (c2 = '' AND (contains(upper(a), c1) OR contains(upper(b), c1))) OR (c2 <> '' AND ((contains(upper(a), c1) AND contains(upper(b), c2)) OR (contains(upper(a), c2) AND contains(upper(b), c1)))) END
  UNION ALL SELECT query, 'account', {KEY.format('G', 'account_id')}, coalesce(home_domain, ''), 0 FROM v_accounts JOIN q ON starts_with({KEY.format('G', 'account_id')}, prefix)
  UNION ALL SELECT query, 'contract', {KEY.format('C', 'contract_id')}, name, 0 FROM v_contracts JOIN q ON CASE WHEN prefix IS NULL THEN contains(lower(name), part) ELSE starts_with({KEY.format('C', 'contract_id')}, prefix) END
  UNION ALL SELECT query, 'asset', CASE WHEN id % 3 <> 2 THEN CAST(id AS VARCHAR) WHEN asset_type = 0 THEN 'native' ELSE concat(asset_code, '-', issuer_id) END, CASE WHEN asset_type = 0 THEN 'XLM' ELSE asset_code END, 0
    FROM v_assets JOIN q ON contains(lower(asset_code), part) OR (asset_type = 0 AND part IN ('xlm', 'native'))
  UNION ALL SELECT query, 'nft', concat(contract_id, '/', token_id), token_name, 0 FROM {TOKEN_ENRICHMENT} t JOIN q ON contains(lower(token_name), part))
SELECT query, kind, route, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY rank, route, label) AS rn FROM hits) x WHERE rn <= 5"""


# --- damaged copies, on which invariants must fire ---


def bad_ledgers(v):
    """A ledger twice, every 50th missing, counts of every 70th negative."""
    good = v.ledgers.where("sequence % 50 <> 0").withColumn("transaction_count", F.when(F.col("sequence") % 70 == 0, -1).otherwise(F.col("transaction_count")))
    return good.unionByName(good.where("sequence % 90 = 0"))


BAD_LEDGERS = "(SELECT sequence, closed_at, hash, CASE WHEN sequence % 70 = 0 THEN -1 ELSE transaction_count END AS transaction_count, base_fee, bucket FROM v_ledgers WHERE sequence % 50 <> 0 UNION ALL SELECT sequence, closed_at, hash, CASE WHEN sequence % 70 = 0 THEN -1 ELSE transaction_count END, base_fee, bucket FROM v_ledgers WHERE sequence % 50 <> 0 AND sequence % 90 = 0)"


def key_of(first, number, wrong):
    """A key of 56 signs; in lower case where wrong holds."""
    key = F.concat(F.lit(first), F.translate(F.lpad(number.cast("string"), 55, "0"), "0123456789", "ABCDEFGHIJ"))
    return F.when(wrong, F.lower(key)).otherwise(key)


def declared(v):
    """Transactions with the number of operations that they declare: every 40th declares none, every 41st -1."""
    n = v.operations.groupBy(F.col("transaction_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    count = F.when(F.col("id") % 41 == 0, -1).when(F.col("id") % 40 == 0, 0).otherwise(F.coalesce("n", F.lit(0)))
    return v.transactions.join(n, "id", "left").withColumn("operation_count", count)


def counted(df):
    """Rows with the number that were folded into each; that of every 77th transaction is 0."""
    return df.withColumn("amount", F.when(F.col("transaction_id") % 77 == 0, 0).when(F.col("transaction_id") % 2 == 0, 1))


def held_assets(v):
    """Assets with supply and holders, every tenth without a code, every 13th with a supply below 0."""
    supply = F.when((F.col("id") % 13 == 0) & F.col("supply").isNotNull(), -1).otherwise(F.col("supply"))
    return some_assets(v).join(R.balance_aggregates(v.balances).withColumnRenamed("asset_id", "id"), "id", "left").withColumn("supply", supply)


def check_sql(parts: list[tuple[str, str, str]]) -> str:
    """(table, check, SQL of the broken rows' keys): violations and the ten smallest keys."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{check}' AS \"check\", (SELECT count(*) FROM ({sql}) x) AS violations, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST(k AS VARCHAR) AS k FROM ({sql}) x(k) ORDER BY 1 LIMIT 10) y), '') AS sample" for table, check, sql in parts
    )


def missing(column: str, of: str, key: str, dim: str, dim_key: str, where: str = "true") -> str:
    return f"SELECT {key} FROM {of} WHERE {column} IS NOT NULL AND {where} AND {column} NOT IN (SELECT {dim_key} FROM {dim} WHERE {dim_key} IS NOT NULL)"


GAPS = "SELECT sequence FROM (SELECT DISTINCT sequence, lead(sequence) OVER (ORDER BY sequence) AS n FROM (SELECT DISTINCT sequence FROM {0}) d) g WHERE n > sequence + 1"
NO_ROWS = "SELECT 0 AS k WHERE false"
CODE_ROWS = "(SELECT DISTINCT code_hash FROM v_contracts WHERE code_hash IS NOT NULL)"


ISSUERS = "(SELECT account_id FROM v_accounts WHERE account_id <> 4)"
SOME_ASSETS = "(SELECT id, asset_type, CASE WHEN id % 10 = 1 THEN '' ELSE asset_code END AS asset_code, issuer_id FROM v_assets)"


def some_assets(v):
    """Assets, every tenth without a code."""
    return v.assets.withColumn("asset_code", F.when(F.col("id") % 10 == 1, "").otherwise(F.col("asset_code")))


def check_issuers(v):
    return V.check_issuers(v.operations, v.balances, v.pools, some_assets(v), v.accounts.where("account_id <> 4"))


def with_issuer(view: str, asset: str) -> str:
    return f"(SELECT t.*, issuer_id FROM {view} t JOIN v_assets a ON a.id = t.{asset}) x"


def check_minimums(v):
    """A token's mint, a contract's first ledger and every seventh account's sequence number are wrong."""
    token = tokens(v).withColumn("minted_at_ledger", F.when(F.col("token_id") == 5, F.col("minted_at_ledger") + 1).otherwise(F.col("minted_at_ledger")))
    contract = v.contracts.withColumn("deployed_at_ledger", F.when(F.col("contract_id") == 8, F.col("deployed_at_ledger") + 1).otherwise(F.col("deployed_at_ledger")))
    account = v.accounts.withColumn("sequence_number", F.when(F.col("account_id") % 7 == 0, 0).otherwise(F.col("sequence_number")))
    operations = v.operations.select("type", F.col("tx_source_id").alias("source_id"), "pool_id", "ledger_sequence")
    return V.check_stored_minimums(v.positions, operations, token, v.nft_ownership, contract, v.events.select("contract_id", F.col("user_id").alias("deployer_id"), "ledger_sequence"), account)


def applied(v):
    """Operations as applied: every 20th transaction has its first two places swapped."""
    o = v.operations.select("transaction_id", "application_order", "type")
    swap = (F.col("transaction_id") % 20 == 0) & F.col("application_order").isin(1, 2)
    return o.withColumn("application_order", F.when(swap, 3 - F.col("application_order")).otherwise(F.col("application_order")))


ORDER_DIFF = """WITH a AS (SELECT transaction_id, list(type ORDER BY application_order) AS t FROM v_operations GROUP BY transaction_id),
m AS (SELECT transaction_id, max_by(type, n * 1000 - type) AS main_type FROM (SELECT transaction_id, type, count(*) AS n FROM v_operations GROUP BY ALL) x GROUP BY transaction_id)
SELECT a.transaction_id, len(t) AS operations, main_type, NOT (a.transaction_id % 20 = 0 AND len(t) > 1 AND t[1] <> t[2]) AS match, CASE WHEN a.transaction_id % 20 = 0 AND len(t) > 1 AND t[1] <> t[2] THEN 0 END AS first_difference FROM a JOIN m ON m.transaction_id = a.transaction_id"""


def other_ledgers(v):
    """An outside copy: every 40th ledger missing, every 30th with another count."""
    return v.ledgers.where("sequence % 40 <> 0").withColumn("transaction_count", F.col("transaction_count") + F.when(F.col("sequence") % 30 == 0, 1).otherwise(0))


TX_DIFFERS, OPS_DIFFER = "sequence % 40 = 0 OR sequence % 30 = 0", "sequence % 40 = 0 OR sequence % 70 = 0"


def counted_ledgers(v, other=False):
    """Ledgers with the number of their operations; an outside copy lacks every 40th, and has other counts of transactions (every 30th) and of operations (every 70th)."""
    n = v.operations.groupBy(F.col("ledger_sequence").alias("sequence")).agg(F.count(F.lit(1)).alias("operation_count"))
    rows = v.ledgers.select("sequence", "transaction_count").join(n, "sequence", "left").withColumn("operation_count", F.coalesce("operation_count", F.lit(0)))
    if not other:
        return rows
    rows = rows.withColumn("transaction_count", F.col("transaction_count") + F.when(F.col("sequence") % 30 == 0, 1).otherwise(0))
    return rows.withColumn("operation_count", F.col("operation_count") + F.when(F.col("sequence") % 70 == 0, 1).otherwise(0)).where("sequence % 40 <> 0")


def versions(v):
    return v.events.select("contract_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("deployer_id"), (F.col("ledger_sequence") * 1_000_000 + F.col("transaction_id")).alias("ledger_sequence"))


def costs(v):
    return v.request_log.select("tag", (F.col("event_id") % 1000).alias("rows_read"), (F.col("event_id") % 777 * 8).alias("bytes_read"), "duration_ms")


COSTS = "(SELECT tag, event_id % 1000 AS rows_read, event_id % 777 * 8 AS bytes_read, duration_ms FROM v_request_log)"


def pending(v):
    return tokens(v).select("contract_id", "token_id", "owner_id").where("token_id % 2 = 1")


def hot(v):
    return tokens(v).select("contract_id", "token_id", "owner_id").where("token_id % 2 = 0")


def some_contracts(v):
    """Contracts 0 to 17 only, a third of them without code and deployment."""
    c = v.contracts.where("contract_id < 18")
    return c.withColumns({"code_hash": F.when(F.col("contract_id") % 3 > 0, F.lit("x")), "deployed_at_ledger": F.when(F.col("contract_id") % 3 > 0, F.lit(1))})


def versioned_enrichment(v):
    return token_enrichment(v).select("contract_id", "token_id", "token_name", "collection_name", F.lit(1).alias("version"))


def keyed_events(v):
    """Events whose data names account and contract keys of 56 signs."""
    digits = F.translate(F.lpad(F.col("user_id").cast("string"), 55, "0"), "0123456789", "ABCDEFGHIJ")
    data = F.concat(F.lit('{"a":"G'), digits, F.lit('","b":"C'), digits, F.lit('"}'))
    return v.events.select("contract_id", "signature", F.lit("[]").alias("topics"), data.alias("data"))


KEYED = "translate(lpad(CAST(user_id AS VARCHAR), 55, '0'), '0123456789', 'ABCDEFGHIJ')"
REPAIR_OPS = "type = 22 AND pool_id IS NOT NULL"

PLANS = {
    "f1_search_transactions": (lambda v: search_parts(v)["transactions"], TX_HITS),
    "f2_search_pools": (lambda v: search_parts(v)["pools"], POOL_HITS),
    "f3_search_accounts": (lambda v: search_parts(v)["accounts"], ACCOUNT_HITS),
    "f4_search_contracts": (lambda v: search_parts(v)["contracts"], CONTRACT_HITS),
    "f5_search_assets": (lambda v: search_parts(v)["assets"], ASSET_HITS),
    "f6_search_nfts": (lambda v: search_parts(v)["nfts"], NFT_HITS),
    "f7_search_table": (searched_table, SEARCHED),
    "f7_search_all": (lambda v: SE.search_all(list(search_parts(v, TEXTS).values()), 5), f"SELECT query, kind, route, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY rank, route, label) AS rn FROM ({ALL_HITS}) a) x WHERE rn <= 5"),
    "x2_visible": (lambda v: X.visible(v.transactions.select("id", "ledger_sequence"), v.ledgers.where("sequence <= 1000")), "SELECT id, ledger_sequence FROM v_transactions WHERE ledger_sequence <= (SELECT max(sequence) FROM v_ledgers WHERE sequence <= 1000)"),
    "x5_texts": (lambda v: v.operations.select("transaction_id", "application_order", X.fee_percent(F.col("quantity")).alias("fee"), X.usd_text(F.col("price") / 7).alias("usd"), X.classify_query(F.when(F.col("type") % 2 == 0, F.concat(F.lit("G"), F.lit("ABC"))).otherwise(F.lit("usd coin"))).alias("query"), X.decimal_text_equal(F.concat(F.col("quantity").cast("string"), F.lit(".000")), F.col("quantity").cast("string")).alias("same")),
        "SELECT transaction_id, application_order, rtrim(rtrim(printf('%.2f', quantity / 100), '0'), '.') AS fee, printf('%.2f', price / 7) AS usd, CASE WHEN type % 2 = 0 THEN 'account' ELSE 'text' END AS query, true AS same FROM v_operations"),
    "v1_ledgers": (lambda v: V.check_ledgers(v.ledgers), check_sql([("ledgers", "contiguous", GAPS.format("v_ledgers")), ("ledgers", "sequence_unique", NO_ROWS), ("ledgers", "hash_unique", NO_ROWS), ("ledgers", "close_time_increasing", NO_ROWS), ("ledgers", "counts_not_negative", NO_ROWS)])),
    "v1_ledgers_damaged": (lambda v: V.check_ledgers(bad_ledgers(v)), check_sql([("ledgers", "contiguous", GAPS.format(BAD_LEDGERS)), ("ledgers", "sequence_unique", f"SELECT sequence FROM {BAD_LEDGERS} b GROUP BY sequence HAVING count(*) > 1"), ("ledgers", "hash_unique", f"SELECT hash FROM {BAD_LEDGERS} b GROUP BY hash HAVING count(*) > 1"), ("ledgers", "close_time_increasing", f"SELECT sequence FROM {BAD_LEDGERS} b GROUP BY sequence HAVING count(*) > 1"), ("ledgers", "counts_not_negative", f"SELECT sequence FROM {BAD_LEDGERS} b WHERE transaction_count < 0")])),
    "v2_transactions": (lambda v: V.check_transactions(declared(v), v.operations, v.ledgers.where("sequence % 9 <> 0"), v.accounts.where("account_id % 50 <> 0")), check_sql([("transactions", "hash_unique", NO_ROWS), ("transactions", "ledger_exists", "SELECT id FROM v_transactions WHERE ledger_sequence % 9 = 0"), ("transactions", "source_exists", "SELECT id FROM v_transactions WHERE source_id % 50 = 0"), ("transactions", "not_negative", "SELECT id FROM v_transactions WHERE id % 41 = 0"), ("transactions", "operations_declared", "SELECT id FROM v_transactions WHERE (id % 40 = 0 OR id % 41 = 0) AND id IN (SELECT transaction_id FROM v_operations)"), ("transactions", "inner_hash_shape", NO_ROWS), ("transactions", "without_operation", "SELECT id FROM v_transactions WHERE id NOT IN (SELECT transaction_id FROM v_operations)")])),
    "v3_hash_index": (lambda v: V.check_hash_index(hash_index(v).where("transaction_id % 100 <> 0"), v.transactions.where("id % 30 <> 1")), check_sql([("hash_index", "transaction_exists", f"SELECT hash FROM {HASH_INDEX} h WHERE transaction_id % 100 <> 0 AND transaction_id % 30 = 1"), ("hash_index", "transaction_indexed", "SELECT hash FROM v_transactions WHERE id % 100 = 0 AND id % 30 <> 1"), ("hash_index", "hash_unique", NO_ROWS), ("hash_index", "hash_shape", NO_ROWS)])),
    "v4_operations": (lambda v: V.check_operations(counted(v.operations), v.transactions.where("id % 100 <> 3"), v.accounts, v.pools.where("pool_id % 27 <> 2")), check_sql([("operations", "transaction_exists", "SELECT transaction_id FROM v_operations WHERE transaction_id % 100 = 3"), ("operations", "source_exists", NO_ROWS), ("operations", "destination_exists", missing("destination_id", "v_operations", "destination_id", "v_accounts", "account_id")), ("operations", "pool_exists", "SELECT pool_id FROM v_operations WHERE pool_id % 27 = 2"), ("operations", "place_unique", NO_ROWS), ("operations", "folded_count", "SELECT transaction_id FROM v_operations WHERE transaction_id % 77 = 0")])),
    "v5_participants": (lambda v: V.check_participants(participants(v), v.transactions, v.accounts, v.partitions), check_sql([("participants", "transaction_exists", NO_ROWS), ("participants", "account_exists", missing("account_id", f"{PARTICIPANTS} p", "account_id", "v_accounts", "account_id")), ("participants", "triple_unique", NO_ROWS)])),
    "v6_contracts": (lambda v: V.check_contracts(v.contracts.withColumn("contract_key", key_of("C", F.col("contract_id"), F.col("contract_id") % 11 == 0)), v.accounts, interfaces(v).where("interface like '%functions%'")), check_sql([("contracts", "contract_unique", NO_ROWS), ("contracts", "deployer_exists", missing("deployer_id", "v_contracts", "contract_id", "v_accounts", "account_id")), ("contracts", "code_exists", "SELECT contract_id FROM v_contracts WHERE code_hash IS NOT NULL AND contract_id % 9 % 3 = 2"), ("contracts", "key_shape", "SELECT contract_id FROM v_contracts WHERE contract_id % 11 = 0"), ("contracts", "type_range", NO_ROWS), ("contracts", "hash_shape", NO_ROWS)])),
    "v7_code": (lambda v: V.check_code(interfaces(v).withColumn("interface", F.when(F.col("interface").contains("note"), "[1]").otherwise(F.col("interface")))), check_sql([("code", "hash_unique", NO_ROWS), ("code", "hash_shape", NO_ROWS), ("code", "json_object", "SELECT DISTINCT code_hash FROM v_contracts WHERE code_hash IS NOT NULL AND contract_id % 9 % 3 = 2")])),
    "v8_events": (lambda v: V.check_events(counted(v.events), v.transactions, v.contracts.where("contract_id % 7 <> 0")), check_sql([("events", "transaction_exists", missing("transaction_id", "v_events", "transaction_id", "v_transactions", "id")), ("events", "contract_exists", "SELECT contract_id FROM v_events WHERE contract_id % 7 = 0"), ("events", "folded_count", "SELECT transaction_id FROM v_events WHERE transaction_id % 77 = 0"), ("events", "ledger_of_parent", "SELECT transaction_id FROM v_events e JOIN v_transactions t ON t.id = e.transaction_id WHERE e.ledger_sequence <> t.ledger_sequence")])),
    "v9_invocations": (lambda v: V.check_invocations(counted(v.invocations), v.transactions, v.contracts, v.accounts, v.events.where("signature = 'other'")), check_sql([("invocations", "transaction_exists", missing("transaction_id", "v_invocations", "transaction_id", "v_transactions", "id")), ("invocations", "contract_exists", NO_ROWS), ("invocations", "caller_exists", missing("caller_id", "v_invocations", "caller_id", "v_accounts", "account_id")), ("invocations", "folded_count", "SELECT transaction_id FROM v_invocations WHERE transaction_id % 77 = 0"), ("invocations", "ledger_of_parent", "SELECT transaction_id FROM v_invocations e JOIN v_transactions t ON t.id = e.transaction_id WHERE e.ledger_sequence <> t.ledger_sequence"), ("invocations", "without_event", "SELECT transaction_id FROM v_invocations i WHERE NOT EXISTS (SELECT 1 FROM v_events e WHERE e.signature = 'other' AND e.contract_id = i.contract_id AND e.transaction_id = i.transaction_id)")])),
    "v10_assets": (lambda v: V.check_assets(held_assets(v), v.accounts.where("account_id <> 4"), v.contracts), check_sql([("assets", "type_range", NO_ROWS), ("assets", "identity_shape", "SELECT id FROM v_assets WHERE id % 10 = 1"), ("assets", "one_native", NO_ROWS), ("assets", "issuer_exists", missing("issuer_id", "v_assets", "id", "(SELECT account_id FROM v_accounts WHERE account_id <> 4)", "account_id")), ("assets", "not_negative", "SELECT id FROM v_assets WHERE id % 13 = 0 AND id IN (SELECT asset_id FROM v_balances)"), ("assets", "contract_exists", NO_ROWS)])),
    "v11_accounts": (lambda v: V.check_accounts(v.accounts.withColumn("account_key", key_of("G", F.col("account_id"), F.col("account_id") % 33 == 0)).withColumn("first_seen_ledger", F.when(F.col("account_id") % 40 == 0, F.col("last_seen_ledger") + 1).otherwise(F.col("first_seen_ledger"))), v.transactions), check_sql([("accounts", "account_unique", NO_ROWS), ("accounts", "key_shape", "SELECT account_id FROM v_accounts WHERE account_id % 33 = 0"), ("accounts", "ledgers_not_negative", "SELECT account_id FROM v_accounts WHERE first_seen_ledger < 0 AND account_id % 40 <> 0 OR last_seen_ledger < 0"), ("accounts", "seen_in_order", "SELECT account_id FROM v_accounts WHERE account_id % 40 = 0"), ("accounts", "sequence_not_negative", NO_ROWS), ("accounts", "source_has_sequence", "SELECT account_id FROM v_accounts WHERE sequence_number = 0")])),
    "v12_balances": (lambda v: V.check_balances(v.balances.unionByName(v.balances.where("asset_id = 0 and holder_id % 3 = 0")).withColumn("amount", F.when(F.col("holder_id") % 60 == 0, -1).otherwise(F.col("amount"))), v.accounts, v.assets.where("id <> 7"), v.partitions), check_sql([("balances", "account_exists", NO_ROWS), ("balances", "asset_exists", "SELECT asset_id FROM v_balances WHERE asset_id = 7"), ("balances", "not_negative", "SELECT holder_id FROM v_balances WHERE holder_id % 60 = 0 UNION ALL SELECT holder_id FROM v_balances WHERE holder_id % 60 = 0 AND asset_id = 0"), ("balances", "holder_asset_unique", "SELECT concat(holder_id, ':0') FROM v_balances WHERE asset_id = 0 AND holder_id % 3 = 0"), ("balances", "one_native_a_holder", "SELECT holder_id FROM v_balances WHERE asset_id = 0 AND holder_id % 3 = 0")])),
    "v13_nfts": (lambda v: V.check_nfts(tokens(v).withColumn("owner_id", F.when(F.col("token_id") == 5, -1).otherwise(F.col("owner_id"))), v.contracts, v.accounts, v.nft_ownership), check_sql([("nfts", "token_unique", NO_ROWS), ("nfts", "contract_exists", NO_ROWS), ("nfts", "owner_exists", missing("owner_id", f"(SELECT contract_id, token_id, CASE WHEN token_id = 5 THEN -1 ELSE owner_id END AS owner_id FROM {TOKENS} t) o", "owner_id", "v_accounts", "account_id")), ("nfts", "minted_before_seen", NO_ROWS), ("nfts", "owner_is_latest", f"SELECT concat(contract_id, ':', token_id) FROM {TOKENS} t WHERE token_id = 5")])),
    "v14_nft_ownership": (lambda v: V.check_nft_ownership(v.nft_ownership, tokens(v).where("token_id <> 3"), v.transactions, v.accounts), check_sql([("nft_ownership", "token_exists", "SELECT concat(contract_id, ':', token_id) FROM v_nft_ownership WHERE token_id = 3"), ("nft_ownership", "transaction_exists", missing("transaction_id", "v_nft_ownership", "transaction_id", "v_transactions", "id")), ("nft_ownership", "owner_exists", missing("owner_id", "v_nft_ownership", "owner_id", "v_accounts", "account_id")), ("nft_ownership", "type_range", NO_ROWS), ("nft_ownership", "first_is_mint", "SELECT concat(contract_id, ':', token_id) FROM (SELECT contract_id, token_id, min_by(event_type, ledger_sequence * 100000 + event_order) AS t FROM v_nft_ownership GROUP BY ALL) x WHERE t <> 0"), ("nft_ownership", "order_not_negative", NO_ROWS)])),
    "v15_pools": (lambda v: V.check_pools(pools_with_creation(v).withColumns({"created_at_ledger": F.coalesce("created_ledger", F.lit(0)), "pool_key": F.when(F.col("pool_id") % 19 > 0, F.col("pool_key")).otherwise(F.substring("pool_key", 1, 32)), "asset_b": F.when(F.col("pool_id") == 3, 0).otherwise(F.col("asset_b")), "fee_bps": F.when(F.col("pool_id") == 4, 20_000).otherwise(F.col("fee_bps"))}), v.assets.where("id <> 25")), check_sql([("pools", "key_shape", "SELECT pool_id FROM v_pools WHERE pool_id % 19 = 0"), ("pools", "placeholders", "SELECT pool_id FROM v_pools WHERE pool_id NOT IN (SELECT pool_id FROM v_pool_snapshots)"), ("pools", "pool_unique", NO_ROWS), ("pools", "leg_order", "SELECT 3"), ("pools", "asset_a_exists", "SELECT pool_id FROM v_pools WHERE asset_a = 25"), ("pools", "asset_b_exists", "SELECT pool_id FROM v_pools WHERE asset_b = 25"), ("pools", "fee_range", "SELECT 4")])),
    "v16_snapshots": (lambda v: V.check_snapshots(v.pool_snapshots.unionByName(v.pool_snapshots.where("ledger_sequence % 50 = 0 and pool_id = 2")), v.pools.where("pool_id <> 13"), v.ledgers), check_sql([("pool_snapshots", "pool_exists", "SELECT pool_id FROM v_pool_snapshots WHERE pool_id = 13"), ("pool_snapshots", "reserves_not_negative", "SELECT pool_id FROM (SELECT * FROM v_pool_snapshots UNION ALL SELECT * FROM v_pool_snapshots WHERE ledger_sequence % 50 = 0 AND pool_id = 2) s WHERE reserve_a < 0 OR reserve_b < 0"), ("pool_snapshots", "volume_not_negative", NO_ROWS), ("pool_snapshots", "one_a_ledger", "SELECT concat(pool_id, ':', ledger_sequence) FROM v_pool_snapshots WHERE ledger_sequence % 50 = 0 AND pool_id = 2"), ("pool_snapshots", "ledger_exists", NO_ROWS)])),
    "v17_positions": (lambda v: V.check_positions(v.positions, v.pools, v.accounts, v.pool_snapshots), check_sql([("positions", "pool_exists", NO_ROWS), ("positions", "account_exists", NO_ROWS), ("positions", "shares_not_negative", NO_ROWS), ("positions", "ledgers_in_order", NO_ROWS), ("positions", "holder_unique", NO_ROWS), ("positions", "shares_add_up", "SELECT p.pool_id FROM (SELECT pool_id, sum(shares) AS held FROM v_positions WHERE shares > 0 GROUP BY pool_id) p JOIN (SELECT pool_id, max_by(total_shares, ledger_sequence) AS total FROM v_pool_snapshots GROUP BY pool_id) s ON s.pool_id = p.pool_id WHERE abs(held - total) > total * 0.001")])),
    "v18_layout": (lambda v: V.check_layout(v.ledgers, 500)[1], "SELECT bucket, count(*) AS rows, bucket > (SELECT max(bucket) FROM v_ledgers) - 2 AS recent FROM v_ledgers GROUP BY bucket"),
    "v18_outside_bucket": (lambda v: V.check_layout(v.ledgers.withColumn("bucket", F.when(F.col("sequence") % 300 == 1, 99).otherwise(F.col("bucket"))), 500)[0], check_sql([("ledgers", "in_bucket", "SELECT sequence FROM v_ledgers WHERE sequence % 300 = 1")])),
    "v19_contract_code": (lambda v: V.check_contract_code(v.contracts.where("contract_id <> 8"), v.events.select("contract_id", "ledger_sequence", "event_index", F.when(F.col("contract_id") % 2 == 0, F.sha2(F.concat(F.lit("code"), (F.col("contract_id") % 9).cast("string")), 256)).otherwise("z").alias("code_hash"))), check_sql([("contracts", "code_is_latest", "SELECT DISTINCT contract_id FROM v_events WHERE contract_id % 2 = 1 OR contract_id % 5 = 0 OR contract_id = 8")])),
    "v20_after_merge": (lambda v: V.check_after_merge(v.ledgers, v.transactions.where("id % 500 <> 4"), v.operations, latest_by_version(v.accounts_versions, ["account_id", "version"], "sequence_number"), v.accounts, participants(v)), check_sql([("ledgers", "gap_after", GAPS.format("v_ledgers")), ("accounts", "first_seen_is_least", f"SELECT a.account_id FROM v_accounts a JOIN (SELECT account_id, min(ledger_sequence) AS l FROM {PARTICIPANTS} p GROUP BY account_id) p ON p.account_id = a.account_id WHERE l <> first_seen_ledger"), ("operations", "without_transaction", "SELECT transaction_id FROM v_operations WHERE transaction_id % 500 = 4"), ("ledgers", "transaction_count", "SELECT sequence FROM v_ledgers l JOIN (SELECT ledger_sequence, count(*) AS n FROM v_transactions WHERE id % 500 <> 4 GROUP BY ledger_sequence) t ON t.ledger_sequence = l.sequence WHERE n <> transaction_count"), ("accounts", "skeleton", "SELECT account_id FROM v_accounts WHERE sequence_number = 0"), ("accounts", "sequence_never_falls", "SELECT version FROM (SELECT version, s, lag(s) OVER (PARTITION BY account_id ORDER BY version) AS b FROM (SELECT account_id, version, max(sequence_number) AS s FROM v_accounts_versions GROUP BY ALL) m) x WHERE s < b")])),
    "v4_issuers": (check_issuers, check_sql([("operations", "issuer_exists", missing("issuer_id", with_issuer("v_operations", "asset_id"), "transaction_id", ISSUERS, "account_id")), ("balances", "issuer_exists", missing("issuer_id", with_issuer("v_balances", "asset_id"), "concat(holder_id, ':', asset_id)", ISSUERS, "account_id")), ("balances", "identity_shape", f"SELECT concat(holder_id, ':', asset_id) FROM v_balances JOIN {SOME_ASSETS} a ON a.id = asset_id WHERE CASE WHEN asset_type = 0 THEN asset_code <> '' OR issuer_id IS NOT NULL ELSE asset_code = '' OR issuer_id IS NULL END"), ("pools", "asset_a_issuer_exists", missing("issuer_id", with_issuer("v_pools", "asset_a"), "pool_id", ISSUERS, "account_id")), ("pools", "asset_b_issuer_exists", missing("issuer_id", with_issuer("v_pools", "asset_b"), "pool_id", ISSUERS, "account_id"))])),
    "v20_stored_minimums": (check_minimums, check_sql([("positions", "first_deposit_is_least", f"SELECT concat(p.pool_id, ':', p.account_id) FROM v_positions p JOIN (SELECT pool_id, tx_source_id, min(ledger_sequence) AS l FROM v_operations WHERE {REPAIR_OPS} GROUP BY ALL) d ON d.pool_id = p.pool_id AND d.tx_source_id = p.account_id WHERE l <> first_deposit_ledger"), ("nfts", "minted_at_is_least", f"SELECT concat(contract_id, ':', token_id) FROM {TOKENS} t WHERE token_id = 5 AND minted_at_ledger IS NOT NULL"), ("contracts", "deployed_at_is_least", "SELECT contract_id FROM v_contracts WHERE contract_id = 8"), ("contracts", "deployer_is_first", "SELECT c.contract_id FROM v_contracts c JOIN (SELECT contract_id, min(struct_pack(l := ledger_sequence, d := user_id)) AS f FROM v_events GROUP BY contract_id) e ON e.contract_id = c.contract_id WHERE f.d <> deployer_id"), ("accounts", "skeleton_rate", "SELECT p FROM (SELECT round(100 * count(*) FILTER (account_id % 7 = 0 OR sequence_number = 0) / count(*), 4) AS p FROM v_accounts) r WHERE p >= 1")])),
    "r1_table_diff": (lambda v: D.table_diff(v.ledgers, other_ledgers(v), ["sequence"], ["transaction_count", "base_fee"]), "SELECT CAST(sequence AS VARCHAR) AS key, CASE WHEN sequence % 40 = 0 THEN 'missing' ELSE 'transaction_count' END AS field, CASE WHEN sequence % 40 <> 0 THEN CAST(transaction_count AS VARCHAR) END AS \"left\", CASE WHEN sequence % 40 = 0 THEN 'right' ELSE CAST(transaction_count + 1 AS VARCHAR) END AS \"right\" FROM v_ledgers WHERE sequence % 40 = 0 OR sequence % 30 = 0"),
    "r1_diff_counts": (lambda v: D.diff_counts(D.table_diff(v.ledgers, other_ledgers(v), ["sequence"], ["transaction_count", "base_fee"])), "SELECT CASE WHEN sequence % 40 = 0 THEN 'missing' ELSE 'transaction_count' END AS field, count(*) AS n FROM v_ledgers WHERE sequence % 40 = 0 OR sequence % 30 = 0 GROUP BY 1"),
    "r2_order_diff": (lambda v: D.order_diff(v.operations.select("transaction_id", "application_order", "type"), applied(v)), ORDER_DIFF),
    "r2_order_rates": (lambda v: D.order_rates(D.order_diff(v.operations.select("transaction_id", "application_order", "type"), applied(v)), v.transactions, 500), f"WITH d AS ({ORDER_DIFF}) SELECT CASE WHEN operations = 1 THEN '1' WHEN operations <= 3 THEN '2-3' ELSE '4+' END AS size, CAST(floor(ledger_sequence / 500) * 500 AS BIGINT) AS ledgers, main_type, count(*) AS n, count(*) FILTER (match) AS matches FROM d JOIN v_transactions t ON t.id = d.transaction_id GROUP BY ALL"),
    "r3_volume_gate": (lambda v: D.volume_gate(v.lp_amounts, v.pool_snapshots.withColumn("gross_volume_a", F.when(F.col("ledger_sequence") % 100 == 0, F.col("gross_volume_a") + 1).otherwise(F.col("gross_volume_a")))), "SELECT pool_id, ledger_sequence, gross_volume_a AS moved, gross_volume_a + 1 AS stated FROM v_pool_snapshots WHERE gross_volume_a IS NOT NULL AND ledger_sequence % 100 = 0"),
    "r4_row_count_parity": (lambda v: D.row_count_parity({"ledgers": v.ledgers, "transactions": v.transactions, "operations": v.operations}, {"ledgers": v.ledgers, "transactions": v.transactions.where("id % 10 <> 0"), "operations": v.operations}), "SELECT 'ledgers' AS \"table\", count(*) AS rows_before, count(*) AS rows_after, true AS same FROM v_ledgers UNION ALL SELECT 'transactions', count(*), count(*) FILTER (id % 10 <> 0), false FROM v_transactions UNION ALL SELECT 'operations', count(*), count(*), true FROM v_operations"),
    "r5_stratified_both_counts": (
        lambda v: D.stratified_compare(counted_ledgers(v), counted_ledgers(v, True), 500, 10_000),
        f"SELECT CAST(floor(sequence / 500) AS BIGINT) AS bucket, count(*) AS drawn, count(*) FILTER ({TX_DIFFERS} OR {OPS_DIFFER}) AS different, round(count(*) FILTER ({TX_DIFFERS} OR {OPS_DIFFER}) / count(*), 6) AS ratio, count(*) FILTER ({TX_DIFFERS}) AS transaction_counts_different, count(*) FILTER ({OPS_DIFFER}) AS operation_counts_different FROM v_ledgers GROUP BY 1",
    ),
    "r5_stratified_gate": (
        lambda v: D.stratified_gate(counted_ledgers(v), counted_ledgers(v).where("sequence <> 700"), 500, 10_000, percent=0.05).unionByName(D.stratified_gate(counted_ledgers(v), counted_ledgers(v, True), 500, 10_000)),
        "WITH n AS (SELECT count(*) AS drawn, count(*) FILTER (sequence = 700) AS one, count(*) FILTER (" + TX_DIFFERS + ") AS t, count(*) FILTER (" + OPS_DIFFER + ") AS o FROM v_ledgers), "
        "c(\"count\", \"limit\", different) AS (SELECT 'transaction_count', 0.05, one FROM n UNION ALL SELECT 'operation_count', 0.05, one FROM n UNION ALL SELECT 'transaction_count', 0.01, t FROM n UNION ALL SELECT 'operation_count', 0.01, o FROM n) "
        "SELECT \"count\", drawn, different, round(different * 100 / drawn, 6) AS percent, different * 100 / drawn <= \"limit\" AS passed FROM c, n",
    ),
    "r5_stratified_compare": (lambda v: D.stratified_compare(v.ledgers, other_ledgers(v), 500, 10_000), "SELECT CAST(floor(sequence / 500) AS BIGINT) AS bucket, count(*) AS drawn, count(*) FILTER (sequence % 40 = 0 OR sequence % 30 = 0) AS different, round(count(*) FILTER (sequence % 40 = 0 OR sequence % 30 = 0) / count(*), 6) AS ratio FROM v_ledgers GROUP BY 1"),
    "b1_repair_accounts": (lambda v: B.repair_accounts(v.accounts, participants(v)), f"SELECT a.account_id, coalesce(l, first_seen_ledger) AS first_seen_ledger, last_seen_ledger, home_domain, sequence_number FROM v_accounts a LEFT JOIN (SELECT account_id, min(ledger_sequence) AS l FROM {PARTICIPANTS} p GROUP BY account_id) p ON p.account_id = a.account_id"),
    "b2_repair_positions": (lambda v: B.repair_positions(v.positions, v.operations.where("pool_id is not null").select("type", F.col("tx_source_id").alias("source_id"), "ledger_sequence", F.array("pool_id").alias("pool_ids"))), f"SELECT p.pool_id, p.account_id, shares, coalesce(l, first_deposit_ledger) AS first_deposit_ledger, last_updated_ledger FROM v_positions p LEFT JOIN (SELECT pool_id, tx_source_id, min(ledger_sequence) AS l FROM v_operations WHERE {REPAIR_OPS} GROUP BY ALL) d ON d.pool_id = p.pool_id AND d.tx_source_id = p.account_id"),
    "b3_repair_nfts": (lambda v: B.repair_nfts(tokens(v).withColumn("minted_at_ledger", F.lit(99).cast("bigint")), v.nft_ownership), f"SELECT contract_id, token_id, owner_id, coalesce(minted_at_ledger, 99) AS minted_at_ledger, last_seen_ledger FROM {TOKENS} t"),
    "b4_repair_contracts": (lambda v: B.repair_contracts(v.contracts.select("contract_id", "deployer_id", "deployed_at_ledger"), versions(v)), "SELECT c.contract_id, coalesce(d, deployer_id) AS deployer_id, coalesce(l, deployed_at_ledger) AS deployed_at_ledger FROM v_contracts c LEFT JOIN (SELECT contract_id, min(ledger_sequence * 1000000 + transaction_id) AS l, min_by(user_id, ledger_sequence * 1000000 + transaction_id) AS d FROM v_events WHERE user_id % 3 > 0 GROUP BY contract_id) x ON x.contract_id = c.contract_id"),
    "b5_rebuild_contract_types": (lambda v: B.rebuild_contract_types(v.contracts.select("contract_id", "code_hash", "contract_type"), v.contracts.where("code_hash is not null and contract_id % 9 < 6").select("code_hash", F.lit(2).alias("verdict")).distinct()), "SELECT contract_id, code_hash, CASE WHEN contract_type = 0 THEN 0 WHEN code_hash IS NOT NULL AND contract_id % 9 < 6 THEN 2 ELSE contract_type END AS contract_type, contract_type <> CASE WHEN contract_type = 0 THEN 0 WHEN code_hash IS NOT NULL AND contract_id % 9 < 6 THEN 2 ELSE contract_type END AS flipped FROM v_contracts"),
    "b5_missing_token_assets": (lambda v: B.missing_token_assets(v.contracts, v.assets.where("id < 9").withColumn("asset_type", F.lit(3))), "SELECT contract_id, 3 AS asset_type FROM v_contracts WHERE contract_type = 3 AND contract_id >= 9"),
    "b6_reclassify_nfts": (lambda v: B.reclassify_nfts(hot(v), pending(v), some_contracts(v))[0], f"SELECT contract_id, token_id, owner_id FROM {TOKENS} t WHERE (token_id % 2 = 0 AND NOT (contract_id < 18 AND contract_id % 4 IN (0, 3))) OR (token_id % 2 = 1 AND contract_id < 18 AND contract_id % 4 = 2)"),
    "b6_reclassify_counts": (lambda v: B.reclassify_nfts(hot(v), pending(v), some_contracts(v))[2], f"SELECT move, count(*) AS rows FROM (SELECT CASE WHEN token_id % 2 = 0 THEN CASE WHEN contract_id < 18 AND contract_id % 4 IN (0, 3) THEN 'legacy_dropped' ELSE 'hot' END WHEN contract_id >= 18 THEN 'kept' WHEN contract_id % 4 = 2 THEN 'promoted' ELSE 'dropped' END AS move FROM {TOKENS} t) m GROUP BY move"),
    "b7_skeleton_accounts": (lambda v: B.skeleton_accounts(v.accounts.withColumn("sequence_number", F.when(F.col("account_id") % 7 == 0, 0).otherwise(1)), participants(v), 500, 900), f"SELECT account_id, min(ledger_sequence) AS first_seen FROM {PARTICIPANTS} p WHERE ledger_sequence BETWEEN 500 AND 900 AND account_id % 7 = 0 AND account_id IN (SELECT account_id FROM v_accounts) GROUP BY account_id"),
    "b8_holder_candidates": (lambda v: B.holder_candidates(keyed_events(v), v.contracts.where("contract_id % 3 = 0")), f"SELECT DISTINCT contract_id, concat('C', {KEYED}) AS holder FROM v_events WHERE contract_id % 3 <> 0 OR signature <> 'other' UNION SELECT DISTINCT contract_id, concat('G', {KEYED}) FROM v_events WHERE contract_id % 3 <> 0"),
    "b9_enrichment_candidates": (lambda v: B.enrichment_candidates(v.balances, enrichment(v), ["asset_id"], ["name", "icon"]), "SELECT DISTINCT asset_id FROM v_balances WHERE asset_id % 2 = 1"),
    "b9_sentinels": (lambda v: B.enrichment_candidates(v.balances, enrichment(v), ["asset_id"], ["name", "icon"], "sentinels"), "SELECT DISTINCT asset_id FROM v_balances WHERE asset_id % 4 = 2 AND asset_id % 6 <> 0"),
    "b9_collections_without_name": (lambda v: B.collections_without_name(tokens(v), token_enrichment(v), v.contracts.where("contract_id % 3 = 0")), f"SELECT DISTINCT contract_id FROM {TOKENS} t WHERE (token_id % 2 = 1 OR contract_id % 2 = 1) AND contract_id % 3 <> 0"),
    "b10_stamp_collection_name": (lambda v: B.stamp_collection_name(versioned_enrichment(v), v.contracts.select("contract_id", F.col("name").alias("collection_name")).where("contract_id % 3 = 0")), f"SELECT contract_id, token_id, token_name, collection_name, 1 AS version FROM {TOKEN_ENRICHMENT} t UNION ALL SELECT contract_id, token_id, token_name, concat('Contract ', contract_id), 2 FROM {TOKEN_ENRICHMENT} t WHERE collection_name = '' AND contract_id % 3 = 0"),
    "b11_derive_token_presence": (lambda v: B.derive_token_presence(raw_events(v)), "SELECT DISTINCT CASE contract_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'USD:GI' ELSE concat('contract:', contract_id) END AS asset, ledger_sequence, transaction_id, unnest(CASE WHEN signature = 'transfer' THEN [concat('G', user_id), concat('G', user_id + 1)] ELSE [concat('G', user_id)] END) AS account FROM v_events WHERE transaction_id % 11 <> 0 AND signature <> 'other'"),
    "b12_replay_amounts_only": (lambda v: B.replay_amounts_only(pool_operations(v), 500, 999), f"SELECT * FROM ({AMOUNTS}) a WHERE ledger_sequence BETWEEN 500 AND 999"),
    "b13_drain_pending": (lambda v: B.drain_pending(pending(v), some_contracts(v))[0], f"SELECT contract_id, token_id, owner_id FROM {TOKENS} t WHERE token_id % 2 = 1 AND contract_id < 18 AND contract_id % 4 NOT IN (0, 3) AND contract_id % 3 > 0"),
    "b13_drain_counts": (lambda v: B.drain_pending(pending(v), some_contracts(v))[1], f"SELECT CASE WHEN contract_id < 18 AND contract_id % 4 IN (0, 3) THEN 'classified' ELSE 'orphan' END AS reason, contract_id, count(*) AS rows FROM {TOKENS} t WHERE token_id % 2 = 1 AND NOT (contract_id < 18 AND contract_id % 4 NOT IN (0, 3) AND contract_id % 3 > 0) GROUP BY 1, 2"),
    "o1_latency_summary": (lambda v: O.latency_summary(v.request_log), "SELECT endpoint, count(*) AS requests, count(*) FILTER (status >= 400) AS errors, round(count(*) FILTER (status >= 400) * 100 / count(*), 4) AS error_percent, " + ", ".join(f"round(quantile_cont(duration_ms, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", max(duration_ms) AS max FROM v_request_log GROUP BY endpoint"),
    "o2_query_cost_by_endpoint": (lambda v: O.query_cost_by_endpoint(costs(v)), f"SELECT split_part(tag, '-', 1) AS endpoint, count(*) AS queries, count(DISTINCT tag) AS requests, round(avg(rows_read), 4) AS avg_rows, max(rows_read) AS max_rows, round(avg(bytes_read), 4) AS avg_bytes, max(bytes_read) AS max_bytes, round(quantile_cont(duration_ms, 0.95), 6) AS p95, CAST(sum(rows_read) AS BIGINT) AS total_rows FROM {COSTS} c GROUP BY 1"),
    "o3_query_cost_by_request": (lambda v: O.query_cost_by_request(costs(v)), f"SELECT tag, count(*) AS queries, CAST(sum(rows_read) AS BIGINT) AS rows_read, CAST(sum(bytes_read) AS BIGINT) AS bytes_read FROM {COSTS} c GROUP BY tag"),
    "o4_join_client_server": (lambda v: O.join_client_server(v.request_log.select("tag", "duration_ms", "status"), O.query_cost_by_request(costs(v).where("rows_read % 4 <> 0"))), "SELECT tag, duration_ms, status, CASE WHEN event_id % 1000 % 4 <> 0 THEN 1 END AS queries, CASE WHEN event_id % 1000 % 4 <> 0 THEN event_id % 1000 END AS rows_read, CASE WHEN event_id % 1000 % 4 <> 0 THEN event_id % 777 * 8 END AS bytes_read, event_id % 1000 % 4 <> 0 AS matched FROM v_request_log"),
    "o4_match_rate": (lambda v: O.match_rate(O.join_client_server(v.request_log.select("tag", "status"), O.query_cost_by_request(costs(v).where("rows_read % 4 <> 0")))), "SELECT count(*) AS requests, round(count(*) FILTER (event_id % 1000 % 4 <> 0) / count(*), 6) AS rate FROM v_request_log"),
    "o6_enrichment_coverage": (lambda v: O.enrichment_coverage(v.balances, enrichment(v), ["asset_id"], ["name", "icon"]), "SELECT count(*) AS candidates, count(*) FILTER (a % 2 = 0) AS rows, count(*) FILTER (a % 4 = 0) AS name_real, count(*) FILTER (a % 4 = 2) AS name_sentinel, count(*) FILTER (a % 6 = 0) AS icon_real, count(*) FILTER (a % 2 = 0 AND a % 6 <> 0) AS icon_sentinel, count(*) FILTER (a % 4 = 0 OR a % 6 = 0) AS rows_real FROM (SELECT DISTINCT asset_id AS a FROM v_balances) b"),
}
