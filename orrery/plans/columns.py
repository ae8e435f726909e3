"""Queries of the shared column rules, over values that reach each of their branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from orrery.functions import exprs as X
from orrery.plans.checks import KEY, LEG, key_of
from orrery.plans.reads import LABEL

KIND = "CAST(id % 5 AS INT)"
POOL_TEXTS = ["brand#1", "1/2", " xlm / brand#2 ", "Brand#3/", "/", "p7/p7", "no such"]


def kinds(v):
    """Assets with a kind of each sort (4: none that is known), some without code or issuer."""
    a = v.assets
    return a.select("id", (F.col("id") % 5).cast("int").alias("kind"), F.when(F.col("id") % 7 > 0, F.col("asset_code")).alias("code"), F.when(F.col("id") % 11 > 0, F.col("issuer_id")).alias("issuer"), F.when(F.col("id") % 13 > 0, F.col("id")).alias("contract"))


KINDS = f"(SELECT id, {KIND} AS kind, CASE WHEN id % 7 > 0 THEN asset_code END AS code, CASE WHEN id % 11 > 0 THEN issuer_id END AS issuer, CASE WHEN id % 13 > 0 THEN id END AS contract FROM v_assets) k"


def surrogate_ids(v):
    """Of each kind: how many ids there are for how many natural keys, how many are the contract's own, and how many pool legs of wire type 1 or 2 have their asset's id."""
    k = kinds(v)
    own = X.asset_id(F.col("kind"), F.coalesce("code", F.lit("")), F.coalesce("issuer", F.lit(-1)), F.col("contract"))
    leg = X.pool_leg_asset_id(F.when(F.col("kind") == 1, 1 + F.col("id") % 2).otherwise(F.col("kind")), F.coalesce("code", F.lit("")), F.coalesce("issuer", F.lit(-1)))
    return k.withColumns({"own": own, "leg": leg}).groupBy("kind").agg(F.count_distinct("own").alias("ids"), F.count_if(F.col("own") == F.col("contract")).alias("contracts"), F.count_if((F.col("kind") < 2) & (F.col("leg") == F.col("own"))).alias("legs"))


def filtered_pools(v):
    a, b = (v.assets.select(F.col("id").alias(f"asset_{s}"), X.leg_code(F.col("asset_type"), F.col("asset_code")).alias(f"code_{s}")) for s in "ab")
    rows = v.pools.join(a, "asset_a").join(b, "asset_b")
    return reduce(lambda x, y: x.unionByName(y), [rows.where(X.pool_filter(t, F.col("code_a"), F.col("code_b"))).select(F.lit(t).alias("text"), "pool_id") for t in POOL_TEXTS])


def pool_sql(text: str) -> str:
    codes = [c.strip().upper() for c in text.split("/", 1) if c.strip()]
    a, b = (f"contains(upper({LEG.format(s)}), '{{}}')" for s in "ab")
    fits = "true" if not codes else f"{a.format(codes[0])} OR {b.format(codes[0])}" if len(codes) == 1 else f"({a.format(codes[0])} AND {b.format(codes[1])}) OR ({a.format(codes[1])} AND {b.format(codes[0])})"
    return f"SELECT '{text}' AS text, p.pool_id FROM v_pools p JOIN v_assets a ON a.id = asset_a JOIN v_assets b ON b.id = asset_b WHERE {fits}"


def amounts(v):
    """Amounts as texts, with and without zeros behind the point."""
    o = v.operations
    tail = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("", ".0", ".0000000", ".5", ".50", ".05")]), (k % 6 + 1).cast("int"))
    return o.select("transaction_id", "application_order", F.concat(F.col("quantity"), tail(F.col("application_order"))).alias("a"), F.when(F.col("transaction_id") % 50 > 0, F.concat(F.col("quantity"), tail(F.col("transaction_id")))).alias("b"))


TAIL = "(['', '.0', '.0000000', '.5', '.50', '.05'])[CAST({} % 6 + 1 AS INT)]"


def texts(v):
    t = v.transactions.where("id % 3 = 0").select(F.when(F.col("id") % 2 == 0, F.upper("hash")).otherwise(F.concat(F.lit(" "), F.col("hash"))).alias("text"))
    a = v.accounts.select(F.substring(key_of("G", F.col("account_id"), F.col("account_id") % 2 == 0), F.lit(1), (F.col("account_id") % 57).cast("int")).alias("text"))
    c = v.contracts.select(F.concat(key_of("C", F.col("contract_id"), F.lit(False)), F.when(F.col("contract_id") % 4 == 0, "A").otherwise("")).alias("text"))
    return t.union(a).union(c).union(v.assets.select("name")).union(v.assets.select("asset_code"))


TEXTS = f"""(SELECT CASE WHEN id % 2 = 0 THEN upper(hash) ELSE concat(' ', hash) END AS text FROM v_transactions WHERE id % 3 = 0 UNION ALL SELECT substr(CASE WHEN account_id % 2 = 0 THEN lower({KEY.format('G', 'account_id')}) ELSE {KEY.format('G', 'account_id')} END, 1, account_id % 57) FROM v_accounts
UNION ALL SELECT concat({KEY.format('C', 'contract_id')}, CASE WHEN contract_id % 4 = 0 THEN 'A' ELSE '' END) FROM v_contracts UNION ALL SELECT name FROM v_assets UNION ALL SELECT asset_code FROM v_assets) x"""
UP = "upper(trim(text))"

PLANS = {
    "x1_surrogate_ids": (
        surrogate_ids,
        f"SELECT kind, CASE kind WHEN 0 THEN count(DISTINCT 0) WHEN 1 THEN count(DISTINCT concat(coalesce(code, ''), ':', coalesce(issuer, -1))) WHEN 4 THEN 0 ELSE count(DISTINCT contract) END AS ids, count(*) FILTER (kind IN (2, 3) AND contract IS NOT NULL) AS contracts, count(*) FILTER (kind < 2) AS legs FROM {KINDS} GROUP BY kind",
    ),
    "x3_pool_filter": (filtered_pools, " UNION ALL ".join(pool_sql(t) for t in POOL_TEXTS)),
    "x4_price_leg": (
        lambda v: kinds(v).select("id", X.price_leg(F.col("kind"), F.col("code"), F.col("issuer"), F.col("contract")).alias("leg")).select("id", F.col("leg.kind").alias("kind"), F.col("leg.code").alias("code"), F.col("leg.issuer").alias("issuer")),
        f"SELECT id, CASE WHEN kind = 0 THEN 'native' WHEN priced THEN 'credit' WHEN kind = 3 AND contract IS NOT NULL THEN 'contract' END AS kind, CASE WHEN kind = 0 THEN '' WHEN priced THEN code WHEN kind = 3 THEN CAST(contract AS VARCHAR) END AS code, CASE WHEN kind = 0 THEN '' WHEN priced THEN CAST(issuer AS VARCHAR) WHEN kind = 3 AND contract IS NOT NULL THEN '' END AS issuer "
        f"FROM (SELECT *, kind IN (1, 2) AND coalesce(code, '') <> '' AND issuer IS NOT NULL AS priced FROM {KINDS}) p",
    ),
    "x5_fee_percent": (lambda v: v.assets.select("id", X.fee_percent((F.col("id") * 7 % 10_001).cast("int")).alias("fee")), "SELECT id, rtrim(rtrim(printf('%.2f', (id * 7 % 10001) / 100.0), '0'), '.') AS fee FROM v_assets"),
    "x6_op_type_label": (lambda v: v.assets.select("id", X.op_type_label(F.col("id") % 40 - 3).alias("label")), f"SELECT id, {LABEL} AS label FROM (SELECT id, id % 40 - 3 AS type FROM v_assets) x"),
    "x7_decimal_text_equal": (
        lambda v: amounts(v).withColumn("same", X.decimal_text_equal(F.col("a"), F.col("b"))),
        f"SELECT *, coalesce(CAST(a AS DECIMAL(38, 7)) = CAST(b AS DECIMAL(38, 7)), false) AS same FROM (SELECT transaction_id, application_order, concat(quantity, {TAIL.format('application_order')}) AS a, CASE WHEN transaction_id % 50 > 0 THEN concat(quantity, {TAIL.format('transaction_id')}) END AS b FROM v_operations) x",
    ),
    "x8_classify_query": (
        lambda v: texts(v).select("text", X.classify_query(F.col("text")).alias("kind")),
        f"SELECT text, CASE WHEN regexp_full_match({UP}, '[0-9A-F]{{64}}') THEN 'hash' WHEN regexp_full_match({UP}, 'G[A-Z2-7]{{1,55}}') THEN 'account' WHEN regexp_full_match({UP}, 'C[A-Z2-7]{{1,55}}') THEN 'contract' ELSE 'text' END AS kind FROM {TEXTS}",
    ),
}
