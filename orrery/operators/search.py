"""Search over transactions, pools, accounts, contracts, assets and tokens.

Each function takes one text or a list of them and gives query (the text), kind, route, label and rank: a table is read once
for all texts, as each row is compared with all of them and repeated for those that it fits. Only search_all() sorts, and takes
the first few of each text and kind. A blank text finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.exprs import NATIVE, asked_hash, key_prefix, leg_code, pool_filter
from orrery.functions.versioned import top_n_by

HIT = ("query", "kind", "route", "label", "rank")
Texts = str | Sequence[str]


def _fitting(df: DataFrame, texts: Texts, fits: Callable[[str], Column | None]) -> DataFrame:
    """Rows with query, once for each text that they fit. fits: the condition of a text, None if no row can fit it."""
    texts = [texts] if isinstance(texts, str) else list(dict.fromkeys(texts))
    conditions = [(t, c) for t in texts if t.strip() and (c := fits(t)) is not None]
    if not conditions:
        return df.where("false").withColumn("query", F.lit(""))
    return df.withColumn("query", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in conditions]))))


def _hits(df: DataFrame, kind: str, route: Column, label: Column, rank: Column | None = None) -> DataFrame:
    return df.select("query", F.lit(kind).alias("kind"), route.cast("string").alias("route"), label.alias("label"), F.coalesce(F.lit(0) if rank is None else rank, F.lit(0)).cast("bigint").alias("rank"))


def search_transactions(hash_index: DataFrame, texts: Texts) -> DataFrame:
    """By outer or inner hash."""
    rows = _fitting(hash_index, texts, lambda t: F.col("hash") == h if (h := asked_hash(t)) else None)
    return _hits(rows, "transaction", F.col("hash"), F.col("hash")).distinct()


def search_pools(pools: DataFrame, assets: DataFrame, texts: Texts) -> DataFrame:
    """A pool's id, its hash (pool_key, also as a key of 56 signs), or codes of the legs; the newest pools first. pools: pool_id, pool_key, asset_a, asset_b, created_ledger."""
    a, b = (assets.select(F.col("id").alias(f"asset_{s}"), leg_code(F.col("asset_type"), F.col("asset_code")).alias(f"code_{s}")) for s in "ab")

    def fits(text: str) -> Column:
        if found := asked_hash(text):
            return F.col("pool_key") == found
        return (F.col("pool_id").cast("string") == text.strip()) | pool_filter(text, F.col("code_a"), F.col("code_b"))

    rows = _fitting(pools.join(a, "asset_a").join(b, "asset_b"), texts, fits)
    return _hits(rows, "pool", F.col("pool_id"), F.concat_ws(" / ", "code_a", "code_b"), -F.col("created_ledger"))


def search_accounts(accounts: DataFrame, texts: Texts, key: str = "account_key") -> DataFrame:
    """By a prefix of the key, for texts of its shape only. Label: the home domain."""
    rows = _fitting(accounts, texts, lambda t: F.col(key).startswith(p) if (p := key_prefix(t)) else None)
    return _hits(rows, "account", F.col(key), F.coalesce("home_domain", F.lit("")))


def search_contracts(contracts: DataFrame, texts: Texts, key: str = "contract_key") -> DataFrame:
    """A text of the shape of a key by a prefix of the key, any other by a part of the latest name."""
    rows = _fitting(contracts, texts, lambda t: F.col(key).startswith(p) if (p := key_prefix(t)) else F.lower("name").contains(t.strip().lower()))
    return _hits(rows, "contract", F.col(key), F.coalesce("name", F.lit("")))


def search_assets(assets: DataFrame, texts: Texts, wrappers: DataFrame) -> DataFrame:
    """Part of the code; `xlm` and `native` find the native asset. Route: the wrapper's contract, else CODE-ISSUER, else native."""
    native = F.col("asset_type") == NATIVE

    def fits(text: str) -> Column:
        part = F.lower("asset_code").contains(text.strip().lower())
        return part | native if text.strip().lower() in ("xlm", "native") else part

    rows = _fitting(assets, texts, fits).join(wrappers.select(F.col("asset_id").alias("id"), "contract_id"), "id", "left")
    route = F.coalesce(F.col("contract_id").cast("string"), F.when(~native, F.concat_ws("-", "asset_code", F.col("issuer_id").cast("string"))), F.lit("native"))
    return _hits(rows, "asset", route, leg_code(F.col("asset_type"), F.col("asset_code")))


def search_nfts(tokens: DataFrame, texts: Texts) -> DataFrame:
    rows = _fitting(tokens, texts, lambda t: F.lower("token_name").contains(t.strip().lower()))
    return _hits(rows, "nft", F.concat_ws("/", F.col("contract_id").cast("string"), F.col("token_id").cast("string")), F.col("token_name"))


def search_all(groups: list[DataFrame], n: int) -> DataFrame:
    """The first n of each text and kind, in one list."""
    both = groups[0].select(*HIT)
    for df in groups[1:]:
        both = both.unionByName(df.select(*HIT))
    return top_n_by(both, ["query", "kind"], [F.col("rank"), F.col("route"), F.col("label")], n)
