"""Rebuilds of stored columns from the whole history, and what is left to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.exprs import CONTRACT_FUNGIBLE, CONTRACT_NFT, CONTRACT_TOKEN, TOKEN
from orrery.operators.contracts import token_events
from orrery.operators.ingest import lp_amounts_of_operations

DEPOSIT = 22


def repair_accounts(accounts: DataFrame, parts: DataFrame) -> DataFrame:
    """First seen: the least ledger that the account took part in, else as it was."""
    least = parts.groupBy("account_id").agg(F.min("ledger_sequence").alias("least_"))
    joined = accounts.join(least, "account_id", "left")
    return joined.withColumn("first_seen_ledger", F.coalesce("least_", "first_seen_ledger")).drop("least_")


def repair_positions(positions: DataFrame, operations: DataFrame) -> DataFrame:
    """First deposit: the least ledger of the holder's deposits into the pool. operations: pool_ids, an array."""
    deposits = operations.where(F.col("type") == DEPOSIT).select(F.explode("pool_ids").alias("pool_id"), F.col("source_id").alias("account_id"), "ledger_sequence")
    least = deposits.groupBy("pool_id", "account_id").agg(F.min("ledger_sequence").alias("least_"))
    return positions.join(least, ["pool_id", "account_id"], "left").withColumn("first_deposit_ledger", F.coalesce("least_", "first_deposit_ledger")).drop("least_")


def repair_nfts(tokens: DataFrame, ownership: DataFrame) -> DataFrame:
    """Mint ledger: the least one of the token's mints."""
    least = ownership.where("event_type = 0").groupBy("contract_id", "token_id").agg(F.min("ledger_sequence").alias("least_"))
    return tokens.join(least, ["contract_id", "token_id"], "left").withColumn("minted_at_ledger", F.coalesce("least_", "minted_at_ledger")).drop("least_")


def repair_contracts(contracts: DataFrame, versions: DataFrame) -> DataFrame:
    """Deployer and ledger of the earliest version that has a deployer."""
    first = versions.where("deployer_id is not null").groupBy("contract_id").agg(F.min(F.struct("ledger_sequence", "deployer_id")).alias("first_"))
    joined = contracts.join(first, "contract_id", "left")
    return joined.withColumns({"deployer_id": F.coalesce("first_.deployer_id", "deployer_id"), "deployed_at_ledger": F.coalesce("first_.ledger_sequence", "deployed_at_ledger")}).drop("first_")


def rebuild_contract_types(contracts: DataFrame, code: DataFrame) -> DataFrame:
    """Types anew from the verdict of each contract's code, with a flag where it changed; wrappers stay."""
    joined = contracts.join(code.select("code_hash", "verdict"), "code_hash", "left")
    new = F.when(F.col("contract_type") == CONTRACT_TOKEN, F.col("contract_type")).otherwise(F.coalesce("verdict", "contract_type"))
    return joined.select(*[c for c in contracts.columns if c != "contract_type"], new.alias("contract_type"), (new != F.col("contract_type")).alias("flipped"))


def missing_token_assets(contracts: DataFrame, assets: DataFrame) -> DataFrame:
    """Fungible contracts without an asset row of type 3."""
    have = assets.where(F.col("asset_type") == TOKEN).select(F.col("id").alias("contract_id"))
    return contracts.where(F.col("contract_type") == CONTRACT_FUNGIBLE).select("contract_id").join(have, "contract_id", "left_anti").withColumn("asset_type", F.lit(TOKEN))


def reclassify_nfts(hot: DataFrame, pending: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new hot rows (pending ones of NFT contracts promoted, those of tokens dropped), the new pending rows, and counts of what would move."""
    kinds = contracts.select("contract_id", F.col("contract_type").alias("kind_"))
    p = pending.join(kinds, "contract_id", "left").withColumn("move", F.when(F.col("kind_") == CONTRACT_NFT, "promoted").when(F.col("kind_").isNotNull(), "dropped").otherwise("kept"))
    h = hot.join(kinds, "contract_id", "left").withColumn("move", F.when(F.col("kind_").isin(CONTRACT_TOKEN, CONTRACT_FUNGIBLE), "legacy_dropped").otherwise("hot"))
    counts = p.select("move").union(h.select("move")).groupBy("move").agg(F.count(F.lit(1)).alias("rows"))
    new_hot = h.where("move = 'hot'").select(*hot.columns).unionByName(p.where("move = 'promoted'").select(*hot.columns))
    return new_hot, p.where("move = 'kept'").select(*pending.columns), counts


def skeleton_accounts(accounts: DataFrame, parts: DataFrame, lo: int, hi: int) -> DataFrame:
    """Accounts that took part in ledgers lo to hi and whose sequence number is still 0, with the first of these ledgers."""
    seen = parts.where(F.col("ledger_sequence").between(lo, hi)).groupBy("account_id").agg(F.min("ledger_sequence").alias("first_seen"))
    return accounts.where("sequence_number = 0").select("account_id").join(seen, "account_id")


def holder_candidates(events: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Distinct keys of accounts and contracts in each token's events (JSON text); of wrappers contract keys and value events only."""
    keys = F.regexp_extract_all(F.concat_ws(" ", "topics", "data"), F.lit(r"\b([GC][A-Z2-7]{55})\b"), 1)
    wrapped = wrappers.select("contract_id", F.lit(True).alias("wrapped"))
    rows = events.join(wrapped, "contract_id", "left").where("wrapped is null or lower(signature) in ('transfer', 'mint', 'burn', 'clawback')")
    found = rows.select("contract_id", "wrapped", F.explode(keys).alias("holder")).where("wrapped is null or holder like 'C%'")
    return found.select("contract_id", "holder").distinct()


def enrichment_candidates(keys: DataFrame, enrichment: DataFrame, key: list[str], columns: list[str], mode: str = "untried") -> DataFrame:
    """untried: keys without a row; all; sentinels: keys whose row has '' in every column (tried, nothing found)."""
    own = keys.select(*key).distinct()
    if mode == "all":
        return own
    if mode == "untried":
        return own.join(enrichment, key, "left_anti")
    empty = enrichment.where(" and ".join(f"{c} = ''" for c in columns))
    return own.join(empty, key, "left_semi")


def collections_without_name(tokens: DataFrame, enrichment: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts of tokens that lack a collection name, and that have no name on the chain."""
    lacking = tokens.select("contract_id", "token_id").join(enrichment.where("collection_name <> ''"), ["contract_id", "token_id"], "left_anti").select("contract_id").distinct()
    return lacking.join(contracts.where("name is not null and name <> ''").select("contract_id"), "contract_id", "left_anti")


def stamp_collection_name(enrichment: DataFrame, names: DataFrame) -> DataFrame:
    """Enrichment rows with the new versions that set an empty collection name; other columns stay. names: contract_id, collection_name."""
    new = names.select("contract_id", F.col("collection_name").alias("new_"))
    stamped = enrichment.where("collection_name = ''").join(new, "contract_id").withColumns({"collection_name": F.col("new_"), "version": F.col("version") + 1})
    return enrichment.unionByName(stamped.select(*enrichment.columns))


def derive_token_presence(events: DataFrame) -> DataFrame:
    """Asset presence and participants replayed from stored token events."""
    found = token_events(events)
    return found.select("asset", "ledger_sequence", "transaction_id", F.explode(F.array_compact(F.array("from", "to"))).alias("account")).distinct()


def replay_amounts_only(operations: DataFrame, lo: int, hi: int) -> DataFrame:
    """lp_amounts_of_operations of a range of ledgers, nothing else."""
    return lp_amounts_of_operations(operations.where(F.col("ledger_sequence").between(lo, hi)))


def drain_pending(pending: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of the pending rows, and the counts by reason and contract: wrappers and tokens, fungibles, orphans (no code, never deployed)."""
    c = contracts.select("contract_id", "contract_type", "code_hash", "deployed_at_ledger")
    joined = pending.join(c, "contract_id", "left")
    reason = F.when(F.col("contract_type").isin(CONTRACT_TOKEN, CONTRACT_FUNGIBLE), "classified").when(F.col("code_hash").isNull() & F.col("deployed_at_ledger").isNull(), "orphan")
    marked = joined.withColumn("reason", reason)
    return marked.where("reason is null").select(*pending.columns), marked.where("reason is not null").groupBy("reason", "contract_id").agg(F.count(F.lit(1)).alias("rows"))
