"""Folds of decoded records into table rows: transactions, operations, amounts, balances, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.exprs import AMOUNT, CONTRACT_OPS, CREDIT, NATIVE, TOKEN
from orrery.functions.versioned import dedup_by_key, latest_by_version, merge_facets

# --- ledgers, accounts, transactions ---


def ledger_rows(headers: DataFrame) -> DataFrame:
    """Decoded headers (closed_at in epoch seconds) as ledger rows."""
    return headers.select("sequence", F.lower("hash").alias("hash"), F.timestamp_seconds("closed_at").alias("closed_at"), "protocol_version", "transaction_count", F.col("base_fee").cast("bigint").alias("base_fee"))


def is_account(column: str) -> Column:
    """Keys of accounts: G…, 56 signs at most."""
    return F.col(column).startswith("G") & (F.length(column) <= 56)


def account_universe(roles: list[DataFrame]) -> DataFrame:
    """Every account of any role: one-column frames; only account keys (G…, 56 signs at most)."""
    both = roles[0].toDF("account")
    for df in roles[1:]:
        both = both.unionByName(df.toDF("account"))
    return both.where(is_account("account")).distinct()


def account_state_merge(states: DataFrame, place: Column | None = None) -> DataFrame:
    """One state of each account: last sequence number that is not -1, first and last seen, last home domain. Order: (ledger, order), or place."""
    at = F.struct("last_seen_ledger" if place is None else place.alias("place"), "order")
    known = F.col("sequence_number") >= 0
    return states.groupBy("account_id").agg(
        F.max(F.when(known, F.struct(at.alias("at"), F.col("sequence_number").alias("value")))).getField("value").alias("sequence_number"),
        F.min("first_seen_ledger").alias("first_seen_ledger"),
        F.max("last_seen_ledger").alias("last_seen_ledger"),
        F.max(F.when(F.col("home_domain").isNotNull(), F.struct(at.alias("at"), F.col("home_domain").alias("value")))).getField("value").alias("home_domain"),
    )


def transaction_rows(transactions: DataFrame, operations: DataFrame) -> DataFrame:
    """Application order from 1 in each ledger, number of operations, and whether any touches a contract. transactions: a column position."""
    ops = operations.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("operation_count"), F.bool_or(F.col("type").isin(*CONTRACT_OPS)).alias("has_contract"))
    order = F.row_number().over(Window.partitionBy("ledger_sequence").orderBy("position")).cast("bigint")
    joined = transactions.withColumn("application_order", order).join(ops, F.col("id") == F.col("transaction_id"), "left").drop("transaction_id")
    return joined.withColumns({"operation_count": F.coalesce("operation_count", F.lit(0)), "has_contract": F.coalesce("has_contract", F.lit(False))})


def hash_index(transactions: DataFrame) -> DataFrame:
    """Outer and inner hashes to their ledger."""
    outer = transactions.select("hash", "ledger_sequence")
    inner = transactions.where("inner_tx_hash is not null").select(F.col("inner_tx_hash").alias("hash"), "ledger_sequence")
    return outer.unionByName(inner)


# --- operations ---


def detail(path: str) -> Column:
    return F.get_json_object("details", f"$.{path}")


def op_typed(operations: DataFrame) -> DataFrame:
    """Destination, contract, asset and pools of each operation from its details (JSON), by type."""
    kind = F.col("type")
    destination = F.when(kind.isin(0, 1, 2, 8, 13), detail("destination")).when(kind.isin(7, 21), detail("trustor")).when(kind == 19, detail("from")).when(kind == 16, detail("sponsoredId"))
    contract = F.when(kind.isin(*CONTRACT_OPS), detail("contractId"))
    asset = F.when(kind.isin(1, 14, 19, 21), detail("asset")).when(kind.isin(2, 13), detail("destAsset")).when(kind.isin(3, 4, 12), detail("selling")).when(kind == 6, detail("line"))
    single = F.when(kind.isin(22, 23), F.array(detail("poolId")))
    claimed = F.from_json(detail("claimedAtoms"), "array<struct<poolId: string>>")
    pools = F.coalesce(single, F.when(kind.isin(2, 3, 4, 12, 13), F.transform(claimed, lambda a: a.poolId)))
    parts = F.split("asset_text", ":", 2)
    credit = F.col("asset_text").contains(":")
    return (
        operations.withColumn("asset_text", asset)
        .withColumns(
            {
                "destination": destination,
                "contract": contract,
                "asset_code": F.when(credit, F.get(parts, 0)),
                "asset_issuer": F.when(credit, F.get(parts, 1)),
                "pool_ids": F.array_sort(F.array_distinct(F.array_compact(F.coalesce(pools, F.array().cast("array<string>"))))),
            }
        )
        .drop("asset_text")
    )


def operations_fold(operations: DataFrame, identity: list[str], pools: str = "pool_ids") -> DataFrame:
    """Equal operations of a transaction in one row: how many, and the first place. Pool lists count as sets; nulls are equal."""
    rows = operations.withColumn(pools, F.array_sort(F.array_distinct(pools)))
    return rows.groupBy("transaction_id", *identity, pools).agg(F.count(F.lit(1)).alias("amount"), F.min("application_order").alias("application_order"))


def asset_presence(ops: DataFrame, token_events: DataFrame, net: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each asset and transaction: what was settled; 0 where an operation moved nothing, null where only events tell.

    partitions: of what is grouped and joined, both sides laid out once by asset and transaction; else the session's.
    """
    by_op = ops.select("asset_id", "ledger_sequence", "transaction_id", F.lit(0).cast(AMOUNT).alias("none"))
    by_event = token_events.select("asset_id", "ledger_sequence", "transaction_id", F.lit(None).cast(AMOUNT).alias("none"))
    both, settled, key = by_op.unionByName(by_event), net.withColumn("known", F.lit(True)), ["asset_id", "transaction_id"]
    if partitions is not None:
        both, settled = both.repartition(partitions, *key), settled.repartition(partitions, *key)
    seen = both.groupBy("asset_id", "ledger_sequence", "transaction_id").agg(F.max("none").alias("none"))
    joined = seen.join(settled, key, "left")
    return joined.select("asset_id", "ledger_sequence", "transaction_id", F.when(F.col("known"), F.col("net_settled")).otherwise(F.col("none")).alias("net_settled"))


def pool_presence(operations: DataFrame) -> DataFrame:
    return operations.select(F.explode("pool_ids").alias("pool_id"), "ledger_sequence", "transaction_id").distinct()


def lp_operation_amounts(atoms: DataFrame, deltas: DataFrame) -> DataFrame:
    """Amounts of each operation, pool and asset from the pool's side; legs that sum to 0 have no row.

    atoms: bought (+) and sold (-) assets and amounts; deltas: before and after of both legs of deposits and withdrawals.
    """
    legs = atoms.select(*OF_POOL, F.inline(F.array(*legs_of_atom(F.col("asset_bought"), F.col("amount_bought"), F.col("asset_sold"), F.col("amount_sold")))))
    moved = deltas.select(*OF_POOL, F.inline(F.array(leg_of_delta(F.col("asset_id"), F.col("before"), F.col("after")))))
    return amounts_of_legs(legs.unionByName(moved))


def lp_amounts_of_operations(operations: DataFrame) -> DataFrame:
    """lp_operation_amounts of operations that carry their atoms and deltas (arrays of structs, null if none): what they come from is read, joined and sorted once, not once for each kind."""
    legs = F.flatten(F.transform("atoms", lambda a: F.array(*legs_of_atom(a.asset_bought, a.amount_bought, a.asset_sold, a.amount_sold))))
    moved = F.transform("deltas", lambda d: leg_of_delta(d.asset_id, d.before, d.after))
    return amounts_of_legs(operations.select(*OF_POOL, F.inline(F.flatten(F.array_compact(F.array(legs, moved))))))


OF_POOL = ["transaction_id", "application_order", "ledger_sequence", "pool_id"]


def legs_of_atom(bought: Column, amount_bought: Column, sold: Column, amount_sold: Column) -> list[Column]:
    return [F.struct(asset.alias("asset_id"), amount.cast(AMOUNT).alias("amount")) for asset, amount in ((bought, amount_bought), (sold, -amount_sold))]


def leg_of_delta(asset: Column, before: Column, after: Column) -> Column:
    return F.struct(asset.alias("asset_id"), (after - before).cast(AMOUNT).alias("amount"))


def amounts_of_legs(legs: DataFrame) -> DataFrame:
    return legs.groupBy(*OF_POOL, "asset_id").agg(F.try_sum("amount").cast("bigint").alias("amount")).where("amount <> 0")


def gross_volume_a(atoms: DataFrame, pools: DataFrame) -> DataFrame:
    """Amount of the first asset that trades moved, either way, for each pool and ledger."""
    own = atoms.join(pools.select("pool_id", "asset_a"), "pool_id")
    moved = F.when(F.col("asset_bought") == F.col("asset_a"), F.col("amount_bought")).when(F.col("asset_sold") == F.col("asset_a"), F.col("amount_sold"))
    return own.groupBy("pool_id", "ledger_sequence").agg(F.sum(moved).alias("gross_volume_a"))


# --- pools ---


def pool_definitions(changes: DataFrame) -> DataFrame:
    """The latest definition of each pool, its legs (JSON) split into type, code and issuer."""
    rows = latest_by_version(changes.select("pool_id", "ledger_sequence", "asset_a", "asset_b", "fee_bps"), ["pool_id"], "ledger_sequence")
    for side in "ab":
        leg = F.from_json(f"asset_{side}", "struct<type: string, code: string, issuer: string>")
        kind = F.when(leg.type == "native", 0).when(leg.type == "credit_alphanum4", 1).otherwise(2)
        rows = rows.withColumns({f"asset_{side}_type": kind, f"asset_{side}_code": F.coalesce(leg.code, F.lit("")), f"asset_{side}_issuer": F.coalesce(leg.issuer, F.lit(""))})
    return rows.drop("asset_a", "asset_b")


def final_pool_snapshot(images: DataFrame) -> DataFrame:
    """The last image of each pool and ledger, in order of application."""
    return latest_by_version(images, ["pool_id", "ledger_sequence"], "order")


def lp_positions(changes: DataFrame) -> DataFrame:
    """From share trustlines: the latest shares (0 if removed), and the first ledger of a creation."""
    shares = F.when(F.col("change_type") == "removed", 0).otherwise(F.col("shares"))
    first = F.when(F.col("change_type") == "created", F.col("ledger_sequence"))
    last = F.max(F.struct("ledger_sequence", "order", shares.alias("shares")))
    rows = changes.groupBy("pool_id", "account_id").agg(last.alias("last"), F.min(first).alias("first_deposit_ledger"))
    return rows.select("pool_id", "account_id", F.col("last.shares").alias("shares"), "first_deposit_ledger", F.col("last.ledger_sequence").alias("last_updated_ledger"))


# --- balances ---


def balance_deltas(changes: DataFrame) -> DataFrame:
    """Last balance less first, of each transaction, holder and asset over its ordered changes; 0 is dropped.

    A creation starts at 0 (before is null), a removal ends at 0 (after is null).
    """
    ends = changes.groupBy("transaction_id", "holder_id", "asset_id").agg(
        F.min(F.struct("change_index", F.coalesce("before", F.lit(0)).cast(AMOUNT).alias("value"))).alias("first"), F.max(F.struct("change_index", F.coalesce("after", F.lit(0)).cast(AMOUNT).alias("value"))).alias("last")
    )
    delta = F.try_subtract("last.value", "first.value").cast(AMOUNT)
    return ends.select("transaction_id", "holder_id", "asset_id", delta.alias("delta")).where("delta is null or delta <> 0")


def net_settled(deltas: DataFrame) -> DataFrame:
    """What changed hands in each transaction and asset: the larger of all gains and all losses of accounts. Overflow: null.

    A null delta, or a sum beyond the range, makes that transaction and asset null and no other.
    """
    accounts = deltas.groupBy("transaction_id", "asset_id", "holder_id").agg(F.try_sum("delta").alias("net"), F.bool_or(F.col("delta").isNull()).alias("lost"))
    gains, losses = F.try_sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0)), F.try_sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0))
    broken = F.bool_or(F.col("lost") | F.col("net").isNull())
    whole = F.when(broken | gains.isNull() | losses.isNull(), None).otherwise(F.greatest(gains, losses)).cast(AMOUNT)
    return accounts.groupBy("transaction_id", "asset_id").agg(whole.alias("net_settled"))


def balances_classic(states: DataFrame) -> DataFrame:
    """The latest amount of each holder and asset; a removed trustline is 0. states: account_id, ledger, order, lines (asset_id, amount), removed (asset ids)."""
    held = states.select("account_id", "last_seen_ledger", "order", F.explode("lines").alias("line")).select("account_id", "last_seen_ledger", "order", "line.asset_id", "line.amount")
    gone = states.select("account_id", "last_seen_ledger", "order", F.explode("removed").alias("asset_id"), F.lit(0).cast("bigint").alias("amount"))
    return latest_by_version(held.unionByName(gone), ["account_id", "asset_id"], "last_seen_ledger", ["order"]).drop("order")


def balances_contract(entries: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Balances in contract storage (JSON: a number, or a map with amount), kept under the wrapped asset where the contract is a wrapper."""
    amount = F.coalesce(F.get_json_object("data", "$.amount"), F.when(~F.col("data").startswith("{"), F.col("data"))).try_cast(AMOUNT)
    rows = entries.select("contract_id", "holder", amount.alias("amount"), "ledger_sequence").where("amount is not null")
    joined = rows.join(wrappers.select("contract_id", "asset_id"), "contract_id", "left")
    return latest_by_version(joined.select("holder", F.coalesce("asset_id", "contract_id").alias("asset_id"), "amount", "ledger_sequence"), ["holder", "asset_id"], "ledger_sequence")


def account_states(changes: DataFrame) -> DataFrame:
    """One state for each transaction and account from entry changes (JSON data) in order.

    Native balance, sequence and home domain of the last account image (removed: balance 0); trustlines by the last write of
    each asset, so that a line made anew cancels its removal; without an account image the sequence is -1. Read-only images
    (state) and pool shares are left out.
    """
    rows = changes.where("change_type <> 'state'")
    key = ["transaction_hash", "account_id", "ledger_sequence"]
    acc = rows.where("entry_type = 'account'").withColumn("account_id", F.get_json_object("key", "$.account_id"))
    gone = F.col("change_type") == "removed"
    image = F.struct(
        "change_index",
        F.when(gone, "0").otherwise(F.get_json_object("data", "$.balance")).cast("bigint").alias("balance"),
        F.when(~gone, F.get_json_object("data", "$.sequence").cast("bigint")).alias("sequence"),
        F.when(~gone, F.get_json_object("data", "$.home_domain")).alias("home_domain"),
    )
    acc = acc.groupBy(*key).agg(F.max(image).alias("image"), F.min(F.when(F.col("change_type") == "created", F.col("ledger_sequence"))).alias("first_seen_ledger"))
    lines = rows.where("entry_type = 'trustline'").withColumns({"account_id": F.get_json_object("key", "$.account_id"), "asset": F.get_json_object("key", "$.asset"), "pool": F.get_json_object("key", "$.pool_id")}).where("pool is null and asset is not null")
    last = lines.groupBy(*key, "asset").agg(F.max(F.struct("change_index", gone.alias("gone"), F.get_json_object("data", "$.balance").cast("bigint").alias("balance"))).alias("last"))
    lines = last.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(~F.col("last.gone"), F.struct("asset", F.col("last.balance").alias("balance"))))).alias("lines"), F.array_sort(F.collect_list(F.when(F.col("last.gone"), F.col("asset")))).alias("removed")
    )
    both = acc.join(lines, key, "full_outer")
    return both.select(*key, F.col("image.balance").alias("native_balance"), F.coalesce("image.sequence", F.lit(-1)).alias("sequence_number"), F.col("image.home_domain").alias("home_domain"), "first_seen_ledger", "lines", "removed")


# --- assets of operations, and who takes part ---


def asset_text(path: str) -> Column:
    return detail(path)


def op_assets(operations: DataFrame) -> DataFrame:
    """Assets that an operation touches, in order, by its type and details (JSON); assets of pools and claims come from its own changes."""
    kind = F.col("type")
    route = F.from_json(detail("path"), "array<string>")
    none = F.array().cast("array<string>")
    found = (
        F.when(kind.isin(1, 14, 19, 21), F.array(detail("asset")))
        .when(kind.isin(2, 13), F.concat(F.array(detail("sendAsset")), F.coalesce(route, none), F.array(detail("destAsset"))))
        .when(kind.isin(3, 4, 12), F.array(detail("selling"), detail("buying")))
        .when(kind == 6, F.when(detail("assetA").isNotNull(), F.array(detail("assetA"), detail("assetB"))).otherwise(F.array(detail("line"))))
        .when(kind == 7, F.array(F.concat_ws(":", detail("assetCode"), F.col("source_account"))))
        .when(kind.isin(0, 8), F.array(F.lit("native")))
        .when(kind == 18, F.array(detail("trustlineAsset")))
        .when(kind.isin(15, 20), F.array(detail("claimedAsset")))
        .when(kind.isin(22, 23), F.array(detail("poolAssetA"), detail("poolAssetB")))
        .otherwise(none)
    )
    return operations.select("transaction_id", "application_order", F.posexplode(F.array_compact(found)).alias("place", "asset"))


def counterparties() -> Column:
    """Accounts that an operation (type, details) involves besides its source: targets by type, all claimants, and sellers of claimed order-book atoms."""
    kind = F.col("type")
    none = F.array().cast("array<string>")
    own = (
        F.when(kind.isin(0, 1, 2, 8, 13), F.array(detail("destination")))
        .when(kind == 19, F.array(detail("from")))
        .when(kind.isin(7, 21), F.array(detail("trustor")))
        .when(kind == 16, F.array(detail("sponsoredId")))
        .when(kind == 5, F.array(detail("inflationDest")))
        .when(kind == 18, F.array(detail("owner")))
        .when(kind == 14, F.from_json(detail("claimants"), "array<string>"))
        .otherwise(none)
    )
    sellers = F.transform(F.from_json(detail("claimedAtoms"), "array<struct<seller: string>>"), lambda a: a.seller)
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(own, none), F.coalesce(sellers, none))))


def op_counterparties(operations: DataFrame) -> DataFrame:
    return operations.select("transaction_id", "application_order", F.explode(counterparties()).alias("account"))


def participant_rows(transactions: DataFrame, operations: DataFrame, events: DataFrame, invocations: DataFrame) -> DataFrame:
    """Distinct (account, ledger, transaction) of decoded records, over all roles.

    A transaction's source and fee payer, an operation's source and all its counterparties (claimants and sellers of claimed atoms too), callers, and
    both ends of token events, these only in transactions with a contract operation and without the copies kept for diagnosis. Only account keys
    count (a contract that calls is none); issuers of assets take no part. transactions: transaction_id, ledger_sequence, source_account, fee_source; operations:
    type, source_account, details; invocations: caller_account.
    """
    from orrery.operators.contracts import token_events

    key = ["ledger_sequence", "transaction_id"]
    own = operations.where(F.col("type").isin(*CONTRACT_OPS)).select("transaction_id")
    ends = token_events(events, own)
    roles = [
        transactions.select(*key, F.array("source_account", "fee_source").alias("roles")),
        operations.select(*key, F.concat(F.array("source_account"), counterparties()).alias("roles")),
        ends.select(*key, F.array("from", "to").alias("roles")),
        invocations.select(*key, F.array("caller_account").alias("roles")),
    ]
    both = roles[0]
    for df in roles[1:]:
        both = both.unionByName(df)
    rows = both.select(F.explode(F.array_distinct("roles")).alias("account"), *key)
    return rows.where(is_account("account")).distinct()




def asset_registry(trustlines: DataFrame, wrappers: DataFrame, fungible: DataFrame) -> DataFrame:
    """Distinct assets: the native one, credits of trustlines (removed ones too, no pool shares), wrappers folded onto theirs, fungible contracts.

    trustlines: asset_code, issuer_id, pool_id; wrappers: contract_id, asset_code ('' native), issuer_id; fungible: contract_id.
    """
    null = F.lit(None).cast("bigint")
    native = wrappers.sparkSession.range(1).select(F.lit(NATIVE).alias("asset_type"), F.lit("").alias("asset_code"), null.alias("issuer_id"), null.alias("contract_id"))
    credit = trustlines.where("pool_id is null").select(F.lit(CREDIT).alias("asset_type"), "asset_code", "issuer_id", null.alias("contract_id"))
    wrapped = wrappers.where("asset_code <> ''").select(F.lit(CREDIT).alias("asset_type"), "asset_code", "issuer_id", null.alias("contract_id"))
    tokens = fungible.join(wrappers, "contract_id", "left_anti").select(F.lit(TOKEN).alias("asset_type"), F.lit("").alias("asset_code"), null.alias("issuer_id"), "contract_id")
    rows = native.unionByName(credit).unionByName(wrapped).unionByName(tokens)
    return dedup_by_key(rows, ["asset_type", "asset_code", "issuer_id", "contract_id"])


def wrapper_facets(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wrapper contract and deployed flag of each asset (a deployment is sticky), and the map of deployed wrappers to assets."""
    facets = merge_facets(seen.select("asset_id", "contract_id", F.col("deployed").cast("int").alias("deployed")), ["asset_id"])
    return facets, facets.where("deployed = 1 and contract_id is not null").select("contract_id", "asset_id")
