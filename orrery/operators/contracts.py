"""Folds of contract records: token events, invocations, code, deployments, tokens and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.exprs import CONTRACT_FUNGIBLE, CONTRACT_NFT, CONTRACT_OTHER, CONTRACT_TOKEN
from orrery.functions.versioned import latest_by_version

# Function names that tell what a contract is.
NFT_FUNCTIONS = ("owner_of", "token_uri", "approve_for_all", "get_approved", "is_approved_for_all")
FUNGIBLE_FUNCTIONS = ("decimals", "allowance", "total_supply")
#: Token ids that one range may mint, and the highest ordinal of an ownership event.
MAX_RANGE, MAX_ORDER = 65_535, 32_767
TOPICS = "array<struct<type: string, value: string>>"


def topics_of(column: str = "topics") -> Column:
    return F.from_json(column, TOPICS)


def typed(topic: Column, kind: str) -> Column:
    return F.when(topic.type == kind, topic.value)


def consensus_events(events: DataFrame) -> DataFrame:
    """Events of contracts, without the copies kept for diagnosis."""
    return events.where("contract_id is not null and event_type <> 'diagnostic' and source <> 'diagnostic'")


def event_rows(events: DataFrame) -> DataFrame:
    """signature: the first topic, if it is a symbol."""
    return consensus_events(events).withColumn("signature", typed(F.get(topics_of(), 0), "sym"))


def token_events(events: DataFrame, contract_transactions: DataFrame | None = None) -> DataFrame:
    """transfer, mint, burn and clawback events (any case) with from, to and asset: native, CODE:ISSUER or the contract itself.

    An event that lacks an address where its kind has one is none. contract_transactions: transaction_id, if only those count.
    """
    rows = consensus_events(events)
    if contract_transactions is not None:
        rows = rows.join(contract_transactions.select("transaction_id").distinct(), "transaction_id", "left_semi")
    rows = rows.withColumn("t", topics_of()).withColumn("kind", F.lower(typed(F.get("t", 0), "sym")))
    one, two = typed(F.get("t", 1), "address"), typed(F.get("t", 2), "address")
    moved = F.col("kind") == "transfer"
    text = typed(F.when(moved, F.get("t", 3)).otherwise(F.get("t", 2)), "string")
    asset = F.when(text == "native", text).when(text.rlike("^[^:]+:.+$"), text).otherwise(F.concat(F.lit("contract:"), F.col("contract_id").cast("string")))
    rows = rows.where(F.col("kind").isin("transfer", "mint", "burn", "clawback") & one.isNotNull() & (~moved | two.isNotNull()))
    return rows.select("transaction_id", "event_index", "ledger_sequence", "contract_id", "kind", F.when(F.col("kind") != "mint", one).alias("from"), F.when(moved, two).when(F.col("kind") == "mint", one).alias("to"), asset.alias("asset"))


def invocation_fold(invocations: DataFrame) -> DataFrame:
    """Calls of each contract and transaction, and the first known caller: an account (G…) or a contract (C…)."""
    first = F.min(F.when(F.col("caller").isNotNull(), F.struct("invocation_index", "caller")))
    rows = invocations.where("contract_id is not null").groupBy("contract_id", "transaction_id").agg(F.count(F.lit(1)).alias("amount"), F.max("ledger_sequence").alias("ledger_sequence"), first.caller.alias("caller"))
    return rows.select("contract_id", "transaction_id", "ledger_sequence", "amount", F.when(F.col("caller").startswith("G"), F.col("caller")).alias("caller_account"), F.when(F.col("caller").startswith("C"), F.col("caller")).alias("caller_contract"))


def classify_contracts(code: DataFrame, functions: str = "functions") -> DataFrame:
    names = F.col(functions)
    kind = (
        F.when(F.arrays_overlap(names, F.array(*map(F.lit, NFT_FUNCTIONS))), CONTRACT_NFT).when(F.arrays_overlap(names, F.array(*map(F.lit, FUNGIBLE_FUNCTIONS))), CONTRACT_FUNGIBLE).otherwise(CONTRACT_OTHER)
    )
    return code.withColumn("verdict", kind)


def contract_rows(deployments: DataFrame, batch_code: DataFrame, known_code: DataFrame) -> DataFrame:
    """The first deployment of each contract with a verdict: by code of this batch, else by earlier code; wrappers are tokens whatever their code.

    deployments: contract_id, code_hash, deployer_id, ledger_sequence, order, is_wrapper; code: code_hash, verdict.
    """
    first = deployments.groupBy("contract_id").agg(F.min(F.struct("ledger_sequence", "order", "code_hash", "deployer_id", "is_wrapper")).alias("d")).select("contract_id", "d.*")
    joined = first.join(batch_code.select("code_hash", F.col("verdict").alias("now")), "code_hash", "left").join(known_code.select("code_hash", F.col("verdict").alias("before")), "code_hash", "left")
    kind = F.when(F.col("is_wrapper"), CONTRACT_TOKEN).otherwise(F.coalesce("now", "before", F.lit(CONTRACT_OTHER)))
    return joined.select("contract_id", "code_hash", "deployer_id", F.col("ledger_sequence").alias("deployed_at_ledger"), kind.alias("contract_type"))


def contract_stubs(references: list[DataFrame], deployed: DataFrame) -> DataFrame:
    """Contracts that are named somewhere but not deployed here, as rows of version 0."""
    both = references[0].select("contract_id")
    for df in references[1:]:
        both = both.union(df.select("contract_id"))
    return both.where("contract_id is not null").distinct().join(deployed.select("contract_id"), "contract_id", "left_anti").withColumn("version", F.lit(0))


def code_upgrades(contracts: DataFrame, events: DataFrame) -> DataFrame:
    """Versions of contracts: an executable_update of the system (topics: symbol, old, new hash) gives a row with the new code and the old identity.

    contracts: contract_id, code_hash, version and more. Contracts that aren't known are left out. The latest version of each is returned.
    """
    t = topics_of()
    updates = events.where("event_type = 'system' and contract_id is not null").select("contract_id", "ledger_sequence", "event_index", typed(F.get(t, 0), "sym").alias("verb"), F.get(t, 2).value.alias("new_hash"))
    updates = updates.where("verb = 'executable_update' and new_hash is not null")
    last = updates.groupBy("contract_id", "ledger_sequence").agg(F.max(F.struct("event_index", "new_hash")).new_hash.alias("new_hash"))
    prior = latest_by_version(contracts, ["contract_id"], "version")
    new = prior.join(last, "contract_id").withColumns({"code_hash": F.col("new_hash"), "version": F.col("ledger_sequence")}).select(*contracts.columns)
    return latest_by_version(contracts.unionByName(new), ["contract_id"], "version")


def contract_metadata(versions: DataFrame) -> DataFrame:
    """Latest name, symbol and decimals of each contract."""
    return latest_by_version(versions.select("contract_id", "name", "symbol", "decimals", "ledger_sequence"), ["contract_id"], "ledger_sequence")


# --- tokens ---


def nft_events(events: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """Mint, transfer and burn of tokens in three shapes: addresses as topics and a single value, all packed in a vector, or a map with token_id.

    data: JSON {type, value}; void, map without token_id, vector and error values are no token id. Diagnostic copies and events of wrappers are left out.
    """
    rows = consensus_events(events).where("event_type = 'contract'")
    if wrappers is not None:
        rows = rows.join(wrappers.select("contract_id"), "contract_id", "left_anti")
    rows = rows.withColumns({"t": topics_of(), "data_type": F.get_json_object("data", "$.type")})
    rows = rows.withColumn("kind", F.lower(typed(F.get("t", 0), "sym"))).where(F.col("kind").isin("transfer", "mint", "burn"))
    n = F.when(F.col("kind") == "transfer", 2).otherwise(1)
    one, two = typed(F.get("t", 1), "address"), typed(F.get("t", 2), "address")
    vector = F.when(F.col("data_type") == "vec", F.from_json(F.get_json_object("data", "$.value"), TOPICS))
    mapped = F.when(F.col("data_type") == "map", F.get_json_object("data", "$.value.token_id.value"))
    single = F.when(~F.col("data_type").isin("void", "map", "vec", "error"), F.get_json_object("data", "$.value"))
    in_topics = one.isNotNull() & ((n == 1) | two.isNotNull())
    v1, v2 = typed(F.get(vector, 0), "address"), typed(F.get(vector, 1), "address")
    packed = vector.isNotNull() & (F.size(vector) == n + 1) & v1.isNotNull() & ((n == 1) | v2.isNotNull())
    first = F.when(in_topics, one).when(packed, v1)
    second = F.when(in_topics, two).when(packed, v2)
    token = F.when(in_topics, F.coalesce(single, mapped)).when(packed, F.get(vector, n).value)
    found = rows.withColumns({"first": first, "second": second, "token_id": token}).where("token_id is not null and first is not null")
    return found.select("transaction_id", "contract_id", "ledger_sequence", "event_index", "kind", "token_id", F.when(F.col("kind") != "mint", F.col("first")).alias("from"), F.when(F.col("kind") == "transfer", F.col("second")).when(F.col("kind") == "mint", F.col("first")).alias("to"))


def consecutive_mints(events: DataFrame) -> DataFrame:
    """consecutive_mint: a mint for each id of an inclusive range (map or vector of unsigned values); inverted and huge ranges are dropped."""
    rows = consensus_events(events).where("event_type = 'contract'").withColumns({"t": topics_of(), "data_type": F.get_json_object("data", "$.type")})
    to = typed(F.get("t", 1), "address")
    vector = F.when(F.col("data_type") == "vec", F.from_json(F.get_json_object("data", "$.value"), TOPICS))

    def bound(place: int, name: str) -> Column:
        item = F.get(vector, place)
        in_map = F.when((F.col("data_type") == "map") & F.get_json_object("data", f"$.value.{name}.type").isin("u32", "u64"), F.get_json_object("data", f"$.value.{name}.value"))
        return F.coalesce(F.when(item.type.isin("u32", "u64"), item.value), in_map).try_cast("bigint")

    rows = rows.where(F.lower(typed(F.get("t", 0), "sym")) == "consecutive_mint").select("transaction_id", "contract_id", "ledger_sequence", "event_index", to.alias("to"), bound(0, "from_token_id").alias("lo"), bound(1, "to_token_id").alias("hi"))
    rows = rows.where(f"to is not null and lo is not null and hi >= lo and hi - lo < {MAX_RANGE}")
    return rows.select("transaction_id", "contract_id", "ledger_sequence", "event_index", "to", F.explode(F.transform(F.sequence("lo", "hi"), lambda i: i.cast("string"))).alias("token_id"))


def nft_state(events: DataFrame) -> DataFrame:
    """Latest owner (null after a burn), first mint ledger and last ledger of each token. events: owner_id, event_type (0 mint, 1 transfer, 2 burn)."""
    owner = F.when(F.col("event_type") != 2, F.col("owner_id"))
    last = F.max(F.struct("ledger_sequence", "event_order", owner.alias("owner_id")))
    rows = events.groupBy("contract_id", "token_id").agg(last.alias("last"), F.min(F.when(F.col("event_type") == 0, F.col("ledger_sequence"))).alias("minted_at_ledger"))
    return rows.select("contract_id", "token_id", F.col("last.owner_id").alias("owner_id"), "minted_at_ledger", F.col("last.ledger_sequence").alias("last_seen_ledger"))


def nft_ownership(events: DataFrame) -> DataFrame:
    """Ordinal from 0 of each event among those of its token and ledger, in event order; ordinals past the cap of the format are dropped."""
    order = F.row_number().over(Window.partitionBy("contract_id", "token_id", "ledger_sequence").orderBy("transaction_id", "event_index")) - 1
    return events.withColumn("event_order", order.cast("bigint")).where(F.col("event_order") <= MAX_ORDER)


def route_by_verdict(rows: DataFrame, batch: DataFrame, history: DataFrame) -> DataFrame:
    """route: hot for tokens of NFT contracts, dropped for tokens and fungibles, pending for all else; this batch's verdict goes before history's."""
    joined = rows.join(batch.select("contract_id", F.col("verdict").alias("now")), "contract_id", "left").join(history.select("contract_id", F.col("verdict").alias("before")), "contract_id", "left")
    verdict = F.coalesce("now", "before")
    route = F.when(verdict == CONTRACT_NFT, "hot").when(verdict.isin(CONTRACT_TOKEN, CONTRACT_FUNGIBLE), "dropped").otherwise("pending")
    return joined.withColumn("route", route).drop("now", "before")


# --- calls ---


def call_trace(trace: DataFrame, auth: DataFrame) -> DataFrame:
    """Call and return events of a transaction as rows with depth and caller.

    A return on an empty stack does nothing. caller: the contract of the last open call around; of an outermost call the transaction's source.
    Transactions without a trace take their rows from the authorisation tree (auth: as the result). trace: transaction_id, event_index, what
    (call, return), contract_id, source.
    """
    w = Window.partitionBy("transaction_id").orderBy("event_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("what") == "call", 1).otherwise(-1)
    run = trace.withColumn("run", F.sum(step).over(w))
    # What a counter that never goes under 0 would show: the running sum less its least value so far.
    run = run.withColumn("after", F.col("run") - F.least(F.lit(0), F.min("run").over(w)))
    depth = F.when(F.col("what") == "call", F.col("after") - 1).otherwise(F.col("after")).cast("int")
    run = run.withColumn("depth", depth)
    calls = run.where("what = 'call'")
    # The caller is the last call of one depth less before this one: calls of each depth carry on, level by level of the parent's depth.
    parents = calls.select("transaction_id", "event_index", (F.col("depth") + 1).alias("level"), F.col("contract_id").alias("parent"), F.lit(0).alias("own"))
    both = parents.unionByName(calls.select("transaction_id", "event_index", F.col("depth").alias("level"), "contract_id", "source", F.lit(1).alias("own")), allowMissingColumns=True)
    up = Window.partitionBy("transaction_id", "level").orderBy("event_index", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("caller", F.last("parent", ignorenulls=True).over(up)).where("own = 1")
    traced = both.select("transaction_id", F.col("event_index").alias("invocation_index"), "contract_id", F.col("level").alias("depth"), F.when(F.col("level") == 0, F.col("source")).otherwise(F.col("caller")).alias("caller"))
    return traced.unionByName(auth.join(trace.select("transaction_id").distinct(), "transaction_id", "left_anti"))


def deployer_override(deployments: DataFrame, signers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Deployer: the signer known for the contract in that transaction, else the transaction's source."""
    s = signers.groupBy("transaction_id", "contract_id").agg(F.min("signer").alias("signer"))
    tx = transactions.select(F.col("id").alias("transaction_id"), "source_id")
    joined = deployments.join(s, ["transaction_id", "contract_id"], "left").join(tx, "transaction_id", "left")
    return joined.select(*deployments.columns, F.coalesce("signer", "source_id").alias("deployer_id"))


def new_keys_to_enrich(candidates: DataFrame, enrichment: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys without any row of enrichment: those never tried."""
    return candidates.select(*key).distinct().join(enrichment.select(*key), key, "left_anti")
