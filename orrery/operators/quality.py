"""Invariants of tables: each check gives (table, check, violations, sample).

The rules over a table's rows are decided in one scan: a row gives a line for each rule that it breaks, and one for each key that must be
unique; rows of other tables that must exist are joined on once, as a mark. Lines are counted by rule and key, each task keeps
the count and the ten smallest keys of every rule, and these few are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 10
# Shapes of hashes and keys.
HASH = "^[0-9a-f]{64}$"
CONTRACT_KEY, ACCOUNT_KEY = "^C[A-Z2-7]{55}$", "^(G[A-Z2-7]{55}|M[A-Z2-7]{68})$"


class Rules:
    """Rules over the rows of one frame."""

    def __init__(self, df: DataFrame, table: str):
        self.df, self.table, self.checks, self._lines, self._joined = df, table, [], [], 0

    def _line(self, check: str, said: Column, key: Column, whole: Column | None = None) -> Rules:
        """whole: what makes the key one that must be unique; without it the row breaks the rule where `said` holds."""
        self.checks.append(check)
        own = F.lit(None).cast("string") if whole is None else whole
        self._lines.append((said, own.alias("whole"), key.cast("string").alias("key")))
        return self

    def broken(self, check: str, said: Column, key: Column) -> Rules:
        """Rows for which `said` holds break the rule."""
        return self._line(check, said, key)

    def rule(self, check: str, holds: Column, key: Column, where: Column | None = None) -> Rules:
        """Rows (of those in `where`) for which `holds` is false or unknown."""
        wrong = ~F.coalesce(holds, F.lit(False))
        return self._line(check, wrong if where is None else where & wrong, key)

    def unique(self, check: str, key: list[str], where: Column | None = None) -> Rules:
        """Keys of several rows, each once."""
        texts = [F.col(k).cast("string") for k in key]
        lengths = F.concat_ws(":", *[F.coalesce(F.length(t), F.lit(-1)).cast("string") for t in texts])  # with them the joined text can be taken apart in one way only
        return self._line(check, F.lit(True) if where is None else where, F.concat_ws(":", *texts), lengths)

    def known(self, column: str, dim: DataFrame, dim_key: str, sparse: str | None = None) -> Column:
        """Whether a value has a row in dim. sparse: many rows have no value, and are dealt out by this column, as a join would bring all of them to one task."""
        self._joined += 1
        at, mark, deal = f"dim_{self._joined}_", f"known_{self._joined}_", f"deal_{self._joined}_"
        side = dim.select(F.col(dim_key).alias(at)).distinct().withColumn(mark, F.lit(True))
        same = F.col(column) == F.col(at)
        if sparse is not None:
            self.df = self.df.withColumn(deal, F.when(F.col(column).isNull(), F.xxhash64(sparse)).otherwise(F.xxhash64(column)))
            side = side.withColumn(f"{deal}of_", F.xxhash64(at))  # no constant, which would fall out of the join's keys
            same = same & (F.col(deal) == F.col(f"{deal}of_"))
        self.df = self.df.join(side, same, "left")
        return F.col(mark).isNotNull()

    def foreign_key(self, check: str, column: str, dim: DataFrame, dim_key: str, key: str | Column, where: Column | None = None, sparse: str | None = None) -> Rules:
        """Values that are not null and have no row in dim."""
        wrong = F.col(column).isNotNull() & ~self.known(column, dim, dim_key, sparse)
        return self._line(check, wrong if where is None else where & wrong, F.col(key) if isinstance(key, str) else key)

    def lines(self, first: int) -> DataFrame:
        """A line of each rule that a row breaks or may break, with the rule's number, from `first`."""
        each = [F.when(said, F.struct(F.lit(first + i).alias("rule"), whole, key)) for i, (said, whole, key) in enumerate(self._lines)]
        return self.df.select(F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each rule the count, and the ten smallest keys (a key as often as it breaks the rule)."""
    held: dict[int, tuple[int, list[str]]] = {}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        for rule in pc.unique(rows["rule"]).to_pylist():
            own = rows.filter(pc.equal(rows["rule"], rule))
            first = own.filter(pc.is_valid(own["key"]))
            first = first.take(pc.select_k_unstable(first, k=SAMPLE, sort_keys=[("key", "ascending")]))
            keys = [k for k, n in zip(first["key"].to_pylist(), first["n"].to_pylist(), strict=True) for _ in range(min(n, SAMPLE))]
            n, before = held.get(rule, (0, []))
            held[rule] = n + pc.sum(own["n"]).as_py(), sorted(before + keys)[:SAMPLE]
    for rule, (n, keys) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([rule], pa.int32()), pa.array([n], pa.int64()), pa.array([keys], pa.list_(pa.string()))], names=["rule", "n", "keys"])


def stacked(rules: list[Rules], partitions: int | None = None) -> DataFrame:
    """A row for each rule: table, check, violations, sample (the ten smallest keys of rows that break it).

    partitions: of the lines, where most are of keys that must be unique: a partial step would hold as many; else the session's.
    """
    named = [(r.table, c) for r in rules for c in r.checks]
    lines, first = None, 0
    for r in rules:
        own, first = r.lines(first), first + len(r.checks)
        lines = own if lines is None else lines.unionByName(own)
    if partitions is not None:
        lines = lines.repartition(partitions, "rule", "whole", "key")
    counted = lines.groupBy("rule", "whole", "key").agg(F.count(F.lit(1)).alias("n"))
    wrong = counted.where("whole is null or n > 1").select("rule", "key", F.when(F.col("whole").isNull(), F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("n"))
    parts = wrong.mapInArrow(_smallest, "rule int, n bigint, keys array<string>")  # a few rows a task
    sample = F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, SAMPLE), ",")
    found = parts.groupBy("rule").agg(F.sum("n").alias("violations"), sample.alias("sample"))
    names = lines.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(named)], "rule int, table string, check string")
    joined = names.join(found, "rule", "left")
    return joined.select("table", "check", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("sample", F.lit("")).alias("sample"))


def report(bad: DataFrame, table: str, check: str, key: Column) -> Rules:
    """bad: rows that break the rule."""
    return Rules(bad, table).broken(check, F.lit(True), key)


def unique(df: DataFrame, table: str, check: str, key: list[str]) -> Rules:
    return Rules(df, table).unique(check, key)


def rule(df: DataFrame, table: str, check: str, holds: Column, key: Column) -> Rules:
    return Rules(df, table).rule(check, holds, key)


def increasing(df: DataFrame, table: str, check: str, order: str, value: str, by: list[str], strict: bool = True) -> Rules:
    """value must grow (or not fall) along order within `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("before_", F.lag(value).over(w)).where("before_ is not null")
    return report(rows.where(F.col(value) <= F.col("before_") if strict else F.col(value) < F.col("before_")), table, check, F.col(order))


def increasing_over_buckets(df: DataFrame, table: str, check: str, order: str, value: str, bucket: Column) -> Rules:
    """value must grow along order. Windows run inside buckets; the last row of each bucket is carried to the next one that exists."""
    own = df.select(order, value, bucket.alias("b_"))
    edges = own.groupBy("b_").agg(F.max(F.struct(order, value)).alias("hi_"))
    edges = edges.select("b_", F.lag("hi_").over(Window.orderBy("b_")).alias("edge_"))  # a row for each bucket
    w = Window.partitionBy("b_").orderBy(order, value)
    rows = own.withColumn("before_", F.lag(F.struct(order, value)).over(w)).join(edges, "b_")
    return report(rows.where(F.col(value) <= F.coalesce("before_", "edge_").getField(value)), table, check, F.col(order))


def recompute(stored: DataFrame, computed: DataFrame, table: str, checks: dict[str, str], key: list[str]) -> Rules:
    """checks: rule to column. Keys of both whose stored value isn't the one computed anew."""
    columns = sorted(set(checks.values()))
    both = stored.select(*key, *columns).join(computed.select(*key, *[F.col(c).alias(f"{c}_should_") for c in columns]), key)
    rules = Rules(both, table)
    for check, column in checks.items():
        rules.broken(check, ~F.col(column).eqNullSafe(F.col(f"{column}_should_")), F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    return rules


# --- the tables ---


def check_ledgers(ledgers: DataFrame, bucket: int = 500) -> DataFrame:
    from orrery.operators.reads import ledger_neighbours

    gaps = ledger_neighbours(ledgers, bucket).where("next is not null and next <> sequence + 1")
    rows = Rules(ledgers, "ledgers").unique("sequence_unique", ["sequence"]).unique("hash_unique", ["hash"])
    rows.rule("counts_not_negative", (F.col("transaction_count") >= 0) & (F.col("base_fee") >= 0), F.col("sequence"))
    order = increasing_over_buckets(ledgers, "ledgers", "close_time_increasing", "sequence", "closed_at", F.floor(F.col("sequence") / bucket))
    return stacked([report(gaps, "ledgers", "contiguous", F.col("sequence")), rows, order])


def check_transactions(transactions: DataFrame, operations: DataFrame, ledgers: DataFrame, accounts: DataFrame) -> DataFrame:
    """operation_count is what the transaction declares; its rows of operations may be folded, so there are that many at most."""
    held = operations.groupBy(F.col("transaction_id").alias("of_")).agg(F.count(F.lit(1)).alias("held_"))
    key = F.col("id")
    rows = Rules(transactions.join(held, key == F.col("of_"), "left"), "transactions").unique("hash_unique", ["hash"])
    rows.foreign_key("ledger_exists", "ledger_sequence", ledgers, "sequence", "id").foreign_key("source_exists", "source_id", accounts, "account_id", "id")
    rows.rule("not_negative", (F.col("fee_charged") >= 0) & (F.col("operation_count") >= 0) & (F.col("application_order") >= 0), key)
    rows.rule("operations_declared", F.col("operation_count") >= F.col("held_"), key, F.col("held_").isNotNull())
    rows.rule("inner_hash_shape", F.col("inner_tx_hash").rlike(HASH), key, F.col("inner_tx_hash").isNotNull())
    return stacked([rows.broken("without_operation", F.col("held_").isNull(), key)])


def check_hash_index(index: DataFrame, transactions: DataFrame) -> DataFrame:
    rows = Rules(index, "hash_index").foreign_key("transaction_exists", "transaction_id", transactions, "id", "hash").unique("hash_unique", ["hash"])
    rows.rule("hash_shape", F.col("hash").rlike(HASH), F.col("hash"))
    own = Rules(transactions.select("hash"), "hash_index")
    return stacked([rows, own.broken("transaction_indexed", ~own.known("hash", index, "hash"), F.col("hash"))])


def check_operations(operations: DataFrame, transactions: DataFrame, accounts: DataFrame, pools: DataFrame) -> DataFrame:
    rows = Rules(operations, "operations").foreign_key("transaction_exists", "transaction_id", transactions, "id", "transaction_id")
    rows.foreign_key("source_exists", "source_id", accounts, "account_id", "transaction_id", sparse="transaction_id").foreign_key("destination_exists", "destination_id", accounts, "account_id", "destination_id")
    rows.foreign_key("pool_exists", "pool_id", pools, "pool_id", "pool_id", sparse="transaction_id").unique("place_unique", ["transaction_id", "application_order"])
    return stacked([rows.rule("folded_count", F.col("amount") >= 1, F.col("transaction_id"), F.col("amount").isNotNull())])


def check_participants(parts: DataFrame, transactions: DataFrame, accounts: DataFrame, partitions: int | None = None) -> DataFrame:
    rows = Rules(parts, "participants").foreign_key("transaction_exists", "transaction_id", transactions, "id", "transaction_id")
    rows.foreign_key("account_exists", "account_id", accounts, "account_id", "account_id")
    return stacked([rows.unique("triple_unique", ["account_id", "ledger_sequence", "transaction_id"])], partitions)


def check_contracts(contracts: DataFrame, accounts: DataFrame, code: DataFrame) -> DataFrame:
    key = F.col("contract_id")
    rows = Rules(contracts, "contracts").unique("contract_unique", ["contract_id"])
    rows.foreign_key("deployer_exists", "deployer_id", accounts, "account_id", "contract_id", sparse="contract_id").foreign_key("code_exists", "code_hash", code, "code_hash", "contract_id", sparse="contract_id")
    rows.rule("key_shape", F.col("contract_key").rlike(CONTRACT_KEY), key).rule("type_range", F.col("contract_type").between(0, 3), key)
    return stacked([rows.rule("hash_shape", F.col("code_hash").rlike(HASH), key, F.col("code_hash").isNotNull())])


def check_code(code: DataFrame) -> DataFrame:
    rows = Rules(code, "code").unique("hash_unique", ["code_hash"]).rule("hash_shape", F.col("code_hash").rlike(HASH), F.col("code_hash"))
    return stacked([rows.rule("json_object", F.schema_of_variant(F.try_parse_json("interface")).startswith("OBJECT"), F.col("code_hash"))])


def _with_parent(df: DataFrame, transactions: DataFrame) -> DataFrame:
    """df with the ledger of its transaction, null where there is none."""
    parent = transactions.groupBy(F.col("id").alias("of_")).agg(F.min("ledger_sequence").alias("parent_"), F.max("ledger_sequence").alias("parent_too_"))
    return df.join(parent, F.col("transaction_id") == F.col("of_"), "left")


def _parents(rows: Rules) -> Rules:
    key, there = F.col("transaction_id"), F.col("of_").isNotNull()
    rows.broken("transaction_exists", key.isNotNull() & ~there, key)
    rows.rule("ledger_of_parent", (F.col("ledger_sequence") == F.col("parent_")) & (F.col("ledger_sequence") == F.col("parent_too_")), key, there)
    return rows.rule("folded_count", F.col("amount") >= 1, key, F.col("amount").isNotNull())


def check_events(events: DataFrame, transactions: DataFrame, contracts: DataFrame) -> DataFrame:
    rows = _parents(Rules(_with_parent(events, transactions), "events"))
    return stacked([rows.foreign_key("contract_exists", "contract_id", contracts, "contract_id", "contract_id")])


def check_invocations(invocations: DataFrame, transactions: DataFrame, contracts: DataFrame, accounts: DataFrame, events: DataFrame) -> DataFrame:
    with_event = events.select(F.col("contract_id").alias("c_"), F.col("transaction_id").alias("t_")).distinct()
    rows = _with_parent(invocations, transactions).join(with_event, (F.col("contract_id") == F.col("c_")) & (F.col("transaction_id") == F.col("t_")), "left")
    rows = _parents(Rules(rows, "invocations")).foreign_key("contract_exists", "contract_id", contracts, "contract_id", "contract_id")
    rows.foreign_key("caller_exists", "caller_id", accounts, "account_id", "caller_id", sparse="transaction_id")
    return stacked([rows.broken("without_event", F.col("t_").isNull(), F.col("transaction_id"))])


def check_assets(assets: DataFrame, accounts: DataFrame, contracts: DataFrame) -> DataFrame:
    kind, code, issuer, key = F.col("asset_type"), F.col("asset_code"), F.col("issuer_id"), F.col("id")
    shape = F.when(kind == 0, code == "").when(kind == 1, (code != "") & issuer.isNotNull()).otherwise(code == "")
    rows = Rules(assets, "assets").rule("type_range", kind.isin(0, 1, 3), key).rule("identity_shape", shape, key)
    rows.foreign_key("issuer_exists", "issuer_id", accounts, "account_id", "id", sparse="id").foreign_key("contract_exists", "id", contracts, "contract_id", "id", kind == 3)
    rows.rule("not_negative", (F.coalesce("holders", F.lit(0)) >= 0) & (F.coalesce("supply", F.lit(0)) >= 0), key)
    return stacked([rows, rule(assets.agg(F.count_if(kind == 0).alias("n")), "assets", "one_native", F.col("n") == 1, F.col("n"))])


def check_accounts(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    key, first, last = F.col("account_id"), F.col("first_seen_ledger"), F.col("last_seen_ledger")
    rows = Rules(accounts, "accounts").unique("account_unique", ["account_id"]).rule("key_shape", F.col("account_key").rlike(ACCOUNT_KEY), key)
    rows.rule("ledgers_not_negative", (first >= 0) & (last >= 0), key).rule("seen_in_order", first <= last, key).rule("sequence_not_negative", F.col("sequence_number") >= 0, key)
    return stacked([rows.rule("source_has_sequence", F.col("sequence_number") > 0, key, rows.known("account_id", transactions, "source_id"))])


def check_balances(balances: DataFrame, accounts: DataFrame, assets: DataFrame, partitions: int | None = None) -> DataFrame:
    """Issuers and identities of balances: check_issuers()."""
    rows = Rules(balances, "balances").foreign_key("account_exists", "holder_id", accounts, "account_id", "holder_id").foreign_key("asset_exists", "asset_id", assets, "id", "asset_id")
    rows.rule("not_negative", F.col("amount") >= 0, F.col("holder_id")).unique("holder_asset_unique", ["holder_id", "asset_id"])
    return stacked([rows.unique("one_native_a_holder", ["holder_id"], rows.known("asset_id", assets.where("asset_type = 0"), "id"))], partitions)


def check_nfts(tokens: DataFrame, contracts: DataFrame, accounts: DataFrame, ownership: DataFrame) -> DataFrame:
    from orrery.operators.contracts import nft_state

    rows = Rules(tokens, "nfts").unique("token_unique", ["contract_id", "token_id"]).foreign_key("contract_exists", "contract_id", contracts, "contract_id", "contract_id")
    rows.foreign_key("owner_exists", "owner_id", accounts, "account_id", "owner_id", sparse="token_id")
    rows.rule("minted_before_seen", F.col("minted_at_ledger") <= F.col("last_seen_ledger"), F.col("token_id"), F.col("minted_at_ledger").isNotNull())
    return stacked([rows, recompute(tokens, nft_state(ownership), "nfts", {"owner_is_latest": "owner_id"}, ["contract_id", "token_id"])])


def check_nft_ownership(ownership: DataFrame, tokens: DataFrame, transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """The first event of a token is a mint, which is type 0."""
    key = ["contract_id", "token_id"]
    first = ownership.groupBy(*key).agg(F.min(F.struct("ledger_sequence", "event_order", "event_type")).event_type.alias("event_type"))
    name = F.concat_ws(":", "contract_id", "token_id")
    there = tokens.select(F.col("contract_id").alias("c_"), F.col("token_id").alias("t_")).distinct()
    rows = Rules(ownership.join(there, (F.col("contract_id") == F.col("c_")) & (F.col("token_id") == F.col("t_")), "left"), "nft_ownership")
    rows.broken("token_exists", F.col("t_").isNull(), name).foreign_key("transaction_exists", "transaction_id", transactions, "id", "transaction_id")
    rows.foreign_key("owner_exists", "owner_id", accounts, "account_id", "owner_id", sparse="transaction_id").rule("type_range", F.col("event_type").between(0, 2), name)
    rows.rule("order_not_negative", F.col("event_order") >= 0, name)
    return stacked([rows, rule(first, "nft_ownership", "first_is_mint", F.col("event_type") == 0, name)])


def check_pools(pools: DataFrame, assets: DataFrame) -> DataFrame:
    """A pool without a creation ledger (0) is a placeholder: that is reported, and no fault. Issuers of the legs: check_issuers()."""
    key = F.col("pool_id")
    rows = Rules(pools, "pools").rule("key_shape", F.col("pool_key").rlike(HASH), key).broken("placeholders", F.col("created_at_ledger") == 0, key).unique("pool_unique", ["pool_id"])
    rows.rule("leg_order", F.col("asset_a") < F.col("asset_b"), key).rule("fee_range", F.col("fee_bps").between(0, 10_000), key)
    return stacked([rows.foreign_key("asset_a_exists", "asset_a", assets, "id", "pool_id").foreign_key("asset_b_exists", "asset_b", assets, "id", "pool_id")])


def check_snapshots(snapshots: DataFrame, pools: DataFrame, ledgers: DataFrame) -> DataFrame:
    key, volume = F.col("pool_id"), F.col("gross_volume_a")
    rows = Rules(snapshots, "pool_snapshots").foreign_key("pool_exists", "pool_id", pools, "pool_id", "pool_id")
    rows.rule("reserves_not_negative", (F.col("reserve_a") >= 0) & (F.col("reserve_b") >= 0), key).rule("volume_not_negative", volume >= 0, key, volume.isNotNull())
    return stacked([rows.unique("one_a_ledger", ["pool_id", "ledger_sequence"]).foreign_key("ledger_exists", "ledger_sequence", ledgers, "sequence", "ledger_sequence")])


def check_positions(positions: DataFrame, pools: DataFrame, accounts: DataFrame, snapshots: DataFrame, tolerance: float = 0.001) -> DataFrame:
    from orrery.operators.pools import latest_snapshots

    total = latest_snapshots(snapshots).select("pool_id", "total_shares")
    sums = positions.where("shares > 0").groupBy("pool_id").agg(F.sum("shares").alias("held")).join(total, "pool_id")
    key = F.col("account_id")
    rows = Rules(positions, "positions").foreign_key("pool_exists", "pool_id", pools, "pool_id", "pool_id").foreign_key("account_exists", "account_id", accounts, "account_id", "account_id")
    rows.rule("shares_not_negative", F.col("shares") >= 0, key).rule("ledgers_in_order", F.col("first_deposit_ledger") <= F.col("last_updated_ledger"), key)
    rows.unique("holder_unique", ["pool_id", "account_id"])
    return stacked([rows, rule(sums, "positions", "shares_add_up", F.abs(F.col("held") - F.col("total_shares")) <= F.col("total_shares") * tolerance, F.col("pool_id"))])


def check_layout(ledgers: DataFrame, size: int, recent: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows outside of their bucket, and rows of each bucket with whether it is one of the recent ones."""
    wrong = rule(ledgers, "ledgers", "in_bucket", F.col("bucket") == F.floor(F.col("sequence") / size), F.col("sequence"))
    buckets = ledgers.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    newest = buckets.agg(F.max("bucket").alias("last"))
    return stacked([wrong]), buckets.join(F.broadcast(newest)).select("bucket", "rows", (F.col("bucket") > F.col("last") - recent).alias("recent"))  # newest is one row


def check_contract_code(contracts: DataFrame, updates: DataFrame) -> DataFrame:
    """The stored code hash is that of the latest update; a contract that is missing or has none breaks the rule. updates: contract_id, ledger_sequence, event_index, code_hash."""
    last = updates.groupBy("contract_id").agg(F.max(F.struct("ledger_sequence", "event_index", "code_hash")).code_hash.alias("should"))
    joined = last.join(contracts.select("contract_id", "code_hash"), "contract_id", "left")
    return stacked([rule(joined, "contracts", "code_is_latest", F.col("code_hash") == F.col("should"), F.col("contract_id"))])


def check_after_merge(ledgers: DataFrame, transactions: DataFrame, operations: DataFrame, versions: DataFrame, accounts: DataFrame, parts: DataFrame) -> DataFrame:
    """Gaps, stored minimums against those of participants, transactions without operations, counts of ledgers, sequence numbers that fall."""
    from orrery.operators.reads import ledger_neighbours

    first = parts.groupBy(F.col("account_id").alias("of_")).agg(F.min("ledger_sequence").alias("first_"))
    stored = Rules(accounts.join(first, F.col("account_id") == F.col("of_"), "left"), "accounts").rule("skeleton", F.col("sequence_number") > 0, F.col("account_id"))
    stored.broken("first_seen_is_least", F.col("of_").isNotNull() & ~F.col("first_seen_ledger").eqNullSafe(F.col("first_")), F.col("account_id"))
    counts = transactions.groupBy(F.col("ledger_sequence").alias("sequence")).agg(F.count(F.lit(1)).alias("transaction_count"))
    own = Rules(operations.select("transaction_id"), "operations")
    return stacked(
        [
            report(ledger_neighbours(ledgers).where("next > sequence + 1"), "ledgers", "gap_after", F.col("sequence")),
            stored,
            own.broken("without_transaction", ~own.known("transaction_id", transactions, "id"), F.col("transaction_id")),
            recompute(ledgers, counts, "ledgers", {"transaction_count": "transaction_count"}, ["sequence"]),
            increasing(versions, "accounts", "sequence_never_falls", "version", "sequence_number", ["account_id"], strict=False),
        ]
    )


def check_issuers(operations: DataFrame, balances: DataFrame, pools: DataFrame, assets: DataFrame, accounts: DataFrame) -> DataFrame:
    """Issuers of the assets of operations, balances and pool legs exist; a native balance has neither code nor issuer, a credit balance both.

    Assets are looked up in the accounts once; what refers to them takes the verdict from there.
    """
    known = accounts.select(F.col("account_id").alias("issuer_id"), F.lit(True).alias("known_")).distinct()
    own = assets.select(F.col("id").alias("asset_"), "asset_type", "asset_code", "issuer_id").join(known, "issuer_id", "left")
    own = own.select("asset_", "asset_type", "asset_code", "issuer_id", (F.col("issuer_id").isNotNull() & F.col("known_").isNull()).alias("lost_"))
    name = F.concat_ws(":", "holder_id", "asset_id")
    kind, code, issuer = F.col("asset_type"), F.coalesce("asset_code", F.lit("")), F.col("issuer_id")
    shape = F.when(kind == 0, (code == "") & issuer.isNull()).when(kind.isin(1, 2), (code != "") & issuer.isNotNull()).otherwise(True)

    def legs(df: DataFrame) -> DataFrame:
        side = lambda x: own.select(F.col("asset_").alias(f"{x}_"), F.col("lost_").alias(f"{x}_lost_"))
        return df.join(side("a"), F.col("asset_a") == F.col("a_"), "left").join(side("b"), F.col("asset_b") == F.col("b_"), "left")

    return stacked(
        [
            Rules(operations.join(own, F.col("asset_id") == F.col("asset_")), "operations").broken("issuer_exists", F.col("lost_"), F.col("transaction_id")),
            Rules(balances.join(own, F.col("asset_id") == F.col("asset_")), "balances").broken("issuer_exists", F.col("lost_"), name).rule("identity_shape", shape, name),
            Rules(legs(pools), "pools").broken("asset_a_issuer_exists", F.col("a_lost_"), F.col("pool_id")).broken("asset_b_issuer_exists", F.col("b_lost_"), F.col("pool_id")),
        ]
    )


def check_stored_minimums(positions: DataFrame, operations: DataFrame, tokens: DataFrame, ownership: DataFrame, contracts: DataFrame, versions: DataFrame, accounts: DataFrame, percent: float = 1.0) -> DataFrame:
    """Stored minimums of positions, tokens and contracts against those of the whole history, and the share of skeleton accounts, which must be under percent."""
    deposits = operations.where("type = 22 and pool_id is not null").groupBy("pool_id", F.col("source_id").alias("account_id")).agg(F.min("ledger_sequence").alias("first_deposit_ledger"))
    mints = ownership.where("event_type = 0").groupBy("contract_id", "token_id").agg(F.min("ledger_sequence").alias("minted_at_ledger"))
    first = versions.where("deployer_id is not null").groupBy("contract_id").agg(F.min(F.struct("ledger_sequence", "deployer_id")).alias("first_"))
    deployed = first.select("contract_id", F.col("first_.ledger_sequence").alias("deployed_at_ledger"), F.col("first_.deployer_id").alias("deployer_id"))
    known = contracts.where("deployer_id is not null")
    rate = accounts.agg(F.round(F.try_divide(F.lit(100) * F.count_if(F.coalesce("sequence_number", F.lit(0)) == 0), F.count(F.lit(1))), 4).alias("percent_")).where("percent_ is not null")
    return stacked(
        [
            recompute(positions, deposits, "positions", {"first_deposit_is_least": "first_deposit_ledger"}, ["pool_id", "account_id"]),
            recompute(tokens, mints, "nfts", {"minted_at_is_least": "minted_at_ledger"}, ["contract_id", "token_id"]),
            recompute(known, deployed, "contracts", {"deployed_at_is_least": "deployed_at_ledger", "deployer_is_first": "deployer_id"}, ["contract_id"]),
            rule(rate, "accounts", "skeleton_rate", F.col("percent_") < percent, F.col("percent_")),
        ]
    )
