"""Queries of layout, progress and lag over the ledger views."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import reads as R
from orrery.plans.reads import json_events, HASH_INDEX, TXL, hash_index
from orrery.sources.bucketed import bucket_page, buckets_of
from orrery.sources.records import prune, publish_version, read_records, read_version, scratch_folder, with_bucket, write_bucketed
from orrery.streaming import live as L


def stored_records(v):
    """Ledgers as JSON lines, read with the fixed schema of their list; what the schema lacks (a bucket) isn't read, what the lines lack is null."""
    folder = scratch_folder(v.spark)
    v.ledgers.withColumn("closed_at", F.col("sequence") * 86400).write.json(f"{folder}/ledgers")
    return read_records(v.spark, folder, "ledgers", "json").select("sequence", "hash", "closed_at", "protocol_version", "transaction_count", "base_fee")


def written_batches(v):
    """Two batches, one again, and one whose ledgers are written anew in place of all their rows."""
    root = scratch_folder(v.spark)
    tx = v.transactions.select("id", "ledger_sequence", "fee_charged")

    def put(where, fee, **how):
        tables = {"ledgers": v.ledgers.select("sequence", "hash"), "transactions": tx.withColumn("fee_charged", fee)}
        L.write_ledger_batch({k: t.where(where.format("sequence" if k == "ledgers" else "ledger_sequence")) for k, t in tables.items()}, root, 500, **how)

    put("{} <= 1200", F.lit(-1))
    put("{} between 1100 and 2000", F.col("fee_charged"))  # of 1100 to 1200 nothing is new
    put("{} > 2000", F.col("fee_charged"))
    put("{} between 300 and 700", F.col("fee_charged"), replace=True)
    return v.spark.read.parquet(f"{root}/transactions")


def swapped_versions(v):
    """The accounts' last ledgers as a first version, and a second one made from it with what the transactions say."""
    target = scratch_folder(v.spark)
    publish_version(v.accounts.select("account_id", F.lit(0).cast("bigint").alias("last_seen_ledger")), target)
    seen = v.transactions.groupBy(F.col("source_id").alias("account_id")).agg(F.max("ledger_sequence").alias("seen"))
    now = read_version(v.spark, target).join(seen, "account_id", "left")
    publish_version(now.select("account_id", F.greatest("last_seen_ledger", "seen").alias("last_seen_ledger")), target)
    return read_version(v.spark, target)


def stored(v, df, size):
    """df as a table in ledger buckets, and its buckets."""
    path = scratch_folder(v.spark)
    write_bucketed(df, path, size)
    return v.spark.read.parquet(path), buckets_of(v.spark, path)


def paged(v, df, size, key, limit, cursor=None, build=None, **how):
    facts, buckets = stored(v, df, size)
    return bucket_page(facts, buckets, key, limit, cursor, size=size, build=build, **how).drop("ledger_bucket")


def events_of_transactions(v):
    """Events in the ledger of their transaction."""
    return v.events.drop("ledger_sequence").join(v.transactions.select(F.col("id").alias("transaction_id"), "ledger_sequence"), "transaction_id")


def early_hashes(v):
    """Hashes of the transactions of ledgers 700 to 900, among them inner ones, and texts that are no hash."""
    t = v.transactions.where("ledger_sequence BETWEEN 700 AND 900")
    return t.select("hash").union(t.select("inner_tx_hash")).union(v.transactions.where("id % 100 = 0").selectExpr("CAST(id AS STRING)"))


def pruned_events(v):
    events, _ = stored(v, events_of_transactions(v), 500)
    return R.events_by_tx_hash(events, hash_index(v), early_hashes(v), 500)


TX_KEY = ["ledger_sequence", "application_order"]
PAGE = "true AS has_next, {} AS has_prev"
TX_PAGE = "SELECT id, ledger_sequence, application_order, " + PAGE + " FROM v_transactions WHERE {} ORDER BY ledger_sequence {}, application_order {} LIMIT 25"

PLANS = {
    "q41_bucket_page": (lambda v: paged(v, v.transactions.select("id", *TX_KEY), 500, TX_KEY, 25, (1200, 3)), TX_PAGE.format("true", "(ledger_sequence, application_order) < (1200, 3)", "DESC", "DESC")),
    "q41_bucket_page_back": (lambda v: paged(v, v.transactions.select("id", *TX_KEY), 500, TX_KEY, 25, (1200, 3), backward=True), TX_PAGE.format("true", "(ledger_sequence, application_order) > (1200, 3)", "", "")),
    "q5_tx_list_paged": (lambda v: paged(v, v.transactions, 500, TX_KEY, 100, build=lambda t: R.tx_list(t, v.ledgers)), f"SELECT {PAGE.format('false')}, {TXL} ORDER BY t.ledger_sequence DESC, application_order DESC LIMIT 100"),
    "q28_invocations_paged": (
        lambda v: paged(v, v.invocations, 5_000, ["ledger_sequence", "transaction_id"], 50, (30_000, 0), build=lambda i: R.contract_invocations(i.where("contract_id = 7"), v.transactions)),
        f"SELECT contract_id, transaction_id, i.ledger_sequence, invocation_index, hash, successful, caller_id, count(*) OVER () > 50 AS has_next, true AS has_prev FROM v_invocations i JOIN v_transactions t ON t.id = transaction_id WHERE contract_id = 7 AND i.ledger_sequence < 30000 ORDER BY i.ledger_sequence DESC, transaction_id DESC LIMIT 50",
    ),
    "q29_events_paged": (
        lambda v: paged(v, json_events(v), 5_000, ["ledger_sequence", "transaction_id"], 50, build=lambda e: R.contract_events(e.where("contract_id = 3"), v.transactions).drop("topics", "n_topics")),
        "SELECT contract_id, e.ledger_sequence, transaction_id, event_index, signature, data, hash, successful, count(*) OVER () > 50 AS has_next, false AS has_prev FROM v_events e LEFT JOIN v_transactions t ON t.id = transaction_id WHERE contract_id = 3 ORDER BY e.ledger_sequence DESC, transaction_id DESC LIMIT 50",
    ),
    "q44_events_pruned": (
        pruned_events,
        f"SELECT i.hash, e.transaction_id, event_index, contract_id, signature, data FROM v_events e JOIN {HASH_INDEX} i ON i.transaction_id = e.transaction_id WHERE i.ledger_sequence BETWEEN 700 AND 900",
    ),
    "s1_read_records": (stored_records, "SELECT CAST(sequence AS INT) AS sequence, hash, sequence * 86400 AS closed_at, CAST(NULL AS INT) AS protocol_version, CAST(transaction_count AS INT) AS transaction_count, CAST(base_fee AS INT) AS base_fee FROM v_ledgers"),
    "s3_ledger_batches": (written_batches, "SELECT id, ledger_sequence, CASE WHEN ledger_sequence <= 1200 AND ledger_sequence NOT BETWEEN 300 AND 700 THEN -1 ELSE fee_charged END AS fee_charged, CAST(floor(ledger_sequence / 500) AS INT) AS ledger_bucket FROM v_transactions"),
    "s8_versions": (swapped_versions, "SELECT a.account_id, greatest(0, coalesce(max(t.ledger_sequence), 0)) AS last_seen_ledger FROM v_accounts a LEFT JOIN v_transactions t ON t.source_id = a.account_id GROUP BY a.account_id"),
    "s2_with_bucket": (lambda v: with_bucket(v.transactions.select("id", "ledger_sequence"), 500), "SELECT id, ledger_sequence, CAST(floor(ledger_sequence / 500) AS INT) AS ledger_bucket FROM v_transactions"),
    "s2_prune": (lambda v: prune(with_bucket(v.transactions.select("id", "ledger_sequence"), 500), 700, 1300, 500), "SELECT id, ledger_sequence, CAST(floor(ledger_sequence / 500) AS INT) AS ledger_bucket FROM v_transactions WHERE ledger_sequence BETWEEN 700 AND 1300"),
    "s11_missing_ledgers": (lambda v: L.missing_ledgers(v.ledgers, 1, 2500), "SELECT s AS sequence FROM range(1, 2501) r(s) WHERE s NOT IN (SELECT sequence FROM v_ledgers)"),
    "s11_progress_by_partition": (lambda v: L.progress_by_partition(v.ledgers, 1, 2500, 640), "SELECT CAST(floor(s / 640) AS BIGINT) AS part, count(*) AS expected, count(l.sequence) AS indexed, count(*) - count(l.sequence) AS pending, round(count(l.sequence) * 100 / count(*), 4) AS percent FROM range(1, 2501) r(s) LEFT JOIN (SELECT DISTINCT sequence FROM v_ledgers) l ON l.sequence = s GROUP BY 1"),
    "s12_contiguous": (lambda v: L.contiguous(v.ledgers, 100).select("sequence"), "SELECT sequence FROM v_ledgers WHERE sequence > 100 AND sequence < (SELECT min(s) FROM range(101, 10000) r(s) WHERE s NOT IN (SELECT sequence FROM v_ledgers))"),
    "o5_ingestion_lag": (lambda v: L.ingestion_lag(v.ledgers.withColumn("closed_at", F.timestamp_seconds(F.col("sequence") * 86400)), "1974-01-01 00:00:00 UTC"), "SELECT sequence, greatest(0, 126230400 - sequence * 86400) AS lag_seconds FROM v_ledgers"),
}
