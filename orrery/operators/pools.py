"""Read models of liquidity pools and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.exprs import pool_filter
from orrery.functions.versioned import asof_left, latest_by_version

#: Id of the native asset in pools and wrappers.
NATIVE_ID = 0


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return latest_by_version(snapshots, ["pool_id"], "ledger_sequence")


def pool_list(
    pools: DataFrame, snapshots: DataFrame, positions: DataFrame, ledgers: DataFrame, wrappers: DataFrame, text: str | None = None, leg_a: Column | None = None, leg_b: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Pools with first and latest snapshot and its close time, participants that hold shares, and of each leg the wrapper contract and the icon.

    A pool without snapshots counts as created at its last update; a native leg has no wrapper here. wrappers: asset_id, contract_id, icon.
    """
    rows = pools if text is None else pools.where(pool_filter(text, leg_a, leg_b))
    first = snapshots.groupBy("pool_id").agg(F.min("ledger_sequence").alias("created_ledger"))
    last = latest_snapshots(snapshots).withColumnRenamed("ledger_sequence", "snapshot_ledger")
    closes = ledgers.select(F.col("sequence").alias("snapshot_ledger"), F.col("closed_at").alias("snapshot_at")).dropDuplicates(["snapshot_ledger"])
    holders = positions.where("shares > 0").groupBy("pool_id").agg(F.count(F.lit(1)).alias("participants"))
    joined = rows.join(first, "pool_id", "left").join(last, "pool_id", "left").join(holders, "pool_id", "left").join(closes, "snapshot_ledger", "left")
    side = wrappers.where(F.col("asset_id") != NATIVE_ID).groupBy("asset_id").agg(F.max("contract_id").alias("contract"), F.max(F.nullif("icon", F.lit(""))).alias("icon"))
    for s in "ab":
        joined = joined.join(side.select(F.col("asset_id").alias(f"asset_{s}"), F.col("contract").alias(f"contract_{s}"), F.col("icon").alias(f"icon_{s}")), f"asset_{s}", "left")
    created = F.coalesce("created_ledger", "last_updated_ledger").alias("created_ledger")
    found = joined.select(*pools.columns, created, "snapshot_ledger", "snapshot_at", "reserve_a", "reserve_b", "total_shares", F.coalesce("participants", F.lit(0)).alias("participants"), "contract_a", "icon_a", "contract_b", "icon_b")
    return found if limit is None else found.orderBy(F.desc("last_updated_ledger"), F.desc("pool_id")).limit(limit)


def pool_detail(pools: DataFrame, snapshots: DataFrame, positions: DataFrame, ledgers: DataFrame, wrappers: DataFrame, keys: DataFrame) -> DataFrame:
    wanted = keys.select("pool_id").distinct()
    return pool_list(*(df.join(wanted, "pool_id", "left_semi") for df in (pools, snapshots, positions)), ledgers, wrappers)


def pool_participants(positions: DataFrame, snapshots: DataFrame, head: int, fresh: int) -> DataFrame:
    """Holders with shares and their percentage of the latest total; null if that is 0 or older than `fresh` ledgers."""
    last = latest_snapshots(snapshots).select("pool_id", F.when((F.col("ledger_sequence") >= head - fresh) & (F.col("total_shares") > 0), F.col("total_shares")).alias("total"))
    joined = positions.where("shares > 0").join(last, "pool_id", "left")
    return joined.select("pool_id", "account_id", "shares", F.round(F.col("shares").cast("double") * 100 / F.col("total"), 6).alias("percentage"), "first_deposit_ledger", "last_updated_ledger")


def pool_activity(amounts: DataFrame, operations: DataFrame) -> DataFrame:
    """The two legs of each operation on a pool in one row: kind by their signs, its source, and how many pools the operation crossed.

    Amounts meet once, by operation: a map of pools to their legs is made there and taken apart again.
    """
    key = ["transaction_id", "application_order"]
    legs = amounts.groupBy(*key, "pool_id", "ledger_sequence").agg(F.max(F.when(F.col("leg") == "A", F.col("amount"))).alias("amount_a"), F.max(F.when(F.col("leg") == "B", F.col("amount"))).alias("amount_b"))
    by_operation = legs.groupBy(*key).agg(F.collect_list(F.struct("pool_id", "ledger_sequence", "amount_a", "amount_b")).alias("legs"), F.count_distinct("pool_id").alias("pools_crossed"))
    source = operations.where("pool_id is not null").select(*key, F.coalesce("source_id", "tx_source_id").alias("source_id"))
    a, b = F.col("amount_a"), F.col("amount_b")
    kind = F.when(a.isNull() | b.isNull(), None).when((a > 0) & (b > 0), "deposit").when((a < 0) & (b < 0), "withdrawal").otherwise("trade")
    return by_operation.join(source, key, "left").select(*key, "pools_crossed", "source_id", F.inline("legs")).withColumn("kind", kind)


def pool_volume(snapshots: DataFrame, since: int) -> DataFrame:
    """Gross volume of each pool from a ledger on; null without a trade."""
    return snapshots.where(F.col("ledger_sequence") > since).groupBy("pool_id").agg(F.sum("gross_volume_a").alias("volume"))


def closed_within(ledgers: DataFrame, seconds: int, now: Column | None = None) -> DataFrame:
    """Ledgers (ledger_sequence, each once) that closed in the last seconds before `now`, or before the last close: a window by time, however many ledgers that is."""
    own = ledgers.groupBy(F.col("sequence").alias("ledger_sequence")).agg(F.min(F.unix_timestamp(F.col("closed_at").cast("timestamp"))).alias("second_"))
    end = own.agg(F.max("second_").alias("end_")) if now is None else ledgers.sparkSession.range(1).select(F.unix_timestamp(now).alias("end_"))  # one row
    return own.join(F.broadcast(end), (F.col("second_") > F.col("end_") - seconds) & (F.col("second_") <= F.col("end_"))).select("ledger_sequence")


def pool_volume_by_close(snapshots: DataFrame, ledgers: DataFrame, seconds: int = 86_400, now: Column | None = None) -> DataFrame:
    """Gross volume of each pool over the ledgers that closed within the window; null without a trade. Snapshots that repeat count once."""
    recent = snapshots.join(closed_within(ledgers, seconds, now), "ledger_sequence", "left_semi")
    each = recent.groupBy("pool_id", "ledger_sequence").agg(F.max("gross_volume_a").alias("gross_volume_a"))
    return each.groupBy("pool_id").agg(F.sum("gross_volume_a").alias("volume"))


def last_closes(prices: DataFrame, now: int, max_age: int) -> DataFrame:
    """The last positive price of each asset, at most max_age old; the bucket of `now` is not closed yet."""
    rows = prices.where((F.col("close_usd") > 0) & (F.col("bucket") < now) & (F.col("bucket") >= now - max_age))
    return rows.groupBy("asset_id").agg(F.max(F.struct("bucket", "close_usd")).alias("last")).select("asset_id", F.col("last.bucket").alias("bucket"), F.col("last.close_usd").alias("close_usd"))


def pool_usd(pools: DataFrame, snapshots: DataFrame, closes: DataFrame, volume: DataFrame) -> DataFrame:
    """Value locked if both legs have a price; volume and fee from the first leg's."""
    price = closes.select("asset_id", F.col("close_usd").alias("price"))
    rows = pools.join(latest_snapshots(snapshots), "pool_id").join(volume, "pool_id", "left")
    for side in "ab":
        rows = rows.join(price.select(F.col("asset_id").alias(f"asset_{side}"), F.col("price").alias(f"price_{side}")), f"asset_{side}", "left")
    tvl = F.col("reserve_a") * F.col("price_a") + F.col("reserve_b") * F.col("price_b")
    worth = F.col("volume") * F.col("price_a")
    return rows.select("pool_id", F.round(tvl, 4).alias("tvl_usd"), F.round(worth, 4).alias("volume_usd"), F.round(worth * F.col("fee_bps") / 10000, 4).alias("fee_usd"))


#: Chart interval: (its bucket, the bucket of the prices that it uses).
INTERVALS = {"1h": ("hour", "hour"), "1d": ("day", "day"), "1w": ("week", "day")}


#: Seconds of a bucket of prices, and buckets in one stretch of time of the as-of pass, which makes a leg of very many pools many groups.
SECONDS, STRETCH = {"hour": 3_600, "day": 86_400}, 64


def with_prices(rows: DataFrame, prices: DataFrame, grain: str, carry: int, now: Column | None = None, partitions: int | None = None) -> DataFrame:
    """rows (leg, price_second: the start of a price bucket) with price: the close of that bucket or of the last one before it, at most `carry` seconds older; without a leg null.

    One pass over prices and rows by leg and time; rows without a leg are dealt out one by one. The bucket of `now` is still open, and left out.
    """
    own = prices.where("close_usd > 0 AND leg is not null").select("leg", F.date_trunc(grain, "bucket").alias("bucket"), "close_usd")
    if now is not None:
        own = own.where(F.col("bucket") < F.date_trunc(grain, now))
    if partitions is not None:  # a leg has a price a bucket: the steps by leg and time need no shuffles of their own
        own = own.repartition(partitions, "leg")
    own = own.groupBy("leg", F.unix_timestamp("bucket").alias("second")).agg(F.max("close_usd").alias("close_usd")).withColumn("deal_", F.lit(0).cast("bigint"))
    rows = rows.withColumn("deal_", F.when(F.col("leg").isNull(), F.xxhash64(*rows.columns)).otherwise(0))
    found = asof_left(rows, own, ["leg", "deal_"], "price_second", "second", ["close_usd"], max(STRETCH * SECONDS[grain], 8 * carry), carry, partitions)
    return found.withColumn("price", F.when(F.col("price_second") - F.col("second") <= carry, F.col("close_usd"))).drop("second", "close_usd", "deal_")


def pool_chart(pools: DataFrame, snapshots: DataFrame, ledgers: DataFrame, prices: DataFrame, interval: str, carry: int, now: Column | None = None, since: Column | None = None, until: Column | None = None, partitions: int | None = None) -> DataFrame:
    """For each pool and hour, day or week (from Monday) by close time: value of the last snapshot that has both prices, volume (null if a trade has no price), fee, samples.

    A snapshot is priced by the close of its own price bucket or of the last one before it, at most `carry` seconds older.
    pools: pool_id, leg_a, leg_b (price_leg()), fee_bps; prices: leg, bucket, close_usd. Snapshots and ledgers that repeat count once.
    since, until: bounds of the close times charted; the price bucket of `now` is open and gives no price.
    partitions: of the steps on all prices and snapshots, else the session's.
    """
    bucket, grain = INTERVALS[interval]
    closes = ledgers.select(F.col("sequence").alias("ledger_sequence"), F.col("closed_at").cast("timestamp").alias("closed_at")).dropDuplicates(["ledger_sequence"])
    if since is not None:
        closes = closes.where(F.col("closed_at") >= since)
    if until is not None:
        closes = closes.where(F.col("closed_at") < until)
    rows = snapshots.dropDuplicates(["pool_id", "ledger_sequence"]).join(pools.select("pool_id", "leg_a", "leg_b", "fee_bps"), "pool_id").join(closes, "ledger_sequence")
    second = F.unix_timestamp(F.date_trunc(grain, "closed_at")).alias("price_second")
    leg = lambda side: F.struct(F.lit(side).alias("side"), F.col(f"leg_{side}").alias("leg"), F.col(f"reserve_{side}").alias("reserve"))
    key = ["pool_id", "ledger_sequence", F.date_trunc(bucket, "closed_at").alias("bucket"), "fee_bps", "gross_volume_a"]
    sides = with_prices(rows.select(*key, second, F.inline(F.array(leg("a"), leg("b")))), prices, grain, carry, now, partitions)
    if partitions is not None:  # both groupings go by pool
        sides = sides.repartition(partitions, "pool_id")
    worth = F.col("reserve") * F.col("price")
    both = sides.groupBy("pool_id", "ledger_sequence", "bucket").agg(
        F.when(F.count("price") == 2, F.sum(worth)).alias("tvl"), F.max(F.when(F.col("side") == "a", F.col("price"))).alias("price_a"), F.max("gross_volume_a").alias("gross_volume_a"), F.max("fee_bps").alias("fee_bps")
    )
    rows = both.withColumn("worth", F.col("gross_volume_a") * F.col("price_a"))
    unpriced = F.count_if(F.col("gross_volume_a").isNotNull() & F.col("price_a").isNull())
    volume = F.when(unpriced > 0, None).otherwise(F.round(F.sum("worth"), 4))
    grouped = rows.groupBy("pool_id", "bucket").agg(
        F.round(F.max_by("tvl", F.when(F.col("tvl").isNotNull(), F.col("ledger_sequence"))), 4).alias("tvl_usd"), volume.alias("volume_usd"), F.max("fee_bps").alias("fee_bps"), F.count(F.lit(1)).alias("samples")
    )
    fee = F.round(F.col("volume_usd") * F.col("fee_bps") / 10000, 4)
    return grouped.select("pool_id", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "tvl_usd", "volume_usd", fee.alias("fee_usd"), "samples")
