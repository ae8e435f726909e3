"""Search for a table of texts: the same hits as search.py gives, by joins.

Hashes join by equality. Prefixes of keys join by equality too: each key is cut to the lengths that are asked for. Parts of names go
through postings: numbers of an entity and an n-gram of its name, of those lengths and n-grams that the texts hold. An n-gram of a text is all of it,
or of a longer text its first and its last signs, at least half of it each; each text takes the one that fewer entities have, and what is found by it is
confirmed by the whole text. So what is looked at comes near to the hits, work grows with texts, names and hits, and no text is compared with every row.
Blank texts find nothing, equal texts count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.exprs import NATIVE, asked_hash, asset_codes, key_prefix, leg_code
from orrery.operators.search import _hits

SHORT = 8
PARSED = "query string, hash string, prefix string, part string, codes array<string>"


def parsed(texts: DataFrame, column: str = "query") -> DataFrame:
    """Each text with what it may be: a hash, a key's prefix, a part of a name, codes of a pool's legs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            made = [own, [asked_hash(t) for t in own], [key_prefix(t) for t in own], [t.strip().lower() for t in own], [asset_codes(t) for t in own]]
            types = [pa.string()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], names=["query", "hash", "prefix", "part", "codes"])

    return texts.select(F.col(column).cast("string").alias("query")).where(F.trim("query") != "").distinct().mapInArrow(run, PARSED).where("part <> ''")


def _postings(entities: DataFrame, key: str, names: list[Column], lengths: DataFrame) -> DataFrame:
    """key_ and gram_ (a number) for each place and length of each name; the empty n-gram once for each name. Plain columns, no lambdas: this is most of the rows."""
    spread = entities.select(F.col(key).alias("key_"), *[F.coalesce(name, F.lit("")).alias(f"name_{i}") for i, name in enumerate(names)])
    spread = spread.repartition(spread.sparkSession.sparkContext.defaultParallelism, "key_").withColumn("name_", F.explode(F.array(*[f"name_{i}" for i in range(len(names))])))
    sized = spread.join(F.broadcast(lengths)).select("key_", "name_", F.explode("lengths_").alias("n_")).where(F.length("name_") >= F.col("n_"))
    placed = sized.withColumn("at_", F.explode(F.sequence(F.lit(1), F.when(F.col("n_") == 0, 1).otherwise(F.length("name_") - F.col("n_") + 1))))
    return placed.select("key_", F.xxhash64(F.substring(F.col("name_"), F.col("at_"), F.col("n_"))).alias("gram_"))


def _ends(part: Column) -> Column:
    """A text's n-grams: the text up to SHORT signs, from there its first and last ones, as many as the largest power of two that fits: together they cover it."""
    n = F.when(F.length(part) <= SHORT, F.length(part)).otherwise(F.pow(F.lit(2), F.length(F.bin(F.length(part))) - 1)).cast("int")
    return F.array(F.substring(part, F.lit(1), n), F.substring(part, F.length(part) - n + 1, n))


def _containing(entities: DataFrame, key: str, names: list[Column], asked: DataFrame, fits: Column) -> DataFrame:
    """entities with what is asked (query and its other columns) for each text that fits. asked: query, parts (texts that all must be in some name), and what fits() needs.

    A text without parts is in every name.
    """
    own = F.array_distinct(F.flatten(F.transform("parts", _ends)))
    grams = asked.withColumn("gram_", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("")))))
    lengths = grams.agg(F.coalesce(F.collect_set(F.length("gram_")), F.array().cast("array<int>")).alias("lengths_"))  # one row of few numbers
    wanted = grams.withColumn("gram_", F.xxhash64("gram_"))
    posted = _postings(entities, key, names, lengths).join(wanted.select("gram_").distinct(), "gram_", "left_semi").distinct()
    sizes = posted.groupBy("gram_").agg(F.count(F.lit(1)).alias("n_"))
    ranked = wanted.join(sizes, "gram_", "left").groupBy("query").agg(
        F.min(F.struct("n_", "gram_")).alias("best_"), F.count_if(F.col("n_").isNull()).alias("lost_"), *[F.any_value(c).alias(c) for c in asked.columns if c != "query"]
    )
    rarest = ranked.where("lost_ = 0").select(*asked.columns, F.col("best_.gram_").alias("gram_"))  # a text with an n-gram that no name has fits none
    near = posted.join(rarest, "gram_").drop("gram_")
    return entities.join(near, F.col(key) == F.col("key_")).drop("key_").where(fits)


def _prefixed(entities: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """entities with query for each asked prefix of their key."""
    own = asked.where("prefix is not null").select("query", "prefix")
    lengths = own.agg(F.coalesce(F.collect_set(F.length("prefix")), F.array().cast("array<int>")).alias("lengths_"))  # one row of at most 55 numbers
    cut = entities.join(F.broadcast(lengths)).withColumn("length_", F.explode("lengths_")).where(F.length(key) >= F.col("length_"))
    return cut.withColumn("prefix", F.substring(F.col(key), F.lit(1), F.col("length_"))).join(own, "prefix").drop("lengths_", "length_", "prefix")


def search_transactions(hash_index: DataFrame, asked: DataFrame) -> DataFrame:
    return _hits(hash_index.join(asked.where("hash is not null").select("query", "hash"), "hash"), "transaction", F.col("hash"), F.col("hash")).distinct()


def search_pools(pools: DataFrame, assets: DataFrame, asked: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """created (pool_id, created_ledger): where pools come without it; it is joined to the hits only."""
    a, b = (assets.select(F.col("id").alias(f"asset_{s}"), leg_code(F.col("asset_type"), F.col("asset_code")).alias(f"code_{s}")) for s in "ab")
    rows = pools.join(a, "asset_a").join(b, "asset_b").select("pool_id", "pool_key", *(["created_ledger"] if created is None else []), "code_a", "code_b")
    plain = asked.where("hash is null").select("query", F.col("codes").alias("parts"))
    up, first, second = (F.upper("code_a"), F.upper("code_b")), F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    one = up[0].contains(first) | up[1].contains(first)
    two = (up[0].contains(first) & up[1].contains(second)) | (up[0].contains(second) & up[1].contains(first))
    fits = F.when(F.size("parts") == 0, True).when(F.size("parts") == 1, one).otherwise(two)
    by_code = _containing(rows, "pool_id", list(up), plain, fits).drop("parts")
    by_key = rows.join(asked.where("hash is not null").select("query", F.col("hash").alias("pool_key")), "pool_key")
    by_id = rows.withColumn("id_", F.col("pool_id").cast("string")).join(asked.where("hash is null").select("query", F.trim("query").alias("id_")), "id_").drop("id_")
    both = by_code.unionByName(by_key).unionByName(by_id).dropDuplicates(["query", "pool_id"])
    if created is not None:
        both = both.join(created, "pool_id", "left")
    return _hits(both, "pool", F.col("pool_id"), F.concat_ws(" / ", "code_a", "code_b"), -F.col("created_ledger"))


def search_accounts(accounts: DataFrame, asked: DataFrame, key: str = "account_key") -> DataFrame:
    return _hits(_prefixed(accounts, key, asked), "account", F.col(key), F.coalesce("home_domain", F.lit("")))


def _named(entities: DataFrame, key: str, name: Column, asked: DataFrame) -> DataFrame:
    parts = asked.select("query", "part", F.array("part").alias("parts"))
    return _containing(entities, key, [name], parts, name.contains(F.col("part"))).drop("part", "parts")


def search_contracts(contracts: DataFrame, asked: DataFrame, key: str = "contract_key") -> DataFrame:
    by_name = _named(contracts, "contract_id", F.lower("name"), asked.where("prefix is null"))
    return _hits(_prefixed(contracts, key, asked).unionByName(by_name), "contract", F.col(key), F.coalesce("name", F.lit("")))


def search_assets(assets: DataFrame, asked: DataFrame, wrappers: DataFrame) -> DataFrame:
    native = F.col("asset_type") == NATIVE
    by_name = assets.where(native).crossJoin(asked.where(F.col("part").isin("xlm", "native")).select("query"))  # one row, and two texts but for case and white space
    rows = _named(assets, "id", F.lower("asset_code"), asked).unionByName(by_name).dropDuplicates(["query", "id"])
    rows = rows.join(wrappers.select(F.col("asset_id").alias("id"), "contract_id"), "id", "left")
    route = F.coalesce(F.col("contract_id").cast("string"), F.when(~native, F.concat_ws("-", "asset_code", F.col("issuer_id").cast("string"))), F.lit("native"))
    return _hits(rows, "asset", route, leg_code(F.col("asset_type"), F.col("asset_code")))


def search_nfts(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    key = F.concat_ws("/", F.col("contract_id").cast("string"), F.col("token_id").cast("string"))
    rows = _named(tokens.withColumn("route_", key), "route_", F.lower("token_name"), asked)
    return _hits(rows, "nft", F.col("route_"), F.col("token_name"))
