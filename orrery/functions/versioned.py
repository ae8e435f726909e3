"""Tables of versions: the latest row of a key, one row of equal copies, the first n of a key, merged facets, lookups, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_version(df: DataFrame, key: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row of the highest version of each key; of equal versions the largest in `ties`, then in all columns.

    An aggregate with a partial step before the shuffle, so a key of many versions leaves each task as one row.
    """
    rest = [c for c in df.columns if c not in key]
    order = [version, *ties, *(c for c in rest if c != version and c not in ties)]
    best = df.groupBy(*key).agg(F.max(F.struct(*order)).alias("best_"))
    return best.select(*[F.col(c) if c in key else F.col(f"best_.{c}").alias(c) for c in df.columns])


def dedup_by_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row of each key, for keys whose copies are identical."""
    return df.dropDuplicates(list(key))


def top_n_by(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark prunes each task's rows to n of a key before the shuffle (a window group limit)."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")


def merge_facets(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Partial rows of a key joined by maximum."""
    return df.groupBy(*key).agg(*[F.max(c).alias(c) for c in df.columns if c not in key])


def resolve_ids(df: DataFrame, columns: dict[str, str], dim: DataFrame, id_column: str, natural: str) -> DataFrame:
    """columns: id column to the name of its natural key. A missing id gives null. The optimizer broadcasts dim only if its size is small."""
    for column, name in columns.items():
        side = dim.select(F.col(id_column).alias("dim_id_"), F.col(natural).alias(name))
        df = df.join(side, F.col(column) == F.col("dim_id_"), "left").drop("dim_id_")
    return df


def lookup_hash(hashes: DataFrame, hash_index: DataFrame) -> DataFrame:
    """Rows of the hash index (outer and inner hashes) for the hashes asked for."""
    return hash_index.join(hashes.select("hash").distinct(), "hash")


def beyond(df: DataFrame, key: Sequence[str], cursor: Sequence, falling: bool) -> Column:
    """Whether a row comes after the cursor, a tuple of key values."""
    here = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, cursor, strict=True)])
    at = F.struct(*[F.col(k) for k in key])
    return at < here if falling else at > here


def keyset_page(df: DataFrame, key: Sequence[str], limit: int, cursor: Sequence | None = None, backward: bool = False, descending: bool = True) -> DataFrame:
    """A page of `limit` rows after (or before) the cursor, a tuple of key values, with has_next and has_prev.

    limit + 1 rows are taken, the last one tells whether there is more in that direction.
    """
    falling = descending != backward
    rows = df if cursor is None else df.where(beyond(df, key, cursor, falling))
    order = [F.col(k).desc() if falling else F.col(k).asc() for k in key]
    taken = rows.orderBy(*order).limit(limit + 1)
    ranked = taken.withColumn("rank_", F.row_number().over(Window.orderBy(*order))).withColumn("more_", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    page = ranked.where(F.col("rank_") <= limit)
    behind = F.lit(cursor is not None)
    nxt, prev = (behind, F.col("more_")) if backward else (F.col("more_"), behind)
    final = [F.col(k).desc() if descending else F.col(k).asc() for k in key]
    return page.withColumn("has_next", nxt).withColumn("has_prev", prev).orderBy(*final).drop("rank_", "more_")


def asof_left(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, values: Sequence[str], step: int | None = None, reach: int | None = None, partitions: int | None = None) -> DataFrame:
    """Each left row with the values (and time) of the last right row of its keys at or before it; none: null.

    Both sides are stacked, laid out by key and time, and the last right row is carried forward: one shuffle, no pairs.
    step: the time axis is cut into stretches of this length, so that a hot key is many groups; each stretch starts with the
    last right row before it, which is found among one row for each key and stretch. reach: right rows that are older by more may be left
    out; then what stretches start with is made from the right side alone, and the left side is read once. partitions: of the stacked sides, else the session's.
    """
    carried = F.struct(F.col(right_at).alias(right_at), *[F.col(v) for v in values])
    whole = F.struct(*[F.col(c) for c in left.columns])
    r = right.select(*by, F.col(right_at).alias("at_"), F.lit(1).alias("side_"), carried.alias("carried_"))
    lt = left.select(*by, F.col(at).alias("at_"), F.lit(2).alias("side_"), whole.alias("row_"))
    both = r.unionByName(lt, allowMissingColumns=True)
    group = list(by)
    if step is not None:
        both = both.withColumn("stretch_", F.floor(F.col("at_") / step))
        group.append("stretch_")
        if reach is None:
            ends = both.groupBy(*group).agg(F.max(F.when(F.col("side_") == 1, F.struct("at_", "carried_"))).carried_.alias("end_"))
            before = Window.partitionBy(*by).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
            starts = ends.withColumn("carried_", F.last("end_", ignorenulls=True).over(before)).where("carried_ is not null")
        else:  # the last row of a stretch starts the next ones, up to that in which the next row lies
            ends = r.withColumn("stretch_", F.floor(F.col("at_") / step)).groupBy(*group).agg(F.max(F.struct("at_", "carried_")).alias("end_"))
            after = F.lead("stretch_").over(Window.partitionBy(*by).orderBy("stretch_"))
            last = F.floor((F.col("end_.at_") + reach) / step)
            ends = ends.withColumn("to_", F.least(F.coalesce(after, last), last)).where(F.col("to_") > F.col("stretch_"))
            starts = ends.select(*by, F.explode(F.sequence(F.col("stretch_") + 1, "to_")).alias("stretch_"), F.col("end_.carried_").alias("carried_"))
        starts = starts.select(*group, (F.col("stretch_") * step).cast(both.schema["at_"].dataType).alias("at_"), F.lit(0).alias("side_"), "carried_")
        both = both.unionByName(starts, allowMissingColumns=True)
    if partitions is not None:
        both = both.repartition(partitions, *group)
    w = Window.partitionBy(*group).orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("carried_", F.last("carried_", ignorenulls=True).over(w)).where("side_ = 2")
    return both.select("row_.*", *[F.col(f"carried_.{c}").alias(c) for c in (right_at, *values)])
