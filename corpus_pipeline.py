"""Documents on their way to training: toxicity, repeated lines, near duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and keeps the columns of docs, but for the last, which returns
doc_id, n_tokens, ids, parity and round_trip. Ids are expected to tell documents apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, line_dedup, near_dup, sentencepiece_codec, toxicity
from orrery.llm.common import field, mark, saved, saved_alone, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5 stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model).where("score < 0.5").select("doc.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without passages of 50 words or more that stand earlier; n_chars follows the text."""
    cut = line_dedup.remove_passages(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest id and then hash of the text (shingles of four words, similarity 0.8 or more, as in op6_near_duplicates); null ids come last."""
    own = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(F.struct(*[field(c) for c in docs.columns]).alias("row"), own.alias("doc_id"), "text")
    found = saved(near_dup.near_duplicates(rows.select("doc_id", "text"), size=4, percent=80).select("doc_id", "n_shingles", "kept"))
    left = rows.drop("text").join(found.where("not kept").select("doc_id"), "doc_id", "left_anti")
    again = saved(found.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))  # id and text repeat
    if again.isEmpty():
        return left.select("row.*")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(again, "doc_id", "left_anti").select("row.*").union(one.select("row.*"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded_and_back(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]
#: SQL can express neither the conditional random field nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage but the last is written as Parquet and read again; what was written for the stages before goes then."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for _, stage in STAGES[:-1]:
        docs = saved_alone(stage(spark, docs, sf_dir), since)
    return STAGES[-1][1](spark, docs, sf_dir)
