"""Corpus pipeline: rules, near copies, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet and reads it again as the next one's documents. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import entries, mixing, near, packing, quality, repeats
from boxloom.llm.common import Scratch, small_enough


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go.

    Null and empty texts go (fewer than ten words). Rows with a null id are judged like others,
    repeated rows each. Without labels only the base rules reject. An empty table stays empty.
    """
    good = quality.trusted_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.quality_rules(docs, good)
    # a filter on "kept" would be pushed down and copy the measures' expressions over and over
    rows = out.select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return rows.where(F.col("_row").isNotNull()).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays.

    Documents without words are no copies and stay; so do rows with a null id. Rows that
    repeat the smallest id stay all. An empty table stays empty; other columns are kept as they are.
    """
    found = near.near_duplicates(docs, shingle=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("id").alias("doc_id")).distinct()
    gone = Scratch(spark, "gone").keep(gone, "gone")
    gone = F.broadcast(gone) if small_enough(gone, near.BROADCAST_IDS) else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; a document that a cut has left without a word goes.

    The parts of a character that a cut has split go with it. Documents without a cut are
    untouched, null and empty texts too. n_chars follows the text. An empty table stays empty.
    """
    out = repeats.remove_repeats(docs, characters=True)
    cut = F.size("spans") > 0
    out = out.withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("_row.text")))
    out = out.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.when(cut, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Documents without words have no share and go. A null source is a source of its own; ties
    are settled by a hash of the id. An empty table stays empty.
    """
    out = mixing.mix(docs).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def packing_tiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a document that was taken twice is packed twice.

    Null and empty texts are the end id alone. An empty table gives no pieces.
    """
    return packing.pack(docs, entries.tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("source_mix", source_mix),
    ("packing", packing_tiers),
]

#: Components, suffix order and knapsacks are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
