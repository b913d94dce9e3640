"""Queries of the corpus operators: each derives the contract's columns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm import chains, licenses, media, mixing, near, packing, pages, quality, repeats, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    good = quality.trusted_labels(_read(spark, sf_dir, "labels", "doc_id", "quality"))
    out = quality.quality_rules(docs, good)
    return out.select(F.col("_row.doc_id").alias("doc_id"), *[c for c in out.columns if c != "_row"])


def license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id").withColumn("spans", F.to_json("spans"))


def progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return media.describe(stored).withColumnRenamed("id", "doc_id")


def site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    out = toxicity.classify(docs, _read(spark, sf_dir, "labels", "doc_id", *toxicity.CATEGORIES))
    return out.withColumnRenamed("id", "doc_id")


def collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chains.fuzzy_passages(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id").withColumns({c: F.to_json(c) for c in ("passages", "own")})


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer())


def hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id")


def prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"))
    left = F.length("kept").cast("long")
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        F.col("_row.doc_id").alias("doc_id"),
        (left + cut).alias("n_bytes"),
        cut.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def mixing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op2_license_diagonals": license_diagonals,
        "op1_collinear_chains": collinear_chains,
        "op3_site_style_tree": site_style_tree,
        "op4_classifier_chain": classifier_chain,
        "op8_progressive_jpeg": progressive_jpeg,
        "op5_hierarchical_packing": packing_tiers,
        "op6_hyperminhash": hyperminhash,
        "op7_prefix_free_parsing": prefix_free,
        "op9_subset_sum_mixing": mixing_budget,
        "op10_ngram_llr": quality_llr,
    }


def oracle_sql() -> dict[str, str]:
    return {}
