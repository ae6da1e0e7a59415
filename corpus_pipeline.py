"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm import bpe, decontaminate, line_dedup, ngram_jaccard, perplexity
from vidra.llm.shared import count_upto, keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Perplexity, BM25 and byte pairs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or leave their language's perplexity band go.

    Null and empty texts have no words and so go; a null language has a band of its own; equal
    rows stay or go alike, whatever their ids.
    """
    return perplexity.keep_good(spark, docs.select(*COLUMNS))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that are left without a word, and n_chars follows the text.

    Null and empty texts, which have no lines, stay; rows that repeat an id and a text stay alike;
    null ids come last in the order that says which occurrence of a line is the first.
    """
    left = line_dedup.dedup(spark, docs.select(*COLUMNS)).filter("n_exact + n_near < n_lines or n_lines = 0")
    n_chars = F.when(F.col("n_exact") + F.col("n_near") > 0, F.char_length("doc.text")).otherwise(F.col("doc.n_chars")).cast("long")
    return left.select(*(n_chars.alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: one with the smallest id; null ids come last.

    Null and empty texts, which are near to nothing, stay. Ids can be null or repeated, so rows are
    told apart by a key that is written once.
    """
    docs = keep(spark, docs.select(*COLUMNS).withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = keep(spark, ngram_jaccard.components(spark, docs.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")), "near-copies")
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), "_key")
    shared = found.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_group")
    grouped = found.join(shared, "_group", "left_semi").join(docs.select("doc_id", "_key"), "_key")
    first = grouped.groupBy("_group").agg(F.min(place)["_key"].alias("_first"))
    others = keep(spark, grouped.join(first, "_group").filter("_key <> _first").select("_key"), "others")
    if count_upto(others, ngram_jaccard.MAX_BROADCAST_IDS) <= ngram_jaccard.MAX_BROADCAST_IDS:
        others = F.broadcast(others)
    return docs.join(others, "_key", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.keep_clean(spark, docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token ids of what is left; null and empty texts have no ids."""
    import public_tokenizers

    return bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines_once),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
