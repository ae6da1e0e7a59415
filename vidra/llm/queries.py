"""The registered queries of the subpackage: each takes (spark, sf_dir) and reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.warc import round_trip

    return round_trip(spark, _table(spark, sf_dir, "pages"))

def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.quality_fm import score

    return score(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.perplexity import verdicts

    return verdicts(spark, _table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.pii import find

    return find(_table(spark, sf_dir, "documents"))


def op5_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.langid import predict

    return predict(spark, _table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.line_dedup import report

    return report(spark, _table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.ngram_jaccard import components

    return components(spark, _table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.decontaminate import matches

    return matches(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vidra.llm.bpe import encode

    return encode(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vidra.llm.licenses import scan

    return scan(spark, _table(spark, sf_dir, "documents"))


def base_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express, from its own rows."""
    return op3_perplexity(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express, from its own rows."""
    return op4_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def base_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express, from its own rows."""
    return op10_license_templates(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith(("op", "base_op"))}
