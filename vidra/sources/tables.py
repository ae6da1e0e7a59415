"""The built tables as Parquet, with a format version that readers check, and the other sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidra.operators import lexicon, morphology

VERSION = {"lexicon": 1, "morph": 2, "freq": 1, "bigram": 1}
_READING = "struct<lemma: string, tags: array<string>, pos: string, gender: string, number: string, defn: string, person: int>"
SCHEMA = {
    "lexicon": "form string",
    "morph": f"surface string, readings array<{_READING}>",
    "freq": "word string, n bigint",
    "bigram": "prev string, word string, n bigint",
}
MAX_WORD_BYTES = 65_535


def write(table: DataFrame, kind: str, path: str) -> None:
    """Write a table, sorted within its files by its key, with its version as a column that Parquet stores once a page."""
    key = table.columns[:2] if kind == "bigram" else table.columns[:1]
    table.withColumn("format_version", F.lit(VERSION[kind])).sortWithinPartitions(*key).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read a table; a wrong schema or version is an error."""
    table = spark.read.parquet(path)
    want = T.StructType.fromDDL(SCHEMA[kind])
    found = {f.name: f.dataType.simpleString() for f in table.schema}
    if "format_version" not in found or any(found.get(f.name) != f.dataType.simpleString() for f in want):
        raise ValueError(f"{path} is no {kind} table")
    other = table.filter(F.col("format_version") != VERSION[kind]).limit(1).count()
    if other:
        raise ValueError(f"{path} has another version of the {kind} format")
    return table.select(*want.fieldNames())


def build_lexicon(forms: DataFrame, path: str) -> None:
    write(lexicon.build(forms), "lexicon", path)


def build_morphology(rows: DataFrame, path: str) -> None:
    write(morphology.build(rows), "morph", path)


def build_frequency(counts: DataFrame, path: str) -> None:
    write(counts.select("word", "n"), "freq", path)


def build_bigrams(counts: DataFrame, path: str) -> None:
    """Keys are lower-cased; a word of more than 65,535 bytes is an error."""
    low = counts.select(F.lower("prev").alias("prev"), F.lower("word").alias("word"), "n")
    fits = (F.octet_length("prev") <= MAX_WORD_BYTES) & (F.octet_length("word") <= MAX_WORD_BYTES)
    checked = low.withColumn("n", F.when(F.assert_true(fits, F.lit("word too long for the table")).isNull(), F.col("n")))
    write(checked.groupBy("prev", "word").agg(F.max("n").alias("n")), "bigram", path)


def as_json(diagnostics: DataFrame) -> DataFrame:
    """(doc_id, json) with the diagnostics of each document as a JSON array in document order."""
    from vidra.plans.checker import collected

    item = lambda d: F.struct(*(d[c].alias(c) for c in ("rule", "severity", "char_start", "char_end", "text", "message", "suggestions")))
    return collected(diagnostics).select("doc_id", F.to_json(F.transform("diagnostics", item)).alias("json"))


MARKS = {"error": "✗", "warning": "!", "info": "·"}


def report(diagnostics: DataFrame, words: int | None = None) -> Iterator[str]:
    """Lines for a console: a mark for the severity, the place, the text, the message and the proposals, and a footer."""
    from vidra.plans.checker import ordered

    n = 0
    for r in ordered(diagnostics).orderBy("doc_id", "place").toLocalIterator():
        n += 1
        proposed = f" → {', '.join(r['suggestions'])}" if r["suggestions"] else ""
        yield f"{MARKS[r['severity']]} {r['char_start']}-{r['char_end']} {r['rule']} {r['text']}: {r['message']}{proposed}"
    yield f"{n} problems" + (f" in {words} words" if words is not None else "")


def tsv(rows: DataFrame, path: str, *order) -> None:
    """One sorted tab-separated file without header."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path)


def export_words(words: DataFrame, path: str, header: str = "# Ignored words") -> None:
    """A header and one word a line."""
    first = words.sparkSession.createDataFrame([(0, header)], "o int, value string")
    first.unionByName(words.select(F.lit(1).alias("o"), F.col("word").alias("value")).distinct()).orderBy("o", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
