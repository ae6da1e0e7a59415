"""Evaluation reports over diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.functions import fixed
from vidra.functions import text as X


def flag_rate(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(words, flags, rate in percent); words are what white space separates."""
    words = docs.agg(F.coalesce(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))), F.lit(0)).alias("words"))
    flags = diagnostics.agg(F.count(F.lit(1)).alias("flags"))
    return words.join(F.broadcast(flags)).select("words", "flags", (100 * F.col("flags") / F.greatest("words", F.lit(1))).alias("rate"))


def by_rule(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def top_words(diagnostics: DataFrame, limit: int = 15) -> DataFrame:
    """The unknown words flagged most often."""
    return diagnostics.filter("rule = 'MK_SPELL'").groupBy("text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "text").limit(limit)


def shape(diagnostics: DataFrame) -> DataFrame:
    """Of unknown words: how many, and what percentage is capitalised, has three characters at most, a hyphen, a digit."""
    rows = diagnostics.filter("rule = 'MK_SPELL'")
    share = lambda c: 100 * F.count_if(c) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return rows.agg(
        F.count(F.lit(1)).alias("spell"), share(X.starts_upper("text")).alias("capitalized"), share(F.char_length("text") <= 3).alias("short"),
        share(F.contains("text", F.lit("-"))).alias("with_hyphen"), share(X.has_digit("text")).alias("with_digit"),
    )


def typos(freq: DataFrame, words: int = 3000, seed: int = 7) -> DataFrame:
    """(word, typo): one deletion, substitution or transposition in each of the most frequent words of five letters or more, drawn by a digest of word and seed."""
    top = freq.orderBy(F.desc("n"), "word").limit(words).filter(F.char_length("word") >= 5)
    drawn = F.md5(F.concat("word", F.lit(f" {seed}")))
    h = lambda k: F.conv(F.substring(drawn, 6 * k - 5, 6), 16, 10).cast("int")
    n = F.char_length("word")
    letter = F.substring(F.lit(fixed.LETTERS), h(3) % len(fixed.LETTERS) + 1, F.lit(1))
    rows = top.select("word", (h(1) % n).alias("i"), F.least(h(1) % n, n - 2).alias("j"), (h(2) % 3).alias("kind"), letter.alias("letter"), n.alias("n"))
    cut = lambda a, m: F.substring("word", a, m)
    typo = (
        F.when(F.col("kind") == 0, F.concat(cut(F.lit(1), F.col("i")), cut(F.col("i") + 2, F.col("n"))))
        .when(F.col("kind") == 1, F.concat(cut(F.lit(1), F.col("i")), "letter", cut(F.col("i") + 2, F.col("n"))))
        .otherwise(F.concat(cut(F.lit(1), F.col("j")), cut(F.col("j") + 2, F.lit(1)), cut(F.col("j") + 1, F.lit(1)), cut(F.col("j") + 3, F.col("n"))))
    )
    return rows.select("word", typo.alias("typo")).filter("typo <> word").groupBy("typo").agg(F.min("word").alias("word")).select("word", "typo")


def missed(typo_rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(typos, missed, rate): typos that no diagnostic names."""
    flagged = diagnostics.select(F.col("text").alias("typo")).distinct().withColumn("hit", F.lit(1))
    return typo_rows.join(flagged, "typo", "left").agg(F.count(F.lit(1)).alias("typos"), F.count_if(F.col("hit").isNull()).alias("missed")).withColumn("rate", 100 * F.col("missed") / F.greatest("typos", F.lit(1)))


def gate(spark: SparkSession, probe: DataFrame, checker) -> DataFrame:
    """(rows, targets, uncovered, false_positives, hits, recall): the correct column, read as one text, must be silent; of the other texts a finding must name the wrong token."""
    rows = probe.orderBy("place").collect()  # a labelled probe: tens of rows by nature
    joined = spark.createDataFrame([(0, "\n".join(r["correct"] for r in rows))], "doc_id long, text string")
    wrong = checker.check(joined, suggestions=False).count()
    targets = probe.filter("family not in ('-', 'clean')").select(F.col("place").alias("doc_id"), F.col("perturbed").alias("text"), "wrong_token")
    found = checker.check(targets, suggestions=False).select("doc_id", F.lower("text").alias("t"))
    hits = targets.join(found, "doc_id").filter(F.contains("t", F.lower("wrong_token"))).select("doc_id").distinct().count()
    n = targets.count()
    uncovered = sum(r["family"] == "-" for r in rows)
    return spark.createDataFrame([(len(rows), n, uncovered, wrong, hits, 100.0 * hits / max(n, 1))], "`rows` long, targets long, uncovered long, false_positives long, hits long, recall double")


def positions(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, word, at, rule): where, among the words that white space separates, the text of a finding first stands; null if nowhere."""
    words = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("at", "word")).groupBy("doc_id", "word").agg(F.min("at").alias("at"))
    return diagnostics.select("doc_id", F.col("text").alias("word"), "rule").join(words, ["doc_id", "word"], "left")
