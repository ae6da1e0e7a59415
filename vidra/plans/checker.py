"""The checker: documents in, diagnostics out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidra.operators import grammar, lexicon, ngrams, spelling

COLUMNS = ["doc_id", "rule", "severity", "char_start", "char_end", "text", "message", "suggestions"]


class Checker:
    """Spelling over a lexicon; grammar, frequency and pair ranking where their tables are given."""

    def __init__(self, lexicon: DataFrame, morph: DataFrame | None = None, freq: DataFrame | None = None, bigram: DataFrame | None = None):
        self.lexicon, self.morph, self.freq, self.bigram = lexicon, morph, freq, bigram

    def with_morphology(self, morph: DataFrame) -> Checker:
        return Checker(self.lexicon, morph, self.freq, self.bigram)

    def with_frequency(self, freq: DataFrame) -> Checker:
        return Checker(self.lexicon, self.morph, freq, self.bigram)

    def with_bigram(self, bigram: DataFrame) -> Checker:
        return Checker(self.lexicon, self.morph, self.freq, bigram)

    @property
    def degraded(self) -> list[str]:
        """The optional tables that are missing."""
        return [name for name in ("morph", "freq", "bigram") if getattr(self, name) is None]

    def check(self, docs: DataFrame, suggestions: bool = True, cap: int | None = None) -> DataFrame:
        """Diagnostics of documents (doc_id, text), with rule_order, which breaks ties of equal spans; ``cap`` limits the code points that are checked, as an editor does, and is off by default."""
        if cap is not None:
            docs = docs.withColumn("text", F.left("text", F.lit(cap)))
        out = spelling.check(docs, self.lexicon, self.freq, self.bigram, suggestions)
        return out if self.morph is None else out.unionByName(grammar.check(docs, self.lexicon, self.morph))

    def suggest_next(self, asked: DataFrame, limit: int = 3) -> DataFrame:
        """Completions of (prev, prefix); none without a table of pairs."""
        if self.bigram is None:
            return asked.select("prev", "prefix").limit(0).selectExpr("prev", "prefix", "prefix AS word", "0L AS n", "0 AS place")
        return ngrams.top_next(asked, self.bigram, limit)


def ordered(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics with their place in the document."""
    by = W.partitionBy("doc_id").orderBy("char_start", "char_end", "rule_order")
    return diagnostics.withColumn("place", F.row_number().over(by))


def collected(diagnostics: DataFrame) -> DataFrame:
    """(doc_id, diagnostics) in document order, as an array."""
    item = F.struct("char_start", "char_end", "rule_order", *(c for c in COLUMNS[1:] if c not in ("char_start", "char_end")))
    return diagnostics.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("diagnostics"))
