"""Documents to token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidra.functions import text as X

FIELDS = ["idx", "text", "char_start", "char_end", "byte_start", "byte_end", "kind"]


def tokens(docs: DataFrame, together: bool = False) -> DataFrame:
    """(doc_id, idx, text, char_start, char_end, byte_start, byte_end, kind), one row a token.

    ``together`` deals the documents by doc_id before they are cut up: later windows and joins by
    doc_id then need no exchange of tokens. Null and empty texts have no tokens.
    """
    rows = docs.select("doc_id", "text")
    if together:
        rows = rows.repartition("doc_id")
    return rows.select("doc_id", F.explode(X.tokenize("text")).alias("t")).select("doc_id", *(F.col(f"t.{f}").alias(f) for f in FIELDS))


def words_beside(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text, char_start, char_end, prev, next, latin, in_run), one row a word token.

    prev and next are the words before and after it, lower case; ``latin`` is a word of Latin
    letters only, ``in_run`` one beside another. Neighbours are taken from the document's own
    array, before it is cut up: no shuffle, no sort, and streams can do it.
    """
    return beside(docs).withColumns(
        {"char_start": F.col("char_end") - F.char_length("text"), "prev": F.lower(X.trimmed("prev")), "next": F.lower(X.trimmed("next")), "latin": X.is_all_latin("text"), "in_run": in_run()}
    ).select("doc_id", "idx", "text", "char_start", "char_end", "prev", "next", "latin", "in_run")


def beside(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text, char_end, prev, next), one row a word token; prev and next as they stand, with white space before them, so that nothing is worked out for words that go."""
    rows = docs.select("doc_id", F.explode(X.placed_words("text")).alias("w"))
    return rows.select("doc_id", "w.idx", X.trimmed("w.unit").alias("text"), "w.char_end", "w.prev", "w.next")


def in_run() -> Column:
    """Is the word, of ``beside``, a Latin one beside another?"""
    near = lambda c: F.coalesce(X.is_all_latin(c), F.lit(False))
    return X.is_all_latin("text") & (near("prev") | near("next"))
