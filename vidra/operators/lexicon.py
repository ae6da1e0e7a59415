"""Word lookup, fuzzy search and ranking over a lexicon table (form)."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidra.functions import fixed
from vidra.functions import text as X
from vidra.operators import near
from vidra.sources.scratch import scratch, tidy

#: Rows and bytes (written as JSON) up to which a lookup table goes to every executor; above them Spark joins by a shuffle.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 2_000_000, 64 << 20
_decided: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def lookup(table: DataFrame, most: int = MAX_BROADCAST, most_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``table`` with a broadcast hint if it is measured to be small; it is measured once."""
    if table not in _decided:
        r = table.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).collect()[0]
        _decided[table] = F.broadcast(table) if r["n"] <= most and (r["bytes"] or 0) <= most_bytes else table
    return _decided[table]


def build(forms: DataFrame, column: str = "form") -> DataFrame:
    """The set of lower-cased forms."""
    return forms.select(F.lower(column).alias("form")).filter("form <> ''").distinct()


def contains(words: DataFrame, lexicon: DataFrame, word: str, flag: str) -> DataFrame:
    """``words`` with a flag: is the lower-cased word in the lexicon?"""
    known = lookup(lexicon).select(F.col("form").alias("_form"))
    return words.join(known, F.lower(word) == F.col("_form"), "left").withColumn(flag, F.col("_form").isNotNull()).drop("_form")


def compounds(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, compound) for the distinct ``word`` with a hyphen: is every part, none of them empty, known?"""
    parts = words.select("word").filter(F.contains("word", F.lit("-"))).distinct().select("word", F.explode(F.split("word", "-", -1)).alias("part"))
    return contains(parts, lexicon, "part", "known").groupBy("word").agg(F.every(F.col("known") & (F.col("part") != "")).alias("compound"))


def deletions(word: str, distance: int) -> F.Column:
    """The word (SQL) and all that is left of it after up to ``distance`` (1 or 2) deletions."""
    one = "transform(sequence(1, char_length({w})), i -> concat(left({w}, i - 1), substring({w}, i + 1)))"
    first = one.format(w="w")
    second = f"flatten(transform(dels, x -> IF(x = '', array(''), {one.format(w='x')})))"
    rest = f"concat(array(w), dels{', ' + second if distance > 1 else ''})"
    return F.expr(f"array_distinct(transform(array({word}), w -> transform(array(IF(w = '', array(''), {first})), dels -> {rest})[0])[0])")


def keys(lexicon: DataFrame, distance: int = 2) -> DataFrame:
    """(key, form): the deletion neighbourhood of a lexicon. Built once and written, it serves any number of searches."""
    return lexicon.select("form", F.explode(deletions("form", distance)).alias("key"))


def search(queries: DataFrame, lexicon: DataFrame, distance: int = 2, table: DataFrame | None = None) -> DataFrame:
    """(query, form, distance) of all forms but the query itself within an edit distance, by an equi-join of deletion neighbourhoods: hashed ones, or those of ``table`` as they were written.

    Queries have 1 to 32 characters; others find nothing.
    """
    asked = queries.select("query").filter(F.char_length("query").between(1, fixed.MAX_QUERY)).distinct()
    if table is None:
        pairs = near.pairs(asked, lexicon, distance, fixed.MAX_QUERY)
    else:
        pairs = asked.select("query", F.explode(deletions("query", distance)).alias("key")).join(table, "key")
    # Pairs that share a key can be twice as far apart: those (-1) go before pairs are dealt out to be told apart, by query, as readers want them.
    hits = pairs.select("query", "form", F.levenshtein("query", "form", distance).alias("distance")).filter("distance > 0")
    return hits.repartition("query").distinct()


def suggest(queries: DataFrame, lexicon: DataFrame, limit: int, table: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(query, form, cost, place): the best ``limit`` forms of each query (lower case), best first.

    All forms within the distance count; with ``first``, of each distance only the first ``first`` in byte order.
    """
    hits = search(queries, lexicon, 2, table)
    if first is not None:
        alphabetical = W.partitionBy("query").orderBy("form")
        near = F.count_if(F.col("distance") == 1).over(alphabetical.rowsBetween(W.unboundedPreceding, W.currentRow))
        hits = hits.withColumns({"n": F.row_number().over(alphabetical), "m": near}).filter((F.col("n") <= first) | ((F.col("distance") == 1) & (F.col("m") <= first)))
    both = hits.select("query", "form", X.weighted_cost("query", "form").alias("cost"))
    other = F.substring("query", 1, 1) != F.substring("form", 1, 1)
    best = W.partitionBy("query").orderBy("cost", other, F.abs(F.char_length("query") - F.char_length("form")), "form")
    return both.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)


def ranked(asked: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, bigram: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """(query, prev, next, suggestions) for the distinct rows (query, prev, next), lower case, prev and next null at the ends.

    Without tables, the first five as ``suggest`` ranks them; with them, of its first twenty the
    five with the most pairs with the neighbours, then the most frequent, then the cheapest.
    """
    most = fixed.MAX_SUGGESTIONS
    asked = asked.select("query", "prev", "next").distinct()
    if freq is None and bigram is None:
        best = suggest(asked, lexicon, 4 * most, table).filter(F.col("place") <= most)
        found = best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "form"))), lambda s: s["form"]).alias("suggestions"))
        return asked.join(found, "query", "left").select("query", "prev", "next", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
    # As files, so that what the search has shuffled goes before the joins below shuffle more.
    path = scratch(asked.sparkSession, "suggested")
    suggest(asked, lexicon, 4 * most, table).select("query", "form", "cost").write.parquet(path)
    tidy(asked.sparkSession)
    hits = asked.join(asked.sparkSession.read.schema("query string, form string, cost int").parquet(path), "query")
    bi, fr = F.lit(0), F.lit(0)
    if bigram is not None:
        small = lookup(bigram)
        hits = hits.join(small.toDF("prev", "form", "left_n"), ["prev", "form"], "left").join(small.toDF("form", "next", "right_n"), ["form", "next"], "left")
        bi = F.coalesce("left_n", F.lit(0)) + F.coalesce("right_n", F.lit(0))
    if freq is not None:
        hits = hits.join(lookup(freq).toDF("form", "own_n"), "form", "left")
        fr = F.coalesce("own_n", F.lit(0))
    hits = hits.select("query", "prev", "next", F.struct((-bi).alias("bi"), (-fr).alias("fr"), "cost", "form").alias("k"))
    found = hits.groupBy("query", "prev", "next").agg(F.slice(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["form"]), 1, most).alias("suggestions"))
    found = found.toDF("_q", "_p", "_n", "suggestions")
    same = F.col("query").eqNullSafe(F.col("_q")) & F.col("prev").eqNullSafe(F.col("_p")) & F.col("next").eqNullSafe(F.col("_n"))
    return asked.join(found, same, "left").select("query", "prev", "next", F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))
