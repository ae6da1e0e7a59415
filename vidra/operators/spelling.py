"""The spelling pass: at most one diagnostic a word, the first rule that matches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidra.functions import fixed
from vidra.functions import text as X
from vidra.operators import cut
from vidra.operators import lexicon as L


def check(docs: DataFrame, lexicon: DataFrame, freq: DataFrame | None = None, bigram: DataFrame | None = None, suggestions: bool = True) -> DataFrame:
    """Diagnostics (doc_id, rule, rule_order, severity, char_start, char_end, text, message, suggestions) of documents (doc_id, text)."""
    # Rows are the distinct words of a batch until it is known which of them are flagged.
    rows = cut.places(docs, neighbours=suggestions and bigram is not None).filter(~X.has_digit("text"))
    # Words of plain letters, nearly all, need no more than this test.
    odd = ~F.col("text").rlike(f"^[{X.MK}]*$")
    rows = rows.withColumns({"issue": F.when(odd, X.script_issue("text")), "fixed": F.when(odd, X.normalize("text")).otherwise(F.col("text")), "low": F.lower("text")})
    # Only odd words can be rewritten; the others have no key here and are not looked up again.
    rows = L.contains(L.contains(rows, lexicon, "low", "known").withColumn("_odd", F.when(odd, F.col("fixed"))), lexicon, "_odd", "fixed_known").drop("_odd")
    pairs = F.create_map(*(F.lit(x) for kv in fixed.SERBIAN.items() for x in kv))
    rows = rows.withColumn("serb", F.try_element_at(pairs, F.col("low")))
    rule = (
        F.when(F.col("issue") == "ForeignCyrillic", "MK_FOREIGN_CYRILLIC").when(F.col("issue") == "Homoglyph", "MK_HOMOGLYPH")
        .when(odd & X.is_all_latin("text"), F.when((F.char_length("text") >= fixed.MIN_LATIN) & ~X.is_acronym("text"), "MK_LATIN_TEXT"))
        .when(F.col("serb").isNotNull() & ~(F.col("known") & X.starts_upper("text")), "MK_SERBIANISM")
        .when(F.col("known") | X.is_acronym("text") | (F.char_length("text") == 1) | (F.col("low") == "нај"), None)
        .otherwise("MK_SPELL")
    )
    rows = rows.withColumn("rule", rule).filter("rule is not null")
    # What is flagged is read three times below; it is a small share of the words. It is worked out
    # here, as readers that begin together on several executors would each do it.
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    lists = {"doc_ids": "doc_id", "ends": "char_end", "in_run": "in_run", "prevs": "prev", "nexts": "next"}
    lists = {a: b for a, b in lists.items() if a in rows.columns}

    def spread(words: DataFrame) -> DataFrame:
        """A row a place; Latin words only where they are beside another."""
        out = words.select(*(c for c in words.columns if c not in lists), F.explode(F.arrays_zip(*lists)).alias("_at"))
        out = out.select(*(c for c in out.columns if c != "_at"), *(F.col(f"_at.{a}").alias(b) for a, b in lists.items())).filter((F.col("rule") != "MK_LATIN_TEXT") | F.col("in_run"))
        return out.withColumns({"char_start": F.col("char_end") - F.char_length("text")} | {c: F.lower(c) for c in ("prev", "next") if c in out.columns})

    # Each join moves only the rows that it is about, and words before their places: most flagged words need none.
    spell, latin, hyphened = F.col("rule") == "MK_SPELL", F.col("rule") == "MK_LATIN_TEXT", F.contains("text", F.lit("-"))
    # Compounds: only unknown words with a hyphen are looked up, by part.
    whole = L.compounds(rows.filter(spell).select(F.col("text").alias("word")), lexicon).filter("compound").select(F.col("word").alias("text"))
    unknown = spread(rows.filter(spell & ~hyphened).unionByName(rows.filter(spell & hyphened).join(whole, "text", "left_anti").select(rows.columns)))
    # Latin words: distinct words are read, and the readings looked up.
    beside = rows.filter(latin & F.array_contains("in_run", True))
    read = beside.select("text").distinct().select("text", F.posexplode(X.candidates("text")).alias("at", "r"))
    read = L.contains(read, lexicon, "r", "ok").filter("ok").groupBy("text").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda s: s["r"]), 1, fixed.MAX_SUGGESTIONS).alias("readings"))
    none = F.array().cast("array<string>")
    if suggestions:
        asked = unknown.select(F.col("low").alias("query"), *(F.col(c) if bigram is not None else F.lit(None).cast("string").alias(c) for c in ("prev", "next")))
        found = L.ranked(asked, lexicon, freq, bigram).toDF("_q", "_p", "_n", "suggestions")
        on = [F.col("low") == F.col("_q")]
        if bigram is not None:
            on += [F.col("prev").eqNullSafe(F.col("_p")), F.col("next").eqNullSafe(F.col("_n"))]
        unknown = unknown.join(found, on, "left").drop("_q", "_p", "_n")
    parts = (unknown, spread(beside.join(read, "text")), spread(rows.filter(~spell & ~latin)))
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    if not suggestions:
        rows = rows.withColumn("suggestions", none)
    severity = (
        F.when(F.col("issue").isNotNull(), F.when(F.col("fixed_known"), "error").otherwise("warning")).when(F.col("rule") == "MK_LATIN_TEXT", "warning")
        .when(F.col("rule") == "MK_SERBIANISM", F.when(F.col("known"), "info").otherwise("warning")).otherwise("error")
    )
    message = F.lit("")
    for r in fixed.RULES:
        text = F.replace(F.lit(r[5]), F.lit("{}"), F.col("serb")) if "{}" in r[5] else F.lit(r[5])
        message = F.when(F.col("rule") == r[0], text).otherwise(message)
    proposed = (
        F.when(F.col("issue").isNotNull(), F.when(F.col("fixed") != F.col("text"), F.array("fixed")).otherwise(none)).when(F.col("rule") == "MK_LATIN_TEXT", F.col("readings"))
        .when(F.col("rule") == "MK_SERBIANISM", F.array(X.match_case("text", "serb"))).otherwise(F.coalesce("suggestions", none))
    )
    return rows.select("doc_id", "rule", F.lit(0).alias("rule_order"), severity.alias("severity"), "char_start", "char_end", "text", message.alias("message"), proposed.alias("suggestions"))
