"""The morphology table: surface -> readings with their features, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidra.functions import fixed
from vidra.operators.lexicon import lookup

MAX_READINGS = 255


def _first(tags: Column, table: dict[str, str]) -> Column:
    """The feature of the first tag, in tag order, that has one."""
    keyed = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(F.filter(F.transform(tags, lambda t: F.try_element_at(keyed, t)), lambda x: x.isNotNull()), F.lit(1))


def reading(lemma: str = "lemma", tags: str = "tags") -> Column:
    """A reading with its derived features."""
    t = F.col(tags)
    person = F.when(F.array_contains(t, "p1"), 1).when(F.array_contains(t, "p2"), 2).when(F.array_contains(t, "p3"), 3)
    return F.struct(
        F.col(lemma).alias("lemma"), t.alias("tags"), _first(t, fixed.POS).alias("pos"), _first(t, fixed.GENDER).alias("gender"),
        _first(t, fixed.NUMBER).alias("number"), _first(t, fixed.DEFINITENESS).alias("defn"), person.alias("person"),
    )


def build(rows: DataFrame) -> DataFrame:
    """morph(surface, readings) of rows (surface, lemma, tags, place): each reading once, in order of its first place, of any type that can be ordered."""
    once = rows.groupBy("surface", "lemma", "tags").agg(F.min("place").alias("place"))
    lists = once.select("surface", F.struct("place", reading().alias("r")).alias("x")).groupBy("surface").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lists.select("surface", F.slice(F.transform("xs", lambda x: x["r"]), 1, MAX_READINGS).alias("readings"))


def participles(morph: DataFrame) -> DataFrame:
    """(lemma, forms): the l-participle surfaces of each lemma in byte order, each with all its readings."""
    rows = morph.select("surface", "readings", F.explode("readings").alias("r")).filter(F.array_contains("r.tags", "lp"))
    return rows.select("r.lemma", F.struct("surface", "readings").alias("f")).distinct().groupBy("lemma").agg(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["surface"] < b["surface"], -1).when(a["surface"] > b["surface"], 1).otherwise(0)).alias("forms"))


def by_word(words: DataFrame, table: DataFrame, word: str, *columns: str) -> DataFrame:
    """``words`` with ``columns`` of the table's row for a word: of the exact surface, or, only if that is absent, of the lower-cased one; else null."""
    small = lookup(table)
    exact = small.select(F.col("surface").alias("_s1"), F.struct(*columns).alias("_r1"))
    lower = small.select(F.col("surface").alias("_s2"), F.struct(*columns).alias("_r2"))
    out = words.join(exact, F.col(word) == F.col("_s1"), "left")
    # Only what is still without a row, and is not lower case, is looked up again.
    out = out.join(lower, F.when(F.col("_s1").isNull() & (F.lower(word) != F.col(word)), F.lower(word)) == F.col("_s2"), "left")
    return out.select(*words.columns, *(F.coalesce(F.col("_r1")[c], F.col("_r2")[c]).alias(c) for c in columns))


def analyze(words: DataFrame, morph: DataFrame, word: str, name: str = "readings") -> DataFrame:
    """``words`` with the readings of a word, as ``by_word`` finds them; empty if there are none."""
    found = by_word(words, morph, word, "readings")
    return found.withColumn("readings", F.coalesce("readings", F.array().cast(morph.schema["readings"].dataType))).withColumnRenamed("readings", name)


def summary(morph: DataFrame) -> DataFrame:
    """(forms, lemmas)."""
    return morph.select("surface", F.explode("readings").alias("r")).agg(F.count_distinct("surface").alias("forms"), F.count_distinct("r.lemma").alias("lemmas"))


def dump(words: DataFrame, morph: DataFrame, word: str = "word") -> DataFrame:
    """(word, lemma, tags joined by dots), one row a reading; nulls for words without one."""
    return analyze(words, morph, word).select(word, F.explode_outer("readings").alias("r")).select(word, "r.lemma", F.array_join("r.tags", ".").alias("tags"))


# Predicates over arrays of readings; a null or empty array is a word without analysis.


def has(r: Column, tag: str) -> Column:
    return F.array_contains(r["tags"], tag)


def of(readings: Column, *pos: str) -> Column:
    return F.filter(readings, lambda r: r["pos"].isin(*pos))


def some(readings: Column, test) -> Column:
    return F.coalesce(F.exists(readings, lambda r: F.coalesce(test(r), F.lit(False))), F.lit(False))


def every(readings: Column, test) -> Column:
    """Not empty, and true of all."""
    return (F.size(readings) > 0) & F.coalesce(F.forall(readings, lambda r: F.coalesce(test(r), F.lit(False))), F.lit(False))


def is_definite(r: Column) -> Column:
    return F.coalesce(r["defn"].isin("def", "prx", "dst"), F.lit(False))


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | (a == "C") | (b == "C")


def first(readings: Column) -> Column:
    return F.try_element_at(readings, F.lit(1))


def definite(readings: Column, pos: str) -> Column:
    """struct<gender, number> of the first reading of a part of speech, if all of them are definite."""
    own = of(readings, pos)
    return F.when(every(own, is_definite), F.struct(first(own)["gender"].alias("gender"), first(own)["number"].alias("number")))


def forms(readings: Column, pos: str) -> Column:
    """array<struct<gender, number>> of the readings of a part of speech; null if one lacks a feature or is a count form, or there are none."""
    own = of(readings, pos)
    whole = every(own, lambda r: r["gender"].isNotNull() & r["number"].isNotNull() & (r["number"] != "ct"))
    return F.when(whole, F.transform(own, lambda r: F.struct(r["gender"].alias("gender"), r["number"].alias("number"))))


def agree(a: Column, b: Column) -> Column:
    """Does some (gender, number) of one list agree with one of the other?"""
    return F.exists(a, lambda x: F.exists(b, lambda y: compatible(x["gender"], y["gender"]) & (x["number"] == y["number"])))


def subject(readings: Column) -> Column:
    """struct<person, number> of a nominative pronoun without a clitic reading, if its readings agree."""
    own = F.filter(readings, lambda r: F.coalesce((r["pos"] == "pronoun") & has(r, "nom") & r["person"].isNotNull() & r["number"].isNotNull(), F.lit(False)))
    kinds = F.array_distinct(F.transform(own, lambda r: F.struct(r["person"].alias("person"), r["number"].alias("number"))))
    return F.when(~some(readings, lambda r: has(r, "clt")) & (F.size(kinds) == 1), first(kinds))


def doubling_clitic(readings: Column) -> Column:
    """го, ја or ги, if every reading asks for the same."""
    each = F.transform(
        readings,
        lambda r: F.when(r["gender"].isNull(), None).when(r["number"] == "pl", "ги").when((r["number"] == "sg") & (r["gender"] == "F"), "ја").when((r["number"] == "sg") & r["gender"].isin("M", "N"), "го"),
    )
    kinds = F.array_distinct(each)
    return F.when(F.size(kinds) == 1, first(kinds))


def doubling_thing(readings: Column) -> Column:
    """A definite noun that is not a time, whose readings ask for one clitic."""
    thing = every(readings, lambda r: (r["pos"] == "noun") & is_definite(r)) & ~some(readings, lambda r: r["lemma"].isin(fixed.TIME_NOUNS))
    return thing & doubling_clitic(readings).isNotNull()


def cardinal(readings: Column) -> Column:
    return every(readings, lambda r: (r["pos"] == "numeral") & r["number"].isNull() & ~has(r, "ma") & ~has(r, "apprx"))


def plural(readings: Column) -> Column:
    return every(readings, lambda r: (r["pos"] == "noun") & (r["number"] == "pl") & ~is_definite(r))


def _pronoun(tag: str):
    return lambda r: (r["pos"] == "pronoun") & has(r, tag)


def _full(r: Column) -> Column:
    return r["gender"].isNotNull() & r["number"].isNotNull()


def _able(readings: Column) -> Column:
    verbs = of(readings, "verb")
    return some(verbs, lambda r: has(r, "tv")) & every(verbs, lambda r: r["person"] < 3)


#: What the grammar rules ask of a word's readings, a bit each.
FEATURES = {
    "read": lambda rs: F.size(rs) > 0, "definite_adjective": lambda rs: definite(rs, "adjective").isNotNull(), "definite_noun": lambda rs: definite(rs, "noun").isNotNull(),
    "accusative": lambda rs: some(rs, _pronoun("acc")), "dative": lambda rs: some(rs, _pronoun("dat")), "all_pronoun": lambda rs: every(rs, lambda r: r["pos"] == "pronoun"),
    "verb": lambda rs: some(rs, lambda r: r["pos"] == "verb"), "noun": lambda rs: some(rs, lambda r: r["pos"] == "noun"), "adjective": lambda rs: some(rs, lambda r: r["pos"] == "adjective"),
    "some_definite": lambda rs: some(rs, is_definite), "definite_among_adjectives": lambda rs: some(rs, lambda r: (r["pos"] == "adjective") & is_definite(r)),
    "nominative": lambda rs: some(rs, lambda r: _pronoun("nom")(r) & _full(r)), "participle": lambda rs: some(rs, lambda r: has(r, "lp") & _full(r)),
    "all_adjective": lambda rs: every(rs, lambda r: r["pos"] == "adjective"), "adjective_forms": lambda rs: forms(rs, "adjective").isNotNull(), "noun_forms": lambda rs: forms(rs, "noun").isNotNull(),
    "subject": lambda rs: subject(rs).isNotNull(), "clitic": lambda rs: some(rs, lambda r: has(r, "clt") | has(r, "ref")), "accusative_clitic": lambda rs: some(rs, lambda r: has(r, "clt") & has(r, "acc")),
    "cardinal": cardinal, "plural": plural, "doubling": _able, "doubled": doubling_thing,
}


def features(morph: DataFrame) -> DataFrame:
    """(surface, bits) of a morphology table."""
    bits = F.lit(0).cast("long")
    for i, test in enumerate(FEATURES.values()):
        bits = bits + F.when(F.coalesce(test(F.col("readings")), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return morph.select("surface", bits.alias("bits"))


def feature(bits: Column, *names: str) -> Column:
    """Are all these bits set? None is, of a word without readings."""
    mask = sum(1 << list(FEATURES).index(n) for n in names)
    return F.coalesce(bits, F.lit(0).cast("long")).bitwiseAND(F.lit(mask).cast("long")) == mask
