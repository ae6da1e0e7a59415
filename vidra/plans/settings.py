"""User settings over diagnostics, and applying fixes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.functions import fixed

DEFAULTS = {"enabled": True, "delayMs": 700, "rulesOff": [], "userWords": [], "siteOff": []}


def normalise(raw: Any) -> dict:
    """Settings of the right types; anything else is its default. Delays lie between 0 and 5000, words are lower case."""
    raw = raw if isinstance(raw, dict) else {}
    strings = lambda x: [s for s in x if isinstance(s, str)] if isinstance(x, list) else []
    delay = raw.get("delayMs")
    number = isinstance(delay, (int, float)) and not isinstance(delay, bool) and delay == delay
    return {
        "enabled": raw["enabled"] if isinstance(raw.get("enabled"), bool) else True,
        "delayMs": int(min(max(delay, 0), 5000)) if number else DEFAULTS["delayMs"],
        "rulesOff": strings(raw.get("rulesOff")),
        "userWords": [w.lower() for w in strings(raw.get("userWords"))],
        "siteOff": strings(raw.get("siteOff")),
    }


def rules(spark: SparkSession) -> DataFrame:
    """The catalogue: (rule, rule_order, group, name, description)."""
    return spark.createDataFrame([r[:5] for r in fixed.RULES], "rule string, rule_order int, `group` string, name string, description string")


def find_rules(spark: SparkSession, text: str = "", group: str | None = None) -> DataFrame:
    """Rules whose name, description or id contains a text, of one group or all."""
    out = rules(spark)
    low = text.lower()
    out = out.filter(F.contains(F.lower(F.concat_ws(" ", "rule", "name", "description")), F.lit(low)))
    return out if group is None else out.filter(F.col("group") == group)


def apply(diagnostics: DataFrame, settings: dict) -> DataFrame:
    """Diagnostics without those of disabled rules and those whose whole text is a user's word, whatever the rule."""
    s = normalise(settings)
    if not s["enabled"]:
        return diagnostics.filter(F.lit(False))
    spark = diagnostics.sparkSession
    out = diagnostics.join(F.broadcast(spark.createDataFrame([(x,) for x in s["rulesOff"]], "rule string")), "rule", "left_anti")
    words = spark.createDataFrame([(x,) for x in s["userWords"]], "_w string")
    return out.join(F.broadcast(words), F.lower("text") == F.col("_w"), "left_anti").select(*diagnostics.columns)


def enabled_sources(docs: DataFrame, settings: dict, column: str = "source") -> DataFrame:
    """Documents of sources that are not turned off."""
    s = normalise(settings)
    return docs.filter(F.lit(s["enabled"]) & ~F.coalesce(F.col(column).isin(s["siteOff"]), F.lit(False)))


def toggle(settings: dict, off: bool, chosen: DataFrame) -> dict:
    """Settings with all rules of ``chosen`` (of ``find_rules``) turned off, or on again."""
    s = normalise(settings)
    names = [r["rule"] for r in chosen.select("rule").collect()]  # the catalogue has nineteen
    kept = [r for r in s["rulesOff"] if r not in names]
    return s | {"rulesOff": kept + sorted(names) if off else kept}


def reset(settings: dict) -> dict:
    """Defaults again; the words of the user stay."""
    return normalise({}) | {"userWords": normalise(settings)["userWords"]}


def ignore(settings: dict, word: str) -> dict:
    """Settings with one more word of the user's own."""
    s = normalise(settings)
    return s | {"userWords": s["userWords"] + [w for w in [word.lower()] if w not in s["userWords"]]}


def splice(text: Column, start: Column, end: Column, was: Column, replacement: Column) -> Column:
    """``text`` with the span replaced, if it still holds what the diagnostic saw; else as it is. Offsets count code points."""
    holds = F.substring(text, start + 1, end - start) == was
    return F.when(holds, F.concat(F.substring(text, F.lit(1), start), replacement, F.substring(text, end + 1, F.char_length(text)))).otherwise(text)


def apply_first_fixes(docs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with the first suggestion of each diagnostic applied, from the end; of overlapping ones the last stays."""
    fixes = diagnostics.filter(F.size("suggestions") > 0).select("doc_id", F.struct("char_start", "char_end", "text", F.col("suggestions")[0].alias("fix")).alias("d"))
    lists = fixes.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list("d"))).alias("ds"))
    start = F.struct(F.col("text").alias("text"), F.lit(2**31 - 1).alias("before"))

    def one(acc: Column, d: Column) -> Column:
        free = d["char_end"] <= acc["before"]
        return F.when(free, F.struct(splice(acc["text"], d["char_start"], d["char_end"], d["text"], d["fix"]).alias("text"), d["char_start"].alias("before"))).otherwise(acc)

    return docs.select("doc_id", "text").join(lists, "doc_id", "left").select("doc_id", F.when(F.col("ds").isNull(), F.col("text")).otherwise(F.aggregate("ds", start, one)["text"]).alias("text"))
