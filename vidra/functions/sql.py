"""The word functions as SQL functions of the session: ``CREATE TEMPORARY FUNCTION``, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vidra.functions import fixed, text


def register(spark: SparkSession) -> list[str]:
    """Create vidra_is_acronym, vidra_is_all_latin, vidra_script_issue and vidra_capitalize; returns their names."""
    mk, cyr = text.MK, text.CYRILLIC
    latin = rf"[\p{{IsAlphabetic}}&&[^{cyr}]]"
    bodies = {
        "vidra_is_acronym(w STRING) RETURNS BOOLEAN": rf"char_length(w) BETWEEN 2 AND {fixed.MAX_ACRONYM} AND NOT w RLIKE r'[\p{{IsAlphabetic}}&&[^\p{{IsUppercase}}]]'",
        "vidra_is_all_latin(w STRING) RETURNS BOOLEAN": rf"w RLIKE r'{latin}' AND NOT w RLIKE r'[{cyr}]'",
        "vidra_script_issue(w STRING) RETURNS STRING": rf"CASE WHEN w RLIKE r'[{cyr}&&[^{mk}]]' THEN 'ForeignCyrillic' WHEN w RLIKE r'[{mk}]' AND w RLIKE r'{latin}' THEN 'Homoglyph' END",
        "vidra_capitalize(w STRING) RETURNS STRING": "concat(upper(left(w, 1)), substring(w, 2))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in bodies]
