"""Personal data in whole texts, with DataFrame and SQL functions only.

For each kind a regular expression cuts the text into tiles: a proposed span, or nothing, and
then everything up to the next place where a span could start. The tiles cover the text, so a
span's place is the length of the tiles before it. All loops in the patterns are possessive or
bounded: time is linear in the text and no pattern recurses on long runs. Validators confirm
the proposals (Luhn for cards, mod-97 for IBANs, ranges for addresses, digit counts for phone
numbers), and words near a span raise its score. Base kinds need no context; the kinds that the
method adds (``iban``, ``ssn``) are reported from a score of ``ADDED_FROM`` on.

Defined cases: a null text is empty and has no spans; equal rows give equal rows; positions
count code points, ends are exclusive; any number of spans in a text costs linear time (their
list is built in blocks); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED_FROM = 0.8
#: Code points on either side of a span in which context words count, and what they add.
NEAR, CONTEXT_GAIN = 40, 0.3
_BLOCK = 256

_L, _D = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """guard: SQL that is false where the kind cannot occur; span: pattern of a proposal; other: what a tile starts with
    where no span does; skip: what follows up to the next possible start; valid: SQL on m, the proposal."""

    name: str
    guard: str
    span: str
    other: str
    skip: str
    valid: str
    score: float
    context: str
    #: Characters that may not touch the span.
    edge: str = ""


# Context words.
_CONTEXT = {
    "email": "e-?mail|mail|contact|write to|kontakt|correo|courriel",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|llame|appelez",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}

_RUN = "[0-9]++(?:[ -][0-9]++)*+"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN (length({d}) - i) % 2 = 1"
    " THEN 2 * int(substring({d}, i, 1)) - IF(int(substring({d}, i, 1)) > 4, 9, 0) ELSE int(substring({d}, i, 1)) END) % 10 = 0"
).format(d=_DIGITS)
_IBAN = "concat(substring(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4))"
_MOD97 = (
    "aggregate(sequence(1, length({v})), 0, (a, i) -> CASE WHEN substring({v}, i, 1) BETWEEN '0' AND '9'"
    " THEN (a * 10 + int(substring({v}, i, 1))) % 97 ELSE (a * 100 + ascii(substring({v}, i, 1)) - 55) % 97 END) = 1"
).format(v=_IBAN)

BASE = [
    Kind("email", "contains(text, '@')", f"{_L}++@{_D}++(?:\\.{_D}++)++", f"{_L}++", f"(?:[^A-Za-z0-9._%+-]++|{_L}++(?!@))*+", "true", 0.9, _CONTEXT["email"]),
    Kind("ip", "contains(text, '.')", r"[0-9]++(?:\.[0-9]++){3}", "[0-9]++", r"(?:[^0-9]++|[0-9]++(?!\.[0-9]))*+", "forall(split(m, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$')", 0.6, _CONTEXT["ip"]),
    Kind("card", "text rlike '[0-9][ -]?[0-9]'", _RUN, _RUN, f"(?:[^0-9]++|(?!(?:[0-9][ -]?){{12}}[0-9]){_RUN})*+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", 0.9, _CONTEXT["card"]),
    Kind("phone", "contains(text, '+')", r"\+[0-9][ ().0-9-]+[0-9]", r"\+", r"(?:[^+]++|\+(?![0-9]))*+", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, _CONTEXT["phone"]),
]
ADDED = [
    Kind("iban", "text rlike '[A-Z]{2}[0-9]{2}'", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]", "(?:[^A-Z]++|[A-Z](?![A-Z][0-9]{2}))*+", f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}", 0.9, _CONTEXT["iban"], "[A-Za-z0-9]"),
    Kind("ssn", "contains(text, '-')", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]++", "(?:[^0-9]++|[0-9]++(?!-[0-9]))*+", "m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'", 0.5, _CONTEXT["ssn"], "[0-9-]"),
]


def _spans(kind: Kind) -> Column:
    """array<struct<start, end, score>> of one kind over the column ``text``."""
    tile = f"(?s)(?:{kind.span}|{kind.other})?+{kind.skip}"
    near = f"lower(concat(right(IF(i = 0, '', element_at(tiles, i)), {NEAR}), ' ', substring(t, length(m) + 1, {NEAR})))"
    score = f"{kind.score}D + IF({near} rlike r'(?<![a-z])(?:{kind.context})(?![a-z])', {CONTEXT_GAIN}D, 0.0D)"
    least = ADDED_FROM if kind in ADDED else 0.0
    # Names are bound by one-element transforms, so that nothing is worked out twice.
    valid = kind.valid
    if kind.edge:
        valid += f" AND NOT IF(i = 0, '', right(element_at(tiles, i), 1)) rlike '{kind.edge}' AND NOT (length(m) = length(t) AND coalesce(left(try_element_at(tiles, i + 2), 1), '') rlike '{kind.edge}')"
    scored = f"IF(m <> '' AND {valid}, IF({score} >= {least}D, least(1.0D, {score}), CAST(NULL AS DOUBLE)), CAST(NULL AS DOUBLE))"
    items = (
        "transform(tiles, (t, i) -> transform(array("
        f"regexp_extract(t, r'^(?:{kind.span})', 0)), m -> named_struct('n', length(t), 'm', length(m), 'score', {scored}))[0])"
    )
    empty = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, score: DOUBLE>>)"
    inner = (
        f"aggregate(slice(items, b * {_BLOCK} + 1, {_BLOCK}), named_struct('pos', acc.pos, 'list', {empty}), (a, x) -> named_struct('pos', a.pos + x.n, 'list', "
        "IF(x.score IS NULL, a.list, concat(a.list, array(named_struct('start', a.pos, 'end', a.pos + x.m, 'score', x.score))))))"
    )
    placed = (
        f"flatten(aggregate(sequence(0, (size(items) - 1) DIV {_BLOCK}), named_struct('pos', 0, 'lists', array({empty})), "
        f"(acc, b) -> transform(array({inner}), z -> named_struct('pos', z.pos, 'lists', concat(acc.lists, array(z.list))))[0], acc -> acc.lists))"
    )
    every = f"transform(array(regexp_extract_all(text, r'{tile}', 0)), tiles -> transform(array({items}), items -> {placed})[0])[0]"
    return F.expr(f"IF({kind.guard}, {every}, {empty})")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans, their digest, all spans, how many the method added and the highest score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", *(_spans(k).alias(k.name) for k in [*BASE, *ADDED]))
    written = {k.name: F.expr(f"transform({k.name}, s -> concat('{k.name}:', s.start, ':', s.end))") for k in [*BASE, *ADDED]}
    base = F.array_join(F.concat(*(written[k.name] for k in BASE)), ",")
    every = F.array_join(F.concat(*written.values()), ",")
    scores = F.expr("array_max(transform(concat(" + ", ".join(written) + "), s -> s.score))")
    return rows.select(
        "doc_id",
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        every.alias("spans"),
        sum(F.size(k.name) for k in ADDED).cast("long").alias("n_added"),
        F.coalesce(scores, F.lit(0.0)).alias("score"),
    )
