"""Character and word operators as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidra.functions import fixed

_LOWER = fixed.LETTERS + fixed.ACCENTED
MK = _LOWER + _LOWER.upper()
CYRILLIC = r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}"
_MK_RE = f"[{MK}]"
_FOREIGN_RE = f"[{CYRILLIC}&&[^{MK}]]"
_LATIN_RE = rf"[\p{{IsAlphabetic}}&&[^{CYRILLIC}]]"
_A, _AN, _SEP = r"\p{IsAlphabetic}", r"[\p{IsAlphabetic}\p{N}]", r"['\x{2019}\x{02BC}-]"
#: One token with the white space before it, or the white space at the end; all loops are possessive.
UNIT = rf"\p{{IsWhite_Space}}*+(?:{_AN}++(?:{_SEP}{_AN}++)*+|{_SEP}{_A}{_AN}*+(?:{_SEP}{_A}{_AN}*+)*+|[^\p{{IsWhite_Space}}]|\z)"
#: Units in a block and in a chunk of blocks.
_BLOCK, _CHUNK = 32, 256
#: The characters of white space.
_SPACE = "".join(f"\\u{c:04X}" for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

_SPACE_CHARACTERS = _SPACE.encode().decode("unicode_escape")

Word = Column | str


def _c(x: Word) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _units(text: str) -> str:
    """SQL: the units that tile a text (SQL); only the last can be white space alone."""
    return f"filter(regexp_extract_all({text}, r'{UNIT}', 0), u -> u <> '')".replace("'" + UNIT + "'", "'" + UNIT.replace("'", r"\x{27}") + "'")


def _tiled(one: str) -> str:
    """SQL: the array of ``one`` (SQL) for each unit u of the text body; blk has the units us of its block, i, c and b are the units, characters and bytes before the block.

    A unit ends where the units up to it end. These are put together from the start of a block,
    blocks from the start of a chunk, and the places of chunks are added up, so that the time
    stays linear in very long texts.
    """
    block = (
        f"transform(array(array_join(slice(chunk, 1, j * {_BLOCK}), '')), p -> named_struct('us', slice(chunk, j * {_BLOCK} + 1, {_BLOCK}), "
        f"'i', k * {_CHUNK} + j * {_BLOCK}, 'c', at.c + char_length(p), 'b', at.b + octet_length(p)))[0]"
    )
    chunk = f"slice(us, k * {_CHUNK} + 1, {_CHUNK})"
    inside = f"transform(array({chunk}), chunk -> flatten(transform(sequence(0, greatest(size(chunk) - 1, 0) DIV {_BLOCK}), j -> transform(array({block}), blk -> transform(blk.us, (u, i) -> {one}))[0])))[0]"
    places = (
        f"aggregate(sequence(0, (size(us) - 1) DIV {_CHUNK}), array(named_struct('c', 0, 'b', 0)), (acc, k) -> concat(acc, transform(array(array_join({chunk}, '')), "
        "p -> named_struct('c', element_at(acc, -1).c + char_length(p), 'b', element_at(acc, -1).b + octet_length(p)))))"
    )
    # Texts and units are bound once, by one-element transforms.
    return f"transform(array({_units('body')}), us -> flatten(transform(slice({places}, 1, (size(us) - 1) DIV {_CHUNK} + 1), (at, k) -> {inside})))[0]"


def tokenize(text: str) -> Column:
    """array<struct<idx, text, char_start, char_end, byte_start, byte_end, kind>> of a text, named or as SQL; null for null.

    The units tile the text, and a token ends where its unit ends. No shuffle, no window: it runs on streams too.
    """
    kind = r"CASE WHEN x.w rlike r'\p{IsAlphabetic}' THEN 'word' WHEN x.w rlike r'\p{N}' THEN 'number' ELSE 'punct' END"
    # x: the token, and the units of its block up to it; y: the characters and bytes of these.
    one = (
        f"transform(array(named_struct('w', trim(LEADING '{_SPACE}' FROM u), 'p', array_join(slice(blk.us, 1, i + 1), ''))), x -> transform(array(named_struct('c', blk.c + char_length(x.p), 'b', blk.b + octet_length(x.p))), "
        f"y -> named_struct('idx', blk.i + i, 'text', x.w, 'char_start', y.c - char_length(x.w), 'char_end', y.c, 'byte_start', y.b - octet_length(x.w), 'byte_end', y.b, 'kind', {kind}))[0])[0]"
    )
    return F.expr(f"transform(array({text}), body -> IF(body IS NULL, NULL, filter({_tiled(one)}, t -> t.text <> '')))[0]")


def placed_words(text: str, steps: bool = False) -> Column:
    """array<struct<idx, unit, char_end, prev, next>> of the word tokens of a text, named or as SQL; null for null.

    prev and next are the units of the words before and after it. A unit has the white space before the word, see ``trimmed``.
    With ``steps`` also behind and ahead, how many tokens prev and next are away.
    """
    one = "named_struct('idx', blk.i + i, 'unit', u, 'char_end', blk.c + char_length(array_join(slice(blk.us, 1, i + 1), '')))"
    item = "named_struct('idx', w.idx, 'unit', w.unit, 'char_end', w.char_end, 'prev', get(ws, i - 1).unit, 'next', get(ws, i + 1).unit)"
    if steps:
        item = item[:-1] + ", 'behind', w.idx - get(ws, i - 1).idx, 'ahead', get(ws, i + 1).idx - w.idx)"
    return F.expr(f"transform(array({text}), body -> IF(body IS NULL, NULL, transform(array(filter({_tiled(one)}, t -> t.unit rlike r'{_A}')), ws -> transform(ws, (w, i) -> {item}))[0]))[0]")


def trimmed(unit: Word) -> Column:
    """A unit without the white space before it."""
    return F.ltrim(_c(unit), F.lit(_SPACE_CHARACTERS))


def bare_words(text: str) -> Column:
    """array<string>: the texts of the word tokens of a text, named or as SQL, without their places; null for null."""
    return F.expr(f"transform(filter({_units(text)}, u -> u rlike r'{_A}'), u -> trim(LEADING '{_SPACE}' FROM u))")


def words(tokens: Word) -> Column:
    """The word tokens only."""
    return F.filter(_c(tokens), lambda t: t["kind"] == "word")


def is_mk_letter(c: Word) -> Column:
    return _c(c).rlike(f"^{_MK_RE}$")


def is_cyrillic(c: Word) -> Column:
    return _c(c).rlike(f"^[{CYRILLIC}]$")


def is_word_internal(c: Word) -> Column:
    return _c(c).rlike(f"^{_SEP}$")


def script_of(c: Word) -> Column:
    """Macedonian, ForeignCyrillic, Latin (any other alphabetic), Digit or Other, of one character."""
    return (
        F.when(_c(c).rlike(f"^{_MK_RE}$"), "Macedonian").when(_c(c).rlike(f"^[{CYRILLIC}]$"), "ForeignCyrillic")
        .when(_c(c).rlike(f"^{_A}$"), "Latin").when(_c(c).rlike(r"^\p{N}$"), "Digit").otherwise("Other")
    )


def has_mk(w: Word) -> Column:
    return _c(w).rlike(_MK_RE)


def has_foreign(w: Word) -> Column:
    return _c(w).rlike(_FOREIGN_RE)


def has_latin(w: Word) -> Column:
    return _c(w).rlike(_LATIN_RE)


def is_all_latin(w: Word) -> Column:
    return has_latin(w) & ~has_mk(w) & ~has_foreign(w)


def has_digit(w: Word) -> Column:
    return _c(w).rlike(r"\p{N}")


def starts_upper(w: Word) -> Column:
    return _c(w).rlike(r"^\p{IsUppercase}")


def is_acronym(w: Word) -> Column:
    """2 to 5 characters, every letter upper case."""
    return F.char_length(_c(w)).between(2, fixed.MAX_ACRONYM) & ~_c(w).rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")


def capitalize_first(w: Word) -> Column:
    return F.concat(F.upper(F.substring(_c(w), 1, 1)), F.substring(_c(w), 2, 2**31 - 1))


def match_case(original: Word, replacement: Word) -> Column:
    return F.when(starts_upper(original), capitalize_first(replacement)).otherwise(_c(replacement))


def normalize(w: Word) -> Column:
    """Lookalikes and foreign letters rewritten to Macedonian ones."""
    foreign = fixed.FOREIGN | {k.upper(): v[:1].upper() + v[1:] for k, v in fixed.FOREIGN.items()}
    single = fixed.LOOKALIKES | {k: v for k, v in foreign.items() if len(v) == 1}
    gone = "".join(k for k, v in foreign.items() if not v)
    out = F.translate(_c(w), "".join(single) + gone, "".join(single.values()))
    for k, v in foreign.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def script_issue(w: Word) -> Column:
    """ForeignCyrillic, Homoglyph or null."""
    return F.when(has_foreign(w), "ForeignCyrillic").when(has_mk(w) & has_latin(w), "Homoglyph")


def confusion_cost(a: Word, b: Word) -> Column:
    pairs = [x for p in fixed.CONFUSED for x in (p, p[::-1])]
    return F.when(_c(a) == _c(b), 0).when(F.concat(_c(a), _c(b)).isin(pairs), 1).otherwise(2)


def weighted_cost(q: Word, c: Word) -> Column:
    """1 for one adjacent transposition, 2 for one inserted or deleted letter, else what the places cost and 2 a letter of difference."""
    q, c = _c(q), _c(c)
    a, b = F.split(q, ""), F.split(c, "")
    n = F.least(F.size(a), F.size(b))
    costs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: confusion_cost(x, y))
    differ = F.filter(F.transform(costs, lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    i = F.try_element_at(differ, F.lit(1))
    swapped = (
        (F.char_length(q) == F.char_length(c)) & (F.size(differ) == 2) & (F.try_element_at(differ, F.lit(2)) == i + 1)
        & (F.substring(q, i + 1, F.lit(1)) == F.substring(c, i + 2, F.lit(1))) & (F.substring(q, i + 2, F.lit(1)) == F.substring(c, i + 1, F.lit(1)))
    )
    gap = F.abs(F.char_length(q) - F.char_length(c))
    placed = F.aggregate(costs, F.lit(0), lambda s, x: s + x) + 2 * gap
    return F.when((F.size(differ) == 2) & swapped, 1).when((gap == 1) & (F.levenshtein(q, c) == 1), 2).otherwise(placed)


def _readings(word: str, table: list[tuple[str, str]], most: int) -> Column:
    """All ways to read a Latin word (SQL), lower-cased, by ``table``, longest sequence first, ``most`` at most; worked out from the end."""

    def read(n: int, tail: str) -> str:
        found: dict[str, list[str]] = {}
        for a, b in table:
            if len(a) == n:
                found.setdefault(a, []).append(b)
        cases = " ".join(f"WHEN '{a}' THEN array({', '.join(repr(b) for b in bs)})" for a, bs in found.items())
        letters = f"CASE substring(low, i, {n}) {cases} ELSE CAST(array() AS ARRAY<STRING>) END"
        return f"flatten(transform({letters}, l -> transform({tail}, s -> concat(l, s))))"

    parts = ", ".join(read(n, tail) for n, tail in ((3, "acc.c"), (2, "acc.b"), (1, "acc.a")))
    step = (
        f"transform(array(slice(concat({parts}), 1, {most})), r -> "
        "named_struct('a', IF(size(r) > 0, r, transform(acc.a, s -> concat(substring(low, i, 1), s))), 'b', acc.a, 'c', acc.b))[0]"
    )
    none = "CAST(array() AS ARRAY<STRING>)"
    every = f"aggregate(reverse(sequence(1, char_length(low))), named_struct('a', array(''), 'b', {none}, 'c', {none}), (acc, i) -> {step}, acc -> acc.a)"
    return F.expr(f"transform(array(lower({word})), low -> IF(low = '', array(''), {every}))[0]")


def candidates(word: str) -> Column:
    """Every plausible reading of a Latin word (a column's name or SQL), in order, 64 at most, with its capital restored, without repeats."""
    found = _readings(word, fixed.LATIN + fixed.LATIN_MORE, fixed.MAX_READINGS)
    return F.array_distinct(F.transform(found, lambda r: match_case(F.expr(word), r)))


def transliterate(word: str) -> Column:
    """The reading that takes the longest sequence at each place."""
    return match_case(F.expr(word), F.element_at(_readings(word, fixed.LATIN, 1), 1))
