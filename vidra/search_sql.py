"""Fuzzy search, ranking and Latin readings in DuckDB SQL, for the registered queries' checks."""

from __future__ import annotations

from vidra.functions import fixed

# DuckDB's edit distance counts bytes: every character that occurs gets a byte of its own.
_BYTES = "".join(chr(c) for c in range(33, 127) if chr(c) not in "'\\")


def cost(q: str, c: str) -> str:
    """The weighted cost of two words."""
    pairs = ", ".join(f"'{x}'" for p in fixed.CONFUSED for x in (p, p[::-1]))
    n = f"least(length({q}), length({c}))"
    differ = f"list_filter(range(1, {n} + 1), lambda i: ({q})[i] <> ({c})[i])"
    placed = f"coalesce(list_sum(list_transform({differ}, lambda i: CASE WHEN ({q})[i] || ({c})[i] IN ({pairs}) THEN 1 ELSE 2 END)), 0) + 2 * abs(length({q}) - length({c}))"
    d = f"({differ})"
    swapped = f"length({q}) = length({c}) AND len({d}) = 2 AND {d}[2] = {d}[1] + 1 AND ({q})[{d}[1]] = ({c})[{d}[2]] AND ({q})[{d}[2]] = ({c})[{d}[1]]"
    long, short = f"(CASE WHEN length({q}) > length({c}) THEN {q} ELSE {c} END)", f"(CASE WHEN length({q}) > length({c}) THEN {c} ELSE {q} END)"
    at = f"coalesce({d}[1], {n} + 1)"
    one_letter = f"abs(length({q}) - length({c})) = 1 AND {long}[{at} + 1:] = {short}[{at}:]"
    return f"(CASE WHEN {swapped} THEN 1 WHEN {one_letter} THEN 2 ELSE {placed} END)::INT"


def _deletions(table: str, word: str, name: str) -> str:
    """name(w, key): each word and what is left of it after up to two deletions."""
    less = lambda w: f"list_transform(range(1, length({w}) + 1), lambda i: ({w})[1:i - 1] || ({w})[i + 1:])"
    return (
        f"{name}1 AS (SELECT DISTINCT {word} AS w, unnest({less(word)}) AS a FROM {table}), "
        f"{name} AS (SELECT DISTINCT {word} AS w, {word} AS key FROM {table} UNION SELECT w, a FROM {name}1 UNION SELECT w, unnest({less('a')}) FROM {name}1)"
    )


def suggest(limit: int, whole: bool = False) -> str:
    """sg(query, form, cost, place) for q(query) over k(form): the best ``limit`` forms of each, of all or of the first 8 * ``limit`` of each distance."""
    first = "" if whole else f" WHERE n <= {8 * limit} OR (distance = 1 AND m <= {8 * limit})"
    lev = "levenshtein(translate(query, al.f, al.t), translate(form, al.f, al.t))"
    return (
        f"al AS (SELECT string_agg(c, '' ORDER BY c) AS f, '{_BYTES}'[:count(*)] AS t FROM (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM (SELECT query AS w FROM q UNION SELECT form FROM k))), "
        f"qs AS (SELECT DISTINCT query FROM q WHERE length(query) BETWEEN 1 AND {fixed.MAX_QUERY}), {_deletions('qs', 'query', 'dq')}, {_deletions('k', 'form', 'dk')}, "
        f"hp AS (SELECT DISTINCT dq.w AS query, dk.w AS form FROM dq JOIN dk USING (key)), hd AS (SELECT query, form, {lev} AS distance FROM hp, al), "
        f"hn AS (SELECT query, form, distance, row_number() OVER (PARTITION BY query ORDER BY form) AS n, row_number() OVER (PARTITION BY query, distance ORDER BY form) AS m FROM hd WHERE distance BETWEEN 1 AND 2), "
        f"hc AS (SELECT query, form, {cost('query', 'form')} AS cost FROM hn{first}), "
        f"sg AS (SELECT * FROM (SELECT query, form, cost, row_number() OVER (PARTITION BY query ORDER BY cost, query[1] <> form[1], abs(length(query) - length(form)), form)::INT AS place FROM hc) WHERE place <= {limit})"
    )


def ranked() -> str:
    """rk(query, prev, next, suggestions) for asked(query, prev, next) over sg, fr(word, n) and b(prev, word, n)."""
    most = fixed.MAX_SUGGESTIONS
    return (
        "ax AS (SELECT DISTINCT query, prev, next FROM asked), "
        "hx AS (SELECT ax.*, sg.form, sg.cost, coalesce(l.n, 0) + coalesce(r.n, 0) AS bi, coalesce(fr.n, 0) AS own FROM ax JOIN sg USING (query) LEFT JOIN b l ON l.prev = ax.prev AND l.word = sg.form LEFT JOIN b r ON r.prev = sg.form AND r.word = ax.next LEFT JOIN fr ON fr.word = sg.form), "
        f"rk AS (SELECT query, prev, next, array_to_string(list(form ORDER BY bi DESC, own DESC, cost, form)[:{most}], '|') AS suggestions FROM hx GROUP BY ALL)"
    )


def readings(of: str) -> str:
    """cd(word, readings, first) of the distinct words of ``of``: all readings of a Latin word in order, and the one by the longest sequences; needs WITH RECURSIVE."""

    def letters(n: int, table: list[tuple[str, str]]) -> str:
        found: dict[str, list[str]] = {}
        for a, b in table:
            if len(a) == n:
                found.setdefault(a, []).append(b)
        cases = " ".join(f"WHEN '{a}' THEN [{', '.join(repr(b) for b in bs)}]" for a, bs in found.items())
        return f"CASE low[i:i + {n - 1}] {cases} ELSE [] END"

    def step(tails: str, table: list[tuple[str, str]], most: int) -> str:
        parts = [f"flatten(list_transform({letters(n, table)}, lambda l: list_transform({tails}{k}, lambda s: l || s)))" for n, k in ((3, 3), (2, 2), (1, 1))]
        every = f"list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]})[:{most}]"
        return f"CASE WHEN len({every}) > 0 THEN {every} ELSE list_transform({tails}1, lambda s: low[i] || s) END"

    cased = "CASE WHEN regexp_matches(word, '^\\p{Lu}') THEN CASE WHEN x[1] = 'ß' THEN 'SS' ELSE upper(x[1]) END || x[2:] ELSE x END"
    none = "[]::VARCHAR[]"
    return (
        f"rw AS (SELECT DISTINCT word, lower(word) AS low FROM {of}), "
        f"rc AS (SELECT word, low, length(low) AS i, [''] AS m1, {none} AS m2, {none} AS m3, [''] AS o1, {none} AS o2, {none} AS o3 FROM rw UNION ALL "
        f"SELECT word, low, i - 1, {step('m', fixed.LATIN + fixed.LATIN_MORE, fixed.MAX_READINGS)}, m1, m2, {step('o', fixed.LATIN, 1)}, o1, o2 FROM rc WHERE i > 0), "
        f"ca AS (SELECT word, list_transform(m1, lambda x: {cased}) AS l, list_transform(o1, lambda x: {cased})[1] AS first FROM rc WHERE i = 0), "
        "cd AS (SELECT word, list_filter(l, lambda x, j: list_position(l, x) = j) AS readings, first FROM ca)"
    )
