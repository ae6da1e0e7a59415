import random

from vidra.llm import line_dedup
from vidra.llm.line_dedup import ALIKE, report


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute(rows):
    """rows of distinct (id, text); (id, text) -> text left."""
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[doc, text] = None
            continue
        left = []
        for line in text.split("\n"):
            if line.strip():
                drop = any(line == x or (min(len(line), len(x)) >= ALIKE and within_one(line, x)) for x in seen)
                seen.append(line)
                if drop:
                    continue
            left.append(line)
        out[doc, text] = "\n".join(left)
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé d😀") for _ in range(n)) for n in (3, 9, 10, 11, 12, 20, 31, 32, 33, 48, 64, 90) for _ in range(2)]

    def edit(s):
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + rng.choice("ax") + s[i + 1 :]])
        return s

    rows = [(i, "\n".join(rng.choice([edit(rng.choice(base)), rng.choice(base), "", "   "]) for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "word " * 4000 + "end"), (504, "word " * 4000 + "and")]
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, row string, _x int")
    got = {(r.doc_id, t): r for r, (i, t) in zip(report(spark, docs).orderBy("doc_id").collect(), sorted(rows, key=lambda r: r[0])) if r.doc_id == i}
    assert len(got) == len(rows)
    for key, r in got.items():
        assert r.text == want[key], (key, r)
    assert sum(r.n_near for r in got.values()) > 10 and sum(r.n_exact for r in got.values()) > 10


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = [(1, "one line that is long enough"), (1, "one line that is long enough"), (2, "one line that is long enough"), (None, "one line that is long enouch\nkept"), (3, "a\na\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.text, r.n_lines, r.n_exact, r.n_near) for r in report(spark, docs).collect())
    line = rows[0][1]
    assert got == [(1, line, 1, 0, 0), (1, line, 1, 0, 0), (2, "", 1, 1, 0), (3, "a\nb", 3, 1, 0), (99, "kept", 2, 0, 1)]
    assert report(spark, docs.limit(0)).count() == 0


def test_common_lines_and_columns_of_any_name(spark, monkeypatch):
    rng = random.Random(12)
    lines = ["a common line of some length", "a common line of some lengths", *(f"line number {i} {rng.random()}" for i in range(30))]
    rows = [(i, "\n".join(rng.choice(lines[:2] if rng.random() < 0.6 else lines) for _ in range(8))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, i, "x", 1.5, t) for i, t in rows], "doc_id long, text string, row long, gone string, near double, `n_lines` string")
    monkeypatch.setattr(line_dedup, "COMMON", 20)
    got = line_dedup.dedup(spark, docs).select("doc.*").collect()
    want = brute(rows)
    assert {r.doc_id: (r.text, r.row, r.gone, r.near, r.n_lines) for r in got} == {i: (want[i, t], i, "x", 1.5, t) for i, t in rows}
