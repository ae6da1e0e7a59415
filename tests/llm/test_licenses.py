import random
import re

from vidra.llm import licenses
from vidra.llm.license_texts import TEMPLATES
from vidra.llm.licenses import PHRASES, Automaton, scan


def brute(template, words):
    """Whether some run of words is a reading of the template, by trying all of them."""
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template)

    def tree(i):
        out = []
        while i < len(parts) and parts[i] != "]]":
            if parts[i] == "[[":
                inner, i = tree(i + 1)
                out.append(inner)
            else:
                out.append(parts[i])
            i += 1
        return out, i

    def ends(seq, at):
        now = {at}
        for x in seq:
            if isinstance(x, list):
                now |= {e for p in now for e in ends(x, p)}
            elif x[:2] == "{{":
                now = {p + k for p in now for k in range(int(x[2:-2]) + 1) if p + k <= len(words)}
            else:
                now = {p + 1 for p in now if p < len(words) and words[p] == x}
        return now

    seq, _ = tree(0)
    return any(ends(seq, i) for i in range(len(words)))


def test_random_templates_against_all_readings(monkeypatch):
    rng = random.Random(3)

    def template(depth=0):
        out = []
        for _ in range(rng.randrange(1, 4)):
            k = rng.random()
            out.append(f"[[{template(depth + 1)}]]" if k < 0.3 and depth < 2 else "{{%d}}" % rng.randrange(1, 4) if k < 0.45 else rng.choice("abcd"))
        return " ".join(out)

    for nodes in (1 << 16, 3):
        monkeypatch.setattr(licenses, "MAX_NODES", nodes)
        for _ in range(60):
            templates = [(f"t{i}", f"{rng.choice('abcd')} {template()}") for i in range(5)]
            phrases = {"a b": "p", "b a b": "q", "c": "r"}
            automaton = Automaton(phrases, templates)
            for _ in range(20):
                words = [rng.choice("abcdx") for _ in range(rng.randrange(12))]
                labels, places = automaton.run([w.encode() for w in words])
                assert labels == {label for label, t in templates if brute(t, words)}, (templates, words)
                assert sorted(places) == sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def filled(template, rng, put):
    """A reading of a template: optional words by chance, replaceable ones made up."""
    text = re.sub(r"\{\{(\d+)\}\}", lambda m: " ".join("Someone" for _ in range(rng.randrange(int(m[1]) + 1))), template)
    while "[[" in text:
        text = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: m[1] if put or rng.random() < 0.5 else "", text)
    return text


def test_every_license_text_is_accepted_and_changed_wording_is_not(spark):
    rng = random.Random(4)
    rows, want = [], []
    for k, (label, template) in enumerate(TEMPLATES):
        for put in (True, False):
            text = filled(template, rng, put)
            rows.append((len(rows), f"Before it.\n{text}\nBehind it."))
            want.append((label, True))
            words = re.findall(r"[^\s]+", filled(re.sub(r"\[\[.*?\]\]|\{\{\d+\}\}", " ", template), rng, False))
            at = len(words) // 2
            rows.append((len(rows), " ".join([*words[:at], "quite", *words[at:]])))
            want.append((label, False))
    got = {r.doc_id: set(r.labels.split(",")) for r in scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = {label for label, t in TEMPLATES if len(t.split()) < 30}
    for i, (label, accepted) in enumerate(want):
        if accepted:
            assert label in got[i], (label, rows[i])
        elif label not in short:
            assert label not in got[i], (label, rows[i])


def test_templates():
    a = Automaton({}, [("x", "licensed under [[the [[old]] terms of]] the {{2}} license")])
    accepts = lambda s: a.run(s.encode().split())[0] == {"x"}
    assert all(map(accepts, ["licensed under the license", "x licensed under the a b license y", "licensed under the terms of the license", "licensed under the old terms of the q license"]))
    assert not any(map(accepts, ["licensed under the a b c license", "licensed under old terms of the license", "licensed the license", ""]))


def test_scan(spark):
    texts = [None, "", "Released under the MIT License.", "the mit-license mit license MIT\nLICENSE", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0", "cc by cc by", "GNU General Public Licenses", "é" * 5 + " word" * 50_000 + " mit license", "İ cc by"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in scan(spark, docs).collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (texts[r.doc_id] or "").encode()))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    got = {r.doc_id: (r.labels, r.score) for r in scan(spark, docs).collect()}
    assert got[2] == ("mit", 1.0) and got[4] == ("cc-by,cc-by-nc-4.0", 1.0) and got[5] == ("apache,apache-2.0", 1.0) and got[6] == ("cc-by", 0.5) and got[0] == ("", 0.0)
    assert scan(spark, docs.limit(0)).count() == 0
