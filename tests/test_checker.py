from collections import defaultdict

import fixtures
import pytest
from pyspark.sql import functions as F

from vidra.functions import text as X
from vidra.operators import lexicon, morphology, ngrams
from vidra.plans import evaluate, settings
from vidra.plans.checker import Checker, ordered
from vidra.sources import tables

SPELL = "книга книгата градот град дома оди тој тоа македонски здраво како си денес црно бел коњ ѓубре секогаш можда многу дом том дим".split()


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(w,) for w in SPELL], "form string")


@pytest.fixture(scope="module")
def morph(spark):
    rows = [(s, lemma, t.split(), i) for i, (s, lemma, t) in enumerate(fixtures.MORPH)]
    return morphology.build(spark.createDataFrame(rows, "surface string, lemma string, tags array<string>, place long")).cache()


def found(spark, checker, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = defaultdict(list)
    for r in ordered(checker.check(docs, **more)).orderBy("doc_id", "place").collect():
        out[r.doc_id].append(r)
    return [out[i] for i in range(len(texts))]


def test_every_grammar_case(spark, morph):
    vocabulary = spark.createDataFrame([(w,) for w in fixtures.LEXICON], "form string")
    got = found(spark, Checker(vocabulary, morph), [c[1] for c in fixtures.GRAMMAR], suggestions=False)
    for (rule, text, want), rows in zip(fixtures.GRAMMAR, got):
        assert [(r.suggestions[0] if r.suggestions else None) for r in rows if r.rule == rule] == want, (rule, text, rows)


def test_spelling_rules(spark, small):
    texts = ["Тој оди дома.", "книгаа", "мaкeдoнски", "ђубре", "zdravo kako si denes", "Skopje", "BBC CNN", "Увек", "можда", "Можда", "црно-бел", "МПЦ и ДДВ", "1-ви", "нај", "zdravo kako, мaкeдoнски книгаа", "🎉 книгаа"]
    got = found(spark, Checker(small), texts)
    short = [[(r.rule, r.severity, r.text, list(r.suggestions)[:1]) for r in rows] for rows in got]
    assert short[0] == []
    assert short[1] == [("MK_SPELL", "error", "книгаа", ["книга"])]
    assert short[2] == [("MK_HOMOGLYPH", "error", "мaкeдoнски", ["македонски"])]
    assert short[3] == [("MK_FOREIGN_CYRILLIC", "error", "ђубре", ["ѓубре"])]
    assert [r[0] for r in short[4]] == ["MK_LATIN_TEXT"] * 3 and short[4][0][3] == ["здраво"]
    assert short[5] == short[6] == short[9] == short[10] == short[11] == short[12] == short[13] == []
    assert short[7] == [("MK_SERBIANISM", "warning", "Увек", ["Секогаш"])]
    assert short[8] == [("MK_SERBIANISM", "info", "можда", ["можеби"])]
    assert [r[0] for r in short[14]] == ["MK_LATIN_TEXT", "MK_LATIN_TEXT", "MK_HOMOGLYPH", "MK_SPELL"]
    assert [(r.char_start, r.char_end) for r in got[15]] == [(2, 8)]


def test_ranking_by_tables(spark):
    forms = spark.createDataFrame([(w,) for w in ("дома", "дама", "даме")], "form string")
    freq = spark.createDataFrame([("дама", 50), ("дома", 10)], "word string, n bigint")
    bigram = spark.createDataFrame([("тој", "дома", 9)], "prev string, word string, n bigint")
    first = lambda c: found(spark, c, ["тој дима"])[0][-1].suggestions
    assert list(first(Checker(forms, freq=freq)))[0] == "дама"
    assert list(first(Checker(forms, freq=freq, bigram=bigram)))[0] == "дома"
    assert Checker(forms, freq=freq).degraded == ["morph", "bigram"]


def test_search_equals_brute_force(spark, small):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    queries = ["дом", "книгаа", "град", "кнштв", "а", "абвгдѓежзѕијклљмнњопрстќуфхцчџша"]
    got = {(r.query, r.form, r.distance) for r in lexicon.search(spark.createDataFrame([(q,) for q in queries], "query string"), small).collect()}
    assert got == {(q, f, d) for q in queries if len(q) <= 32 for f in SPELL if 0 < (d := distance(q, f)) <= 2}


def test_costs_and_readings(spark):
    pairs = spark.createDataFrame([("кнгиа", "книга"), ("книгаа", "книга"), ("кука", "куќа"), ("абв", "где"), ("а", "а")], "a string, b string")
    assert [r.c for r in pairs.select(X.weighted_cost("a", "b").alias("c")).collect()] == [1, 2, 1, 6, 0]
    words = spark.createDataFrame([("Skopje",), ("konj",), ("kje",), ("c" * 12,)], "w string").select(X.candidates("w").alias("c"), X.transliterate("w").alias("t")).collect()
    assert words[0].t == "Скопје" and words[1].c[:2] == ["коњ", "конј"] and words[2].t == "ќе" and len(words[3].c) <= 64


def test_tokens_reproduce_the_text(spark):
    texts = ["Тој оди , дома. -збор 'рж к'смет 1-ви 🎉 2026 црно-бел  ", "", None, "   ", "а-б" * 3000]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokenize("t").alias("k")).collect():
        for k in r.k or []:
            assert r.t[k.char_start : k.char_end] == k.text and r.t.encode()[k.byte_start : k.byte_end].decode() == k.text
        assert (r.k is None) == (r.t is None)
        assert "".join(k.text for k in r.k or []) == "".join((r.t or "").split())


def test_completion_and_alternatives(spark):
    pairs = spark.createDataFrame([("тој", "оди", 9), ("тој", "отиде", 9), ("тој", "сака", 50), ("ја", "виде", 40), ("виде", "книгата", 40)], "prev string, word string, n bigint")
    asked = spark.createDataFrame([("Тој", "о"), ("никој", "о")], "prev string, prefix string")
    assert [(r.word, r.place) for r in ngrams.top_next(asked, pairs).orderBy("place").collect()] == [("оди", 1), ("отиде", 2)]
    freq = spark.createDataFrame([("види", 300), ("ја", 900), ("книгата", 900)], "word string, n bigint")
    forms = spark.createDataFrame([("виде",), ("види",)], "form string")
    words = spark.createDataFrame([("види", "ја", "книгата"), ("виде", "ја", "книгата")], "word string, prev string, next string")
    assert [(r.word, r.alternative) for r in ngrams.alternatives(words, forms, freq, pairs).collect()] == [("види", "виде")]


def test_settings_and_fixes(spark, small):
    assert settings.normalise({"delayMs": 9e9, "enabled": 1, "userWords": ["А", 3]}) == {"enabled": True, "delayMs": 5000, "rulesOff": [], "userWords": ["а"], "siteOff": []}
    assert settings.rules(spark).count() == 19
    docs = spark.createDataFrame([(1, "🎉 мaкeдoнски книгаа мaкeдoнски"), (2, "дома")], "doc_id long, text string")
    diagnostics = Checker(small).check(docs)
    off = settings.apply(diagnostics, {"rulesOff": ["MK_SPELL"]})
    assert {r.rule for r in off.collect()} == {"MK_HOMOGLYPH"}
    assert settings.apply(diagnostics, {"userWords": ["КНИГАА"]}).filter("text = 'книгаа'").count() == 0
    fixed = {r.doc_id: r.text for r in settings.apply_first_fixes(docs, diagnostics).collect()}
    assert fixed == {1: "🎉 македонски книга македонски", 2: "дома"}
    shape = evaluate.shape(diagnostics).collect()[0]
    assert (shape.spell, shape.short) == (1, 0.0)


def test_json_and_report(spark, small):
    docs = spark.createDataFrame([(1, "книгаа")], "doc_id long, text string")
    diagnostics = Checker(small).check(docs)
    assert '"rule":"MK_SPELL"' in tables.as_json(diagnostics).collect()[0].json
    lines = list(tables.report(diagnostics, 1))
    assert lines[0].startswith("✗ 0-6 MK_SPELL книгаа") and lines[-1] == "1 problems in 1 words"


def test_gate_and_cap(spark, morph):
    """Correct sentences stay silent, each slip is named; a cap leaves the rest of a text unchecked."""
    vocabulary = spark.createDataFrame([(w,) for w in fixtures.LEXICON], "form string")
    checker = Checker(vocabulary, morph)
    slips = [(rule, text, want) for rule, text, want in fixtures.GRAMMAR if want]
    rows = [(i, "", text, text.split()[0], rule) for i, (rule, text, _) in enumerate(slips)] + [(900, "", "", "", "-"), (901, "", "", "", "clean")]
    probe = spark.createDataFrame(rows, "place long, correct string, perturbed string, wrong_token string, family string")
    r = evaluate.gate(spark, probe, checker).collect()[0]
    assert (r["rows"], r.targets, r.uncovered, r.false_positives) == (len(rows), len(slips), 1, 0) and r.hits > 0.5 * len(slips)
    docs = spark.createDataFrame([(1, "книгаа " * 30)], "doc_id long, text string")
    spelled = lambda **more: checker.check(docs, suggestions=False, **more).filter("rule = 'MK_SPELL'").count()
    assert (spelled(), spelled(cap=16)) == (30, 3)


def test_words_without_places_and_words_in_long_texts(spark):
    """F6 to F15: words are read without all of the token's fields, in blocks; the token rows say what they must be."""
    from vidra.operators.tokens import beside

    odd = [None, "", "  ", "а", " а ", "д'а -в- б’г 1-в 2024 x", "😀 a😀b", "а " * 256, "аб, " * 1000 + "  ", "а\u2003б\u00a0в", " ".join(["збор"] * 4097)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in docs.select("text", X.tokenize("text").alias("ts"), X.bare_words("text").alias("ws")).collect():
        assert r.ws == (None if r.text is None else [t.text for t in r.ts if t.kind == "word"])
        assert r.ts is None or all(r.text[t.char_start : t.char_end] == t.text and r.text.encode()[t.byte_start : t.byte_end].decode() == t.text and t.idx == i for i, t in enumerate(r.ts))
    want = {(r.doc_id, t.idx, t.text, t.char_end) for r in docs.select("doc_id", X.tokenize("text").alias("ts")).collect() for t in r.ts or [] if t.kind == "word"}
    assert {(r.doc_id, r.idx, r.text, r.char_end) for r in beside(docs).collect()} == want


def test_flagged_words_are_worked_out_once(spark, small):
    """F6 to F12: the flagged words are cached when the check is put together, so that readers that begin together do not each work them out."""
    docs = spark.createDataFrame([(1, "книгаа црно-белл zdravo kako")], "doc_id long, text string")
    spark.catalog.clearCache()
    rows = Checker(small).check(docs, suggestions=False)
    kept = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert sum(k.numCachedPartitions() for k in kept) > 0
    assert sorted(r.text for r in rows.collect()) == ["kako", "zdravo", "књигаа".replace("њ", "н"), "црно-белл"]


def test_searches_work_out_their_lexicon_once(spark, tmp_path, monkeypatch):
    """l5_suggest and j6_search read the documents for one lexicon, not two."""
    from vidra import registry, registry_io

    texts = [(i, f"dom grad dom{'abc'[i % 3]} gradi", "x") for i in range(9)] + [(9, "gradu", "x")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    built, known = [], registry.known
    monkeypatch.setattr(registry, "known", lambda d: built.append(1) or known(d))
    assert registry_io.j6_search(spark, str(tmp_path)).count() > 0
    assert len(built) == 1
    registry.l5_suggest(spark, str(tmp_path)).count()
    assert len(built) == 2


def test_search_deals_out_hashes_not_neighbours(spark):
    """a search of long words deals out few rows, whatever the number of their neighbours, and loses no pair."""
    import random

    draw = random.Random(5)
    forms = sorted({"".join(draw.choice("абвг") for _ in range(draw.randint(0, 6))) for _ in range(300)} | {"а" * 32, "а" * 34, "а" * 35, "😀б", "а\nб"})
    queries = sorted({"".join(draw.choice("абвг") for _ in range(draw.randint(1, 6))) for _ in range(60)} | {"а" * 32, "а" * 33, "б", "б😀"})
    asked, known = (spark.createDataFrame([(w,) for w in words], f"{name} string") for words, name in ((queries, "query"), (forms, "form")))
    for distance in (1, 2):
        want = asked.filter("char_length(query) <= 32").crossJoin(known).selectExpr("query", "form", "levenshtein(query, form) AS distance").filter(f"distance BETWEEN 1 AND {distance}")
        assert sorted(lexicon.search(asked, known, distance).collect()) == sorted(want.collect())
    plan = lexicon.search(asked, known)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "BroadcastExchange" not in plan


def test_tables_of_alternatives_never_pass_the_driver(spark, monkeypatch):
    """tables of all words and pairs are as large as the texts; what is broadcast are the few keys asked for."""
    texts = ["ја виде книгата", "ја, види, книгата", "ја\nвиди\nкнигата", "ја види, книгата", "ја, види книгата", "ја, вaди, книгата", "ја 1 види 2 книгата", "ја", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in ngrams.apart(docs).collect()) == [("види", "ја", "книгата")] * 3
    table = spark.range(5).selectExpr("concat('збор', id) AS word", "id AS n")
    words = spark.createDataFrame([("види", "ја", "книгата")], "word string, prev string, next string")
    sent, lookup = [], ngrams.lookup
    monkeypatch.setattr(ngrams, "lookup", lambda table, *most: sent.append(table.columns) or lookup(table, *most))
    ngrams.alternatives(words, table.selectExpr("word AS form"), table, table.selectExpr("word AS prev", "word", "n")).collect()
    assert sent and not any("n" in columns for columns in sent)


def test_ranked_checks_count_words_once(spark, tmp_path, monkeypatch):
    """r5_suggestions and check_all read their tables of words and pairs from files; measuring and joining them counts nothing again."""
    from vidra import registry

    spark.createDataFrame([(i, f"dom grad dom{'abc'[i % 3]} gradi", "x") for i in range(9)] + [(9, "gradu", "x")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    written, write = [], tables.write
    monkeypatch.setattr(tables, "write", lambda table, kind, path: written.append(kind) or write(table, kind, path))
    for query in (registry.r5_suggestions, registry.check_all):
        written.clear()
        assert query(spark, str(tmp_path)).count() > 0
        assert sorted(written) == ["bigram", "freq", "lexicon"]


def test_joins_move_only_rows_they_are_about(spark, small):
    """flagged words that need no suggestion and no reading are not dealt out by their text."""
    docs = spark.createDataFrame([(i, "мaкeдoнски книгаа црно-белл црно-бел zdravo kako xyzzy xyzzy") for i in range(3)], "doc_id long, text string")
    bigram = spark.createDataFrame([("книга", "црно", 2)], "prev string, word string, n bigint")
    out = Checker(small, bigram=bigram).check(docs)
    assert sorted((r.rule, r.text) for r in out.filter("doc_id = 1").collect()) == [("MK_HOMOGLYPH", "мaкeдoнски"), ("MK_LATIN_TEXT", "kako"), ("MK_LATIN_TEXT", "zdravo"), ("MK_SPELL", "книгаа"), ("MK_SPELL", "црно-белл")]
    plan = out.filter("rule = 'MK_HOMOGLYPH'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString() and plan.count("Join LeftOuter") < 2


def test_no_form_is_too_late_in_the_alphabet(spark):
    """F7, F8: the best form counts wherever it stands among the forms within the distance."""
    forms = spark.createDataFrame([(f"а{x}шч",) for x in "бвгдежзијк"] + [("чшшч",)], "form string")
    asked = spark.createDataFrame([("шчшч",)], "query string")
    assert [(r.form, r.cost) for r in lexicon.suggest(asked, forms, 1).collect()] == [("чшшч", 1)]
    # Of each distance only the first, where that is asked for.
    assert [r.form for r in lexicon.suggest(asked, forms, 1, first=8).collect()] == ["абшч"]


def test_counted_tables_are_whole(spark):
    """all words and pairs of the documents count, not only the most frequent."""
    from itertools import islice, product

    from vidra import registry

    words = ["".join(w) for w in islice(product("абвгдежзик", repeat=5), 50_100)]
    freq, bigram = registry.counted(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    assert (freq.count(), bigram.count()) == (50_100, 50_099)


def test_words_are_asked_about_once_a_batch(spark):
    """a check looks up each distinct word of a batch once; its places are those of the words beside each other."""
    from vidra.operators import cut
    from vidra.operators.tokens import beside, in_run

    texts = ["црно-бел, 'тој' оди  оди", "a1b 12 ⅷ ab cd, ef", "", None, "  \n", "zdravo 3 kako 𝒶𝒷 đ’ак -е̄т", "ͅѓ ҃ а҃ İstanbul ΑΣ"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = cut.places(docs, True)
    got = rows.selectExpr("text", "explode(arrays_zip(doc_ids, ends, in_run, prevs, nexts)) AS p").select("p.doc_ids", "text", "p.ends", "p.in_run", "p.prevs", "p.nexts")
    want = beside(docs).select("doc_id", "text", "char_end", in_run(), X.trimmed("prev"), X.trimmed("next"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert rows.count() == rows.select("text").distinct().count()
    assert {tuple(r) for r in cut.met(docs, 99).collect()} == {(r.text, r.doc_id) for r in want.collect()}
    assert cut.met(docs.selectExpr("doc_id", "'а' AS text"), 3).count() == 3


def test_documents_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    """the parts of larger tables are more, not larger."""
    from vidra import registry

    spark.range(100).selectExpr("id AS doc_id", "repeat(uuid(), 100) AS text", "'x' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(registry, "PART_BYTES", 4096)
    assert registry.docs(spark, str(tmp_path)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_grammar_sorts_no_tokens(spark, morph):
    """where the words with readings are few, tokens are neither moved nor sorted; the rows are those of the join and the window."""
    from vidra.operators import cut, grammar

    texts = [c[1] for c in fixtures.GRAMMAR] + [None, "", " \n ", "Рече: „…Тој… дојде", "3 книги , 12ⅷ : ; 𝒶𝒷 нај добар .", "…. Дома", "не НЕСАКА İ Σ"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = spark.createDataFrame([(w,) for w in fixtures.LEXICON], "form string")
    columns = ["doc_id", *grammar._NEAR, "opener"]
    few, many = (grammar.speaking(docs, vocabulary, morph, most).select(columns) for most in (1000, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() > 50
    assert "Window" in many._jdf.queryExecution().toString()
    plan = few._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert all(x == spark.range(1).select(F.lower(F.lit(chr(c)))).first()[0] for c, x in list(cut.lowered(spark).items())[:3])
