import io
import json
import tarfile

import pytest

from vidra import cli
from vidra.plans import etl
from vidra.sources import readers, tables


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_lists_and_tables(spark, tmp_path):
    words = put(tmp_path / "w.txt", "# c\n Книга \n\nград\n")
    assert sorted(r.form for r in readers.word_list(spark, words).collect()) == ["Книга", "град"]
    rows = put(tmp_path / "m.tsv", "и\tclitic\tprn,dat\nи\tи\tcnjcoo\nи\tclitic\tprn,dat\nкратко\n\n")
    tables.build_morphology(readers.morphology_rows(spark, rows), str(tmp_path / "m"))
    got = tables.read(spark, "morph", str(tmp_path / "m")).collect()
    assert [(r.surface, [x.lemma for x in r.readings]) for r in got] == [("и", ["clitic", "и"])]
    tables.build_lexicon(readers.word_list(spark, words), str(tmp_path / "l"))
    assert [r.form for r in tables.read(spark, "lexicon", str(tmp_path / "l")).orderBy("form").collect()] == ["град", "книга"]
    with pytest.raises(ValueError):
        tables.read(spark, "freq", str(tmp_path / "l"))
    assert readers.counts(spark, put(tmp_path / "f.tsv", "а\t3\nб\n")).collect() == [("а", 3)]
    with pytest.raises(ValueError, match=":2: bad count"):
        readers.counts(spark, put(tmp_path / "b.tsv", "а\t3\nб\tx\n"))
    assert readers.counts(spark, put(tmp_path / "p.tsv", "а\tб\t3\n\tв\t2\n"), pairs=True).collect() == [("а", "б", 3)]
    assert [r.form for r in readers.hunspell(spark, put(tmp_path / "h.dic", "2\nград/A\nдома\n", "windows-1251")).orderBy("form").collect()] == ["град", "дома"]
    with pytest.raises(Exception):
        readers.word_list(spark, str(tmp_path / "none")).collect()


def test_corpora(spark, tmp_path):
    vert = '<p lang="mk">\n<s>\nЗдраво\tx\nсвете\tx\n</s>\n</p>\n<p lang="sr">\n<s>\nне\tx\n</s>\n</p>\n<p id="1">\n<s>\nда\tx\n</s>\n</p>\n'
    path = put(tmp_path / "c.vert", vert)
    assert [r.line for r in readers.corpus(spark, path).collect()] == ["Здраво свете", "да"]
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        t.add(path, "c.vert")
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "c.tar.gz")).collect()] == [("Здраво свете", "c.tar.gz"), ("да", "c.tar.gz")]
    with pytest.raises(Exception, match="missing corpus"):
        readers.corpus(spark, str(tmp_path / "none.tar.gz")).collect()
    long = '<text id="1">\nпред\tx\n' + "".join(f'<p id="{i}"{" lang=" + chr(34) + lang + chr(34) if lang else ""}>\n<s>\nзбор{i}\tx\ty\n<g/>\n.\tx\n</s>\n<s>\nдва\tx\n</s>\nбез\tx\n</p>\n' for i, lang in enumerate(["mk", "sr", None] * 50)) + "</text>\n"
    want = [x for i in range(150) if i % 3 != 1 for x in (f"збор{i} .", "два")]
    assert [r.line for r in readers.corpus(spark, put(tmp_path / "l.vert", long)).collect()] == want
    xml = "<mediawiki><page><ns>0</ns><revision><text>еден {{знаме|а}}\nдва</text></revision></page><page><ns>1</ns><revision><text>три</text></revision></page></mediawiki>"
    assert [r.line for r in readers.corpus(spark, put(tmp_path / "d.xml", xml)).collect()] == ["еден {{знаме|а}}", "два"]
    lines = spark.createDataFrame([("новзбор НОВ книга новзбор-друг abв новзбор", "b", 2), ("новзбор ъ", "b", 3), ("'''Скопје'''то новзбор", "a", 1)], "line string, source string, place long")
    known = spark.createDataFrame([("книга",)], "form string")
    assert [tuple(r) for r in etl.gaps(lines, known).collect()] == [("новзбор", 3, "a"), ("скопје", 1, "a"), ("то", 1, "a")][:2]
    marked = spark.createDataFrame([("[[Македонија|македонск]]ите {{знаме|x=1}} '''Скопје'''то",)], "line string").select(etl.strip_markup("line").alias("x")).collect()[0].x
    assert marked.split() == ["македонските", "1}}", "Скопјето"]


def test_paradigms(spark, tmp_path):
    xml = (
        '<dictionary><pardefs><pardef n="а"><e><p><l>та</l><r><s n="n"/><s n="def"/></r></p></e><e><p><l/><r><s n="n"/><s n="ind"/></r></p></e></pardef><pardef n="круг"><e><par n="круг"/></e></pardef></pardefs>'
        '<section id="main"><e lm="книга"><i>книга</i><par n="а"/></e><e lm="x" i="yes"><i>x</i></e><e><i>y</i></e><e lm="z"><i>z</i><par n="нема"/></e><e lm="к"><i>к</i><par n="круг"/></e><e lm="r"><re>.</re></e><e lm="на пат"><i>на<b/>пат</i></e></section></dictionary>'
    )
    rows = etl.expand_paradigms(spark, readers.paradigms(spark, put(tmp_path / "d.dix", xml)))
    got = sorted((r.surface, r.lemma, tuple(r.tags)) for r in rows.collect())
    assert got == [("книга", "книга", ("n", "ind")), ("книгата", "книга", ("n", "def")), ("на пат", "на пат", ())]
    assert sorted(r.form for r in etl.single_words(rows).collect()) == ["книга", "книгата"]
    solved = etl.solve({"a": [["b", ("x", "y", ("1",))], ["a"], []], "b": [[("p", "q", ()), ("r", "r", ("2",))], ["c"]], "c": [["d", ("s", "s", ())]], "d": [["c"], [("t", "t", ())]]})
    assert solved["a"] == [("prx", "qry", ("2", "1")), ("", "", ())] and solved["b"] == [("pr", "qr", ("2",))] and solved["c"] == [] and solved["d"] == [("t", "t", ())]


def test_dictionary(spark, tmp_path):
    lines = [
        '{"word":"книга","pos":"noun","lang_code":"mk","head_templates":[{"name":"mk-noun","args":{"1":"f"}}],"forms":[{"form":"книгата","tags":["definite","singular","unspecified"]},{"form":"kniga","tags":["romanization"]}]}',
        '{"word":"прави","pos":"verb","lang_code":"mk","senses":[{"tags":["transitive"]}],"forms":[{"form":"x","tags":["canonical","imperfective"]},{"form":"правам","tags":["first-person","singular","present"]},{"form":"правел","tags":["imperfect","masculine"]}]}',
        '{"word":"праи","pos":"verb","lang_code":"mk","senses":[{"tags":["nonstandard"]}]}',
        '{"word":"hlaba","pos":"noun","lang_code":"sr"}',
    ]
    forms = etl.dictionary_forms(readers.jsonl(spark, put(tmp_path / "k.jsonl", "\n".join(lines))))
    got = {(r.form, " ".join(r.tags) if r.tags else None) for r in forms.collect()}
    assert got == {("книгата", "n f sg nom def"), ("книга", None), ("правам", "vblex impf tv pres p1 sg"), ("правел", "vblex impf tv lp m sg"), ("прави", None)}
    analysed = spark.createDataFrame([("правам",)], "surface string")
    assert {r.surface for r in etl.new_analyses(forms, analysed).collect()} == {"книгата", "правел"}


def test_names(spark):
    parts = etl.name_parts(spark.createDataFrame([("Ржаново_(Струшко)",), ("«Битола» РМ книга",)], "line string"))
    known = spark.createDataFrame([("книга",)], "form string")
    new = etl.new_names(parts, known)
    assert sorted(r.name for r in new.collect()) == ["Битола", "Ржаново"]
    old = spark.createDataFrame([("Охрид",), ("Книга",)], "name string")
    assert sorted(r.name for r in etl.gazetteer(new, old, known).collect()) == ["Битола", "Охрид", "Ржаново"]


def test_word_list_and_gazetteer_builds(spark, tmp_path):
    dic = put(tmp_path / "h.dic", "3\nград/A\nдома\nград/B\n", "windows-1251")
    etl.prepare_word_list(spark, dic, str(tmp_path / "words"))
    assert [r.form for r in readers.word_list(spark, str(tmp_path / "words")).collect()] == ["град", "дома"]
    titles, places, old = put(tmp_path / "t.txt", "Ржаново_(Струшко)\nград\n"), put(tmp_path / "p.txt", "Битола\nСкопје\t41\n"), put(tmp_path / "o.txt", "Охрид\nДома\n")
    known = readers.known_words(spark, str(tmp_path / "words"))
    etl.build_gazetteer(spark, [titles], [places], old, known, known, str(tmp_path / "g"))
    assert [r.form for r in readers.word_list(spark, str(tmp_path / "g")).collect()] == ["Битола", "Охрид", "Ржаново"]
    with pytest.raises(ValueError, match="no names"):
        etl.build_gazetteer(spark, [put(tmp_path / "e.txt", "# nothing\n")], [], old, known, known, str(tmp_path / "g2"))


def test_rules_are_toggled_and_reset(spark):
    from vidra.plans import settings

    some = settings.find_rules(spark, group="Стил")
    off = settings.toggle({"userWords": ["а"], "rulesOff": ["MK_SPELL"]}, True, some)
    assert off["rulesOff"] == ["MK_SPELL", "MK_SERBIANISM"] and settings.toggle(off, False, some)["rulesOff"] == ["MK_SPELL"]
    assert settings.reset(off) == settings.normalise({"userWords": ["а"]})
    every = settings.toggle({}, True, settings.rules(spark))
    assert len(every["rulesOff"]) == 19


def test_command_line(spark, tmp_path, capsys):
    words = put(tmp_path / "w.txt", "книга\nдома\n")
    assert cli.run(spark, ["build-lexicon", str(tmp_path / "lex"), words]) == 0
    assert cli.run(spark, ["check", str(tmp_path / "lex"), "книга дома"]) == 0
    assert cli.run(spark, ["check", str(tmp_path / "lex"), "книгаа", "--json"]) == 1
    with pytest.raises(ValueError):
        cli.run(spark, ["check", str(tmp_path / "lex"), "  "])
    # Files that share a surface: readings in the order of the files.
    one, two = put(tmp_path / "1.tsv", "град\tград\tn,m,sg\n"), put(tmp_path / "2.tsv", "град\tгради\tvblex,imp\nград\tград\tn,m,sg\n")
    assert cli.run(spark, ["build-morph", str(tmp_path / "m2"), one, two]) == 0
    assert [x.lemma for x in tables.read(spark, "morph", str(tmp_path / "m2")).collect()[0].readings] == ["град", "гради"]
    # JSON of several documents is one array.
    (tmp_path / "texts").mkdir()
    for i in range(3):
        put(tmp_path / "texts" / f"{i}.txt", f"книга погрешно{'аб' * i} книгаа")
    out = io.StringIO()
    assert cli.run(spark, ["check", str(tmp_path / "lex"), "--file", str(tmp_path / "texts"), "--json"], out) == 1
    assert sorted(d["text"] for d in json.loads(out.getvalue())) == ["книгаа"] * 3 + ["погрешно", "погрешноаб", "погрешноабаб"]


def test_stream(spark, tmp_path, small=None):
    from vidra.plans.checker import Checker
    from vidra.streaming.check import check_stream

    lexicon = spark.createDataFrame([("книга",)], "form string")
    spark.createDataFrame([(1, "книгаа", 1), (1, "книга", 2), (2, "книгаа", 1)], "doc_id long, text string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, v int").parquet(str(tmp_path / "in"))
    seen = []
    check_stream(stream, Checker(lexicon), lambda rows, n: seen.extend(r.doc_id for r in rows.collect()), str(tmp_path / "cp"), version="v").awaitTermination()
    assert seen == [2]


def test_stream_without_suggestions(spark, tmp_path):
    """F16: a stream of which no suggestions are wanted searches for none."""
    from vidra.plans.checker import Checker
    from vidra.streaming.check import check_stream

    lexicon = spark.createDataFrame([("книга",)], "form string")
    spark.createDataFrame([(1, "книгаа"), (2, "книга")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    for wanted, got in ((False, []), (True, ["книга"])):
        seen = []
        check_stream(stream, Checker(lexicon), lambda rows, n, seen=seen: seen.extend(rows.collect()), str(tmp_path / f"cp{wanted}"), suggestions=wanted).awaitTermination()
        assert [(r.doc_id, r.rule, r.text, list(r.suggestions)) for r in seen] == [(1, "MK_SPELL", "книгаа", got)]
