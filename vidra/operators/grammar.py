"""The grammar pass: fourteen rules over tokens and their readings.

What a rule asks of a word's readings is worked out once for each surface of the morphology, as
a bit; one window over each document puts the bits and places of the tokens before and after
beside each token. Integer tests pick the few tokens where a rule may speak; only there are the
readings looked up and the rules, a column each, evaluated. Findings that depend on another
word's readings carry it as ``key`` and are decided after one more lookup.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidra.functions import fixed
from vidra.functions import text as X
from vidra.operators import cut
from vidra.operators import lexicon as L
from vidra.operators import morphology as M
from vidra.operators.tokens import tokens

ORDER = {r[0]: r[1] for r in fixed.RULES}
_ENDER, _DOT = r"^[.?!…]$", r"^[.…]$"
#: Words with features up to which each task reads them all; beyond, they are joined to the tokens.
MAX_FEATURES = 2_000_000
_TOKEN = "struct<idx:int,text:string,kind:string,char_start:int,char_end:int,byte_start:int,byte_end:int,bits:bigint,known:boolean>"
_NEAR = {"t": 0, "n1": 1, "n2": 2, "n3": 3, "p1": -1, "p2": -2, "p3": -3}


def context(tokens: DataFrame, lexicon: DataFrame, morph: DataFrame) -> DataFrame:
    """Token rows with feature bits and neighbours: t, n1 to n3 after it, p1 to p3 before it, opener (the last token before it that is no dot)."""
    rows = L.contains(M.by_word(tokens, M.features(morph), "text", "bits"), lexicon, "text", "known")
    token = F.struct("idx", "text", "kind", "char_start", "char_end", "byte_start", "byte_end", "bits", "known")
    by = W.partitionBy("doc_id").orderBy("idx")
    rows = rows.select("doc_id", "idx", token.alias("t"))
    dot = (F.col("t.kind") == "punct") & F.col("t.text").rlike(_DOT)
    plain = F.struct(F.col("t.text").alias("text"), F.col("t.kind").alias("kind"))
    beside = {f"n{k}": F.lead("t", k).over(by) for k in (1, 2, 3)} | {f"p{k}": F.lag("t", k).over(by) for k in (1, 2, 3)}
    return rows.withColumns(beside | {"opener": F.last(F.when(~dot | (F.col("idx") == 0), plain), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))})


def _has(name: str, *features: str) -> Column:
    return M.feature(F.col(f"{name}.bits"), *features)


def may_speak() -> Column:
    """Can some rule have a finding at the token? Tests of bits, kinds and single words."""
    t, a = _word("t"), F.col("n1")
    gap = _is("n1", "punct") & a["text"].isin(fixed.CLOSERS) & (a["byte_start"] != F.col("t.byte_end")) & (F.col("t.kind") != "punct")
    start = F.col("t.known") & ((F.col("t.idx") <= 1) | (_is("p1", "punct") & F.col("p1.text").rlike(_ENDER)))
    pair = (
        (_has("t", "definite_adjective") & _has("n1", "definite_noun")) | (_has("t", "accusative", "all_pronoun") & _has("n1", "dative") & _has("n2", "verb")) | (_has("n1", "dative") & _has("n2", "accusative") & t.isin(fixed.SUBJECTS))
        | (_has("t", "nominative") & _has("n1", "participle")) | (t.isin("нај", "по") & _has("n1", "read")) | (_has("t", "all_adjective", "adjective_forms") & _has("n1", "noun_forms"))
        | _has("t", "subject") | (_has("t", "cardinal") & _has("n1", "plural")) | (_has("t", "doubling") & _has("n1", "doubled"))
    )
    fused = ~_has("t", "read") & t.startswith("не")
    return gap | (_is("t") & (pair | start | fused))


def _is(name: str, kind: str = "word") -> Column:
    return F.coalesce(F.col(f"{name}.kind") == kind, F.lit(False))


def _word(name: str) -> Column:
    return F.lower(F.col(f"{name}.text"))


def _found(rule: str, when: Column, start: Column, end: Column, text: Column, suggestions: Column | None, severity: str = "error", key: Column | None = None, extra: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), start.alias("char_start"), end.alias("char_end"), text.alias("text"),
            (F.array().cast("array<string>") if suggestions is None else suggestions).alias("suggestions"), (nothing if key is None else key).alias("key"), (nothing if extra is None else extra).alias("extra"),
        ),
    )


def _following() -> Column:
    """The token after the subject that should be its verb: clitics and не are passed over, two at most."""
    skip = lambda n: _is(n) & ((F.col(f"{n}.text") == "не") | _has(n, "clitic"))
    return F.when(~skip("n1"), F.col("n1")).when(~skip("n2"), F.col("n2")).otherwise(F.col("n3"))


def findings() -> list[Column]:
    """A column for each rule, null where it is silent, over the columns of ``context`` and tr, ar and vr, the readings of the token, the next one and the verb."""
    t, a, b, tr, ar, vr = (F.col(c) for c in ("t", "n1", "n2", "tr", "ar", "vr"))
    pair, triple = _is("t") & _is("n1"), _is("t") & _is("n1") & _is("n2")
    both = F.concat_ws(" ", "t.text", "n1.text")
    three = F.concat_ws(" ", "t.text", "n1.text", "n2.text")
    span = (t["char_start"], a["char_end"])
    out = []

    d1, d2 = M.definite(tr, "adjective"), M.definite(ar, "noun")
    noun = M.first(M.of(ar, "noun"))
    out.append(_found("MK_DOUBLE_DEFINITE", pair & _has("t", "definite_adjective") & _has("n1", "definite_noun") & M.compatible(d1["gender"], d2["gender"]) & (d1["number"] == d2["number"]), *span, both, None, key=noun["lemma"], extra=F.concat_ws(",", d2["gender"], d2["number"])))

    order = _has("t", "accusative", "all_pronoun") & _has("n1", "dative") & _has("n2", "verb")
    out.append(_found("MK_CLITIC_ORDER", triple & order, t["char_start"], b["char_end"], three, F.array(F.concat_ws(" ", "n1.text", "t.text", "n2.text"))))

    dative = _word("t").isin(fixed.SUBJECTS) & (_word("n1") == "и") & _has("n1", "dative") & _has("n2", "accusative")
    out.append(_found("MK_DATIVE_I", triple & dative, a["char_start"], a["char_end"], a["text"], F.array(F.when(X.starts_upper("n1.text"), "Ѝ").otherwise("ѝ"))))

    full = lambda r: r["gender"].isNotNull() & r["number"].isNotNull()
    own = F.filter(tr, lambda r: F.coalesce((r["pos"] == "pronoun") & M.has(r, "nom") & full(r), F.lit(False)))
    part = F.filter(ar, lambda r: F.coalesce(M.has(r, "lp") & full(r), F.lit(False)))
    lemma = F.when(F.size(F.array_distinct(F.transform(part, lambda r: r["lemma"]))) == 1, M.first(part)["lemma"])
    out.append(_found("MK_L_PARTICIPLE", pair & _has("t", "nominative") & _has("n1", "participle") & ~M.agree(own, part), *span, both, None, key=lemma, extra=F.concat_ws(",", M.first(own)["gender"], M.first(own)["number"], t["text"])))

    fused = _word("t").startswith("не") & (F.char_length("t.text") >= 4) & ~_has("t", "read")
    for x in fixed.NE_EXCEPTED:
        fused &= ~_word("t").startswith(x)
    apart = F.concat(F.substring("t.text", 1, 2), F.lit(" "), F.expr("substring(t.text, 3)"))
    out.append(_found("MK_NE_FUSED", _is("t") & fused, t["char_start"], t["char_end"], t["text"], F.array(apart), key=F.substring(_word("t"), 3, 2**31 - 1)))

    def together(prefix: str) -> tuple[Column, Column]:
        one = F.concat(F.lit(prefix), _word("n1"))
        return one, F.array(X.match_case("t.text", one))

    one, fix = together("нај")
    out.append(_found("MK_NAJ_SEPARATED", pair & (_word("t") == "нај") & (_has("n1", "adjective") | _has("n1", "noun") | _has("n1", "verb")), *span, both, fix, key=one))

    out.append(_capital())

    one, fix = together("по")
    governed = _is("p1") & _has("p1", "noun")
    phrase = _is("n2") & (_has("n2", "noun") | _has("n2", "definite_among_adjectives"))
    comparative = (_word("t") == "по") & (_has("n1", "adjective") | _has("n1", "verb")) & ~_has("n1", "some_definite") & ~phrase & ~governed
    out.append(_found("MK_PO_SEPARATED", pair & comparative, *span, both, fix, key=one))

    emoticon = a["text"].isin(":", ";") & _is("n2", "punct") & (b["byte_start"] == a["byte_end"])
    gap = (_is("t") | _is("t", "number")) & _is("n1", "punct") & a["text"].isin(fixed.CLOSERS) & (a["byte_start"] != t["byte_end"]) & ~F.coalesce(emoticon, F.lit(False))
    out.append(_found("MK_SPACE_BEFORE_PUNCT", gap, t["char_end"], a["char_end"], F.concat(F.lit(" "), a["text"]), F.array(a["text"]), "warning"))

    adj, head = M.forms(tr, "adjective"), M.forms(ar, "noun")
    modifier = _is("n2") & _has("n2", "noun")
    out.append(_found("MK_ADJ_AGREEMENT", pair & _has("t", "all_adjective", "adjective_forms") & _has("n1", "noun_forms") & ~M.agree(adj, head) & ~modifier & ~X.starts_upper("t.text"), *span, both, None))

    verb, who = _following(), M.subject(tr)
    finite = F.filter(vr, lambda r: F.coalesce((r["pos"] == "verb") & r["person"].isNotNull() & r["number"].isNotNull(), F.lit(False)))
    wrong = (F.size(finite) > 0) & ~F.exists(finite, lambda r: (r["person"] == who["person"]) & (r["number"] == who["number"]))
    out.append(_found("MK_VERB_AGREEMENT", _is("t") & _has("t", "subject") & (verb["kind"] == "word") & wrong, t["char_start"], verb["char_end"], F.concat_ws(" ", t["text"], verb["text"]), None))

    counted = pair & _has("t", "cardinal") & _has("n1", "plural")
    gender = lambda g: M.every(ar, lambda r: r["gender"] == g)
    swapped = F.when((_word("t") == "два") & gender("F"), "две").when((_word("t") == "две") & gender("M"), "два")
    out.append(_found("MK_NUMERAL_GENDER", counted & swapped.isNotNull(), *span, both, F.array(F.concat_ws(" ", X.match_case("t.text", swapped), a["text"]))))

    count = F.when(_word("n1").rlike("[ое]ви$"), F.concat(F.regexp_replace(_word("n1"), "[ое]ви$", ""), F.lit("а")))
    lemmas = F.array_join(F.transform(ar, lambda r: r["lemma"]), "\t")
    out.append(_found("MK_COUNT_FORM", counted & swapped.isNull() & gender("M") & count.isNotNull(), *span, both, F.array(F.concat_ws(" ", t["text"], X.match_case("n1.text", count))), "warning", key=count, extra=lemmas))

    clitic = M.doubling_clitic(ar)
    doubled = F.when(X.starts_upper("t.text"), F.concat_ws(" ", X.capitalize_first(clitic), _word("t"), a["text"])).otherwise(F.concat_ws(" ", clitic, t["text"], a["text"]))
    clause = F.coalesce(F.col("n2.text") == "да", F.lit(False))
    out.append(_found("MK_OBJECT_DOUBLING", pair & _has("t", "doubling") & _has("n1", "doubled") & ~clause & ~_has_clitic(), *span, both, F.array(doubled), "warning"))
    return out


def _has_clitic() -> Column:
    """Is there an accusative clitic before the verb, at most three words back over clitics, не, ќе and да?"""
    out = F.lit(False)
    for k in (3, 2, 1):
        out = F.when(~_is(f"p{k}"), False).when(_word(f"p{k}").isin("не", "ќе", "да"), out).when(_has(f"p{k}", "accusative_clitic"), True).when(_has(f"p{k}", "clitic"), out).otherwise(False)
    return out


def _capital() -> Column:
    t, e, w = F.col("t"), F.col("p1"), F.col("p2")
    ender = _is("p1", "punct") & e["text"].rlike(_ENDER)
    second = ender & (t["idx"] >= 2) & ~(_is("p2") & (F.char_length(w["text"]) == 1))
    start = (t["idx"] == 0) | ((t["idx"] == 1) & ender)
    glued = (w["byte_end"] == e["byte_start"]) & ((e["byte_end"] == t["byte_start"]) | (F.char_length(t["text"]) <= 3))
    quoted = e["text"].rlike(_DOT) & (F.col("opener.kind") == "punct") & F.col("opener.text").isin(fixed.OPENERS)
    quiet = (_is("p2") & F.lower(w["text"]).isin(fixed.ABBREVIATIONS)) | _is("p2", "number") | F.coalesce(quoted, F.lit(False)) | F.coalesce(glued, F.lit(False))
    able = _is("t") & (F.char_length(t["text"]) >= 2) & ~t["text"].rlike(r"\p{IsUppercase}") & t["known"]
    return _found("MK_SENTENCE_CAPITAL", able & (start | (second & ~quiet)), t["char_start"], t["char_end"], t["text"], F.array(X.capitalize_first(t["text"])))


def speaking(docs: DataFrame, lexicon: DataFrame, morph: DataFrame, most: int = MAX_FEATURES) -> DataFrame:
    """The rows of ``context`` where some rule may speak.

    As long as the words with features or in the lexicon are few, each task reads them and no token is
    moved: neighbours and bits are taken from arrays of a batch's tokens, and only the rows that stay become
    rows. Beyond, tokens are joined to them and sorted by document.
    """
    spark = docs.sparkSession
    words = M.features(morph).select(F.col("surface").alias("word"), "bits", F.lit(False).alias("known")).unionByName(lexicon.select(F.col("form").alias("word"), F.lit(None).cast("long").alias("bits"), F.lit(True).alias("known")))
    words = words.groupBy("word").agg(F.max("bits").alias("bits"), F.max("known").alias("known"))
    found = words.limit(most + 1).select("word", "bits", "known").toArrow()
    if found.num_rows > most:
        return context(tokens(docs, together=True), lexicon, morph).filter(may_speak())
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(found)
    table = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    patterns, space = cut.patterns(spark), cut.characters(spark, r"\p{IsWhite_Space}")
    number, names, lower = cut.characters(spark, r"\p{N}"), list(M.FEATURES), cut.lowered(spark)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, " + ", ".join(f"{n} {_TOKEN}" for n in _NEAR) + ", opener struct<text:string,kind:string>"
    lists = fixed.SUBJECTS, fixed.CLOSERS
    rows = docs.select("doc_id", "text").mapInArrow(lambda batches: _speaking(batches, table, patterns, space, number, lower, names, lists), schema)
    # The few rows are tested again, by the rules' own words.
    return rows.withColumn("idx", F.col("t.idx")).filter(may_speak())


def _speaking(batches: Iterator[pa.RecordBatch], table, patterns: tuple[str, ...], space: str, number: str, lower: dict[int, str], names: list[str], lists: tuple[list[str], list[str]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``context`` of the tokens where a rule may speak, and of some others."""
    found = pa.ipc.open_stream(table.value).read_all().combine_chunks()
    # A last row, for words that are not there.
    forms, its = found.column(0).combine_chunks(), np.append(np.asarray(found.column(1).fill_null(-1)), -1)
    listed = np.append(np.asarray(found.column(2)), False)
    row = lambda xs: np.asarray(pc.index_in(pa.array(xs, pa.string()), value_set=forms).fill_null(len(forms)))
    split, letter, digit = re.compile(f"({patterns[0][1:-1]}|(?!{space})[\\s\\S])").split, re.compile(patterns[1]).search, re.compile(number).search
    subjects, closers = (set(x) for x in lists)
    bit = lambda *fs: sum(1 << names.index(f) for f in fs)
    for batch in batches:
        codes, whose, code, gap = cut.Codes(), [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            parts = split(text) if text else ()
            n = len(parts) // 2
            if n:
                whose.append(np.full(n, i, np.int32))
                code.append(np.fromiter(map(codes.__getitem__, parts[1::2]), np.int32, n))
                gap.append(np.fromiter(map(codes.__getitem__, parts[0:-1:2]), np.int32, n))
        if not whose:
            continue
        words = list(codes)
        low = [w.translate(lower).lower() for w in words] if lower else [w.lower() for w in words]
        word = np.array([letter(w) is not None for w in words])
        punct = ~word & np.array([digit(w) is None for w in words])
        chars, size = np.array([len(w) for w in words], np.int64), np.array([len(w.encode()) for w in words], np.int64)
        exact, lowered = row(words), row(low)
        # The readings of the word as it stands, else of its lower case.
        bits = np.where(its[exact] >= 0, its[exact], its[lowered])
        has, known = np.maximum(bits, 0), listed[lowered]
        among = lambda ws, xs: np.array([x in ws for x in xs])
        subject, close, dot, end, up, ne = among(subjects, low), among(closers, words), among({".", "…"}, words), among({".", "?", "!", "…"}, words), among({"нај", "по"}, low), np.array([x.startswith("не") for x in low])
        whose, code, gap = np.concatenate(whose), np.concatenate(code), np.concatenate(gap)
        first = np.flatnonzero(np.diff(whose, prepend=-1))
        start_of = np.repeat(first, np.diff([*first, len(whose)]))
        idx = np.arange(len(whose)) - start_of

        def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            upto = np.cumsum(lengths[code] + lengths[gap])
            upto -= np.where(start_of > 0, upto[start_of - 1], 0)
            return upto - lengths[code], upto

        (cs, ce), (bs, be) = places(chars), places(size)

        def beside(k: int) -> np.ndarray:
            """The token k places on in the same document, or -1."""
            at = np.arange(len(whose)) + k
            inside = (at >= 0) & (at < len(whose))
            at = np.where(inside, at, 0)
            return np.where(inside & (whose[at] == whose), at, -1)

        near = {n: beside(k) for n, k in _NEAR.items()}
        # What is asked of a token that is not there is false.
        at = lambda flag, n: np.where(near[n] >= 0, flag[code[near[n]]], False)
        t, n1, n2 = (np.where(near[n] >= 0, has[code[near[n]]], 0) for n in ("t", "n1", "n2"))
        are = lambda b, *fs: (b & bit(*fs)) == bit(*fs)
        apart = at(punct, "n1") & at(close, "n1") & ~punct[code] & (np.where(near["n1"] >= 0, bs[near["n1"]], 0) != be)
        start = known[code] & ((idx <= 1) | (at(punct, "p1") & at(end, "p1")))
        pair = (
            (are(t, "definite_adjective") & are(n1, "definite_noun")) | (are(t, "accusative", "all_pronoun") & are(n1, "dative") & are(n2, "verb")) | (are(n1, "dative") & are(n2, "accusative") & subject[code])
            | (are(t, "nominative") & are(n1, "participle")) | (up[code] & are(n1, "read")) | (are(t, "all_adjective", "adjective_forms") & are(n1, "noun_forms"))
            | are(t, "subject") | (are(t, "cardinal") & are(n1, "plural")) | (are(t, "doubling") & are(n1, "doubled"))
        )
        some = np.flatnonzero(apart | (word[code] & (pair | start | (~are(t, "read") & ne[code]))))
        # The last token before it that is no dot, or else the document's first.
        plain = ~(punct & dot)[code] | (idx == 0)
        last = np.maximum.accumulate(np.where(plain, np.arange(len(whose)), -1))
        before = np.where(idx > 0, last[np.maximum(np.arange(len(whose)) - 1, 0)], -1)
        texts, kinds = pa.array(words, pa.string()), pa.array(np.where(word, "word", np.where(punct, "punct", "number")))
        every = pa.array(bits, pa.int64(), mask=bits < 0)
        for a in range(0, len(some), 65_536):
            here = some[a : a + 65_536]
            columns = [batch.column(0).take(pa.array(whose[here]))]
            for n in _NEAR:
                x = near[n][here]
                own = pa.array(code[x])
                fields = {"idx": pa.array(idx[x].astype(np.int32)), "text": texts.take(own), "kind": kinds.take(own)}
                fields |= {c: pa.array(v[x].astype(np.int32)) for c, v in (("char_start", cs), ("char_end", ce), ("byte_start", bs), ("byte_end", be))}
                fields |= {"bits": every.take(own), "known": pa.array(known[code[x]])}
                columns.append(pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=pa.array(x < 0)))
            x = before[here]
            own = pa.array(code[x])
            columns.append(pa.StructArray.from_arrays([texts.take(own), kinds.take(own)], ["text", "kind"], mask=pa.array(x < 0)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_NEAR, "opener"])


def check(docs: DataFrame, lexicon: DataFrame, morph: DataFrame) -> DataFrame:
    """Diagnostics of all grammar rules in documents (doc_id, text)."""
    rows = speaking(docs, lexicon, morph).withColumns({"_t": F.col("t.text"), "_a": F.col("n1.text"), "_v": F.when(_has("t", "subject"), _following()["text"])})
    for word, name in (("_t", "tr"), ("_a", "ar"), ("_v", "vr")):
        rows = M.analyze(rows, morph, word, name)
    rows = rows.select("doc_id", F.explode(F.filter(F.array(*findings()), lambda x: x.isNotNull())).alias("f")).select("doc_id", "f.*")
    rows = L.contains(M.analyze(rows, morph, "key", "kr"), lexicon, "key", "key_known")
    lp = L.lookup(M.participles(morph)).select(F.col("lemma").alias("_lemma"), "forms")
    rows = rows.join(lp, (F.col("rule") == "MK_L_PARTICIPLE") & (F.col("key") == F.col("_lemma")), "left")
    at = lambda i: F.try_element_at(F.split("extra", ",", 3), F.lit(i))
    fits = lambda r: (r["number"] == at(2)) & M.compatible(r["gender"], at(1))
    bare = M.some(F.col("kr"), lambda r: (r["pos"] == "noun") & ~M.is_definite(r) & fits(r))
    form = M.first(F.filter("forms", lambda f: M.some(f["readings"], lambda r: M.has(r, "lp") & fits(r))))["surface"]
    head = F.substring_index("text", " ", 1)
    verb_only = M.every(F.col("kr"), lambda r: r["pos"].isNull() | r["pos"].isin("verb", "particle"))
    finite = M.some(F.col("kr"), lambda r: (r["pos"] == "verb") & (M.has(r, "pres") | M.has(r, "imp") | M.has(r, "impf")) & ~M.has(r, "pp") & ~M.has(r, "pprs") & ~M.has(r, "lp"))
    counted = M.some(F.col("kr"), lambda r: (r["pos"] == "noun") & (r["number"] == "pl") & F.array_contains(F.split("extra", "\t"), r["lemma"]))
    stays = (
        F.when(F.col("rule").isin("MK_NAJ_SEPARATED", "MK_PO_SEPARATED"), F.col("key_known") | (F.size("kr") > 0))
        .when(F.col("rule") == "MK_NE_FUSED", verb_only & finite).when(F.col("rule") == "MK_COUNT_FORM", counted).otherwise(True)
    )
    proposed = (
        F.when((F.col("rule") == "MK_DOUBLE_DEFINITE") & bare, F.array(F.concat_ws(" ", head, "key")))
        .when((F.col("rule") == "MK_L_PARTICIPLE") & form.isNotNull(), F.array(F.concat_ws(" ", head, form))).otherwise(F.col("suggestions"))
    )
    order, message = F.lit(0), F.lit("")
    for r in fixed.RULES:
        order = F.when(F.col("rule") == r[0], r[1]).otherwise(order)
        message = F.when(F.col("rule") == r[0], r[5]).otherwise(message)
    return rows.filter(stays).select("doc_id", "rule", order.alias("rule_order"), "severity", "char_start", "char_end", "text", message.alias("message"), proposed.alias("suggestions"))
