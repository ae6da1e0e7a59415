import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from vidra.llm import langid, perplexity, quality_fm
from vidra.llm.kernels import buffers

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "qwx zzyk vrrt kkpl wwzx jjhq".split()}


def prose(rng, lang, n=80):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_ids(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := ("aa", "bb")[i % 2]), lang, "s") for i in range(300)]
    rows += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "12 34", "aa", "s"), (903, "x" * 20_000 + prose(rng, "bb", 9000), None, "s"), (None, prose(rng, "aa"), "aa", "s"), (1, rows[1][1], "bb", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.predict(spark, docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].lang_pred == "bb"
    held = [(r, rows[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r, _ in held) and all(r.lang_pred == d[2] for r, d in held)
    assert {r.lang_pred for r in langid.predict(spark, docs.filter("lang is null")).collect()} == {"und"}


def plain_probabilities(net, raw):
    """The network by loops: the mean over the windows of the softmax of the pooled filters."""
    found = []
    for a in range(0, len(raw), langid.WINDOW):
        window = raw[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        hidden = []
        for table, bias in zip(net.tables, net.bias):
            for f in range(table.shape[2]):
                best = max(sum(float(table[j, window[p + j], f]) for j in range(len(table))) for p in range(len(window) - len(table) + 1))
                hidden.append(max(best + float(bias[f]), 0.0))
        z = [sum(h * float(net.out[i, c]) for i, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(len(net.labels))]
        e = [math.exp(v - max(z)) for v in z]
        found.append([v / sum(e) for v in e])
    return [sum(c) / len(found) for c in zip(*found)]


def test_predictions_against_loops(spark, monkeypatch):
    rng = random.Random(31)
    langs = ["aa", "bb", "cc"]
    words = {c: ["".join(rng.choice(s) for _ in range(5)) for _ in range(30)] for c, s in zip(langs, ("abcde", "defgh", "aghij"))}
    rows = [(i, " ".join(rng.choice(words[langs[i % 3]]) for _ in range(rng.randrange(1, 90))), langs[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(*langid.sample(docs))
    got = {r.doc_id: r for r in langid.predict(spark, docs).collect()}
    for i, text, _ in rows[:12]:
        p = plain_probabilities(net, text.encode())
        assert got[i].lang_pred == net.labels[p.index(max(p))] and math.isclose(got[i].score, max(p), rel_tol=1e-4)


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    net = langid.Network(["a", "b", "c"], [rng.normal(0, 0.5, (w, 256, 2)) for w in (2, 3)], [rng.normal(0, 0.1, 2) for _ in range(2)], rng.normal(0, 0.5, (4, 3)), rng.normal(0, 0.1, 3))
    windows, y = rng.integers(97, 103, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(5), y]).mean()
    for w, g in zip([*net.tables, *net.bias, net.out, net.out_bias], langid.gradients(net, windows, y)):
        for at in {tuple(rng.integers(0, n) for n in w.shape) for _ in range(10)} | {tuple(np.unravel_index(np.abs(g).argmax(), g.shape))}:
            before, step = w[at], 1e-6
            w[at] = before + step
            up = loss()
            w[at] = before - step
            down = loss()
            w[at] = before
            assert math.isclose((up - down) / (2 * step), g[at], rel_tol=1e-4, abs_tol=1e-6)
    x = quality_fm.features(*buffers(pa.array(["a b a c\nd", "e f", "b b"])))
    m = quality_fm.Machine(0.2, rng.normal(size=quality_fm.WIDTH), rng.normal(size=(quality_fm.WIDTH, 4)) * 0.3)
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: -(y * np.log(m.score(x)) + (1 - y) * np.log(1 - m.score(x))).mean()
    base, index, linear, factors = quality_fm.gradients(m, x, y)
    for k, i in list(enumerate(index))[::7]:
        for w, at, g in ((m.linear, i, linear[k]), (m.factors, (i, 1), factors[k, 1])):
            before, step = w[at], 1e-5
            w[at] = before + step
            up = loss()
            w[at] = before - step
            down = loss()
            w[at] = before
            assert math.isclose((up - down) / (2 * step), g, rel_tol=1e-3, abs_tol=1e-6)


def test_more_languages_than_rows_of_the_sample(spark, monkeypatch):
    """Every language is learnt from, however many there are."""
    rng = random.Random(32)
    langs = [f"l{i}" for i in range(30)]
    rows = [(i, " ".join(chr(0x4E00 + 20 * (i % 30) + rng.randrange(20)) * 3 for _ in range(20)), langs[i % 30]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, labels = langid.sample(docs, 10, 4)
    assert set(labels) == set(langs) and 60 <= len(texts) <= 240
    got = langid.predict(spark, docs).collect()
    assert sum(r.lang_pred == langs[r.doc_id % 30] for r in got) > 0.95 * len(got)


def test_quality_scores(spark):
    rng = random.Random(2)
    docs = [(i, prose(rng, "aa") if i % 3 else prose(rng, "bb").replace(" ", "%% "), "x") for i in range(400)] + [(901, None, "x"), (902, "", "x"), (None, "a", "x")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, 0, 0), (2, None, 1), (5000, 1, 0)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, quality string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_fm.score(spark, d, l).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert held and sum((r.score > 0.5) == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert {r.score for r in quality_fm.score(spark, d, l.limit(0)).collect()} == {0.5}


def test_interactions_by_the_identity():
    x = quality_fm.features(*buffers(pa.array(["a b a c\nd", "", "b b"])))
    rng = np.random.default_rng(3)
    m = quality_fm.Machine(0.3, rng.normal(size=quality_fm.WIDTH), rng.normal(size=(quality_fm.WIDTH, 4)))
    for row, got in enumerate(m.raw(x)):
        own = [(i, v) for r, i, v in zip(x.row, x.index, x.value) if r == row]
        assert len({i for i, _ in own}) == len(own)
        pairs = sum(float(m.factors[i] @ m.factors[j]) * v * w for a, (i, v) in enumerate(own) for j, w in own[a + 1 :])
        assert math.isclose(got, 0.3 + sum(m.linear[i] * v for i, v in own) + pairs, rel_tol=1e-5, abs_tol=1e-5)


def brute_model(texts, order):
    """Modified Kneser-Ney of bytes with dictionaries."""
    table = Counter()
    for t in texts:
        p = b"\0" * (order - 1) + t
        table.update(p[i : i + order] for i in range(len(t)))
    counts = {order: table}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, contexts = {}, {}
    for n, c in counts.items():
        few = Counter(v for v in c.values() if v <= 4)
        n1, n2, n3, n4 = (few[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        discounts[n] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        contexts[n] = defaultdict(list)
        for g, v in c.items():
            contexts[n][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / 256
        n = len(g)
        own, low = contexts[n].get(g[:-1]), p(g[1:])
        if not own:
            return low
        d, c = discounts[n], counts[n].get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / sum(own) + sum(d[min(v, 3) - 1] for v in own) / sum(own) * low

    return p


def test_perplexity_against_dictionaries(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice(["aa", "bb"]), rng.randrange(1, 60)) for _ in range(40)] + [None, "", "é😀"]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    fitted = perplexity.fit(spark, docs)
    model = fitted.load()
    p = brute_model([(t or "").encode() for t in texts], perplexity.ORDER)
    data, off = buffers(pa.array([t or "" for t in texts]))
    for t, got in zip(texts, perplexity.log_perplexity(model, data, off)):
        raw = (t or "").encode()
        padded = b"\0" * (perplexity.ORDER - 1) + raw
        want = [-math.log2(p(padded[i : i + perplexity.ORDER])) for i in range(len(raw))]
        assert math.isclose(got, sum(want) / len(want) if want else 0, rel_tol=1e-3, abs_tol=1e-3)
    # Shards of any size add up to the same, also in the passes over a table.
    ranges = fitted.shards(40)
    assert len(ranges) > 3
    whole, parts = perplexity.log_perplexity(model, data, off), sum(perplexity.log_perplexity(fitted.load(*r), data, off) for r in ranges)
    assert np.allclose(whole, parts, atol=1e-6)
    once, often = ({r.doc_id: r for r in perplexity.verdicts(spark, docs, most).collect()} for most in (perplexity.MAX_GRAMS, 200))
    assert all(math.isclose(r.perplexity, often[i].perplexity, rel_tol=1e-6) and r[:8] == often[i][:8] for i, r in once.items())


def test_base_statistics_and_verdicts(spark):
    rng = random.Random(6)
    texts = [prose(rng, "aa", 90) for _ in range(150)] + ["".join(chr(rng.randrange(33, 126)) for _ in range(900)).replace("a", " ") + " x" * 60, "one two three " * 30, "a\n\na\nb\n \nb|", None, "", "é #\n" * 3, "x " * 70_000]
    docs = spark.createDataFrame([(i, t, "aa" if i % 2 else None, "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    rows = {r.doc_id: r for r in perplexity.verdicts(spark, docs).collect()}
    for i, t in enumerate(texts):
        words = [w for w in (t or "").encode().split()]
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {j + k for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert all(rows[i].kept for i in range(150) if not rows[i].base_failed) and not rows[150].kept
    kept = {r.doc_id for r in perplexity.keep_good(spark, docs).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}
    assert perplexity.verdicts(spark, docs.limit(0)).count() == 0


def test_rare_languages_keep_their_clean_rows(spark):
    rng = random.Random(12)
    words = {c: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(40 if c == "aa" else 900)] for c, letters in {"aa": "abcdefgh", "b1": "ijklé", "b2": "mnopö", "b3": "qrstñ"}.items()}
    sizes = {"aa": 1200, "b1": 5, "b2": 30, "b3": 99}
    rows = [(lang, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(60, 300)))) for lang, n in sizes.items() for _ in range(n)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    kept = Counter(rows[r.doc_id][0] for r in perplexity.keep_good(spark, docs).collect())
    assert all(kept[c] == n for c, n in sizes.items() if c != "aa") and kept["aa"] >= 1188, kept


def test_rows_marked_by_symbols_go(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    clean = [" ".join(rng.choice(words) for _ in range(rng.randrange(80, 200))) for _ in range(200)]
    junk = [" ".join(w + rng.choice(["%%%", "&&&", "###"]) * (rng.random() < 0.5) for w in t.split()) for t in clean[:10]] + [t.replace(" ", " | ") for t in clean[10:20]]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in perplexity.keep_good(spark, docs).collect()}
    assert not kept & set(range(200, 220)) and len(kept) >= 196
