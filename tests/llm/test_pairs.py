import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from vidra.llm import decontaminate, ngram_jaccard
from vidra.llm.components import connected_components
from vidra.llm.decontaminate import BlockMaxIndex, keep_clean, matches
from vidra.llm.kernels import ALNUM_WORDS, buffers, word_hashes, word_spans
from vidra.llm.ngram_jaccard import components


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows))


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 5, 6, 9, 30, 31, 60, 120) for _ in range(2)]

    def near(words):
        words = list(words)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words[: len(words) - rng.choice([0, 0, 1])]).upper() if rng.random() < 0.3 else " ".join(words)

    rows = [(i, near(rng.choice(base))) for i in range(260)] + [(900, None), (901, ""), (902, "  \n"), (903, "a b"), (904, "A  b"), (905, "x " * 30_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, size int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in components(spark, docs).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_near_copies_that_are_just_too_different(spark, monkeypatch):
    """One family, pairwise below 80 %, with a few true links, in one tile and in many."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(0, 120, 8), 3):
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(0, 90, 9)] + [(200, " ".join(base)), (201, " ".join(base[:-1])), (300, None), (301, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 60 < len({c for _, _, c in want}) < 92
    for tile, similar in ((1 << 19, 30), (1000, 30), (400, 95)):
        monkeypatch.setattr(ngram_jaccard, "TILE", tile)
        monkeypatch.setattr(ngram_jaccard, "SIMILAR", similar)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in components(spark, docs).collect()) == want


def test_components_of_many_rows_without_id(spark):
    rng = random.Random(22)
    rows = [(None, " ".join(f"w{rng.randrange(900)}" for _ in range(40))) for _ in range(60)]
    rows += [(None, t + " more") for _, t in rows[:20]] + [(5, rows[30][1] + " more")]
    got = components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(None, None): 79, (None, 5): 1, (5, 5): 1}


def test_components_of_nulls_repeats_and_nothing(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (7, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, (r.component_id or -1)) for r in components(spark, docs).collect())
    assert got == [(-1, 1, -1), (-1, 2, 3), (3, 2, 3), (3, 2, 3), (7, 1, 7)]
    assert components(spark, docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


def test_search_retrieves_what_brute_force_does():
    """BM25 with dictionaries, of every window with every segment."""
    for seed, vocabulary, ranges in ((1, 30, 64), (2, 200, 3), (3, 8, 1), (4, 2000, 64)):
        rng = random.Random(seed)
        words = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(4000)]
        items = [(i, " ".join(words[j : j + n])) for i in range(80) for j, n in [(rng.randrange(3000), rng.choice([1, 2, 5, 16, 17, 40]))]]
        index = BlockMaxIndex(items, ranges)
        segments = [list(x) for _, text in items for x in np.array_split(np.array(text.split()), -(-len(text.split()) // 16))]
        df = Counter(w for s in segments for w in set(s))
        mean = sum(map(len, segments)) / len(segments)

        def bm25(query, segment):
            tf = Counter(segment)
            return sum(math.log1p((len(segments) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(segment) / mean)) for w in query if w in tf)

        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(30)] + [f"x {items[k][1]} {rng.choice(words)} y" for k in range(0, 80, 4)]
        data, off = buffers(pa.array(texts))
        starts, ends, at = word_spans(data, off, ALNUM_WORDS)
        h = word_hashes(data, starts, ends, ALNUM_WORDS)
        a = np.array([i for x, y in zip(at, at[1:]) for i in range(x, y, 5)])
        b = np.array([min(i + 24, y) for x, y in zip(at, at[1:]) for i in range(x, y, 5)])
        every = [w for t in texts for w in t.split()]
        want = {}
        for w, (i, j) in enumerate(zip(a, b)):
            for s, segment in enumerate(segments):
                share = bm25(set(every[i:j]), segment) / bm25(set(segment), segment)
                if abs(share - 0.8) > 1e-3:
                    want[w, s] = share if share > 0.8 else 0
        got = {(w, s): share for w, s, share in index.search(h, a, b)}
        assert len(got) == len(list(index.search(h, a, b)))
        assert {k for k in got if k in want} == {k for k, v in want.items() if v} and any(want.values())
        assert all(math.isclose(got[k], v, rel_tol=1e-4) for k, v in want.items() if v)


def test_items_beyond_one_index(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(30))) for i in range(40)]
    docs = spark.createDataFrame([(i, f"a b c {items[i][1]} d e f" if i < 40 else "a b c", "x") for i in range(60)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_INDEX_BYTES", 1500)
    assert sorted((r.doc_id, r.item_id) for r in matches(spark, docs, benchmark).collect()) == [(i, i) for i in range(40)]
    assert sorted(r.doc_id for r in keep_clean(spark, docs, benchmark).collect()) == list(range(40, 60))


def test_decontamination(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"What about {text(20)}?\n{text(6)}.") for i in range(30)] + [(50, text(90)), (51, None), (52, ""), (53, "two words")]
    docs = [(i, f"{text(70)} {items[i][1].upper() if i % 2 else items[i][1]} {text(50)}") for i in range(30)]
    docs += [(50, text(200) + " " + items[30][1].replace(" ", "\n")), (60, items[3][1].split("\n")[0] + " " + text(80)), (61, None), (62, ""), (63, text(3000)), (64, "ab " * 30_000), (1, docs[1][1])]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id) for r in matches(spark, d, b).collect())
    assert got == sorted([(i, i) for i in range(30)] + [(50, 50), (1, 1)])
    assert sorted(r.doc_id for r in keep_clean(spark, d, b).collect()) == [60, 61, 62, 63, 64]
    assert matches(spark, d, b.limit(0)).count() == 0 and matches(spark, d.limit(0), b).count() == 0
