"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Items are cut into segments of ``SEGMENT`` words, so that a window of ``WINDOW`` words taken
every ``STRIDE`` words holds any segment whole. The inverted index has, for each term, the
segments that have it, in order, with the term's share of the segment's BM25 score with itself;
a segment is retrieved by a window whose distinct terms reach ``SHARE`` of it. All that do are
retrieved, by block-max WAND: a cursor on each term's postings, the pivot where the terms' largest
shares first reach ``SHARE``, and blocks of ``BLOCK`` postings with their largest share and last
segment, by which the cursors pass over what cannot reach it. The windows of a batch take these
steps together, an array operation for each; before, running sums of the terms' largest shares in
each of ``RANGES`` ranges of segments rule most windows out.

Retrieved items are then verified against the words around the passage: an item whose text has
several lines has its last line as answer and the rest as question, else it is all question.
At least ``OVERLAP`` of the question's three-word shingles must occur there, and as many of the
answer's. An index has at most ``MAX_INDEX_BYTES`` of item text; further ones are further passes,
and the driver and the executors hold one at a time.

Words are runs of ASCII letters and digits and anything beyond ASCII, A-Z lower-cased. Defined
cases: null and empty items have no words and match nothing; items and parts shorter than three
words have their whole sequence as their shingle; null and empty texts match nothing; equal rows
get equal results; an item id given twice counts as two items; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm.kernels import ALNUM_WORDS, buffers, ngram_hashes, parts, word_hashes, word_spans
from vidra.llm.shared import keep, ship, text_only

SEGMENT, WINDOW, STRIDE = 16, 24, 8
SHARE, OVERLAP = 0.8, 0.5
K1, B = 1.2, 0.75
RANGES, BLOCK = 64, 8
MAX_INDEX_BYTES = 16 << 20
#: Windows that search together.
_TOGETHER = 4096
#: More than what rounding adds up to.
_SLACK = 1e-4
_KEY = np.int64(1 << 32)


def _hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM_WORDS)
    return word_hashes(data, starts, ends, ALNUM_WORDS)


def _shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(ngram_hashes(h, min(3, len(h)))) if len(h) else np.zeros(0, np.uint64)


class BlockMaxIndex:
    """Inverted index of item segments with block maxima."""

    def __init__(self, items: list[tuple[int, str]], ranges: int = RANGES):
        self.item_ids, self.questions, self.answers, self.lengths = [], [], [], []
        segments: list[np.ndarray] = []
        self.item_of: list[int] = []
        for item_id, text in items:
            h = _hashes((text or "").encode())
            if not len(h):
                continue
            question, _, answer = text.strip().rpartition("\n")
            self.item_ids.append(item_id)
            self.questions.append(_shingles(_hashes((question or answer).encode())))
            self.answers.append(_shingles(_hashes(answer.encode())) if question else np.zeros(0, np.uint64))
            self.lengths.append(len(h))
            pieces = -(-len(h) // SEGMENT)
            for part in np.array_split(h, pieces):
                segments.append(part)
                self.item_of.append(len(self.item_ids) - 1)
        n = len(segments)
        self.terms, inverse = np.unique(np.concatenate(segments) if n else np.zeros(0, np.uint64), return_inverse=True)
        owner = np.repeat(np.arange(n), [len(s) for s in segments])
        pair, tf = np.unique(inverse * max(n, 1) + owner, return_counts=True)
        term, seg = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(self.terms))
        size = np.array([len(s) for s in segments], float)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[seg] / max(size.mean() if n else 1, 1)))
        #: Each segment's score with itself; postings have shares of it.
        self.own = np.bincount(seg, weight, n)
        share = (weight / self.own[seg]).astype(np.float32)
        #: Postings of term t: at[t] to at[t + 1], by segment; keys are in order over all terms.
        self.at, self.seg, self.share = np.searchsorted(term, np.arange(len(self.terms) + 1)), seg, share
        self.keys = term * _KEY + seg
        first = self.at[:-1]
        self.most = np.maximum.reduceat(share, first) if n else np.zeros(0, np.float32)
        block = (np.arange(len(seg)) - first[term]) // BLOCK if n else seg
        begins = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block_most = np.maximum.reduceat(share, begins) if n else share
        self.block_last = self.keys[np.append(begins[1:], len(seg)) - 1] if n else self.keys
        self.range = max(1, -(-n // ranges))
        self.ranges = -(-n // self.range)
        self.maxima = np.zeros((len(self.terms), self.ranges), np.float32)
        np.maximum.at(self.maxima, (term, seg // self.range), share)
        # Looking up a word: the upper bits of its hash lead to where its term would stand.
        self.first = np.searchsorted(self.terms >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64))

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """The term of each word hash, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        top = (h >> np.uint64(48)).astype(np.int64)
        out = np.full(len(h), -1)
        near = np.flatnonzero(self.first[top + 1] > self.first[top])
        at = np.minimum(np.searchsorted(self.terms, h[near]), len(self.terms) - 1)
        hit = self.terms[at] == h[near]
        out[near[hit]] = at[hit]
        return out

    def search(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(window, segment, share) of all windows [a, b) of words that reach ``SHARE`` of a segment."""
        if not self.ranges or not len(a):
            return
        term = self.term_of(h)
        known = np.flatnonzero(term >= 0)
        term = term[known]
        lo, hi = np.searchsorted(known, a), np.searchsorted(known, b)
        step = max(1, (1 << 20) // self.ranges)
        i = 0
        while i < len(a):
            # Windows are in order; as many of them as have about ``step`` known words.
            j = max(i + 1, int(np.searchsorted(hi, lo[i] + step, "right")))
            x, y = lo[i], hi[i:j].max()
            run = np.zeros((y - x + 1, self.ranges), np.float64)
            np.cumsum(self.maxima[term[x:y]], axis=0, out=run[1:])
            bound = (run[hi[i:j] - x] - run[lo[i:j] - x]).max(axis=1)
            able = i + np.flatnonzero(bound + _SLACK >= SHARE)
            for k in range(0, len(able), _TOGETHER):
                yield from self._wand(able[k : k + _TOGETHER], term, lo, hi)
            i = j

    def _wand(self, windows: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Block-max WAND of several windows at once; a row of cursors for each."""
        width = int((hi[windows] - lo[windows]).max())
        at = lo[windows][:, None] + np.arange(width)
        none = len(self.terms)
        t = np.sort(np.where(at < hi[windows][:, None], term[np.minimum(at, len(term) - 1)], none), axis=1)
        t[:, 1:][t[:, 1:] == t[:, :-1]] = none
        real = t < none
        t = np.where(real, t, 0)
        pos, end = np.where(real, self.at[t], 0), np.where(real, self.at[t + 1], 0)
        most = np.where(real, self.most[t], 0)
        rows = windows
        far = np.int64(len(self.own))
        while len(rows):
            now = np.where(pos < end, self.seg[np.minimum(pos, len(self.seg) - 1)], far)
            # Cursors in order of their segments; the pivot is where the largest shares reach the threshold.
            order = np.argsort(now, axis=1, kind="stable")
            ordered = np.take_along_axis(now, order, axis=1)
            upto = np.cumsum(np.where(ordered < far, np.take_along_axis(most, order, axis=1), 0), axis=1)
            reach = upto + _SLACK >= SHARE
            alive = reach.any(axis=1)
            if not alive.all():
                pos, end, most, t, rows, now, ordered, reach = (x[alive] for x in (pos, end, most, t, rows, now, ordered, reach))
                if not len(rows):
                    return
            pivot = np.take_along_axis(ordered, reach.argmax(axis=1)[:, None], axis=1)
            before = now <= pivot
            beyond = np.where(before, far, now).min(axis=1)
            # The blocks in which these cursors' terms would have the pivot.
            keys = t * _KEY + pivot
            block = np.searchsorted(self.block_last, keys)
            block = np.minimum(block, len(self.block_last) - 1)
            inside = before & (self.block_last[block] >= keys) & (self.block_last[block] < (t + 1) * _KEY)
            bound = np.where(inside, self.block_most[block], 0).sum(axis=1)
            able = bound + _SLACK >= SHARE
            ends = np.where(inside, self.block_last[block] - t * _KEY, far).min(axis=1) + 1
            there = now == pivot
            ready = able & (now.min(axis=1) == pivot[:, 0])
            if ready.any():
                share = np.where(there[ready], self.share[np.minimum(pos[ready], len(self.share) - 1)], 0).astype(np.float64).sum(axis=1)
                for w, seg, score in zip(rows[ready].tolist(), pivot[ready, 0].tolist(), share.tolist()):
                    if score + _SLACK >= SHARE:
                        yield w, seg, score
            # Scored: on to the next segment. Able, but cursors are behind: on to the pivot. Else: behind the first block that ends, or to the next cursor.
            target = np.where(ready, pivot[:, 0] + 1, np.where(able, pivot[:, 0], np.maximum(np.minimum(ends, beyond), pivot[:, 0] + 1)))[:, None]
            move = (now < target) & (now < far)
            pos[move] = np.minimum(np.searchsorted(self.keys, (t * _KEY + target)[move]), end[move])

    def verified(self, item: int, h: np.ndarray, a: int, b: int) -> tuple[float, float] | None:
        """Shares of the question and of the answer found around the words [a, b), if both suffice."""
        near = np.unique(ngram_hashes(h[max(0, a - self.lengths[item]) : b + self.lengths[item]], 3))
        found = []
        for part in (self.questions[item], self.answers[item]):
            if self.lengths[item] < 3 or (len(part) == 1 and not np.isin(part, near).all()):
                words = h[max(0, a - self.lengths[item]) : b + self.lengths[item]]
                near = np.concatenate([near, ngram_hashes(words, 1), ngram_hashes(words, 2)])
            found.append(float(np.isin(part, near).mean()) if len(part) else 1.0)
        return (found[0], found[1]) if min(found) >= OVERLAP else None

    def matches(self, h: np.ndarray, words: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float, int]]:
        """(row, item) -> (best score, question share, answer share, first word of the passage), for rows whose words are [words[i], words[i + 1])."""
        n = np.diff(words)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        a = words[:-1][row] + k * STRIDE
        b = np.minimum(a + WINDOW, words[1:][row])
        out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        tried: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for w, seg, score in self.search(h, a, b):
            tried.setdefault((int(row[w]), self.item_of[seg]), []).append((score, w))
        for key, hits in tried.items():
            own = h[words[key[0]] : words[key[0] + 1]]
            for score, w in sorted(hits, key=lambda x: (-x[0], x[1])):
                at = int(a[w] - words[key[0]])
                shares = self.verified(key[1], own, at, int(b[w] - words[key[0]]))
                if shares:
                    out[key] = (score, *shares, at)
                    break
        return out


def _indexes(spark: SparkSession, benchmark: DataFrame) -> Iterator[tuple]:
    """(index, whether it is the last) of the items, one after another, each over at most about MAX_INDEX_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    n = max(1, -(-size // MAX_INDEX_BYTES))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield spark.sparkContext.broadcast(BlockMaxIndex(rows)), i == n - 1


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap and first_word of every verified pair; the score is BM25 as a share of the segment's own."""
    ship(spark)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]

    def one(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for whole in batches:
                for batch in parts(whole):
                    data, off = buffers(batch.column(1))
                    starts, ends, words = word_spans(data, off, ALNUM_WORDS)
                    found = own.matches(word_hashes(data, starts, ends, ALNUM_WORDS), words)
                    ids = batch.column(0).to_pylist()
                    rows = [(ids[r], own.item_ids[i], *v) for (r, i), v in found.items()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        return text_only(docs).mapInArrow(run, schema)

    out = None
    for index, last in _indexes(spark, benchmark):
        part = one(index)
        if not last:
            part = keep(spark, part, "matches")
            index.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item."""
    ship(spark)
    at = docs.columns.index("text")
    for index, last in _indexes(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for whole in batches:
                for batch in parts(whole, at):
                    data, off = buffers(batch.column(at))
                    starts, ends, words = word_spans(data, off, ALNUM_WORDS)
                    bad = {r for r, _ in own.matches(word_hashes(data, starts, ends, ALNUM_WORDS), words)}
                    yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = keep(spark, docs, "clean")
            index.unpersist()
    return docs
