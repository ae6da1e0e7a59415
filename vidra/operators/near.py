"""Pairs of words that share a deletion neighbour, found over hashed neighbourhoods.

A word's neighbours are never written as text: the hashes of all that is left of it after some
deletions follow from the sums of its letters' terms. Each part of the hashes is dealt to one task
with the words that have them, so a word is moved once a part and a neighbour takes four bytes.
Neighbours of equal hash but different letters only make pairs that the caller's edit distance drops.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of equal hash that are told apart at a time.
_AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def pairs(queries: DataFrame, forms: DataFrame, distance: int, longest: int) -> DataFrame:
    """(query, form) of all words, queries of up to ``longest`` characters, within ``distance`` (1 or 2) and of some beyond it, possibly several times."""
    # Executors need not have this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark = queries.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Longer forms are out of reach of every query.
    both = queries.select(F.col("query").alias("word"), F.lit(True).alias("asked")).unionByName(forms.filter(F.char_length("form") <= longest + distance).select(F.col("form").alias("word"), F.lit(False).alias("asked")))
    dealt = both.mapInArrow(lambda batches: _dealt(batches, parts, distance), "part int, asked boolean, ends binary, letters binary, counts binary, hashes binary").repartitionById(parts, "part")
    return dealt.mapInArrow(lambda batches: _met(batches, distance), "query string, form string")


def hashes(codes: np.ndarray, distance: int) -> np.ndarray:
    """The hashes of what is left of words of equal length after up to ``distance`` (1 or 2) deletions, a row a word; codes: their code points, a row a word."""
    m, n = codes.shape
    c = codes.astype(np.uint64) + np.uint64(1)
    c = (c ^ (c << np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9)
    power = np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)
    back, back2 = (np.uint64(pow(_BASE, -k, 1 << 64)) for k in (1, 2))
    upto = np.zeros((m, n + 1), np.uint64)
    np.cumsum(c * power, axis=1, dtype=np.uint64, out=upto[:, 1:])
    out = [upto[:, n:]]
    # What follows a letter that is gone moves up by a place.
    if n:
        out.append(upto[:, :n] + (upto[:, n:] - upto[:, 1:]) * back)
    if n > 1 and distance > 1:
        i, j = np.triu_indices(n, 1)
        out.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * back + (upto[:, n:] - upto[:, j + 1]) * back2)
    h = np.concatenate(out, axis=1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _dealt(batches: Iterator[pa.RecordBatch], parts: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows of words and their hashes in a part, in the order of the words."""
    for batch in batches:
        # By side and length; words beside their likes pack better.
        rows = sorted(zip(batch.column(1).to_pylist(), (len(w) for w in batch.column(0).to_pylist()), batch.column(0).to_pylist()))
        asked, words = np.array([r[0] for r in rows], bool), [r[2] for r in rows]
        length = np.array([r[1] for r in rows])
        owner, keys, begin = [], [], 0
        while begin < len(words):
            n = length[begin]
            # Words of many letters have many neighbours: some words at a time.
            other = np.flatnonzero(length[begin : begin + 2048] != n)
            end = begin + int(other[0]) if len(other) else min(begin + 2048, len(words))
            codes = np.frombuffer("".join(words[begin:end]).encode("utf-32-le"), np.uint32).reshape(end - begin, n)
            h = hashes(codes, distance)
            owner.append(np.repeat(np.arange(begin, end), h.shape[1]))
            keys.append(h.ravel())
            begin = end
        if not keys:
            continue
        owner, keys = np.concatenate(owner), np.concatenate(keys)
        part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        owner, keys, part = owner[order], keys[order].astype(np.uint32), part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        utf8, rows = [w.encode() for w in words], []
        for p in range(parts):
            own, key = owner[cuts[p] : cuts[p + 1]], keys[cuts[p] : cuts[p + 1]]
            for side in (True, False):
                here = asked[own] == side
                who, counts = np.unique(own[here], return_counts=True)
                if len(who):
                    text = [utf8[x] for x in who]
                    ends = np.cumsum([len(t) for t in text], dtype=np.int32)
                    rows.append((p, side, ends.tobytes(), b"".join(text), counts.astype(np.uint16).tobytes(), key[here].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["part", "asked", "ends", "letters", "counts", "hashes"])


class _Words:
    """The words of some rows: as text, their lengths, a bit for each of their letters; hashes and the words they are of."""

    def __init__(self, rows: list[tuple[bytes, bytes, bytes, bytes]]):
        ends, upto = [np.zeros(1, np.int64)], 0
        for e, letters, _, _ in rows:
            ends.append(np.frombuffer(e, np.int32).astype(np.int64) + upto)
            upto += len(letters)
        ends = np.concatenate(ends)
        self.text = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(r[1] for r in rows)))
        counts = np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows])
        self.key = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
        self.of = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        words = self.text.to_pylist()
        self.long = np.array([len(w) for w in words], np.int32)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        bits = np.left_shift(np.uint64(1), (code % 64).astype(np.uint64))
        # An empty word has no letters, and reduceat would take the next word's.
        self.mask = np.zeros(len(words), np.uint64)
        some = self.long > 0
        if some.any():
            self.mask[some] = np.bitwise_or.reduceat(bits, (np.cumsum(self.long) - self.long)[some])


def _met(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Pairs of equal hash, but those whose lengths or letters are too far apart, once a row of queries."""
    rows: dict[tuple[int, bool], list] = {}
    for batch in batches:
        for part, asked, *row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.setdefault((part, asked), []).append(tuple(row))
    for part in sorted({p for p, _ in rows}):
        asked, known = rows.pop((part, True), []), rows.pop((part, False), [])
        if not asked or not known:
            continue
        forms = _Words(known)
        order = np.argsort(forms.key)
        keys, of = forms.key[order], forms.of[order]
        for row in asked:
            q = _Words([row])
            order = np.argsort(q.key)
            low = np.searchsorted(keys, q.key[order], "left")
            n = np.searchsorted(keys, q.key[order], "right") - low
            some = n > 0
            low, n, who = low[some], n[some], q.of[order][some]
            upto = np.cumsum(n)
            found, begin = [], 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _AT_ONCE, "right")))
                k = n[begin:end]
                at = np.repeat(low[begin:end] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                a, b = np.repeat(who[begin:end], k), of[at]
                close = np.abs(q.long[a] - forms.long[b]) <= distance
                a, b = a[close], b[close]
                x, y = q.mask[a], forms.mask[b]
                close = (np.bitwise_count(x & ~y) <= distance) & (np.bitwise_count(y & ~x) <= distance)
                found.append(np.unique(a[close].astype(np.int64) * len(forms.long) + b[close]))
                begin = end
            if not found:
                continue
            pair = np.unique(np.concatenate(found))
            for k in range(0, len(pair), 65_536):
                a, b = np.divmod(pair[k : k + 65_536], len(forms.long))
                yield pa.RecordBatch.from_arrays([q.text.take(pa.array(a)).cast(pa.string()), forms.text.take(pa.array(b)).cast(pa.string())], ["query", "form"])
