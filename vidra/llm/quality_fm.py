"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    y(x) = w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

so that the pairwise interactions cost linear time. Features of a text are its words, hashed
into ``BUCKETS`` slots and weighted by the root of their share of the words; structure
statistics, each as a number and as one of ``BINS`` ranges; and metadata, the order of
magnitude of its length in bytes, words and lines.

The fit sees a bounded sample of labelled rows (``SAMPLE``, taken by a hash of the id); scoring
sees every row. Defined cases: null and empty texts have no words and are scored by their
statistics alone; labels that are null and rows without a label are not learnt from; of several
labels for one id the smallest counts; without any label to learn from the score is 0.5; equal
rows give equal rows; a null id is never held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm.kernels import SPACE_WORDS, buffers, parts, per_row, word_hashes, word_spans
from vidra.llm.langid import held_out
from vidra.llm.shared import keep, ship, text_only

#: Labelled rows of the fit, at most.
SAMPLE = 6000
BUCKETS, FACTORS, BINS = 1 << 14, 8, 10
THRESHOLD = 0.7
HELD_OUT_MOD, HELD_OUT_REST = 4, 2
STATS = ["upper", "digit", "symbol", "mark", "space", "beyond_ascii", "word_bytes", "long_words", "distinct", "same_as_last", "dup_lines", "line_words", "tailed", "top_word", "bytes", "words", "lines"]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SYMBOL = _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b"#*$%&|<>")
_MARK, _SPACE, _BEYOND = _mask(b".,;:!?"), _mask(b" \t"), _mask(bytes(range(0xC0, 0x100)))


@dataclass
class Features:
    """Rows of sparse features: ``row``, ``index`` and ``value`` sorted by row, each (row, index) once."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rows: int


def features(data: np.ndarray, off: np.ndarray) -> Features:
    """Features of the texts in ``data``; the statistics follow the word buckets."""
    n = len(off) - 1
    size = np.maximum(off[1:] - off[:-1], 1).astype(float)
    starts, ends, words = word_spans(data, off, SPACE_WORDS)
    h = word_hashes(data, starts, ends, SPACE_WORDS)
    n_words = np.diff(words)
    per = np.maximum(n_words, 1).astype(float)
    row = np.repeat(np.arange(n), n_words)

    def by_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x, n) if len(row) else np.zeros(n)

    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(key)))
    own = (key[at] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, own, times)
    last = np.zeros(len(h), bool)
    last[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    lines, dup = np.zeros(n), np.zeros(n)
    raw, o = data.tobytes(), off.tolist()
    for i in range(n):
        own_lines = [x for x in raw[o[i] : o[i + 1]].split(b"\n") if x.strip()]
        lines[i] = len(own_lines)
        dup[i] = len(own_lines) - len(set(own_lines))
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stats = np.stack([
        per_row(_UPPER[data], off) / size, per_row(_DIGIT[data], off) / size, per_row(_SYMBOL[data], off) / size, per_row(_MARK[data], off) / size,
        per_row(_SPACE[data], off) / size, per_row(_BEYOND[data], off) / size, by_word(ends - starts) / per / 20, by_word(ends - starts > 12) / per,
        np.bincount(own, minlength=n) / per, by_word(last) / per, dup / np.maximum(lines, 1), np.log1p(n_words / np.maximum(lines, 1)) / 6,
        by_word(_SYMBOL[tail] | (tail == 33)) / per, top / per, np.log1p(off[1:] - off[:-1]) / 12, np.log1p(n_words) / 10, np.log1p(lines) / 8,
    ])
    bucket = (key[at] & np.uint64(BUCKETS - 1)).astype(np.int64)
    # Two words of a row in one slot are one feature, so that the identity holds.
    slot, inverse = np.unique(own * BUCKETS + bucket, return_inverse=True)
    times = np.bincount(inverse, times, len(slot)) if len(slot) else np.zeros(0)
    w_row, w_index = slot // BUCKETS, slot % BUCKETS
    w_value = np.sqrt(times / per[w_row]) if len(slot) else times
    k = len(STATS)
    s_row, s_index, s_value = np.tile(np.arange(n), k), np.repeat(BUCKETS + np.arange(k), n), stats.ravel()
    ranges = np.minimum((np.clip(stats, 0, 1) ** 0.5 * BINS).astype(np.int64), BINS - 1)
    r_index = (BUCKETS + k + np.arange(k)[:, None] * BINS + ranges).ravel()
    rows, index, value = np.concatenate([w_row, s_row, s_row]), np.concatenate([w_index, s_index, r_index]), np.concatenate([w_value, s_value, np.ones(k * n)])
    order = np.argsort(rows, kind="stable")
    return Features(rows[order], index[order], value[order].astype(np.float32), n)


WIDTH = BUCKETS + len(STATS) * (1 + BINS)


@dataclass
class Machine:
    """w0, the linear weights and the factors."""

    base: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, x: Features) -> np.ndarray:
        out = np.full(x.rows, self.base) + np.bincount(x.row, self.linear[x.index] * x.value, x.rows)
        v = self.factors[x.index] * x.value[:, None]
        at = np.searchsorted(x.row, np.arange(x.rows))
        sums = np.add.reduceat(v, at, axis=0)
        squares = np.add.reduceat(v * v, at, axis=0)
        return out + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def gradients(w: Machine, x: Features, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss: for the base; the features that occur; for their linear weights; for their factors."""
    at = np.searchsorted(x.row, np.arange(x.rows))
    v = w.factors[x.index] * x.value[:, None]
    sums = np.add.reduceat(v, at, axis=0)
    d = (w.score(x) - y) / x.rows
    each = d[x.row] * x.value
    index, inverse = np.unique(x.index, return_inverse=True)
    pairs = each[:, None] * (sums[x.row] - v)
    by_feature = np.stack([np.bincount(inverse, pairs[:, f], len(index)) for f in range(pairs.shape[1])], axis=1)
    return float(d.sum()), index, np.bincount(inverse, each, len(index)), by_feature


def train(x: Features, y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    w = Machine(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    g_linear, g_factors, g_base = np.full(WIDTH, 1e-3), np.full((WIDTH, FACTORS), 1e-3), 1e-3
    bounds = np.searchsorted(x.row, np.arange(x.rows + 1))
    for _ in range(epochs):
        order = rng.permutation(x.rows)
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            n = bounds[rows + 1] - bounds[rows]
            pick = np.repeat(bounds[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            part = Features(np.repeat(np.arange(len(rows)), n), x.index[pick], x.value[pick], len(rows))
            base, index, linear, factors = gradients(w, part, y[rows])
            linear, factors = linear + decay * w.linear[index], factors + decay * w.factors[index]
            g_linear[index] += linear * linear
            g_factors[index] += factors * factors
            g_base += base**2
            w.linear[index] -= rate * linear / np.sqrt(g_linear[index])
            w.factors[index] -= rate * factors / np.sqrt(g_factors[index])
            w.base -= rate * base / np.sqrt(g_base)
    return w


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[Features, np.ndarray] | None:
    """Features and labels of at most ``rows`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(HELD_OUT_MOD, HELD_OUT_REST))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = keep(spark, picked, "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                x = features(*buffers(batch.column(1)))
                b = np.searchsorted(x.row, np.arange(x.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(b, pa.array(x.index.astype(np.int32))), pa.ListArray.from_arrays(b, pa.array(x.value))], ["doc_id", "quality", "index", "value"])

    # The picked ids are ``rows`` at most, so they go to every executor.
    found = text_only(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, index array<int>, value array<float>")
    table = found.orderBy("doc_id").limit(rows).toArrow()
    if not table.num_rows:
        return None
    index, value = table.column("index").combine_chunks(), table.column("value").combine_chunks()
    x = Features(np.repeat(np.arange(table.num_rows), np.diff(index.offsets.to_numpy())), index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), table.num_rows)
    return x, table.column("quality").to_numpy().astype(float)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship(spark)
    known = sample(spark, docs, labels)
    model = spark.sparkContext.broadcast(train(*known) if known else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for whole in batches:
            for batch in parts(whole):
                s = own.score(features(*buffers(batch.column(1)))) if own else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return text_only(docs, held_out(HELD_OUT_MOD, HELD_OUT_REST).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
