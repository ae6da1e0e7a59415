"""Language identification by a byte convolutional network, trained in numpy.

One-hot bytes, filters of several widths, max pooling over the window, softmax. A text is cut
into windows of a fixed number of bytes, the last one padded with zero bytes; every window of
the whole text is scored in batches and the class probabilities are averaged.

The fit sees one window of each row of a bounded sample: about ``SAMPLE`` rows, or ``EACH`` for
every language if that is more, equally many of each language as far as it has them, by a hash of
the row. Every language that any row names is learnt; prediction sees every row. Defined cases: a text that is null
or has no letter is ``und`` with score 0; rows without a language are not learnt from; with no
rows to learn from at all, every text is ``und``; equal rows give equal rows; a null id is never
held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm.kernels import buffers, parts
from vidra.llm.shared import ship

#: Rows of the fit, or rows for each language.
SAMPLE, EACH = 4000, 20
#: Languages sent to every executor; beyond it, a shuffle.
MAX_BROADCAST_LANGUAGES = 100_000
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
HELD_OUT_MOD, HELD_OUT_REST = 5, 0


@dataclass
class Network:
    """tables: for each width an array (width, 256, filters); out: (filters of all widths, classes)."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, where: list | None = None) -> np.ndarray:
        """Maximum over the positions of each filter's response, rectified; ``where`` gets the positions."""
        found = []
        for table, bias in zip(self.tables, self.bias):
            n = windows.shape[1] - len(table) + 1
            r = np.take(table[0], windows[:, :n], axis=0)
            for j in range(1, len(table)):
                r += np.take(table[j], windows[:, j : j + n], axis=0)
            if where is None:
                found.append(r.max(axis=1) + bias)
            else:
                p = r.argmax(axis=1)
                where.append(p)
                found.append(np.take_along_axis(r, p[:, None, :], axis=1)[:, 0] + bias)
        return np.maximum(np.concatenate(found, axis=1), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return self.from_pooled(self.pooled(windows))

    def from_pooled(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every window and the row it belongs to."""
    n = -(-(off[1:] - off[:-1]) // size)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = off[:-1][row] + k * size
    return np.stack([start, np.minimum(start + size, off[1:][row])], axis=1), row


def gather(data: np.ndarray, spans: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The windows' bytes, padded with zeros."""
    at = spans[:, :1] + np.arange(size)
    inside = at < spans[:, 1:]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8)


def gradients(net: Network, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy: for each table, each bias, the output weights and their bias."""
    where: list[np.ndarray] = []
    hidden = net.pooled(windows, where)
    z = net.from_pooled(hidden)
    z[np.arange(len(y)), y] -= 1
    z /= len(y)
    d_hidden = (z @ net.out.T) * (hidden > 0)
    tables, bias, at = [np.zeros_like(t) for t in net.tables], [], 0
    for table, p in zip(tables, where):
        # Only the position of the maximum has a share in a filter's output.
        filters = table.shape[2]
        d = d_hidden[:, at : at + filters]
        at += filters
        bias.append(d.sum(axis=0))
        for j in range(len(table)):
            np.add.at(table[j], (np.take_along_axis(windows, p + j, axis=1), np.broadcast_to(np.arange(filters), p.shape)), d)
    return [*tables, *bias, hidden.T @ z, z.sum(axis=0)]


def train(texts: list[bytes], labels: list[str], epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy of single windows of varying length."""
    names = sorted(set(labels))
    place = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(seed)
    y = np.array([place[x] for x in labels])
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        x[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    net = Network(names, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    weights = [*net.tables, *net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            windows = x[rows].copy()
            if epoch % 2:
                windows[np.arange(WINDOW) >= rng.integers(24, WINDOW + 1, len(rows))[:, None]] = 0
            step += 1
            for w, g, m, v in zip(weights, gradients(net, windows, y[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(mod: int, rest: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE, each: int = EACH) -> tuple[list[bytes], list[str]]:
    """One window of each of about ``rows`` rows, or ``each`` a language; about equally many of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(HELD_OUT_MOD, HELD_OUT_REST)).filter(F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sizes.count()
    if not languages:
        return [], []
    rows = max(rows, each * languages)
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(rows / languages) / F.col("n")).alias("share"))
    if languages <= MAX_BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    h = F.xxhash64("doc_id", "text")
    place = F.pmod(F.shiftright(h, 20), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1)
    picked = (
        known.join(share, "lang").filter(F.pmod(h, F.lit(1 << 20)) < F.col("share") * (1 << 20))
        .select(h.alias("h"), "lang", F.encode(F.substring("text", place.cast("int") + 1, F.lit(WINDOW)), "UTF-8").alias("piece"))
        # Equal rows fall together, so there may be more; twice as many is the bound.
        .orderBy("h", "piece").limit(2 * rows).collect()
    )
    return [bytes(r["piece"]) for r in picked], [r["lang"] for r in picked]


def predict(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    ship(spark)
    texts, labels = sample(docs)
    net = train(texts, labels) if texts else None
    known = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for whole in batches:
            for batch in parts(whole, 3):
                data, off = buffers(batch.column(3))
                n = batch.num_rows
                names, score = ["und"] * n, [0.0] * n
                if own is not None:
                    spans, row = cut(data, off)
                    total = np.zeros((n, len(own.labels)))
                    for a in range(0, len(spans), 256):
                        np.add.at(total, row[a : a + 256], own.probabilities(gather(data, spans[a : a + 256])))
                    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
                    best = total.argmax(axis=1)
                    letters = batch.column(2).to_pylist()
                    names = [own.labels[b] if x else "und" for b, x in zip(best, letters)]
                    score = [float(total[i, b]) if letters[i] else 0.0 for i, b in enumerate(best)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(HELD_OUT_MOD, HELD_OUT_REST).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
