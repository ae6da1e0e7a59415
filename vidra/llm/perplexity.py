"""Quality rules: n-gram perplexity under a modified Kneser-Ney model that Spark counts.

The model is one of bytes, of order ``ORDER``: every byte of every text is predicted from the
bytes before it (zero bytes before the text). Spark counts the n-grams of the highest order
over the whole corpus, exactly; the lower orders' continuation counts, the contexts' totals and
the discounts follow from that table by aggregation, and the interpolated probabilities by joins.
What is stored are tables of the shared folder that grow with the corpus: the log probability of
every n-gram seen and the log back-off mass of every context.

Scoring holds them as sorted hash arrays: a one-to-one hash of the n-gram's own bytes, sorted,
with the value beside it, so an n-gram that was not seen is told from all that were and backs
off. A model is cut by the last two bytes of its n-grams into shards of at most ``MAX_GRAMS``
n-grams of the highest order (of which any two bytes end 2**24 at most); executors hold one
shard at a time, and every further shard is a further pass that adds its bytes' share.

A document's perplexity is per byte. Each language has a band around its own median log
perplexity, ``WIDTH_LOW`` and ``WIDTH_HIGH`` robust deviations (interquartile range / 1.349) wide
and never narrower than ``LEAST`` bits; documents outside it are rejected. Only documents that
pass the base rules count for a band. The quartiles are those of exact counts in bins of
1 / ``BINS`` bits, and so the same however the rows are dealt. The deviation is drawn towards the
typical one within a language as if ``PRIOR_DOCS`` documents had that, and the band is wider by
``ERRORS`` standard errors of the median; both fade as a language has more documents, and no
language is judged by another's median.

The widths are the narrowest, in steps of half a deviation, that reject at most one in a thousand
of the rows labelled good with even ids in the sample of the README. Junk marked by symbols lies
near the median, as the model learns it from the same corpus, so rows with more than
``MAX_SYMBOLS`` symbols for every 100 words are rejected too, and do not count for a band.

Defined cases: a null or empty text has no words and fails the base rules; a null language is
``und``; equal rows count each and get equal verdicts; very long texts are scored whole, in
blocks; an empty table gives an empty model and no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidra.llm.kernels import buffers, lut, mix, ngram_hashes, parts, per_row, word_hashes, word_spans
from vidra.llm.shared import Kept, count_upto, keep, ship, tidy

ORDER, MAX_GRAMS, BINS = 5, 1 << 22, 1024
WIDTH_LOW, WIDTH_HIGH, LEAST = 8.0, 4.0, 0.1
PRIOR_DOCS, ERRORS = 20, 3.0
#: Bands sent to every executor; beyond it, a shuffle.
MAX_BROADCAST_LANGUAGES = 10_000
MIN_WORDS, MAX_REPEATED = 50, 50
#: Symbols for every 100 words.
MAX_SYMBOLS = 10
_BLOCK = 1 << 18
_WORDS = lut(set(range(256)) - {0x20, *range(0x09, 0x0E)}, lower=False)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False
_POINT[[0x20, *range(0x09, 0x0E)]] = False


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, n-grams of order ``ORDER`` that end at these bytes), block by block; each is a number of ORDER bytes."""
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    for a in range(0, len(data), _BLOCK):
        b = min(len(data), a + _BLOCK)
        lead = max(0, a - ORDER + 1)
        x = data[lead:b].astype(np.uint64)
        begin = starts[np.searchsorted(starts, np.arange(a, b), "right") - 1]
        have = np.minimum(np.arange(a, b) - begin, ORDER - 1)
        g = x[a - lead :].copy()
        for k in range(1, ORDER):
            at = np.arange(a - lead - k, b - lead - k)
            g |= np.where(have >= k, x[np.maximum(at, 0)], np.uint64(0)) << np.uint64(8 * k)
        yield a, b, g


class Table:
    """Values by number: the numbers' hashes, sorted, and where the hashes with given upper bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys.astype(np.uint64))
        order = np.argsort(h)
        self.h, self.values = h[order], values[order].astype(np.float32)
        bits = max(1, len(h).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.h >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that are not there."""
        h = mix(keys)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.h[at[todo]] == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


def _last(g: np.ndarray, order: int) -> np.ndarray:
    return g & np.uint64((1 << 8 * order) - 1)


@dataclass
class Model:
    """A shard: for each order log2 probabilities of n-grams and log2 back-off masses of contexts; the last two bytes of its n-grams are in [low, high)."""

    grams: list[Table]
    contexts: list[Table]
    low: int = 0
    high: int = 1 << 16

    def bits_of(self, g: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last byte of each n-gram, given the others; 0 for the n-grams of other shards."""
        out, todo = np.zeros(len(g)), np.arange(len(g))
        if (self.low, self.high) != (0, 1 << 16):
            pair = _last(g, 2)
            todo = np.flatnonzero((pair >= self.low) & (pair < self.high))
        for n in range(len(self.grams), 0, -1):
            own = _last(g[todo], n)
            at = self.grams[n - 1].find(own)
            seen = at >= 0
            out[todo[seen]] -= self.grams[n - 1].values[at[seen]]
            todo = todo[~seen]
            if not len(todo):
                return out
            at = self.contexts[n - 1].find(own[~seen] >> np.uint64(8))
            out[todo[at >= 0]] -= self.contexts[n - 1].values[at[at >= 0]]
        out[todo] += 8
        return out


def count(docs: DataFrame) -> DataFrame:
    """(g, c): how often each n-gram of the highest order occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return u, np.bincount(inverse, np.concatenate([y for _, y in held]), len(u)).astype(np.int64)

        size = 0
        for whole in batches:
            for batch in parts(whole, 0):
                for _, _, g in grams(*buffers(batch.column(0))):
                    held.append(np.unique(g, return_counts=True))
                    size += len(held[-1][0])
                    if size > 2 << 20 and len(held) > 1:
                        held = [merged()]
                        size = len(held[0][0])
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], ["g", "c"])
                            held, size = [], 0
        if held:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


@dataclass
class Fitted:
    """The model's tables (n, g, value) in the shared folder: log2 probabilities of n-grams, log2 back-off masses of contexts."""

    grams: DataFrame
    contexts: DataFrame

    def shards(self, most: int = MAX_GRAMS) -> list[tuple[int, int]]:
        """Ranges of last two bytes with at most ``most`` n-grams of the highest order each, if not a single pair has more."""
        sizes = np.zeros(1 << 16, np.int64)
        for r in self.grams.filter(F.col("n") == ORDER).groupBy(F.col("g").bitwiseAND(0xFFFF).alias("pair")).agg(F.count(F.lit(1)).alias("c")).collect():
            sizes[r["pair"]] = r["c"]
        cuts, held = [0], 0
        for pair in np.flatnonzero(sizes).tolist():
            if held and held + sizes[pair] > most:
                cuts.append(pair)
                held = 0
            held += int(sizes[pair])
        return list(zip(cuts, [*cuts[1:], 1 << 16]))

    def load(self, low: int = 0, high: int = 1 << 16) -> Model:
        """The shard of a range of last two bytes."""
        pair, last = F.col("g").bitwiseAND(0xFFFF), F.col("g").bitwiseAND(0xFF)
        found = []
        for table, own in ((self.grams, (pair >= low) & (pair < high)), (self.contexts, (last >= low >> 8) & (last <= (high - 1) >> 8))):
            rows = table.filter(own | (F.col("n") == 1)).toArrow()
            n, g, value = (rows.column(c).to_numpy() for c in ("n", "g", "value"))
            found.append([Table(g[n == i], value[n == i]) for i in range(1, ORDER + 1)])
        return Model(*found, low, high)


def _one_file(table: DataFrame, order: int) -> DataFrame:
    """Tables of n-grams of two bytes at most have 65,536 rows at most, and go to one file."""
    return table.coalesce(1) if order <= 2 else table


def fit(spark: SparkSession, docs: DataFrame) -> Fitted:
    """The model of all texts."""
    ship(spark)
    held = [Kept(spark, count(docs), "grams")]
    for n in range(ORDER - 1, 0, -1):
        lower = held[-1].df.select(F.col("g").bitwiseAND((1 << 8 * n) - 1).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
        held.append(Kept(spark, _one_file(lower, n), "grams"))
    lower, grams, contexts = None, None, None
    for n, table in enumerate((x.df for x in reversed(held)), 1):
        n1, n2, n3, n4 = table.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).collect()[0]
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("g", 8).alias("context")
        masses = table.groupBy(context).agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("mass"))
        masses = keep(spark, _one_file(masses, n - 1), "contexts")
        found = table.select("g", context, (F.col("c") - off).alias("own")).join(masses, "context")
        below = F.lit(1 / 256)
        if lower is not None:
            found = found.withColumn("rest", F.col("g").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(lower.select(F.col("g").alias("rest"), F.col("p").alias("below")), "rest")
            below = F.col("below")
        lower = keep(spark, _one_file(found.select("g", (F.greatest("own", F.lit(0.0)) / F.col("total") + F.col("mass") * below).alias("p")), n), "probabilities")
        own = [lower.select(F.lit(n).alias("n"), "g", F.log2("p").alias("value")), masses.select(F.lit(n).alias("n"), F.col("context").alias("g"), F.log2("mass").alias("value"))]
        grams, contexts = own if grams is None else (grams.unionByName(own[0]), contexts.unionByName(own[1]))
        tidy(spark)
    for x in held:
        x.drop()
    tidy(spark)
    return Fitted(grams, contexts)


def _spread(lengths: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(n), lengths)


def base_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(off) - 1
    starts, ends, words = word_spans(data, off, _WORDS)
    n_words = np.diff(words)
    row = _spread(n_words, n)
    windows = ngram_hashes(word_hashes(data, starts, ends, _WORDS), 3)
    inside = np.flatnonzero(row[: len(windows)] == row[2:]) if len(windows) else np.zeros(0, np.int64)
    twice = inside[_repeated(windows[inside], row[inside])]
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[twice + k] = True
    repeat = np.bincount(row[covered], minlength=n)
    # Lines: between line feeds and the ends of texts; only those with a word count.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.union1d(off[:-1][off[:-1] < off[1:]], feeds + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_row = np.searchsorted(off, line_starts, "right") - 1
    next_feed = np.searchsorted(feeds, line_starts)
    line_ends = np.minimum(np.append(feeds, len(data))[next_feed], off[1:][line_row])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    several = np.bincount(line_row[has_word], minlength=n) > 1
    use = np.flatnonzero(has_word & several[line_row])
    own = _keyed(word_hashes(data, line_starts[use], line_ends[use], _WORDS), line_row[use])
    distinct = np.unique(own, return_index=True)[1]
    dup = np.bincount(line_row[use], minlength=n) - np.bincount(line_row[use][distinct], minlength=n)
    return {"n_words": n_words, "word_chars": per_row(_POINT[data], off), "n_symbols": per_row(_SYMBOL[data], off), "n_dup_lines": dup, "n_repeat_words": repeat}


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal for equal ``h`` of one row."""
    return mix(h ^ mix(row.astype(np.uint64)))


def _repeated(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether the same hash stands elsewhere in its row."""
    _, inverse, count = np.unique(_keyed(h, row), return_inverse=True, return_counts=True)
    return count[inverse] > 1


def failed(n_words, n_repeat_words):
    """The base rule, on numbers, arrays or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def marked(n_words, n_symbols):
    """Too many symbols for the words, on numbers, arrays or columns."""
    return 100 * n_symbols > MAX_SYMBOLS * n_words


def log_perplexity(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bits of the model's own n-grams for each byte of each text; 0 for empty texts."""
    total = np.zeros(len(off) - 1)
    for a, b, g in grams(data, off):
        bits = model.bits_of(g)
        i, j = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
        own = np.clip(off[i : j + 1], a, b) - a
        total[i:j] += per_row(bits, own)
    return total / np.maximum(off[1:] - off[:-1], 1)


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(spark: SparkSession, docs: DataFrame, model: Fitted, whole: bool = False, most: int = MAX_GRAMS) -> DataFrame:
    """doc, lang, the base statistics and ``bits``, the log perplexity; doc holds doc_id, or ``whole`` rows of those that pass the base rules and the symbol rule."""
    shards = model.shards(most)
    rows = docs if whole else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names = rows.columns
    at, lang_at = names.index("text"), names.index("lang")
    # Further passes need the text again.
    held = names if whole or len(shards) > 1 else ["doc_id"]
    doc = T.StructType([rows.schema[c] for c in held])
    out = T.StructType([T.StructField("doc", doc), T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in _STATS), T.StructField("bits", T.DoubleType())])

    def first(own):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for every in batches:
                for batch in parts(every, at):
                    data, off = buffers(batch.column(at))
                    stats = base_stats(data, off)
                    if whole:
                        good = ~failed(stats["n_words"], stats["n_repeat_words"]) & ~marked(stats["n_words"], stats["n_symbols"])
                        batch, stats = batch.filter(pa.array(good)), {k: v[good] for k, v in stats.items()}
                        data, off = buffers(batch.column(at))
                    row = pa.StructArray.from_arrays([batch.column(names.index(c)) for c in held], held)
                    lang = batch.column(lang_at).cast(pa.string()).fill_null("und")
                    yield pa.RecordBatch.from_arrays([row, lang, *(pa.array(stats[c]) for c in _STATS), pa.array(log_perplexity(own.value, data, off))], ["doc", "lang", *_STATS, "bits"])

        return run

    def further(own):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for every in batches:
                texts = every.column(0).field(held.index("text"))
                for a in range(0, every.num_rows, 64):
                    data, off = buffers(texts.slice(a, 64))
                    batch = every.slice(a, 64)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column(batch.num_columns - 1).to_numpy() + log_perplexity(own.value, data, off))], ["doc", "lang", *_STATS, "bits"])

        return run

    now = None
    for low, high in shards:
        own = spark.sparkContext.broadcast(model.load(low, high))
        new = Kept(spark, rows.mapInArrow(first(own), out) if now is None else now.df.mapInArrow(further(own), out), "perplexities")
        own.unpersist()
        if now is not None:
            now.drop()
        now = new
    tidy(spark)
    return now.df


def _quartiles(good: DataFrame) -> DataFrame:
    """(lang, n, q): the quartiles of ``bits``, from counts by bin."""
    bins = good.groupBy("lang", F.floor(F.col("bits") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    own = W.partitionBy("lang")
    bins = bins.withColumns({"upto": F.sum("c").over(own.orderBy("bin")), "n": F.sum("c").over(own)})
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, (F.col("bin") + 0.5) / BINS)) for k in (1, 2, 3)]
    return bins.groupBy("lang", "n").agg(F.array(*at).alias("q"))


def bands(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """(lang, low, high): lowest and highest accepted log perplexity of each language with a row that passes the base rules and the symbol rule."""
    good = scores.filter(~failed(F.col("n_words"), F.col("n_repeat_words")) & ~marked(F.col("n_words"), F.col("n_symbols")))
    own = keep(spark, _quartiles(good).select("lang", "n", F.col("q")[1].alias("m"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("s")), "bands")
    typical = own.agg((F.sum((F.col("n") - 1) * F.col("s")) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))).alias("s")).collect()[0]["s"] or 0.0
    spread = F.sqrt(((F.col("n") - 1) * F.col("s") ** 2 + PRIOR_DOCS * typical**2) / (F.col("n") - 1 + PRIOR_DOCS))
    error = ERRORS * 1.2533 * F.col("spread") / F.sqrt("n")
    low, high = (F.greatest(w * F.col("spread"), F.lit(LEAST)) + error for w in (WIDTH_LOW, WIDTH_HIGH))
    return own.withColumn("spread", spread).select("lang", (F.col("m") - low).alias("low"), (F.col("m") + high).alias("high"))


def judged(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """``scores`` with base_failed and kept."""
    table = bands(spark, scores)
    if count_upto(table, MAX_BROADCAST_LANGUAGES) <= MAX_BROADCAST_LANGUAGES:
        table = F.broadcast(table)
    bad = failed(F.col("n_words"), F.col("n_repeat_words"))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return scores.join(table, "lang", "left").withColumns({"base_failed": bad, "kept": ~bad & ~marked(F.col("n_words"), F.col("n_symbols")) & inside}).drop("low", "high")


def verdicts(spark: SparkSession, docs: DataFrame, most: int = MAX_GRAMS) -> DataFrame:
    """The base statistics, base_failed, perplexity and kept of every row."""
    scores = scored(spark, docs.select("doc_id", "text", "lang"), fit(spark, docs), most=most)
    return judged(spark, scores).select("doc.doc_id", *_STATS, "base_failed", "kept", F.pow(F.lit(2.0), "bits").alias("perplexity"))


def keep_good(spark: SparkSession, docs: DataFrame, most: int = MAX_GRAMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``verdicts`` keeps."""
    return judged(spark, scored(spark, docs, fit(spark, docs), whole=True, most=most)).filter("kept").select("doc.*")
