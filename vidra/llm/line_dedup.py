"""Line dedup by a deletion-neighbourhood join, within one edit.

An occurrence of a line is dropped if the same line, or a near one, occurs earlier; earlier is by
(doc_id, line number). Near are lines within a single edit (a code point inserted, deleted or
replaced) that is at most one code point in ``ALIKE`` of either, so that lines of less than
``ALIKE`` code points have no near ones. Lines without a word are always kept.

Emitting every deletion of every line would multiply the corpus, so the neighbourhood is
narrowed first, without loss: two lines within one edit, the longer of m code points, agree in
their first or last floor(m / 2) code points. Lines that share such a half with another line
(an equi-join on hashes) are cut into segments of ``SEGMENT`` code points; one edit lies in one
segment, and all before and behind it agree. For each segment whose surroundings another line
shares (again an equi-join on hashes), the line emits the hash of its surroundings together
with every variant of the segment that lacks one code point:

* with the place of the deletion, for lines of equal length (a replacement),
* without it, to meet the undeleted segment of a line that is one code point shorter.

Equal keys are reduced to their earliest line before anything is joined back, so a key that any
share of the lines has costs one row a task. Each line meets the earliest of its keys, the edit
distance is verified on the texts, and the earliest verified neighbour decides. Occurrences are
marked by a join on the line; lines that have more than a share of 1 / ``COMMON`` of all
occurrences, of which there are fewer than ``COMMON``, are sent to every executor for that, so no
task gets all occurrences of one line.

Defined cases: a null text has no lines and stays null; text without a newline is one line; of
equal lines in one document the first stays; rows that repeat an id and a text get equal results
(both keep what the first keeps), rows that repeat an id with another text are kept apart; null
ids come last; very long lines emit rows in proportion to their length; a table without rows
gives none; other columns, of any name, are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.llm.shared import Kept, count_upto, ship, tidy

ALIKE, SEGMENT, COMMON = 10, 16, 100_000
#: Line hashes sent to every executor; beyond it, a shuffle.
MAX_BROADCAST_LINES = 500_000
_LAST = 2**63 - 1
#: A character that is no white space.
_WORD = r"[^\x20\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _h(*parts: str | int) -> int:
    x = xxhash.xxh3_64()
    for p in parts:
        x.update(p.encode() if isinstance(p, str) else b"\0%d\0" % p)
    return x.intdigest() - (1 << 63)


def _halves(line: str) -> Column:
    """Keys of the first and last halves, for partners of up to the same length and for longer ones."""
    n = F.char_length(line)
    out = []
    for m in (n, n + 1):
        size = F.floor(m / 2).cast("int")
        out += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), size)), F.xxhash64(F.lit(1), m, F.substring(line, n - size + 1, size))]
    return F.array(*out)


def _segments(line: str) -> Iterator[tuple[int, int, int, int]]:
    """(key of what surrounds a segment, its start, how much follows it, length of the longer partner)."""
    n = len(line)
    for m in (n, n + 1):
        for s in range(0, m, SEGMENT):
            rest = m - min(s + SEGMENT, m)
            yield _h(m, s, line[:s], rest, line[n - rest :]), s, rest, m


def surroundings(line: str) -> list[int]:
    """The keys of what surrounds each segment, for partners of up to the same length and for longer ones."""
    return [key for key, *_ in _segments(line)]


def variants(line: str, shared: set[int] | None = None) -> Iterator[tuple[int, int]]:
    """(key, role) of the segments whose surroundings are ``shared``: 0 a replacement, 1 the longer line's deletion, 2 the shorter line's whole segment."""
    n = len(line)
    for around, s, rest, m in _segments(line):
        if shared is not None and around not in shared:
            continue
        middle = line[s : n - rest]
        if m > n:
            yield _h(around, 0, middle), 2
            continue
        for i in range(len(middle)):
            less = middle[:i] + middle[i + 1 :]
            yield _h(around, 1, i, less), 0
            if not i or middle[i] != middle[i - 1]:
                yield _h(around, 0, less), 1


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no and line of the lines with a word of (doc_id, row, text)."""
    return docs.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.col("line").rlike(_WORD))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted lines."""
    small = count_upto(wanted, MAX_BROADCAST_LINES) <= MAX_BROADCAST_LINES
    found = _lines(docs).select(F.xxhash64("line").alias("h"), "line").join(F.broadcast(wanted) if small else wanted, "h", "left_semi")
    return found.groupBy("h").agg(F.first("line").alias("line"))


def _surrounded(lines: DataFrame) -> DataFrame:
    """(around, h) of the lines (h, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = surroundings(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0).slice(i, 1).take(pa.array([0] * len(found), pa.int64()))], ["around", "h"])

    return lines.select("h", "line").mapInArrow(run, "around long, h long")


def _variants(lines: DataFrame) -> DataFrame:
    """(key, role, h, place) of the lines (h, line, place, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(variants(batch.column(1)[i].as_py(), set(batch.column(4)[i].as_py())))
                n = pa.array([0] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int8()), batch.column(0).slice(i, 1).take(n), batch.column(2).slice(i, 1).take(n), batch.column(3).slice(i, 1).take(n)], ["key", "role", "h", "doc_id", "line_no"])

    return lines.select("h", "line", "doc_id", "line_no", "shared").mapInArrow(run, "key long, role byte, h long, doc_id long, line_no int")


def earlier(spark: SparkSession, docs: DataFrame) -> Kept:
    """(doc_id, row, gone, near): the numbers of the lines that go, of documents (doc_id, row, text), and how many of them not for an equal line."""
    ship(spark)
    long = F.char_length("line") >= ALIKE - 1
    lines = Kept(spark, _lines(docs).select("doc_id", "row", "line_no", F.xxhash64("line").alias("h"), F.when(long, _halves("line")).alias("keys")), "lines")
    first = Kept(spark, lines.df.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")), "first-lines")
    half = lines.df.filter("keys is not null").select("h", F.explode("keys").alias("key"))
    common = half.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("key")
    near_able = Kept(spark, half.join(common, "key", "left_semi").select("h").distinct(), "near-able")
    place = first.df.join(near_able.df, "h", "left_semi").select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))
    texts = Kept(spark, _texts(docs, near_able.df).join(place, "h"), "line-texts")
    around = Kept(spark, _surrounded(texts.df), "surroundings")
    agree = around.df.groupBy("around").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("around")
    shared = around.df.join(agree, "around", "left_semi").groupBy("h").agg(F.collect_set("around").alias("shared"))
    keyed = Kept(spark, _variants(texts.df.join(shared, "h")), "variants")
    tidy(spark)
    own = F.struct("doc_id", "line_no", "h")
    least = keyed.df.groupBy("key").agg(*(F.min(F.when(F.col("role") == i, own)).alias(f"m{i}") for i in range(3)), F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi")
    met = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = keyed.df.join(least, "key").withColumn("met", met).filter((F.col("met") < own)).select("h", "met.h", F.col("met")).toDF("h", "other", "met").distinct()
    pairs = pairs.join(texts.df.select("h", "line"), "h").join(texts.df.select(F.col("h").alias("other"), F.col("line").alias("other_line")), "other")
    alike = (F.char_length("line") >= ALIKE) & (F.char_length("other_line") >= ALIKE)
    near = pairs.filter(alike & (F.levenshtein("line", "other_line", 1) >= 0)).select("h").distinct()
    gone = Kept(spark, first.df.join(near.withColumn("near", F.lit(True)), "h", "left").filter("n > 1 or near").select("h", "n", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-again")
    # Fewer than COMMON lines can have so many of the occurrences.
    total = lines.df.count()
    often = gone.df.filter(F.col("n") * COMMON > total).select("h", "first", "near")
    places = lines.df.select("doc_id", "row", "line_no", "h").join(F.broadcast(often), "h", "left")
    rest = places.filter("first is null").drop("first", "near").join(gone.df.filter(F.col("n") * COMMON <= total).select("h", "first", "near"), "h")
    found = places.filter("first is not null").unionByName(rest).filter(F.col("near") | (F.struct("doc_id", "line_no") > F.col("first")))
    marked = found.select("doc_id", "row", "line_no", (F.struct("doc_id", "line_no") == F.col("first")).alias("near"))
    out = marked.groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("gone"), F.count_distinct(F.when(F.col("near"), F.col("line_no"))).alias("near"))
    done = Kept(spark, out, "gone")
    for x in (lines, first, near_able, texts, around, keyed, gone):
        x.drop()
    return done


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc, n_lines, n_exact, n_near): all columns of ``docs`` with the text that is left, and the numbers of lines with a word and of those removed."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    found = earlier(spark, rows.select("doc_id", "row", "text"))
    tidy(spark)
    every = F.split("text", "\n", -1)
    flagged = F.transform(every, lambda x, i: F.struct(x.alias("x"), F.array_contains("gone", i).alias("out")))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.filter(flagged, lambda s: ~s["out"]), lambda s: s["x"]), "\n"))
    with_words = F.size(F.filter(every, lambda x: x.rlike(_WORD)))
    return rows.join(found.df, ["doc_id", "row"], "left").select(
        F.struct(*(left.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns)).alias("doc"),
        F.when(F.col("text").isNull(), 0).otherwise(with_words).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone") - F.col("near"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.col("near"), F.lit(0)).cast("long").alias("n_near"),
    )


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near and the text that is left, of every row."""
    return dedup(spark, docs.select("doc_id", "text")).select(F.col("doc.doc_id").cast("long").alias("doc_id"), "n_lines", "n_exact", "n_near", "doc.text")
