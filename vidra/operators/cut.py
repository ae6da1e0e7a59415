"""The words of documents, batch by batch: each distinct word of a batch once, with all its places.

Python's regular expressions and numpy cut the texts, some ten times faster than array functions
in the row do. The classes of characters are the JVM's own, asked for once, so that words are
those of ``functions.text``. What is asked of a word's letters is then asked once a batch.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidra.functions import text as X

#: Distinct words that a task gathers before it puts them out, and words that go out in one batch.
_GATHERED, _AT_ONCE = 300_000, 20_000
_classes: dict[str, str] = {}
_lower: list[dict[int, str]] = []


def characters(spark: SparkSession, java: str) -> str:
    """A class of characters of the JVM's expressions as one of Python's."""
    if java not in _classes:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        found = np.frombuffer(spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"[^{java}]").matcher(every).replaceAll("").encode("utf-32-le"), np.uint32)
        first = np.flatnonzero(np.diff(found, prepend=-2) != 1)
        ranges = [(int(found[a]), int(found[b - 1])) for a, b in zip(first, [*first[1:], len(found)])]
        low, high = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges if (a > 0xFFFF) == beyond) for beyond in (False, True))
        # Beyond the first plane Python tries range after range: only characters from there shall.
        _classes[java] = f"(?:[{low}]|(?=[\\U00010000-\\U0010ffff])[{high}])" if high else f"[{low}]"
    return _classes[java]


def patterns(spark: SparkSession) -> tuple[str, str, str, str]:
    """Of words and numbers, with a group around; of a letter; of a Cyrillic one; of any other."""
    # This module's functions run on executors, which need not have this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    a, an, sep = characters(spark, X._A), characters(spark, r"\p{IsAlphabetic}\p{N}"), "['’ʼ-]"
    return f"({an}+(?:{sep}{an}+)*|{sep}{a}{an}*(?:{sep}{a}{an}*)*)", a, characters(spark, X.CYRILLIC), characters(spark, X._LATIN_RE[1:-1])


def lowered(spark: SparkSession) -> dict[int, str]:
    """The characters, each alone, that Spark has another lower case for than Python, and Spark's."""
    if not _lower:
        every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
        theirs = spark.createDataFrame([("\0".join(every),)], "c string").select(F.lower("c")).first()[0].split("\0")
        _lower.append({ord(c): x for c, x in zip(every, theirs) if x != c.lower()})
    return _lower[0]


class Codes(dict):
    """Words to numbers, in the order in which they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def places(docs: DataFrame, neighbours: bool) -> DataFrame:
    """(text, doc_ids, ends, in_run), with ``neighbours`` also (prevs, nexts): each distinct word of a batch, and of all its places the document, the end, whether it is a Latin word beside another, and the words before and after it."""
    expressions = patterns(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    more = ", prevs array<string>, nexts array<string>" if neighbours else ""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _places(batches, expressions, neighbours), f"text string, doc_ids array<{key}>, ends array<int>, in_run array<boolean>{more}")


def _places(batches: Iterator[pa.RecordBatch], patterns: tuple[str, str, str, str], neighbours: bool) -> Iterator[pa.RecordBatch]:
    split, letter, cyrillic, other = (f(p) for f, p in zip((lambda p: re.compile(p).split, *[lambda p: re.compile(p).search] * 3), patterns))
    for batch in batches:
        codes, whose, code, end = Codes(), [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text is None:
                continue
            # What is between words, and words, by turns.
            parts = split(text)
            n = len(parts) // 2
            if n:
                whose.append(np.full(n, i, np.int32))
                code.append(np.fromiter(map(codes.__getitem__, parts[1::2]), np.int32, n))
                end.append(np.cumsum(np.fromiter(map(len, parts), np.int32, len(parts)), dtype=np.int32)[1::2])
        if not codes:
            continue
        words = list(codes)
        # Numbers are cut, but are no words.
        word = np.array([letter(w) is not None for w in words])
        latin = np.array([cyrillic(w) is None and other(w) is not None for w in words])
        whose, code, end = np.concatenate(whose), np.concatenate(code), np.concatenate(end)
        some = word[code]
        whose, code, end = whose[some], code[some], end[some]
        if not len(code):
            continue
        follows = np.concatenate([[False], whose[1:] == whose[:-1], [False]])
        own = np.concatenate([[False], latin[code], [False]])
        run = own[1:-1] & ((own[:-2] & follows[:-1]) | (own[2:] & follows[1:]))
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(words) + 1))
        text = pa.array(words, pa.string())
        if neighbours:
            none = np.int32(-1)
            before = np.where(follows[:-1], np.concatenate([[none], code[:-1]]), none)[order]
            after = np.where(follows[1:], np.concatenate([code[1:], [none]]), none)[order]
        for a in range(0, len(words), _AT_ONCE):
            kept = np.arange(a, min(a + _AT_ONCE, len(words)))
            kept = kept[cuts[kept] < cuts[kept + 1]]
            if not len(kept):
                continue
            # Words without places have no rows in between.
            low, high = cuts[kept[0]], cuts[kept[-1] + 1]
            offsets = pa.array(np.append(cuts[kept], high) - low, pa.int32())
            at = order[low:high]
            columns = {"text": text.take(pa.array(kept)), "doc_ids": batch.column(0).take(pa.array(whose[at])), "ends": pa.array(end[at]), "in_run": pa.array(run[at])}
            if neighbours:
                columns |= {name: text.take(pa.array(x[low:high], mask=x[low:high] < 0)) for name, x in (("prevs", before), ("nexts", after))}
            yield pa.RecordBatch.from_arrays([x if name == "text" else pa.ListArray.from_arrays(offsets, x) for name, x in columns.items()], list(columns))


def met(docs: DataFrame, least: int) -> DataFrame:
    """(text, doc_id): each word and documents that have it; of all of them, or of ``least`` at least where there are more."""
    expressions = patterns(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _met(batches, expressions, least), f"text string, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def _met(batches: Iterator[pa.RecordBatch], patterns: tuple[str, str, str, str], least: int) -> Iterator[pa.RecordBatch]:
    split, letter = re.compile(patterns[0]).split, re.compile(patterns[1]).search
    found: dict[str, list] = {}
    kind = None

    def out() -> Iterator[pa.RecordBatch]:
        words = [w for w in found if letter(w)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w in words for _ in found[w]], pa.string()), pa.array([d for w in words for d in found[w]], kind)], ["text", "doc_id"])
        found.clear()

    for batch in batches:
        kind = batch.column(0).type
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            for w in set(split(text)[1::2]) if text else ():
                docs = found.get(w)
                if docs is None:
                    found[w] = [doc]
                elif len(docs) < least and doc not in docs:
                    docs.append(doc)
            if len(found) >= _GATHERED:
                yield from out()
    if found:
        yield from out()
