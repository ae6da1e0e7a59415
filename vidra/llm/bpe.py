"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

A text of more than ``CHUNK`` + ``OVERLAP`` code points is cut into chunks that reach into the next
one by ``OVERLAP``, and the chunks are dealt over the tasks. Each is pre-tokenised on its own, from
its first character on, although that may lie within a pre-token. The pattern never looks back,
so two scans that share one boundary agree on all that follow: neighbouring chunks are stitched
at the first boundary that both have in their overlap, never behind white space, as whether a run
of it is one pre-token depends on what follows. A match that touches the end of its chunk may
have been cut and is never used. What lies between two stitches are whole pre-tokens within one
chunk; these pieces are merged by rank in parallel, and one pass over a text's pieces, in order,
joins the ids. Decoding concatenates the bytes of the ids.

Where an overlap has no common boundary (one pre-token spans it), the text is put together again
and encoded in one task: the earlier scan goes on until it meets the later one.

Defined cases: a null or empty text has no ids, and the digests of nothing; equal rows give
equal rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidra.llm.shared import Kept, ship, text_only

#: Code points of a chunk, and by how much a chunk reaches into the next one.
CHUNK, OVERLAP = 1 << 14, 1 << 9


class Codec:
    """Encoder and decoder for one file of ranks and one pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 1):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.scan = regex.compile(pattern)
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.chunk, self.overlap, self.threads = chunk, max(2, overlap), threads

    def decode(self, ids: list[int]) -> bytes:
        own = self.bytes_of
        return b"".join([own[i] for i in ids])

    def segments(self, text: str) -> Iterator[str]:
        """The whole text in runs of whole pre-tokens, which can be merged each on its own."""
        if len(text) <= self.chunk + self.overlap:
            if text:
                yield text
            return
        starts = range(0, len(text), self.chunk)
        if self.threads > 1:
            with ThreadPoolExecutor(self.threads) as pool:
                yield from self._stitched(text, pool.map(lambda s: self._bounds(text, s, True), starts))
        else:
            yield from self._stitched(text, (self._bounds(text, s, False) for s in starts))

    def _bounds(self, text: str, start: int, concurrent: bool) -> list[int]:
        """Where the chunk's whole matches start and end, from the chunk's own start on."""
        piece = text[start : start + self.chunk + self.overlap]
        out, last = [start], start + len(piece) >= len(text)
        for m in self.scan.finditer(piece, concurrent=concurrent):
            if m.end() == len(piece) and not last:
                break
            out.append(start + m.end())
        return out

    def _stitched(self, text: str, chunks: Iterator[list[int]]) -> Iterator[str]:
        """Cut where two neighbouring scans agree, and never behind white space: whether a run of
        it is one pre-token depends on what follows."""
        own: list[int] = []
        for theirs in chunks:
            if not own:
                own = theirs
                continue
            known = set(theirs)
            meet = next((p for p in own if p in known and p > own[0] and not text[p - 1].isspace()), None)
            if meet is None:
                meet = self._on(text, own, theirs[-1], known)
                if meet is None:
                    continue
            yield text[own[0] : meet]
            own = theirs[theirs.index(meet) :]
        if own and own[0] < len(text):
            yield text[own[0] :]

    def _on(self, text: str, own: list[int], end: int, known: set[int]) -> int | None:
        """``own`` carried on over the whole text until it meets the next scan, or passes its end."""
        for m in self.scan.finditer(text, own[-1]):
            p = m.end()
            own.append(p)
            if p in known and not text[p - 1].isspace():
                return p
            if p >= end:
                return None
        return None

    def encode(self, text: str) -> list[int]:
        return [i for part in self.segments(text) for i in self.merge(part)]

    def boundaries(self, text: str, start: int, last: bool) -> tuple[list[int], list[int]]:
        """Where neighbours may be stitched to a chunk that starts at ``start``: the ends of its whole pre-tokens within its first and its last ``overlap`` code points."""
        head, tail = [], []
        for m in self.scan.finditer(text):
            p = m.end()
            if p == len(text) and not last:
                break
            if (p <= self.overlap or p > self.chunk) and not text[p - 1].isspace():
                (head if p <= self.overlap else tail).append(start + p)
        return head, tail


class Digest:
    """The digests of a text's ids and of the bytes decoded from them, as its pieces come."""

    def __init__(self, own: Codec):
        self.own, self.n, self.ids, self.raw = own, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, got: list[int]) -> None:
        name = self.own.text_of
        if got:
            self.ids.update((" " if self.n else "").encode() + " ".join([name[i] for i in got]).encode())
            self.raw.update(self.own.decode(got))
            self.n += len(got)

    def row(self) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by a space, SHA-256 of the decoded bytes."""
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


_codecs: dict[tuple, Codec] = {}


def codec(ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Codec:
    """The process's codec for a file of ranks."""
    key = (ranks_path, pattern, chunk, overlap)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_path, pattern, chunk, overlap)
    return _codecs[key]


_NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
_FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>"


class _Rows:
    """Result rows as record batches of bounded size."""

    def __init__(self, ids: bool):
        self.ids, self.rows, self.held = ids, [], 0

    def add(self, doc_id: int | None, digest: Digest, tokens: list[np.ndarray]) -> None:
        self.rows.append((doc_id, *digest.row(), np.concatenate(tokens) if tokens else np.zeros(0, np.int32)))
        self.held += 200 + (4 * digest.n if self.ids else 0)

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= least:
            columns = list(zip(*self.rows))
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            if self.ids:
                off = np.zeros(len(self.rows) + 1, np.int32)
                np.cumsum([len(x) for x in columns[4]], out=off[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(columns[4]))))
            yield pa.RecordBatch.from_arrays(arrays, _NAMES[: len(arrays)])
            self.rows, self.held = [], 0


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids of every row."""
    ship(spark)
    overlap = max(2, overlap)
    schema = _FIELDS if ids else _FIELDS.rpartition(",")[0]
    key = (ranks_path, pattern, chunk, overlap)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = codec(*key), _Rows(ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                digest, got = Digest(own), own.merge(text.as_py() or "")
                digest.add(got)
                out.add(doc_id, digest, [np.array(got, np.int32)] if ids else [])
                yield from out.batch(1 << 20)
        yield from out.batch()

    rows = text_only(docs)
    long = F.char_length("text") > chunk + overlap
    short = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(whole, schema)
    chunks = Kept(spark, _chunks(rows.filter(long), key), "chunks")
    if not chunks.df.limit(1).count():
        return short
    return short.unionByName(_joined(_encoded(_stitched(chunks.df), key), key, ids, schema))


def _chunks(long: DataFrame, key: tuple) -> DataFrame:
    """(key, doc_id, k, start, last, text, head, tail): the chunks of long texts, pre-tokenised wherever they were dealt to."""
    chunk, overlap = key[2:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, scalar in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = scalar.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                for a in range(0, len(starts), 64):
                    some = starts[a : a + 64]
                    n = len(some)
                    arrays = [pa.array([row] * n, pa.int64()), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(range(a, a + n), pa.int64()), pa.array(some, pa.int64()), pa.array([s == starts[-1] for s in some])]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([text[s:] if s == starts[-1] else text[s : s + chunk + overlap] for s in some], pa.string())], ["key", "doc_id", "k", "start", "last", "text"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*key)
        for batch in batches:
            found = [own.boundaries(t.as_py(), s, z) for t, s, z in zip(batch.column(5), batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            ends = [pa.array(list(x), pa.list_(pa.int64())) for x in zip(*found)] if found else [pa.array([], pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *ends], [*batch.schema.names, "head", "tail"])

    fields = "key long, doc_id long, k long, start long, last boolean, text string"
    pieces = long.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(cut, fields)
    return pieces.repartition("key", "k").mapInArrow(scan, fields + ", head array<long>, tail array<long>")


def _stitched(chunks: DataFrame) -> DataFrame:
    """(key, doc_id, k, a, b, text, whole): the piece [a, b) of each chunk, counted within it; ``whole``: a stitch of its text is missing, and [a, b) is all but the overlap."""
    by = W.partitionBy("key").orderBy("k")
    ends = chunks.select("key", "k", "start", "last", "tail", F.lead("head").over(by).alias("next"), F.lead("start").over(by).alias("next_start"))
    ends = ends.withColumn("cut", F.array_min(F.array_intersect("tail", "next")))
    ends = ends.withColumns({"from": F.coalesce(F.lag("cut").over(by), F.lit(0).cast("long")), "bad": F.max(~F.col("last") & F.col("cut").isNull()).over(W.partitionBy("key"))})
    a = F.when(F.col("bad"), 0).otherwise(F.col("from") - F.col("start"))
    b = F.when(F.col("last"), F.lit(None)).when(F.col("bad"), F.col("next_start") - F.col("start")).otherwise(F.col("cut") - F.col("start"))
    # The boundaries are few; the chunks' texts stay where they are if that can be.
    return chunks.select("key", "doc_id", "k", "text").join(ends.select("key", "k", a.cast("long").alias("a"), b.cast("long").alias("b"), F.col("bad").alias("whole")), ["key", "k"]).select("key", "doc_id", "k", "a", "b", "text", "whole")


def _encoded(pieces: DataFrame, key: tuple) -> DataFrame:
    """(key, doc_id, k, ids, text): the ids of each piece; the text instead where the whole text is to be put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*key)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids, texts = [], []
                for a, b, text, put in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5), part.column(6).to_pylist()):
                    piece = text.as_py()[a:b]
                    ids.append(None if put else np.array(own.merge(piece), np.int32))
                    texts.append(piece if put else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["key", "doc_id", "k", "ids", "text"])

    return pieces.mapInArrow(run, "key long, doc_id long, k long, ids array<int>, text string")


def _joined(pieces: DataFrame, key: tuple, ids: bool, schema: str) -> DataFrame:
    """The result row of each long text, from its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = codec(*key), _Rows(ids)
        now, doc, digest, tokens, texts = None, None, Digest(own), [], []

        def done() -> None:
            for part in own.segments("".join(texts)):
                got = own.merge(part)
                digest.add(got)
                if ids:
                    tokens.append(np.array(got, np.int32))
            out.add(doc, digest, tokens)

        for batch in batches:
            for row, doc_id, got, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                if row != now:
                    if now is not None:
                        done()
                        yield from out.batch(1 << 20)
                    now, doc, digest, tokens, texts = row, doc_id, Digest(own), [], []
                if text is not None:
                    texts.append(text)
                else:
                    some = got.values.to_numpy(zero_copy_only=False)
                    digest.add(some.tolist())
                    if ids:
                        tokens.append(some)
        if now is not None:
            done()
        yield from out.batch()

    return pieces.repartition("key").sortWithinPartitions("key", "k").mapInArrow(run, schema)


def decode(spark: SparkSession, tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of ``token_ids``; null ids give no bytes."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "raw"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, raw binary")
