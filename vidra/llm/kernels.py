"""Vectorised byte and word kernels over Arrow string columns (numpy, no per-character Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: An odd multiplier with an inverse modulo 2**64, for word hashes.
Q = 0x9E3779B97F4A7C15
_LONG = 1 << 12
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _pow() -> tuple[np.ndarray, np.ndarray]:
    if not _cache:
        _cache["up"] = _powers(Q, _BLOCK + 2 * _LONG)
        _cache["down"] = _powers(pow(Q, -1, 1 << 64), _BLOCK + 2 * _LONG)
    return _cache["up"], _cache["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8)[off[0] : off[-1]] if d is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def lut(word: bytes | set[int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, what it becomes) for each byte."""
    is_word = np.zeros(256, bool)
    is_word[list(word)] = True
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    return is_word, to


#: Words are runs of anything but the ASCII space and the controls 9 to 13.
SPACE_WORDS = lut(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
ALNUM_WORDS = lut({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})


def word_spans(data: np.ndarray, off: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the word offsets of the rows (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = table[0][data]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands; computed in blocks of about a megabyte."""
    up, down = _pow()
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            if sizes[i] > _LONG:
                out[i] = xxhash.xxh64_intdigest(table[1][data[starts[i] : ends[i]]].tobytes())
                i += 1
                continue
            j = int(np.searchsorted(ends, starts[i] + _BLOCK, "right"))
            j = max(j, i + 1)
            if len(big := np.flatnonzero(sizes[i:j] > _LONG)):
                j = i + int(big[0])
            s0 = starts[i]
            x = table[1][data[s0 : ends[j - 1]]].astype(np.uint64)
            x += np.uint64(1)
            x *= up[: len(x)]
            f = np.empty(len(x) + 1, np.uint64)
            f[0] = 0
            np.cumsum(x, out=f[1:])
            s, e = starts[i:j] - s0, ends[i:j] - s0
            out[i:j] = (f[e] - f[s]) * down[s]
            i = j
        return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows that start at each word (len(h) - n + 1 of them), rows not regarded."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            x += h[k : len(h) - n + 1 + k] * _PLACE[k]
            x ^= x >> np.uint64(29)
    return mix(x)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row its sorted distinct n-word shingles as hashes; with fewer words, the whole sequence as one; without words, none."""
    starts, ends, words = word_spans(data, off, SPACE_WORDS)
    h = word_hashes(data, starts, ends, SPACE_WORDS)
    grams = ngram_hashes(h, n)
    none = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngram_hashes(h[a:b], b - a) if b > a else none)
    return out


def parts(batch: pa.RecordBatch, column: int = 1, most: int = 4 << 20):
    """The batch in slices of about ``most`` bytes of text, a row at least."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each row's bytes."""
    out = np.zeros(len(off) - 1, np.float64 if mask.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(mask, off[:-1][full], dtype=out.dtype)
    return out
