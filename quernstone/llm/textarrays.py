"""Columns of text as flat numpy arrays: rows, words, characters and their hashes.

Everything here works on one Arrow batch inside a Spark task. Texts are never cut: a block holds
whole rows, and a row longer than the block limit is a block of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 19  # arrays of numbers take up to 200 times as much for a while
BLOCK_ROWS = 2048

# Word separators of the contracts: space and U+0009 to U+000D.
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, 9, 10, 11, 12, 13]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 512  # bytes from which a run of bytes is hashed by BLAKE2b


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # where the C library has it
except (OSError, AttributeError):
    _TRIM = None


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, byte offset of each row and the end) of runs of whole rows.

    A null text counts as an empty one.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), lo + BLOCK_ROWS, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    if offsets[-1] - offsets[0] > 2 * BLOCK_BYTES:
        released()


def released() -> None:
    """Gives freed memory back to the machine: Python workers serve one stage after another beside a JVM."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: byte ``starts`` and ``ends``; row r has words first[r]:first[r+1]."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        n = len(buf)
        sep = IS_SEP[buf]
        edge = np.empty(n + 1, bool)
        edge[0] = True
        edge[1:] = sep
        edge[offs] = True
        self.starts = np.flatnonzero(~sep & edge[:-1])
        edge[:-1] = sep
        edge[-1] = True
        edge[offs] = True
        self.ends = np.flatnonzero(~sep & edge[1:]) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``fold_case`` makes A-Z equal to a-z."""
        return byte_hashes(folded(self.buf) if fold_case else self.buf, self.starts, self.ends)


def folded(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _FOLD[buf]


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; those past the end are zero."""
    return np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]).data, strides=(1,))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes buf[starts:ends].

    Eight bytes a step go through a finaliser together with the hash so far, so two runs of one length that differ in a
    single step never meet, and nothing cancels however a run repeats. Runs of LONG bytes take BLAKE2b instead.
    """
    view, n = eights(buf), ends - starts
    out = mix(n.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(n))
    long = n >= LONG
    if long.any():
        for i in np.flatnonzero(long):
            out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
        at = np.flatnonzero(~long)
    done = 0
    while len(at):
        left = n[at] - done
        out[at] = mix(out[at] ^ (view[starts[at] + done] & LOW_BYTES[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    return out


_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive items of ``h``: of pairs, of pairs of pairs and so on."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, have, whole, power = None, 0, h, 1
    while True:
        if size & power:
            if out is None:
                out, have = whole, power
            else:
                n = len(h) - have - power + 1
                out, have = mix(out[:n] * _STEP + whole[have : have + n]), have + power
        if have == size:
            return mix(out + np.uint64(size))
        whole = mix(whole[:-power] * _STEP + whole[power:])
        power *= 2


def digest(raw: bytes) -> bytes:
    """16 bytes that stand for ``raw``; no two different ones are known to share them."""
    return hashlib.blake2b(raw, digest_size=16).digest()


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[r]:first[r+1]] of each row r."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the offset of each row in them."""
    try:
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        return points, lead[offs]
    except UnicodeDecodeError:  # bytes that are not UTF-8 read as U+FFFD
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])])


_PLAIN = np.arange(0x250, dtype=np.uint32)
_PLAIN[[9, 10, 11, 12, 13]] = 32
_LOWERED = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x250)], np.uint32)
_LOWERED[[9, 10, 11, 12, 13]] = 32


def gram_ids(points: np.ndarray, first: np.ndarray, sizes: tuple[int, ...], bits: int, lower: bool) -> list[np.ndarray]:
    """For each size, the bucket of the character n-gram that starts at each character.

    N-grams that would reach into the next row get the bucket 2**bits, which no row owns.
    """
    if len(points) == 0:
        return [np.zeros(0, np.int32) for _ in sizes]
    plain = _LOWERED if lower else _PLAIN
    c = np.where(points < 0x250, plain[np.minimum(points, 0x24F)], points).astype(np.uint32)
    one = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
    one ^= one >> np.uint32(15)
    out, h = [], one.copy()
    for n in range(1, max(sizes) + 1):
        if n > 1:
            h[: len(h) - n + 1] = h[: len(h) - n + 1] * np.uint32(0x01000193) + one[n - 1 :]
        if n in sizes:
            g = h * np.uint32(0x85EBCA6B + 2 * n)
            g ^= g >> np.uint32(13)
            ids = ((g * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.int32)
            for k in range(1, n):
                cut = first[1:] - k
                ids[cut[cut >= first[:-1]]] = 1 << bits
            out.append(ids)
    return out


def word_ids(words: Words, bits: int, pairs: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Buckets of single words and of word pairs.

    A pair is hashed by exclusive or, so each immediate repetition of a word, whichever the word, is one feature.
    The last word of a row has no pair: bucket 2**bits.
    """
    h = words.hashes()
    shift = np.uint64(64 - bits)
    single = (mix(h + np.uint64(11)) >> shift).astype(np.int32)
    if not pairs:
        return single, None
    two = np.full(len(h), 1 << bits, np.int32)
    if len(h) > 1:
        two[:-1] = mix((h[:-1] ^ h[1:]) + np.uint64(77)) >> shift
    last = words.first[1:] - 1
    two[last[words.first[1:] > words.first[:-1]]] = 1 << bits
    return single, two


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column bears it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def appended(df: DataFrame, fn: Callable, fields: list[tuple[str, T.DataType]], text_col: str = "text") -> DataFrame:
    """``df`` with the columns that ``fn(buf, offs)`` returns for each block of ``text_col``.

    ``fn`` returns one array or list a field. An input column that bears the name of a new one is replaced.
    """
    new = {name.lower() for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fields]])
    names = [f.name for f in kept]
    text = free_name("__text", df.columns)
    source = df.select(*[df[f"`{n}`"] for n in names], df[f"`{text_col}`"].alias(text))
    types = [_arrow(t) for _, t in fields]

    def run(batches):
        for batch in batches:
            parts = [[] for _ in fields]
            for _, _, buf, offs in blocks(batch.column(text)):
                for part, got, kind in zip(parts, fn(buf, offs), types, strict=True):
                    part.append(pa.array(got, kind))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], *[pa.chunked_array(p).combine_chunks() for p in parts]],
                    names=[*names, *[n for n, _ in fields]],
                )

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
