"""Vectorised text work on Arrow string columns: words, word hashes and n-gram hashes.

Texts stay UTF-8 bytes.  Words are found with a 256-entry byte table, hashed with a
polynomial modulo 2**64 over running sums, and n-grams combine word hashes.  A hash
depends on the word's bytes alone, so every process computes the same one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multiplier of the word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at once; bounds the scratch arrays.
BLOCK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def byte_table(separators: bytes | list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(is word byte, lower-cased byte) by byte value; only A-Z are lower-cased."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z: digits, letters, all beyond ASCII.
ALNUM = byte_table([x for x in range(0x80) if not (0x30 <= x <= 0x39 or 0x41 <= x <= 0x5A or 0x61 <= x <= 0x7A)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size > BLOCK + 1:
            return have
        _POWERS[base] = have
    return have[:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of n + 1 texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def stretches(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, most: int = BLOCK, longest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, text offsets, number of the first text) of stretches of a slice of texts: all at once or, of one long text, parts.

    Parts end at bytes outside words; a word is cut only where ``longest`` is given and a part ends in that many bytes of it.
    """
    if len(data) <= most:
        yield data, offsets, 0
        return
    owner, at = int(np.argmax(np.diff(offsets))), 0  # a slice beyond the bound holds one text
    while at < len(data):
        to = min(at + most, len(data))
        if to < len(data):
            tail = data[max(to - (longest or most), at + 1) : to]
            gaps = np.flatnonzero(~inside[tail])
            if len(gaps):
                to = to - len(tail) + int(gaps[-1])
            elif longest is None:
                while to < len(data) and inside[data[to]]:  # by and by, as the next gap may be far
                    ahead = np.flatnonzero(~inside[data[to : to + most]])
                    to = to + int(ahead[0]) if len(ahead) else min(to + most, len(data))
        yield data[at:to], np.array([0, to - at]), owner
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word and, for n texts, the n + 1 word offsets."""
    inside = table[0][data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(int(np.searchsorted(ends, first + BLOCK, side="right")), at + 1)
        span = data[first : ends[to - 1]]
        if lower is not None:
            span = lower[span]
        n = len(span)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((span.astype(U64) + U64(1)) * _powers(BASE, n), out=sums[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        raw = (sums[b] - sums[a]) * _powers(INVERSE, n + 1)[a]
        out[at:to] = mix(raw + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = to
    return out


class RangeHashes:
    """Hashes of any ranges of one array of numbers, from sums that are taken once.

    They are plain polynomial values: equal for equal contents, and not those of ``word_hashes``.
    """

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(BASE, n), out=self.sums[1:])
        self.inverse = _powers(INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (len - n + 1 of them, none if fewer words)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(m, dtype=U64)
    for i in range(n):
        out *= U64(0xFF51AFD7ED558CCD)
        out += hashes[i : i + m]
    return mix(out + U64(n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
