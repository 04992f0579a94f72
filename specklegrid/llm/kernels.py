"""Vectorised numpy kernels over the raw UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(32)
    return x


#: Every byte value gets a 64-bit number of its own before it is joined with others.
BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG_WORD, SEEDS = 256, (U64(0x9FB21C651E98DF25), U64(0x5851F42D4C957F2D))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of what a stands for, followed by what b stands for; not linear, so repeated patterns don't cancel."""
    x = b * U64(0x9E3779B97F4A7C15) + U64(0x2545F4914F6CDD1D)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x += a
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(32)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(31)
    return x


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Identifiers of the `width` items from each place; the last width - 1 places, which have fewer, get 0.

    An identifier of 2 h items is that of h items joined with the identifier found h items later, and so on; the two
    last ones may overlap.
    """
    n, h, level = len(ids), 1, ids
    out = np.zeros(n, U64)
    if n < width:
        return out
    while 2 * h <= width:
        level = join(level[:-h], level[h:])
        h *= 2
    out[: n - width + 1] = join(level[: n - width + 1], level[width - h :][: n - width + 1]) if h < width else level
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and len + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch | pa.Table, text: str, limit: int = 1 << 20, most: int = 4096) -> Iterator[pa.RecordBatch | pa.Table]:
    """The same rows in slices of about `limit` bytes of text and `most` rows; a longer single text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, "right"))), start + most)
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text of a column: byte starts and ends of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~IS_SPACE[data]
        change = inside[1:] != inside[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        # a text's end also ends a word, and its start begins one
        start = np.flatnonzero((change | edge) & inside[1:])
        end = np.flatnonzero((change | edge) & inside[:-1])
        self.start, self.end = start, end
        letters = data[inside[1:-1]]
        self.letters = LOWER[letters] if lower else letters
        self.ends = np.r_[0, np.cumsum(end - start)].astype(np.int64)
        #: the first word of each text; one more at the end
        self.first = np.searchsorted(start, offsets)

    @cached_property
    def coded(self) -> tuple[np.ndarray, int]:
        """A number for each word, equal for equal words only, and how many words there are."""
        words = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(self.ends), pa.py_buffer(self.letters)]).dictionary_encode()
        return words.indices.to_numpy(), len(words.dictionary)

    @cached_property
    def hashes(self) -> np.ndarray:
        """Two independent 64-bit hashes of each word, by row: of its length and its letters, eight at a time."""
        begin, size = self.ends[:-1], np.diff(self.ends)
        padded = np.r_[self.letters, np.zeros(8, np.uint8)]
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        out = np.stack([mix(size.astype(U64) + s) for s in SEEDS])
        use, at = np.flatnonzero(size <= LONG_WORD), 0
        while len(use):
            rest = size[use] - at
            part = eight[begin[use] + at] & np.where(rest >= 8, U64(2**64 - 1), (U64(1) << (U64(8) * np.minimum(rest, 7).astype(U64))) - U64(1))
            for i, s in enumerate(SEEDS):
                out[i, use] = join(out[i, use], part ^ s)
            use, at = use[rest > 8], at + 8
        for i in np.flatnonzero(size > LONG_WORD):
            word = self.letters[begin[i] : begin[i] + size[i]].tobytes()
            out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(word, 20), U64)
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def runs(words: Words, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For every word: the hash of the `width` words from it, and whether they stay in one text (the hash means nothing otherwise). Each lane has hashes independent of the other's."""
    start = np.arange(len(words.start))
    return windows(words.hashes[lane], width), start + width <= np.repeat(words.first[1:], words.counts)


def bucketed(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the rows of each bucket; unblob() gives the columns back."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order].view(U64) if c.dtype.itemsize == 8 else c[order].astype(U64) for c in columns]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(bucket)], strict=True):
        yield int(bucket[a]), blob([c[a:b] for c in columns])


def blob(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first bytes of all, then the second ones, and so on: the high bytes of ids and places are alike, and compress."""
    whole = np.concatenate([np.ascontiguousarray(c).view(U64) for c in columns])
    return whole.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()


def unblob(data: bytes, k: int) -> np.ndarray:
    """k columns of 64-bit numbers."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(k, 8, -1).transpose(0, 2, 1)).view(U64).reshape(k, -1)


def equal_runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
