"""Suffix-array dedup by bucket-pointer refinement.

Suffixes are put into buckets by their first GRAM bytes. A bucket with more than one suffix is refined by the
identifiers of the buckets that its suffixes meet at later offsets, and refined identifiers are used again by the next
refinement, until every pair of suffixes that share `length` bytes has been told from those that don't. An identifier of
depth 2 h is that of depth h joined with the one of depth h found h bytes later (8 bytes stand for themselves), so equal
identifiers stand for equal bytes; those that decide have two independent halves of 64 bits.

Two things make this fit a cluster. Only one suffix in about 35 enters a bucket: the one with the least identifier of
depth GRAM among those of a window of `length` bytes, so equal windows always pick the same one (leftmost on ties). And
what a refinement settles goes no further:

1. Buckets by the picked suffixes' identifiers of depth GRAM. A suffix alone in its bucket is settled, and with it every
   window that picks it: such a window occurs nowhere else. (Not every window that holds it: in a copy with other bytes
   around, what lies at its place may be picked by no window.)
2. A bucket with several suffixes is refined by the identifiers of depth `length` that each meets at the first and the
   last of the windows that pick it. Suffixes that stay together are equal over all those windows, so all but
   the earliest are repeats as a whole; a bucket that doesn't split is settled.
3. If it splits, windows fall into CLASSES by where they hold the suffix, and the bytes that all windows of a class hold (its
   core) tell which of them are settled: those whose core no other part of the bucket has. Only the others of the earliest suffix
   of each part are refined once more, window by window: the earliest of equal identifiers of depth `length` stays,
   the others are repeats.

Cases: a null text is empty; a text below `length` bytes keeps all its bytes; a very long text is one row of its block;
rows of equal doc_id, or of none, are documents in the order of a hash of their texts, and of repeated rows the first
stays; a null doc_id comes before all others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Blocks, again, among, distinct
from .kernels import U64, bucketed, equal_runs, join, mix, unblob, utf8

LENGTH, GRAM, CLASSES = 100, 32, 3  # GRAM is 8 times a power of two
_HEAD = {"runs": np.array([1], U64).tobytes(), "windows": np.array([2], U64).tobytes()}
PLACE_BITS = 48  # of a place within the rows of one doc_id and hash of texts; the hash has the rest
HALF = U64(0x9FB21C651E98DF25)


def in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by doc_id (nulls first), those of equal doc_id by a hash of their texts, and those hashes."""
    texts = pc.fill_null(rows["text"].cast(pa.large_binary()), b"")
    keys = np.array([xxhash.xxh3_64_intdigest(t.as_buffer()) >> PLACE_BITS for t in texts], np.int64)
    by = pc.sort_indices(rows.append_column("key", pa.array(keys, pa.int64())), [("doc_id", "ascending"), ("key", "ascending"), ("text", "ascending")], null_placement="at_start")
    return rows.take(by), keys[by.to_numpy()]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    if len(data) < 8:
        return np.zeros(0, U64)
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(U64)


def identifiers(eight: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of `depth` bytes (8 at least) at places: from those of half the depth, or for other depths than 8 times a power of two from two of the largest such depth, which overlap."""
    if depth == 8:
        return eight[at]
    half = 8 << ((depth - 1) // 8).bit_length() - 1
    return join(identifiers(eight, at, half), identifiers(eight, at + depth - half, half))


class Suffixes:
    """The picked suffixes of one block: for each, the first and last window that picks it, its place and its identifier g of depth `gram`."""

    def __init__(self, rows: pa.Table, length: int, gram: int):
        self.rows, self.keys = in_order(rows)
        self.data, self.offsets = utf8(self.rows["text"])
        self.length, self.gram, n, none = length, gram, len(self.data), np.zeros(0, np.int64)
        self.lo = self.hi = self.pick = none
        self.g = none.view(U64)
        self.eight = eights(self.data)
        if n < length:
            return
        g, h = self.eight, 8
        while h < gram:
            g = join(g[:-h], g[h:])
            h *= 2
        least = (g & U64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U64)
        wide, size = length - gram + 1, 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < wide:
            least = np.minimum(least[: size - wide], least[wide - size :])
        pick = (least & U64(0xFFFFFFFF)).astype(np.int64)
        del least
        valid = np.zeros(n + 1, np.int8)  # windows that end in the text they start in
        sizes = np.diff(self.offsets)
        long = sizes >= length
        np.add.at(valid, self.offsets[:-1][long], 1)
        np.add.at(valid, self.offsets[1:][long] - length + 1, -1)
        valid = np.cumsum(valid[: len(pick)], dtype=np.int8) > 0
        new = np.r_[True, pick[1:] != pick[:-1]]
        self.lo = np.flatnonzero(valid & (new | ~np.r_[False, valid[:-1]]))
        self.hi = np.flatnonzero(valid & np.r_[(new[1:] | ~valid[1:]), True])
        self.pick = pick[self.lo]
        self.g = g[self.pick]

    def unsettled(self, got: list[bytes]) -> None:
        """Keeps the suffixes that aren't alone in their buckets, each with all windows that pick it."""
        shared = among([self.g], got)
        self.g, self.lo, self.hi, self.pick = self.g[shared], self.lo[shared], self.hi[shared], self.pick[shared]

    def classes(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each class of windows: how many bytes before the suffix its core begins, and of each suffix the first and last window of the class (last before first where it has none)."""
        most, out = self.length - self.gram, []
        for k in range(CLASSES):
            near, far = -(-(most + 1) * k // CLASSES), -(-(most + 1) * (k + 1) // CLASSES) - 1
            out.append((near, np.maximum(self.lo, self.pick - far), np.minimum(self.hi, self.pick - near)))
        return out

    def cores(self) -> list[np.ndarray]:
        """For each class, the identifier of each suffix's core; 0 where it has no window of the class."""
        out = []
        for k, (near, first, last) in enumerate(self.classes()):
            far = -(-(self.length - self.gram + 1) * (k + 1) // CLASSES) - 1
            some, core = first <= last, np.zeros(len(self.pick), U64)
            if some.any():
                core[some] = identifiers(self.eight, self.pick[some] - near, self.length - (far - near)) | U64(1)
            out.append(core)
        return out

    def windows(self, at: np.ndarray) -> list[np.ndarray]:
        """Both halves of the identifiers of depth `length`."""
        return [identifiers(e, at, self.length) for e in (self.eight, self.eight ^ HALF)] if len(at) else [np.zeros(0, U64)] * 2

    def refined(self) -> list[np.ndarray]:
        """Both halves of each suffix's refined identifier: those met at its first and its last window, and where it lies between."""
        lies = mix((self.hi - self.lo).astype(U64) << U64(32) | (self.pick - self.lo).astype(U64))
        return [join(join(a, b), lies) for a, b in zip(self.windows(self.lo), self.windows(self.hi), strict=True)]

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, begin = ordinals(self.rows, self.keys, self.offsets)
        row = np.searchsorted(self.offsets, at, "right") - 1
        return ids[row], (self.keys[row].astype(U64) << U64(PLACE_BITS)) + (at - begin[row]).astype(U64)


def ordinals(rows: pa.Table, keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: its doc_id as a number that sorts without sign (a null: 0), and the byte offset at which its doc_id and key begin."""
    ids = pc.fill_null(rows["doc_id"], -(2**63)).to_numpy()
    first = equal_runs(ids, keys)
    return ids.view(U64) ^ U64(1 << 63), np.repeat(offsets[first], np.diff(np.r_[first, len(ids)]))


def _first(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by keys and the starts of its runs of equal keys."""
    by = np.lexsort(keys[::-1])
    return by, equal_runs(*(k[by] for k in keys))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the remaining bytes), spans (start and end of each maximal removed run) of each row of docs(doc_id, text)."""
    if gram < 8 or gram & (gram - 1) or gram > length:
        raise ValueError("gram must be a power of two from 8 to length")
    blocks = Blocks(docs)

    def fill(block, rows, _, buckets):
        """The first buckets: distinct identifiers of picked suffixes."""
        g = distinct(Suffixes(rows, length, gram).g)
        return list(bucketed(((g[0] >> U64(1)) % U64(buckets)).astype(np.int64), g))

    def refine(block, rows, got, buckets):
        s = Suffixes(rows, length, gram)
        s.unsettled(got)
        c = s.refined()
        by, first = _first(*c)
        one = np.sort(by[first])  # in the order of the text, in which numbers compress well
        did, place = s.order(s.lo[one])
        out = [(b, _HEAD["windows"] + x) for b, x in bucketed((s.g[one] % U64(buckets)).astype(np.int64), [s.g[one], c[0][one], c[1][one], did, place, *(k[one] for k in s.cores())])]
        # the buckets' answer is needed once more, by the next step of this block
        return out + [(block % buckets, _HEAD["runs"] + b) for b in got]

    def split(owners, blobs):
        out = [(o, b) for o, b in zip(owners, blobs, strict=True) if b[:8] == _HEAD["runs"]]
        parts = [(o, unblob(b[8:], 5 + CLASSES)) for o, b in zip(owners, blobs, strict=True) if b[:8] == _HEAD["windows"]]
        if parts:
            owner = np.repeat(np.array([o for o, _ in parts]), [x.shape[1] for _, x in parts])
            g, c, d, did, place, *cores = np.concatenate([x for _, x in parts], axis=1)
            by = np.lexsort((place, did, d, c, g))
            g, c, d, owner = g[by], c[by], d[by], owner[by]
            first = np.zeros(len(g), bool)
            first[equal_runs(g, c, d)] = True
            say = np.where(first, 0, 1)  # 1: a repeat as a whole; else bits of the classes (from 2 on) whose core another part has
            at = np.flatnonzero(first)
            for k, core in enumerate(cores):
                core = core[by]
                some = at[core[at] > 0]
                order = some[np.lexsort((core[some], g[some]))]
                starts = equal_runs(g[order], core[order])
                size = np.diff(np.r_[starts, len(order)])
                say[order[np.repeat(size > 1, size)]] |= 2 << k
            told = say > 0
            out += [(o, _HEAD["windows"] + x) for o, x in bucketed(owner[told], [c[told], d[told], say[told]])]
        return out

    def finest(block, rows, got, buckets):
        s = Suffixes(rows, length, gram)
        s.unsettled([b[8:] for b in got if b[:8] == _HEAD["runs"]])
        c = s.refined()
        parts = [unblob(b[8:], 3) for b in got if b[:8] == _HEAD["windows"]]
        said = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), U64)
        # each identifier's answer: sorted together, an answer stands before the suffixes that ask for it
        every = [np.r_[said[k], c[k]] for k in (0, 1)]
        asks = np.r_[np.zeros(said.shape[1], bool), np.ones(len(c[0]), bool)]
        by, first = _first(*every, asks)
        starts = equal_runs(every[0][by], every[1][by])
        head = np.repeat(by[starts], np.diff(np.r_[starts, len(by)]))
        known = np.zeros(len(asks), np.int64)
        known[by] = np.where(head < said.shape[1], np.r_[said[2].astype(np.int64), 0][np.minimum(head, said.shape[1])], 0)
        known = known[said.shape[1] :]
        by, first = _first(*c)
        earliest = np.zeros(len(c[0]), bool)
        earliest[by[first]] = True
        whole = ~earliest | (known == 1)
        ranges = [(lo[fine], hi[fine]) for k, (_, lo, hi) in enumerate(s.classes()) for fine in [earliest & (known & (2 << k) > 0) & (lo <= hi)]]
        lo, hi = (np.concatenate(x) for x in zip(*ranges, strict=True))
        by = np.argsort(lo, kind="stable")
        lo, hi = lo[by], hi[by]
        each = hi - lo + 1
        at = np.repeat(lo - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum()) if len(lo) else lo
        h = s.windows(at)
        by, first = _first(*h)
        one = np.sort(by[first])
        later = np.setdiff1d(np.arange(len(at)), one, assume_unique=True)
        did, place = s.order(at[one])
        out = [(b, _HEAD["windows"] + x) for b, x in bucketed((h[0][one] % U64(buckets)).astype(np.int64), [h[0][one], h[1][one], did, place])]
        runs = np.concatenate([s.lo[whole], at[later]]), np.concatenate([s.hi[whole], at[later]])
        return out + [(block % buckets, _HEAD["runs"] + x) for _, x in bucketed(np.zeros(len(runs[0]), np.int64), [(runs[0] << 32 | runs[1]).astype(U64)])]

    def settle(owners, blobs):
        out = [(o, b) for o, b in zip(owners, blobs, strict=True) if b[:8] == _HEAD["runs"]]
        parts = [(o, unblob(b[8:], 4)) for o, b in zip(owners, blobs, strict=True) if b[:8] == _HEAD["windows"]]
        if parts:
            owner = np.repeat(np.array([o for o, _ in parts]), [x.shape[1] for _, x in parts])
            h, d, did, place = np.concatenate([x for _, x in parts], axis=1)
            by = np.lexsort((place, did, d, h))
            later = np.ones(len(h), bool)
            later[equal_runs(h[by], d[by])] = False
            by = by[later]
            out += [(o, _HEAD["windows"] + x) for o, x in bucketed(owner[by], [did[by], place[by]])]
        return out

    def cut(block, rows, got):
        rows, keys = in_order(rows)
        data, offsets = utf8(rows["text"])
        cover = np.zeros(len(data) + 1, np.int32)
        ids, begin = ordinals(rows, keys, offsets)
        first = equal_runs(ids, keys)
        mine = {(a, b): c for a, b, c in zip(ids[first].tolist(), keys[first].tolist(), begin[first].tolist(), strict=True)}
        for b in got:
            if b[:8] == _HEAD["windows"]:
                did, place = unblob(b[8:], 2)
                key = zip(did.tolist(), (place >> U64(PLACE_BITS)).tolist(), strict=True)
                lo = hi = np.array([mine[k] for k in key], np.int64) + (place & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
            else:
                run = unblob(b[8:], 1)[0]
                lo, hi = (run >> U64(32)).astype(np.int64), (run & U64(0xFFFFFFFF)).astype(np.int64)
            np.add.at(cover, lo, 1)
            np.add.at(cover, hi + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        left = np.r_[0, np.cumsum(~gone)]
        kept = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(left[offsets].astype(np.int64)), pa.py_buffer(data[~gone])])
        edge = np.zeros(len(data), bool)
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]])[: len(gone)])
        end = np.flatnonzero(gone & np.r_[edge[1:] | ~gone[1:], True][: len(gone)]) + 1
        row = np.searchsorted(offsets, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, offsets).astype(np.int32)), spans)
        n = np.diff(offsets)
        return pa.table({"doc_id": rows["doc_id"], "n_bytes": n, "n_removed": n - np.diff(left[offsets]), "kept": kept.cast(pa.binary()), "spans": spans})

    filled = blocks.judge(blocks.ask(fill), again(1))
    refined = blocks.judge(blocks.ask(refine, filled), split)
    settled = blocks.judge(blocks.ask(finest, refined), settle)
    return blocks.finish(cut, settled, "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start: long, end: long>>")


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
