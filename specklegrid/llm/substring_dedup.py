"""Substring dedup by difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a k below v with both i + k and j + k in D
modulo v. So of two equal windows of `width` words, wherever they start, some k gives two cover positions inside
them at which the same `width - v + 1` words begin. Only these anchors are hashed and counted over the corpus
(5 positions of 21); windows around an anchor that occurs again are then extended to their whole `width` words
and counted themselves, which settles them. No window or frequent anchor is left out: a block sends each
distinct hash once, so frequent ones cost their bucket one entry for each block.

Cases: a null or empty text has no words; a text below `width` words keeps all; rows of equal doc_id are
separate documents; an empty table gives no rows; other columns come along only where asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Blocks, again, among, block_of, distinct
from .kernels import U64, Words, bucketed, runs, utf8

WIDTH, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def substring_dedup(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, carry: tuple[str, ...] = (), joined: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text left), spans (first and last + 1 word of each removed run) of each row of docs(doc_id, text), and the columns of `carry`.

    joined: kept holds the words left, joined by single spaces; otherwise the text with its own white space, without
    the removed words and the white space after each. A text that loses nothing is then unchanged, and null stays null.
    """
    if not is_cover(cover, period) or not 0 < period < width:
        raise ValueError("cover must hold every difference modulo period, and period be below width")
    rest = F.struct(*[F.col(c) for c in carry]) if carry else None
    blocks = Blocks(docs)
    if carry:
        blocks.docs = docs.select(block_of(blocks.count), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest")).repartition(blocks.count, "block")
    covered = np.zeros(period, bool)
    covered[list(cover)] = True

    def words_of(rows):
        return Words(*utf8(rows["text"]))

    def anchors_of(w):
        h, fits = runs(w, width - period + 1)
        at = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
        return h, fits & covered[at % period] & np.repeat(w.counts >= width, w.counts)

    def send(buckets, *lanes):
        lanes = distinct(*lanes)
        return list(bucketed(((lanes[0] >> U64(1)) % U64(buckets)).astype(np.int64), lanes))

    def anchors(block, rows, _, buckets):
        h, use = anchors_of(words_of(rows))
        return send(buckets, h[use])

    def windows_of(w):
        (h, fits), (more, _) = runs(w, width), runs(w, width, 1)
        return h, more, fits

    def extend(block, rows, got, buckets):
        w = words_of(rows)
        h, use = anchors_of(w)
        at = np.flatnonzero(use)
        at = at[among([h[at]], got)]
        near = np.zeros(len(h) + 1, np.int32)
        np.add.at(near, np.maximum(at - period + 1, 0), 1)
        np.add.at(near, at + 1, -1)
        h, more, fits = windows_of(w)
        use = fits & (np.cumsum(near[:-1]) > 0)
        return send(buckets, h[use], more[use])

    def cut(block, rows, got):
        data, offsets = utf8(rows["text"])
        w = Words(data, offsets)
        h, more, fits = windows_of(w)
        at = np.flatnonzero(fits & among([h, more], got)) if got else np.zeros(0, np.int64)
        gone = np.zeros(len(h) + 1, np.int32)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + width, -1)
        gone = np.cumsum(gone[:-1]) > 0
        lost = np.r_[0, np.cumsum(gone)]
        removed = lost[w.first[1:]] - lost[w.first[:-1]]
        stay = np.zeros(len(data) + 1, np.int32)  # bytes of kept words
        if joined:
            kept = ~gone
            np.add.at(stay, w.start[kept], 1)
            np.add.at(stay, w.end[kept], -1)
            take = np.cumsum(stay[:-1]) > 0
            left = np.flatnonzero(kept)
            text = np.repeat(np.arange(len(w.counts)), w.counts)[left]
            gap = w.end[left[:-1][text[1:] == text[:-1]]]  # a byte of white space follows each word that is not a text's last
            take[gap] = True
            data = data.copy()
            data[gap] = 32
        else:
            np.add.at(stay, w.start[gone], 1)
            follow = np.r_[w.start[1:], len(data)]
            last = np.zeros(len(h), bool)
            last[(w.first[1:] - 1)[w.counts > 0]] = True
            np.add.at(stay, np.where(last, np.repeat(offsets[1:], w.counts), follow)[gone], -1)
            take = np.cumsum(stay[:-1]) == 0
        ends = np.r_[0, np.cumsum(take)][offsets]
        kept = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[take])]).cast(pa.string())
        if not joined and rows["text"].null_count:
            import pyarrow.compute as pc

            kept = pc.if_else(pc.is_null(rows["text"].combine_chunks()), pa.scalar(None, pa.string()), kept)
        edge = np.zeros(len(h) + 1, bool)
        edge[w.first] = True
        begin = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]])[: len(gone)])
        end = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])[: len(gone)]) + 1
        row = np.searchsorted(w.first, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - w.first[row]), pa.array(end - w.first[row])], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, w.first).astype(np.int32)), spans)
        out = {"doc_id": rows["doc_id"], "n_words": w.counts.astype(np.int64), "n_removed": removed.astype(np.int64), "kept": kept, "spans": spans}
        return pa.table(out | ({"rest": rows["rest"]} if carry else {}))

    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, end: long>>"
    if carry:
        schema += f", rest {docs.select(rest.alias('r')).schema['r'].dataType.simpleString()}"
    known = blocks.judge(blocks.ask(anchors), again(1))
    found = blocks.finish(cut, blocks.judge(blocks.ask(extend, known), again(2)), schema)
    return found.select("doc_id", "n_words", "n_removed", "kept", "spans", *[F.col("rest")[c].alias(c) for c in carry]) if carry else found


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
