"""Packing of documents into sequences of a fixed length, balanced by attention cost.

Every document is encoded whole, with an end id after it. What fills a whole sequence is one; the rest of each document is
packed with others: the cost of a piece is estimated as linear plus quadratic in its length, and in descending
order each piece goes to the sequence of least cost that still has room for it. Where none has room for all of it, the
one of least cost with any room takes what it holds, and what is left over is placed later like any piece of its length.
Rests are gathered up to WINDOW ids; their sequences have the full length but for the last ones, whose
lengths are the powers of two that add up to what remains. So no sequence needs padding, and a window has at
most eleven shorter ones (for a length of 2,048).

A window is packed where its documents lie: no shuffle, memory bounded by a window and the ids of its longest document,
and a lost executor costs its tasks only. sequence_id is the task's partition in its high bits and counts in the low ones.

Ids: merges by rank over the vocabulary of a tokenizer file (merge i makes id 256 + i, which is tested), with added
tokens taken out first. Texts over PART characters are encoded in parts, cut before a space between two letters, where
a token always begins.

Cases: a null or empty text is its end id alone; repeated rows are packed each; very long texts are encoded whole, in
parts; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import pieces

TOKENIZER, END_ID, LENGTH = "byte_bpe_50k.json", 1, 2048
LINEAR, QUADRATIC = 4096.0, 1.0  # cost of an id, and of a pair of ids of one piece
WINDOW, MOST_PIECES, PART, SENT = 1 << 21, 1 << 13, 1 << 20, 1 << 21
TASK_BITS = 40  # sequences of a task


class Encoder:
    def __init__(self, file: str):
        import public_tokenizers
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        # how byte-level vocabularies write bytes: printable ones as themselves, the others from character 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the ids of the vocabulary don't follow its merges")
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added, self.split = added, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def encode(self, text: str) -> np.ndarray:
        out = []
        for k, run in enumerate(self.split.split(text) if self.split and any(a in text for a in self.added) else [text]):
            if k % 2:
                out.append(np.array([self.added[run]], np.uint32))
                continue
            at = 0
            while at < len(run):
                cut = _CUT.search(run, at + PART) if len(run) - at > PART else None
                end = cut.start() if cut else len(run)
                out.append(np.array(self.bpe.encode_ordinary(run[at:end]), np.uint32))
                at = end
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.uint32)


_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@cache
def encoder(tokenizer: str) -> Encoder:
    """tokenizer: a path, or the name of a file of public_tokenizers."""
    if "/" not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return Encoder(tokenizer)


def balanced(lengths: list[int], limit: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, its ids before, length, sequence, offset) of pieces shorter than limit: descending pieces to the least cost with room; pieces are cut where none has room. Sequences are full, or powers of two that fill up."""
    whole, rest = divmod(sum(lengths), limit)
    room = np.array([limit] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    out, todo = [], [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    while todo:
        n, i, at = heapq.heappop(todo)
        n = -n
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            fits = np.flatnonzero(room > 0)
        to = int(fits[np.argmin(cost[fits])])
        take = min(n, int(room[to]))
        out.append((i, at, take, to, int(size[to] - room[to])))
        room[to] -= take
        cost[to] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(todo, (take - n, i, at + take))
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, limit: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset in it, ids (little-endian unsigned 32-bit). limit must be a power of two."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches):
        from pyspark import TaskContext

        e, base, count = encoder(tokenizer), TaskContext.get().partitionId() << TASK_BITS, 0
        kind, held, size, out, sent = pa.int64(), [], 0, [], 0

        def batch_of():
            nonlocal out, sent
            columns = list(zip(*out, strict=True))
            out, sent = [], 0
            types = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [s.split()[0] for s in schema.split(", ")])

        def packed():
            nonlocal held, size, count, sent
            last = -1
            for i, at, n, to, offset in balanced([len(h[2]) for h in held], limit, linear, quadratic):
                doc, start, ids, total = held[i]
                out.append((doc, start + at, n, total, base + count + to, offset, ids[at : at + n].tobytes()))
                last = max(last, to)
            sent += size
            held, size, count = [], 0, count + last + 1

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in pieces(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(e.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    total = len(ids)
                    for start in range(0, total - limit + 1, limit):
                        out.append((doc, start, limit, total, base + count, 0, ids[start : start + limit].tobytes()))
                        count, sent = count + 1, sent + limit
                        if sent >= SENT:
                            yield batch_of()
                    if total % limit:
                        held.append((doc, total - total % limit, ids[total - total % limit :].copy(), total))
                        size += total % limit
                    if size >= WINDOW or len(held) >= MOST_PIECES:
                        packed()
                        yield batch_of()
        if held:
            packed()
        if out:
            yield batch_of()

    return rows.mapInArrow(run, schema)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
