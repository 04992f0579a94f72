"""SentencePiece encoding with byte spans, and decoding.

Normalisation follows the model's own compiled character map: at each place the longest prefix that its trie
holds is replaced, any other character stands for itself, and every normalised byte records the source byte it
came from. The processor's pieces tile the normalised text, so their running lengths, read through that
alignment, give each piece's span of bytes in the original text. That the lengths add up to the normalised text
is checked for every text.

Merges of a BPE model never cross a place whose two bytes stand side by side in no piece. Where the model's own normalisation only
escapes spaces, texts are cut at such places (between words, above all); the library encodes each distinct part of a slice
once. The parts' ids, in their order, are those of the whole texts.
Any other model, and a slice of texts that holds the escape mark itself, is encoded text by text.

Rows are encoded where they lie: no shuffle, and a lost executor costs its tasks only. Cases: a null or empty text
has no pieces and decodes to an empty text; a very long text is encoded whole; repeated rows give equal rows;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import pieces

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
APART = "\x01"  # stands before a part that is encoded alone: no piece joins it with anything
SLICE, TOGETHER = 2 << 20, 32  # bytes of text that are looked at together; parts encoded in a text


def fields(data: bytes):
    """(field, value) of a protocol buffer message: bytes or integers."""
    i = 0

    def number():
        nonlocal i
        v = s = 0
        while True:
            b = data[i]
            i += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[i : i + n]
            i += n


class Normalizer:
    """normalize(text) gives the normalised bytes and, for each of them and their end, the source byte."""

    def __init__(self, spec: bytes):
        got = dict(fields(spec))
        self.prefix, self.squeeze, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        blob = got.get(2, b"")
        self.units, self.strings = None, b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units, self.strings = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes of the longest prefix at `at` that the trie holds (0: none) and what it becomes."""
        u, node, best = self.units, 0, (0, b"")
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        node ^= offset(u[0])
        for end in range(at, len(data)):
            b = data[end]
            node ^= b
            unit = u[node]
            if unit & ((1 << 31) | 0xFF) != b:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = u[node] & ((1 << 31) - 1)
                best = end + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return best

    def next(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes that the normalisation takes at `at`, and what they become: the longest prefix of the map, or one character as it is."""
        n, new = self.longest(data, at) if self.units else (0, b"")
        if n:
            return n, new
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return n, data[at : at + n]

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int32)
        space = SPACE if self.escape else b" "
        if self.units is None and not self.squeeze:
            out = (space if self.prefix else b"") + data.replace(b" ", space)
            width = np.ones(len(data), np.int32)
            width[np.frombuffer(data, np.uint8) == 32] = len(space)
            source = np.repeat(np.arange(len(data), dtype=np.int32), width)
            return out, np.concatenate([np.zeros(len(out) - len(source), np.int32), source, np.array([len(data)], np.int32)])
        at = 0
        if self.squeeze:  # leading white space goes
            while at < len(data):
                n, new = self.next(data, at)
                if new != b" ":
                    break
                at += n
            if at == len(data):
                return b"", np.full(1, len(data), np.int32)
        out, source = bytearray(), []

        def add(new):
            for k, part in enumerate(new.split(b" ")):
                out.extend(space * (k > 0) + part)
                source.extend([at] * (len(part) + len(space) * (k > 0)))

        if self.prefix:
            add(b" ")
        after_space = self.squeeze
        while at < len(data):
            n, new = self.next(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                add(new)
                after_space = self.squeeze and new.endswith(b" ")
            at += n
        if self.squeeze:  # trailing white space goes
            while out.endswith(space):
                at = source[-len(space)]
                del out[-len(space) :], source[-len(space) :]
        return bytes(out), np.array([*source, at], np.int32)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        pieces_ = [dict(fields(v)) for k, v in message if k == 1]
        self.normalizer = Normalizer(next((v for k, v in message if k == 3), b""))
        self.kind = np.array([p.get(3, 1) for p in pieces_])
        self.width = np.array([1 if p.get(3, 1) == 6 else len(p[1]) for p in pieces_], np.int64)
        trained = dict(fields(next((v for k, v in message if k == 2), b"")))
        texts = [p[1] for p in pieces_ if p.get(3, 1) == 1]
        n = self.normalizer
        plain = n.units is None and n.prefix and n.escape and not n.squeeze and not trained.get(24, 0)
        bpe = trained.get(3, 1) == 2 and SPACE in texts and set(self.kind.tolist()) <= {1, 2, 3, 6} and int((self.kind == 6).sum()) == 256
        #: whether texts may be encoded in parts; where so, at which pairs of bytes
        self.parted = plain and bpe and not any(APART.encode() in t for t in texts if len(t) > 1)
        if self.parted:
            texts = [t.replace(SPACE, b" ") for t in texts]
            self.source_width = np.array([1 if k == 6 else len(p[1].replace(SPACE, b" ")) for k, p in zip(self.kind, pieces_, strict=True)], np.int32)
            self.cuts = np.ones(1 << 16, bool)
            for t in texts:
                b = np.frombuffer(t, np.uint8).astype(np.int64)
                self.cuts[b[:-1] << 8 | b[1:]] = False
            self.cuts.reshape(256, 256)[:, 0x80:0xC0] = False  # not within a character

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in the bytes of the text."""
        normal, source = self.normalizer.normalize(text.encode())
        width = self.width[ids]
        if (self.kind[ids] == 2).any():  # an unknown piece is as long as what it stands for
            width = np.array([len(p.piece.encode()) if k != 6 else 1 for p, k in zip(self.sp.encode(text, out_type="immutable_proto").pieces, self.kind[ids], strict=True)])
        ends = np.cumsum(width)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("pieces do not tile the normalised text")
        return source[ends - width], source[ends]

    def ids_of(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts of texts, one after another, and where each part's ids begin; one more at the end. Parts are encoded many in a text, with APART before each."""
        size = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = pa.ListArray.from_arrays(pa.array(np.r_[np.arange(0, len(parts), TOGETHER), len(parts)].astype(np.int32)), parts)
        found = self.sp.encode([APART + t for t in pc.binary_join(groups, APART).to_pylist()], num_threads=1)
        ids = np.concatenate([np.zeros(0, np.int32), *[np.array(x, np.int32) for x in found]])
        ends = np.r_[0, np.cumsum(self.source_width[ids])]
        start = np.cumsum(size + 1) - size + np.arange(len(parts)) // TOGETHER + 1  # a space stands before each text
        first, after = np.searchsorted(ends, start), np.searchsorted(ends, start + size)
        n = after - first
        begin = np.r_[0, np.cumsum(n)]
        return ids[np.repeat(first - begin[:-1], n) + np.arange(begin[-1])], begin

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of texts: where each text's ids end, and all ids, starts and ends."""
        column = pc.fill_null(column, "")
        if not self.parted or pc.any(pc.match_substring(column, SPACE.decode())).as_py():
            texts = column.to_pylist()
            arrays = [np.array(x, np.int32) for x in self.sp.encode(texts, num_threads=1)]
            spans = [self.spans(t, x) for t, x in zip(texts, arrays, strict=True)]
            ends = np.cumsum([len(x) for x in arrays])
            return ends, *(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in (arrays, [s for s, _ in spans], [e for _, e in spans]))
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        size += size > 0  # a space stands before each text
        last = np.cumsum(size)
        joined = pc.binary_join_element_wise(pc.if_else(pc.equal(column, ""), "", " "), column, "")
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: int(size.sum())]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = self.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        cut[last] = True
        at = np.flatnonzero(cut)
        coded = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        which = coded.indices.to_numpy()
        flat, begin = self.ids_of(coded.dictionary)
        n = np.diff(begin)[which]
        done = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat((begin[which] - done[:-1]).astype(np.int32), n) + np.arange(done[-1], dtype=np.int32)]
        width = self.source_width[ids]
        place = np.cumsum(width, dtype=np.int32)
        if not np.array_equal(np.r_[0, place][done], at):
            raise ValueError("pieces do not tile the text")
        ends = done[np.searchsorted(at, last)]
        place -= np.repeat((last - size + 1).astype(np.int32), np.diff(np.r_[0, ends]))
        return ends, ids, np.maximum(place - width, 0), np.maximum(place, 0)


@cache
def codec(model: str) -> Codec:
    """model: a path, or the name of a file of public_tokenizers."""
    if "/" not in model:
        import public_tokenizers

        model = public_tokenizers.path(model)
    return Codec(model)


def encoded(batches: Iterable[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
    """Of batches of (doc_id, text, rest): doc_id, ids, starts, ends, decoded, rest."""
    for batch in batches:
        for part in pieces(batch, "text", SLICE):
            ends, *lists = c.encode(part.column(1))
            bounds = [0, *ends.tolist()]
            ids = lists[0].tolist()
            decoded = c.sp.decode([ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]) if len(ends) else []
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in lists]
            yield pa.record_batch([part.column(0), *lists, pa.array(decoded, pa.string()), part.column(2)], ["doc_id", "ids", "starts", "ends", "decoded", "rest"])


def encode(docs: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, starts, ends (bytes of the text, for each id) and decoded (the text of the ids) of each row of docs(doc_id, text), and the columns of `carry`."""
    rest = F.struct(*[F.col(c) for c in carry]).alias("rest") if carry else F.lit(None).cast("int").alias("rest")
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), rest)

    found = rows.mapInArrow(lambda batches: encoded(batches, codec(model)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>, decoded string, rest {rows.schema['rest'].dataType.simpleString()}")
    keep = found.select("doc_id", "ids", "starts", "ends", "decoded", *[F.col("rest")[c].alias(c) for c in carry])
    return keep


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
