"""N-gram Jaccard self-join by partition of the token universe and the pigeonhole principle.

Sets of word shingles are put into size bands. A scheme covers all pairs whose smaller set is in its band; there
a linked pair differs in at most H shingles. The scheme cuts the hashed shingle universe into m segments, so a
pair that differs in no more than H has a segment that is equal, or (in the d segments that get an allowance of
two) differs by one shingle only: m + d = H + 1 + spare. Every set indexes the hash of each non-empty segment, and
the one-deletion neighbourhood of those d segments. d follows from cost: whole segments are cheaper to index, but
segments under four shingles match by chance, so small bands take fewer, larger segments with deletions.
Empty segments would match everywhere; a set in which no more than `spare` of the allowance falls to segments
that are empty (or of one shingle, where that may be deleted) doesn't need them, and only the few others, which
could be missed by each other alone, index those as well. So no pair is lost.

Verification is exact: candidates are compared on their words. Sets that agree in two independent 64-bit sums of their
shingles' hashes and in size are one class from the start, and aren't compared as words. For each signature the least class is tried with every other (linear), and links are joined to components. Where a signature
still has classes of several components and MEET classes at most, those of different components are tried with each
other. Signatures of more classes (a passage that very many texts share fills whole segments) are too common to tell
anything; their classes are compared where they meet in the prefixes of their sets, rarest shingle first, in which
linked pairs must meet. So nothing is capped.
Before texts move, a pair must have sizes that can link and parity bits (each shingle flips one of 64 * PARITY) that
differ in no more places than linked sets do; sets differ in as many shingles as bits at least, so no link is lost. A
candidate's text goes to a block of texts once, and a pair's other text to the blocks that ask for it.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; one with fewer words
than `width` has its whole sequence as its only shingle; a very long text is one set like others; repeated rows are one
class and each keeps its row; rows of equal doc_id but different texts each get the component of their own text; a row
without doc_id gets the component of the class of its text and connects nothing; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from functools import cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exchange import BLOCK_BYTES, LEAST_BLOCKS, Blocks, made, swept, text_bytes, written
from .kernels import U64, Words, bucketed, equal_runs, join, mix, pieces, unblob, utf8, windows

_K = U64(0x9E3779B97F4A7C15)
PARITY = 8  # longs of a set's parity bits
FULL = 2.5  # shingles a segment should hold on average
MEET = 64  # classes of a signature up to which those of different components are tried with each other
PIECE, HELD = 256 << 10, 1 << 17  # bytes of text and signatures that a task holds at once


def _allocation(h: int, low: int) -> tuple[int, int, int]:
    """m, d and spare of the fewest signatures for a set of `low` shingles, such that segments hold FULL of them and few sets lose more than `spare` to empty ones."""
    best = None
    step = max(1, h // 32)  # wide bands are searched in steps
    for spare in range(0, h // 2 + 3, step):
        for d in range(0, min((h + 1 + spare) // 2, 8 + h // 8) + 1, step):
            m = h + 1 + spare - d
            load = low / m
            empty = exp(-load)
            risk = (m - d) * empty + 2 * d * empty * (1 + load)
            short = 0.0 if m == 1 else max(0.0, risk + 2.5 * risk**0.5 - spare)
            cost = m + d * load + m * 4 * max(0.0, FULL - load) + 10 * short
            if best is None or cost < best[0]:
                best = cost, m, d, spare
        if spare > best[3] + 8 * step:
            break
    return best[1:]


@cache
def schemes(num: int, den: int) -> dict[str, np.ndarray]:
    """For each size band: the least and the largest size that index in its scheme, m, d and spare (m is 0 where only equal sets link)."""
    low, top, ms, ds, spares = 1, [], [], [], []
    lows = []
    while low < 1 << 28:
        nxt = max(low + 1, low * den // num)
        most = (nxt - 1) * den // num
        h = (nxt - 1 + most) * (den - num) // (den + num)
        m, d, spare = _allocation(h, low) if h else (0, 0, 0)
        lows.append(low), top.append(most), ms.append(m), ds.append(d), spares.append(spare)
        low = nxt
    return {k: np.array(v, np.int64) for k, v in {"low": lows, "top": top, "m": ms, "d": ds, "spare": spares}.items()}


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their numbers."""
    w = Words(*utf8(text), lower=True)
    word, counts = w.hashes[0], w.counts
    whole = np.arange(len(word)) + width <= np.repeat(w.first[1:], counts)
    h, doc = [windows(word, width)[whole]], [np.repeat(np.arange(len(counts)), counts)[whole]]
    for n in range(1, width):  # texts of n words are one shingle
        few = np.flatnonzero(counts == n)
        if len(few):
            x = np.full(len(few), n, U64)
            for k in range(n):
                x = join(x, word[w.first[few] + k])
            h.append(x), doc.append(few)
    h, doc = np.concatenate(h), np.concatenate(doc)
    by = np.argsort(doc, kind="stable")
    h, doc = h[by], doc[by]
    edges = np.searchsorted(doc, np.arange(len(counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        h[a:b].sort()
    one = equal_runs(doc, h)
    return h[one], np.bincount(doc[one], minlength=len(counts))


def set_ids(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent numbers of each set: of all its shingles, whatever their order."""
    ends = np.cumsum(sizes)
    sums = (np.r_[U64(0), np.cumsum(x, dtype=U64)] for x in (mix(h), join(h, h ^ _K)))
    return tuple(mix(x[ends] - x[ends - sizes] + sizes.astype(U64) * _K) for x in sums)


def parities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """PARITY longs for each set: every shingle flips one bit."""
    out = np.zeros(len(sizes) * PARITY * 8, np.uint8)
    bit = np.repeat(np.arange(len(sizes)), sizes) * (64 * PARITY) + ((h >> U64(17)) % U64(64 * PARITY)).astype(np.int64)
    np.bitwise_xor.at(out, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
    return out.view(np.int64).reshape(-1, PARITY)


def signatures(h: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the number of the set of each."""
    s = schemes(num, den)
    band = np.searchsorted(s["low"], sizes, "right") - 1
    begin = np.cumsum(sizes) - sizes
    code = mix(h ^ U64(0x5851F42D4C957F2D))
    out_sig, out_set = [], []
    for back in range(8):
        k = band - back
        use = np.flatnonzero((k >= 0) & (sizes > 0) & (s["top"][k] >= sizes) & (s["m"][k] > 0))
        if not len(use):
            if back > 3:
                break
            continue
        k, n = k[use], sizes[use]
        m, d, spare = s["m"][k], s["d"][k], s["spare"][k]
        of = np.repeat(np.arange(len(use)), n)
        at = np.repeat(begin[use] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seg = ((h[at] >> U64(32)) * m[of].astype(U64)) >> U64(32)
        tag = mix((k[of].astype(U64) << U64(40)) + seg + U64(1))
        first = equal_runs(of, seg)
        size = np.diff(np.r_[first, len(of)])
        total = np.add.reduceat(code[at], first)
        owner, seg1, tag1 = of[first], seg[first].astype(np.int64), tag[first]
        out_sig.append(mix(total + tag1)), out_set.append(use[owner])
        two = seg1 < d[owner]
        # the part of the allowance that falls to segments of no use to this set
        lone = two & (size == 1)
        risk = m + d - np.bincount(owner, 1 + two, len(use)).astype(np.int64) + np.bincount(owner, 2 * lone, len(use)).astype(np.int64)
        bare = risk > spare
        run = np.repeat(np.arange(len(first)), size)
        drop = np.flatnonzero(two[run] & ((size[run] > 1) | bare[owner[run]]))
        out_sig.append(mix(total[run[drop]] - code[at[drop]] + tag1[run[drop]])), out_set.append(use[of[drop]])
        if bare.any():
            poor = np.flatnonzero(bare)
            of = np.repeat(poor, m[poor])
            base = np.cumsum(m[poor]) - m[poor]
            each = np.arange(len(of)) - np.repeat(base, m[poor])
            place = np.zeros(len(use), np.int64)
            place[poor] = base
            full = np.zeros(len(of), bool)
            mine = bare[owner]
            full[place[owner[mine]] + seg1[mine]] = True
            of, each = of[~full], each[~full]
            out_sig.append(mix(mix((k[of].astype(U64) << U64(40)) + each.astype(U64) + U64(1)))), out_set.append(use[of])
    if not out_sig:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


_ROWS = "sig long, set long, set2 long, doc_id long, key long, n long, parity array<long>"


def _index(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows of classes (set and set2, doc_id, key, n, parity; sig null) and of signatures that more than one class has (sig, set), from one scan. key is a hash of the text."""
    buckets = max(LEAST_BLOCKS, -(-text_bytes(docs) // (4 * BLOCK_BYTES)))

    def emit(batches):
        seen: set[int] = set()  # classes that this task has indexed lately: a copy costs its own row only
        held, size = [], 0

        def flush():
            rows = []
            if held:
                sig, ids = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                rows = [(b, 1, x) for b, x in bucketed((sig % U64(buckets)).astype(np.int64), [sig, ids])]
                held.clear()
            return rows

        for batch in batches:
            rows = []
            for part in pieces(batch, "text", PIECE):
                h, sizes = shingle_sets(part.column(1), width)
                ids, ids2 = set_ids(h, sizes)
                null = np.asarray(part.column(0).is_null())
                did, key = (part.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
                to = (mix(key.view(U64) ^ ids ^ mix(did.view(U64))) % U64(buckets)).astype(np.int64)
                rows += [(b, 0, x) for b, x in bucketed(to, [ids, ids2, did, key, sizes, null.astype(np.int64), *parities(h, sizes).T])]
                new = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                if len(seen) > HELD:
                    seen.clear()
                keep = np.repeat(new, sizes)
                sig, of = signatures(h[keep], np.where(new, sizes, 0), num, den)
                by = np.argsort(of, kind="stable")  # a class's signatures stay together, so that their ids compress
                held.append((sig[by], ids[of[by]]))
                size += len(sig)
                if size > HELD:
                    yield _sent(rows + flush())
                    rows, size = [], 0
            if rows:
                yield _sent(rows)
        if rows := flush():
            yield _sent(rows)

    def _sent(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])

    def judge(rows: pa.Table) -> pa.Table:
        kinds, blobs = rows["kind"].to_pylist(), rows["data"].to_pylist()
        d = np.concatenate([np.zeros((6 + PARITY, 0), np.int64), *[unblob(b, 6 + PARITY).view(np.int64) for k, b in zip(kinds, blobs, strict=True) if k == 0]], axis=1)
        parts = [unblob(b, 2) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        sig, ids = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), U64)
        del blobs, parts
        by = np.lexsort((ids, sig))
        sig, ids = sig[by], ids[by]
        one = equal_runs(sig, ids)
        sig, ids = sig[one], ids[one]
        first = equal_runs(sig)
        size = np.diff(np.r_[first, len(sig)])
        more = np.repeat(size > 1, size)
        sig, ids = sig[more].view(np.int64), ids[more].view(np.int64)
        a, b = d.shape[1], len(sig)
        none = pa.nulls(b, pa.int64())
        parity = pa.ListArray.from_arrays(pa.array(np.arange(a + 1, dtype=np.int32) * PARITY), pa.array(np.ascontiguousarray(d[6:].T).ravel()))
        return pa.table({
            "sig": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(sig)]), "set": pa.concat_arrays([pa.array(d[0]), pa.array(ids)]), "set2": pa.concat_arrays([pa.array(d[1]), none]),
            "doc_id": pa.concat_arrays([pa.array(d[2], mask=d[5] > 0), none]), "key": pa.concat_arrays([pa.array(d[3]), none]), "n": pa.concat_arrays([pa.array(d[4]), none]),
            "parity": pa.concat_arrays([parity, pa.nulls(b, parity.type)]),
        })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key"))
    sent = rows.mapInArrow(emit, "bucket int, kind int, data binary")
    return written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, _ROWS), "shingles")


def text_key():
    return F.xxhash64(F.col("text").cast("string"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, text of the classes in wanted(set, doc_id, key), each from one of its rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("key"))
    return written(rows.join(wanted, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("set").alias("set"), F.first("text").alias("text")).select("set", "text"), "texts")


def exact_sets(text: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the distinct shingles of all texts, sorted within each, how many each has, and how many there are. Equal numbers are equal words, no hashes."""
    w = Words(*utf8(text), lower=True)
    code, none = w.coded  # none stands for a word that a short text doesn't have
    counts, n = w.counts, len(code)
    at, doc, last = np.arange(n), np.repeat(np.arange(len(counts)), counts), np.repeat(w.first[1:], counts)
    use = (at + width <= last) | (at == w.first[:-1][doc])
    at, doc, last = at[use], doc[use], last[use]
    number, many = np.zeros(len(at), np.int64), 1
    for k in range(width):
        word = np.where(at + k < last, code[np.minimum(at + k, n - 1)], none) if n else number
        coded = pa.array(number * (none + 1) + word).dictionary_encode()
        number, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    pair = np.sort(doc * many + number)
    pair = pair[equal_runs(pair)]
    return pair % many, np.bincount(pair // many, minlength=len(counts)), many


def _linked(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that link. Texts of b lie in blocks; each text a goes once to every block that has a partner of it."""
    blocks = max(LEAST_BLOCKS, -(-4 * text_bytes(texts) // BLOCK_BYTES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int").alias("block")
    asked = pairs.groupBy("a", block("b")).agg(F.collect_list("b").alias("bs")).join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a").select("block", "a", "bs", "ta")
    here = texts.join(pairs.select(F.col("b").alias("set")).distinct(), "set", "left_semi").select(block("set"), "set", "text")

    def check(here: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        if here.num_rows and asked.num_rows:
            codes, sizes, many = exact_sets(pa.chunked_array([*here["text"].chunks, *asked["ta"].chunks]), width)
            begin = np.cumsum(sizes) - sizes
            sets = here["set"].to_numpy()
            by = np.argsort(sets)
            mark = np.zeros(many, bool)
            for i, (a, bs) in enumerate(zip(asked["a"].to_pylist(), asked["bs"], strict=True), here.num_rows):
                own = codes[begin[i] : begin[i] + sizes[i]]
                mark[own] = True
                bs = bs.values.to_numpy()
                rows = by[np.searchsorted(sets, bs, sorter=by)]
                both = np.array([np.count_nonzero(mark[codes[begin[r] : begin[r] + sizes[r]]]) for r in rows])
                mark[own] = False
                link = den * both >= num * (sizes[i] + sizes[rows] - both)
                out.append(np.stack([np.full(link.sum(), a), bs[link]]))
        out = np.concatenate(out, axis=1)
        return pa.table({"a": out[0], "b": out[1]})

    return written(here.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(check, "a long, b long"), "links")


def _tokens(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set, n, c, tokens (shingle hashes) of the classes in wanted(set, n, c)."""

    def read(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                h, sizes = shingle_sets(part.column(1), width)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.record_batch([part.column(0), lists, part.column(2), part.column(3)], ["set", "tokens", "n", "c"])

    return written(texts.join(wanted, "set").select("set", "text", "n", "c").mapInArrow(read, "set long, tokens array<long>, n long, c long"), "tokens")


def _level(f: np.ndarray) -> np.ndarray:
    """How often a shingle occurs as one byte: 0 for once only, then eight steps for each doubling."""
    return np.minimum(np.floor(8 * np.log2(f)), 255).astype(np.uint8)


def _heads(sets: DataFrame, num: int, den: int) -> DataFrame:
    """t, set, n, c, i: the shingles of each set's prefix in the order of how often they occur in all sets, and their places; those that occur once only can't meet and go.

    Blocks of sets send each distinct shingle with its count to a bucket, and buckets answer with levels of the
    totals, one byte each, in the order of the question; so counts are whole at any size and nothing is broadcast.
    """
    weight = int(sets.agg(F.sum(F.size("tokens"))).first()[0] or 0) * 8
    blocks = Blocks.of(sets.select("set", "n", "c", "tokens"), "set", max(LEAST_BLOCKS, -(-weight // BLOCK_BYTES)))
    buckets = blocks.count

    def asked(rows: pa.Table):
        """All shingles of a block, its distinct ones by bucket and value, how often each occurs here, and where each bucket's begin."""
        t = np.concatenate([np.zeros(0, U64), *[c.flatten().to_numpy().view(U64) for c in rows["tokens"].chunks]])
        one, inverse, count = np.unique(t, return_inverse=True, return_counts=True)
        to = (one % U64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        return t, one[by], place[inverse], count[by], np.searchsorted(to[by], np.arange(buckets + 1))

    def emit(block, rows, got, buckets):
        _, one, _, count, cut = asked(rows)
        small = np.minimum(count, 2**32 - 1).astype(np.uint32)
        return [(b, np.uint32(b).tobytes() + one[x:y].tobytes() + small[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]

    def decide(from_blocks, blobs):
        sizes = [(len(x) - 4) // 12 for x in blobs]
        t = np.concatenate([np.frombuffer(x, U64, k, 4) for x, k in zip(blobs, sizes, strict=True)])
        f = np.concatenate([np.frombuffer(x, np.uint32, k, 4 + 8 * k) for x, k in zip(blobs, sizes, strict=True)])
        _, inverse = np.unique(t, return_inverse=True)
        level = _level(np.bincount(inverse, f))[inverse].tobytes()
        ends = np.cumsum(sizes)
        return [(to, x[:4] + level[e - k : e]) for to, x, k, e in zip(from_blocks, blobs, sizes, ends.tolist(), strict=True)]

    def finish(block, rows, got):
        t, one, place, _, cut = asked(rows)
        level = np.zeros(len(one), np.uint8)
        for x in got:
            b = int(np.frombuffer(x, np.uint32, 1)[0])
            level[cut[b] : cut[b + 1]] = np.frombuffer(x, np.uint8, -1, 4)
        f = level[place]
        n = rows["n"].to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        by = np.lexsort((t, f, row))
        at = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
        use = (at < (n - (num * n + den - 1) // den + 1)[row]) & (f[by] > 0)
        r = pa.array(row[use])
        return pa.table({"t": t[by][use].view(np.int64), "set": rows["set"].take(r), "n": rows["n"].take(r), "c": rows["c"].take(r), "i": at[use].astype(np.int32)})

    return blocks.finish(finish, blocks.judge(blocks.ask(emit), decide), "t long, set long, n long, c long, i int")


def _common(texts: DataFrame, rest: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the classes in rest(set, n, c, parity), of different components, that meet in their prefixes."""
    heads = written(_heads(_tokens(texts, rest, width), num, den), "heads")
    twice = heads.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    heads = heads.join(twice, "t", "left_semi")
    heads = heads.join(rest.select("set", "parity"), "set")
    other = heads.select("t", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("i").alias("ib"), F.col("parity").alias("pb"))
    # at its first common shingle, a linked pair still has enough shingles ahead
    ahead = (num + den) * F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("ib")) >= num * (F.col("n") + F.col("nb"))
    near = (F.col("set") < F.col("b")) & (F.col("c") != F.col("cb")) & _alike("n", "nb", "parity", "pb", num, den) & ahead
    return heads.join(other, "t").where(near).select(F.col("set").alias("a"), "b").distinct()


def _alike(n: str, m: str, p: str, q: str, num: int, den: int):
    """Sets of these sizes and parities can link."""
    flipped = sum((F.bit_count(F.get(p, F.lit(k)).bitwiseXOR(F.get(q, F.lit(k)))) for k in range(PARITY)), F.lit(0))
    return (num * F.greatest(n, m) <= den * F.least(n, m)) & ((num + den) * flipped <= (den - num) * (F.col(n) + F.col(m)))


def ngram_join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, component_id and component_key (of the component's least row) of each row of docs(doc_id, text); two texts link at Jaccard similarity num / den or more."""
    others = made()
    index = _index(docs, width, num, den)
    classes = index.where("sig is null").select("doc_id", "key", "set", "set2", "n", "parity")
    shared = index.where("sig is not null").select("sig", "set")
    least = F.min(F.struct("doc_id", "key"))
    first = written(classes.where("n > 0 and doc_id is not null").groupBy("set", "set2").agg(least.alias("rep"), F.max("n").alias("n"), F.any_value("parity").alias("parity")).select("set", "set2", "rep.doc_id", "rep.key", "n", "parity"), "classes")
    members = written(first.join(shared.select("set").distinct(), "set", "left_semi"), "members")
    texts = _texts(docs, members.select("set", "doc_id", "key"))
    own = members.select("set", "n", "parity").distinct()
    lead = shared.groupBy("sig").agg(F.min("set").alias("a"))
    first_pairs = shared.join(lead, "sig").where("set <> a").select("a", F.col("set").alias("b")).distinct()
    side = lambda x: own.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    tried = written(first_pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("na", "nb", "pa", "pb", num, den)).select("a", "b"), "tried")
    links = _linked(tried, texts, width, num, den)
    found = connected_components(links)
    placed = own.join(found, F.col("set") == F.col("node"), "left").select("set", "n", "parity", F.coalesce("component", "set").alias("c"))
    apart = shared.join(placed, "set").groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("sig", "k")
    apart = written(shared.join(apart, "sig").join(placed, "set").select("sig", "k", "set", "n", "c", "parity"), "apart")
    few = apart.where(F.col("k") <= MEET)
    other = few.select("sig", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("parity").alias("pb"))
    pairs = few.join(other, "sig").where((F.col("set") < F.col("b")) & (F.col("c") != F.col("cb")) & _alike("n", "nb", "parity", "pb", num, den)).select(F.col("set").alias("a"), "b").distinct()
    rest = apart.where(F.col("k") > MEET).select("set", "n", "c", "parity").distinct()
    if rest.take(1):
        pairs = pairs.unionByName(_common(texts, written(rest, "rest"), width, num, den)).distinct()
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = written(pairs.select(*ends).join(tried.select(*ends), ["a", "b"], "left_anti"), "pairs")
    if pairs.take(1):
        more = _linked(pairs, texts, width, num, den)
        if more.take(1):
            found = connected_components(links.unionByName(more))
    root = first.join(found, F.col("set") == F.col("node"), "left").select("set", "set2", "doc_id", "key", F.coalesce("component", "set").alias("root"))
    root = root.select("set", "set2", "root").join(root.groupBy("root").agg(least.alias("c")), "root").select("set", "set2", "c")
    of = written(root, "components")
    swept(*others, index, of)  # all else has done its work
    of_own = lambda c: F.when(F.col("n") > 0, F.col("c")[c]).otherwise(F.col(c))
    return classes.join(of, ["set", "set2"], "left").select("doc_id", "key", F.col("n").alias("n_shingles"), of_own("doc_id").alias("component_id"), of_own("key").alias("component_key"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
