"""Approximate nearest neighbours by largest inner product, over shifted space-filling curves.

Each of `curves` orderings projects the vectors by a random rotation and shift of its own and sorts them along a
Hilbert curve, cut into blocks of about `block` rows (quantiles of a sample; a hash of vec_id parts rows of one key).
A row goes to its block of each curve, a query to its own and `reach` blocks on either side, across all edges, and meets
every row there; the best of each block are merged and ranked by their exact inner products. reach is measured on
the table itself: SAMPLE queries are answered exactly in one scan, and reach is the least that holds the share `target` of
their neighbours. So it grows with the rows where recall would fall. Rows are banded by length, in powers of two below
the longest. A band has curves, blocks and a reach of its own, and every query is searched in every band; in bands of
three blocks at most it meets all rows. Within a band, candidates get one more coordinate that makes all lengths equal,
and queries are stretched to that length, so nearness on the curve follows the inner product.

Cases: vectors that are null, empty or zero, that hold null or non-finite components, or whose length isn't the
table's most common one take no part, nor do rows without vec_id; rows of equal vec_id are all candidates and the best
counts; equal vectors stand on the curves as one row that carries its k + 1 smallest vec_ids, so ties go to the smaller
vec_id however many copies there are; with fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .kernels import U64, mix

CURVES, DIMS, BITS, BLOCK, PART_ROWS = 32, 8, 6, 1024, 16384
SAMPLE, TARGET, MOST_BLOCKS, SALTS, SHARE_ROWS = 128, 0.96, 4096, 64, 8192


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of points (rows of unsigned cells below 2**bits) along the Hilbert curve."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level
        low = U64(q - 1)
        for i in range(n):
            on = (x[i] & U64(q)) > 0
            t = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t) if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], U64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & U64(q)) > 0, t ^ U64(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], U64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << U64(1) | (x[i] >> U64(b) & U64(1))
    return key


def frames(dims: int, curves: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """A projection onto DIMS orthonormal directions and a shift for each curve."""
    rng = np.random.default_rng(seed)
    p = min(DIMS, dims)
    return np.stack([np.linalg.qr(rng.normal(size=(dims, p)))[0] for _ in range(curves)]), rng.random((curves, p))


def keys_of(v: np.ndarray, scale: float, projection: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Curve keys of rows of v; coordinates from -3 to 3 times scale fill the cells."""
    cells = np.floor(((v @ projection) / (3 * scale) + 1) / 2 * (1 << BITS) * 0.75 + shift * (1 << BITS) * 0.25)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def lengths(v: np.ndarray) -> np.ndarray:
    """Lengths of the rows of v, as a column; squares neither overflow nor vanish."""
    top = np.abs(v).max(1, keepdims=True)
    return top * np.linalg.norm(v / top, axis=1, keepdims=True)


class Curves:
    """Where the vectors of one band of lengths stand on each curve, how each is cut into `count` blocks, and how far a query reaches."""

    def __init__(self, dims: int, curves: int, n: int, most: float, block: int, exact: bool = False):
        self.count = -(-n // max(block, -(-n // MOST_BLOCKS)))
        self.exact = exact or self.count <= 3  # then every query meets every row, on one curve
        self.curves, self.reach, self.shares = 1 if self.exact else curves, self.count - 1 if self.exact else 1, 1
        self.n, self.most, self.frames, self.edges = n, most, frames(dims + 1, self.curves), np.zeros((self.curves, 0), np.int64)

    def positions(self, v: np.ndarray, ids: np.ndarray, ask: bool) -> np.ndarray:
        """Key and 15 bits of hash, a row for each curve; a query stands at its own place, which for vectors of equal length is the row's."""
        size = lengths(v) if len(v) else np.ones((0, 1))
        u = v / (size if ask else self.most)
        x = np.hstack([u, np.zeros_like(size) if ask else np.sqrt(np.maximum(1 - (size / self.most) ** 2, 0))])
        tie = mix(ids.view(U64)) & U64(0x7FFF)
        return np.stack([(keys_of(x, x.shape[1] ** -0.5, p, s) << U64(15) | tie).view(np.int64) for p, s in zip(*self.frames, strict=True)])

    def share(self, asked: int) -> int:
        """Deals the queries of a block into shares, so that a band of few rows doesn't gather all; returns the rows that go to blocks."""
        wide = min(self.count, 2 * self.reach + 1)
        self.shares = max(1, -(-asked * wide // (self.count * SHARE_ROWS)))
        return self.curves * (self.n * self.shares + asked * wide)

    def cut(self, v: np.ndarray, ids: np.ndarray, blocks: int) -> None:
        """Edges of about equal blocks, from a sample of rows."""
        at = np.sort(self.positions(v, ids, False), axis=1)
        self.edges = at[:, np.arange(1, blocks) * at.shape[1] // blocks]

    def blocks(self, v: np.ndarray, ids: np.ndarray, ask: bool) -> np.ndarray:
        return np.stack([np.searchsorted(e, p, "right") for e, p in zip(self.edges, self.positions(v, ids, ask), strict=True)])


def groups(batches, *names: str):
    """Tables of the rows that are equal in the columns `names`, which follow each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[n].to_numpy() for n in names], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def ranked(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each `at`, by falling score, then by id."""
    order = np.lexsort((ids, -score, at))
    at = at[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < k]


def best_of(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the m largest of each row, and of all that equal the m-th but for rounding."""
    if m < s.shape[1]:
        least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        return np.nonzero(s >= (least - 1e-9 * np.abs(least))[:, None])
    return np.nonzero(s > -np.inf)


def chosen(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each `at`; an id counts once, with its best score."""
    order = np.lexsort((-score, ids, at))
    at, ids, score = at[order], ids[order], score[order]
    first = np.r_[True, (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])][: len(at)]
    at, ids, score = at[first], ids[first], score[first]
    keep = ranked(at, ids, score, k)
    return at[keep], ids[keep], score[keep]


def spread(of: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows `at` of a binary column, and the number of each row's."""
    n = pc.binary_length(of).to_numpy()
    every, begin, many = np.frombuffer(b"".join(of.to_pylist()), np.int64), np.cumsum(n) // 8 - n // 8, n[at] // 8
    return every[np.repeat(begin[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct v: least vec_id, v, whether any row asks, and the k + 1 smallest vec_ids as bytes. Frequent vectors are first joined within SALTS shares."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    part = rows.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(least(F.collect_set("vec_id")).alias("ids"), F.max("q").alias("q"))
    return part.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"), F.max("q").alias("q")).select(F.col("ids")[0].alias("vec_id"), "v", "q", "ids")


def matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def reach_of(rows: DataFrame, places: dict[int, Curves], dims: int, k: int, target: float) -> dict[int, int]:
    """For each band, blocks to either side within which a sample of queries meets, on some curve, the share `target` of those of its k true neighbours that are in the band."""
    asked = rows.where("q").orderBy(F.xxhash64(F.lit("reach"), "vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    if not asked:
        return {}
    qid, q = np.array([r["vec_id"] for r in asked]), np.array([r["v"] for r in asked]).reshape(-1, dims)
    home = {b: p.blocks(q, qid, True) for b, p in places.items() if not p.exact}

    def nearest(batches):
        at, ids, score, v, band = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dims)), np.zeros(0, int)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                i, x = part.column(0).to_numpy(), matrix(part.column(1), dims)
                s = q @ x.T
                s[qid[:, None] == i[None]] = -np.inf
                qi, ci = best_of(s, min(k, len(i)))
                at, ids, v, score, band = np.r_[at, qi], np.r_[ids, i[ci]], np.r_[v, x[ci]], np.r_[score, s[qi, ci]], np.r_[band, part.column(2).to_numpy()[ci]]
                keep = ranked(at, ids, score, k)
                keep = keep[np.isfinite(score[keep])]
                at, ids, score, v, band = at[keep], ids[keep], score[keep], v[keep], band[keep]
        if len(at):
            far = np.zeros(len(at), np.int32)
            for b in home:
                of = band == b
                far[of] = np.abs(places[b].blocks(v[of], ids[of], False) - home[b][:, at[of]]).min(0) if of.any() else 0
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(ids), pa.array(score), pa.array(band.astype(np.int32)), pa.array(far)], ["at", "id", "score", "band", "far"])

    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "id"))
    found = rows.select("vec_id", "v", "band").mapInArrow(nearest, "at int, id long, score double, band int, far int").withColumn("rank", rank).where(F.col("rank") <= k)
    count = [(r["band"], r["far"], r["count"]) for r in found.groupBy("band", "far").count().orderBy("band", "far").collect()]
    reach = {}
    for b in home:
        far, many = np.array([(f, n) for x, f, n in count if x == b], int).reshape(-1, 2).T
        if len(far):
            reach[b] = max(1, int(far[np.searchsorted(np.cumsum(many), target * many.sum())]))
    return reach


def packed(query: list[bytes], ends: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """One row a query, with its ids and scores as bytes; ends are where each query's begin and, last, their number."""
    cut = lambda x: pa.Array.from_buffers(pa.binary(), len(query), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.record_batch([pa.array(query, pa.binary()), cut(ids), cut(score)], ["query", "ids", "scores"])


def search(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, block: int = BLOCK, target: float = TARGET, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k best found for each row of vectors(vec_id, embedding) where the Column is_query holds, among all others. exact: every query goes to every block of one curve, so nothing is missed, at a cost of queries times rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("q", F.coalesce("q", F.lit(False)))
    if not rows.take(1):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    everyone = rows.where(F.size("v") == common).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    top = F.array_max(F.transform("v", F.abs))
    norm = top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top"))))
    rows = collapsed(everyone, k).withColumn("top", top).withColumn("size", norm.cast("double")).drop("top")
    rows = exchange.written(rows, "vectors")
    most = rows.agg(F.max("size")).first()[0]
    # lengths in a band differ by a factor of two at most; equal ones but for rounding are in the first
    rows = rows.withColumn("band", F.floor(F.log2(F.lit(most)) - F.log2("size") + F.lit(1e-5)).cast("int"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.max("size").alias("m"), F.sum(F.col("q").cast("long")).alias("asked")).collect()
    dims, asked = common, sum(r["asked"] for r in sizes)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    places = {r["band"]: Curves(dims, curves, r["n"], r["m"], block, exact) for r in sizes}
    cut = {b: p for b, p in places.items() if p.count > 1}
    if cut:
        draw = F.pmod(F.xxhash64(F.lit("edges"), "vec_id"), F.lit(1 << 30))
        least = F.coalesce(*[F.when(F.col("band") == b, F.lit(int(min(1.0, 16 * p.count / p.n) * (1 << 30)))) for b, p in sorted(cut.items())])
        some = rows.where(draw < least).select("band", "vec_id", "v").collect()
        for b, p in cut.items():
            of = [r for r in some if r["band"] == b] or rows.where(F.col("band") == b).limit(1).collect()
            p.cut(np.array([r["v"] for r in of]).reshape(-1, dims), np.array([r["vec_id"] for r in of]), p.count)
    if not all(p.exact for p in places.values()):
        for b, r in reach_of(rows, places, dims, k, target).items():
            places[b].reach = r
    sent = sum(p.share(asked) for p in places.values())

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, v, q = part.column(0).to_numpy(), matrix(part.column(1), dims), part.column(2).to_numpy(zero_copy_only=False)
                same = pa.array([np.array(x, np.int64).tobytes() for x in part.column(3).to_pylist()], pa.binary())
                raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
                lie, own = part.column(4).to_numpy(), np.flatnonzero(q)
                for band, p in places.items():
                    mine = np.flatnonzero(lie == band)
                    if not len(mine) and not len(own):
                        continue
                    row, ask = p.blocks(v[mine], ids[mine], False), p.blocks(v[own], ids[own], True)
                    wide = np.arange(-p.reach, p.reach + 1)
                    share = (mix(ids[own].view(U64)) % U64(p.shares)).astype(np.int64)
                    for c in range(p.curves):
                        to = (ask[c][:, None] + wide).ravel()
                        use = (to >= 0) & (to < p.count)
                        here = (row[c][:, None] * p.shares + np.arange(p.shares)).ravel()
                        to = np.r_[here, (to * p.shares + np.repeat(share, len(wide)))[use]]
                        who = np.r_[np.repeat(mine, p.shares), np.repeat(own, len(wide))[use]]
                        asks = np.arange(len(to)) >= len(here)
                        for b in range(0, len(to), 8192):
                            w = pa.array(who[b : b + 8192])
                            at_block = [pa.array(np.full(len(w), x, np.int32)) for x in (band, c)] + [pa.array(to[b : b + 8192].astype(np.int32))]
                            yield pa.record_batch([*at_block, same.take(w), pa.array(asks[b : b + 8192]), raw.take(w)], ["band", "curve", "block", "ids", "ask", "v"])

    def meet(batches):
        for t in groups(batches, "band", "curve", "block"):
            ask = t["ask"].to_numpy()
            raw = t["v"].to_pylist()
            v = np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64)
            asked, cand = np.flatnonzero(ask), np.flatnonzero(~ask)
            if not len(cand):
                continue
            held = t["ids"].combine_chunks().take(pa.array(cand))
            step = max(1, (1 << 21) // len(cand))
            for a in range(0, len(asked), step):
                qs = asked[a : a + step]
                s, m = v[qs] @ v[cand].T, k + 1
                while True:  # further groups as long as ids that stand in several leave too few
                    qi, ci = best_of(s, min(m, len(cand)))
                    score = np.einsum("ij,ij->i", v[qs[qi]], v[cand[ci]])
                    ids, many = spread(held, ci)
                    at, ids, score = chosen(np.repeat(qi, many), ids, np.repeat(score, many), k + 1)
                    if m >= len(cand) or len(at) == len(qs) * (k + 1):
                        break
                    m *= 2
                yield packed([raw[i] for i in qs], np.searchsorted(at, np.arange(len(qs) + 1)), ids, score)

    def merge(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("query", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())]))
        ids, score = (np.frombuffer(b"".join(t[c].to_pylist()), x) for c, x in (("ids", np.int64), ("scores", np.float64)))
        query = t["query"].combine_chunks().dictionary_encode() if t.num_rows else pa.array([], pa.binary()).dictionary_encode()
        at = np.repeat(query.indices.to_numpy(), pc.binary_length(t["ids"]).to_numpy() // 8)
        at, ids, score = chosen(at, ids, score, k + 1)
        yield packed(query.dictionary.to_pylist(), np.searchsorted(at, np.arange(len(query.dictionary) + 1)), ids, score)

    keys = ("band", "curve", "block")
    placed = rows.select("vec_id", "v", "q", "ids", "band").mapInArrow(place, "band int, curve int, block int, ids binary, ask boolean, v binary").repartition(max(1, -(-sent // PART_ROWS)), *keys)
    shape = "query binary, ids binary, scores binary"
    found = placed.sortWithinPartitions(*keys).mapInArrow(meet, shape)
    parts = max(1, -(-sum(asked * p.curves * min(p.count, 2 * p.reach + 1) for p in places.values()) // PART_ROWS))
    best = found.repartition(parts, "query").mapInArrow(merge, shape)

    def raws(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in matrix(batch.column(1), dims).astype(kind)], pa.binary())], ["query_id", "query"])

    # every asking row gets its vector's answer, without itself
    asking = everyone.where("q").select("vec_id", "v").mapInArrow(raws, "query_id long, query binary").distinct()

    def apart(batches):
        for batch in batches:
            n = pc.binary_length(batch["ids"]).to_numpy() // 8
            ids, score = (np.frombuffer(b"".join(batch[c].to_pylist()), x) for c, x in (("ids", np.int64), ("scores", np.float64)))
            q = np.repeat(batch["query_id"].to_numpy(), n)
            other = q != ids
            yield pa.record_batch([pa.array(q[other]), pa.array(ids[other]), pa.array(score[other])], ["query_id", "vec_id", "score"])

    pairs = asking.join(best, "query").select("query_id", "ids", "scores").mapInArrow(apart, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_curve_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
