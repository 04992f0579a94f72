"""What filters take from a corpus in every order, by adjacent transpositions.

Every document gets a mask of the filters that it fails, and the corpus becomes mask cells: counts by part (language)
and mask, of all, of good and of toxic documents. All orders of the filters are then visited so that each differs from
the one before by one swap of neighbours (plain changes); only the two steps that the swap touches are read again from the cells, the
others are carried over, and each filter's Shapley sum grows along the walk. Work on texts doesn't depend on the number of orders.

Texts are read once, where they lie: masks of the filters that look at one text, and a 128-bit digest of it. Whether a
smaller doc_id has the same text follows from counts by digest, combined before they are shuffled, so a text that a third of all
rows share is one row a task. For the join with the labels each doc_id's rows are spread over SALTS tasks by their digest, and rows
without doc_id, which have none, over all.

Cases: a null text is empty, and both are equal texts; a null language is the part of the empty string; a row
without doc_id has no label, is a copy of nothing and makes no other row one; rows of equal doc_id and text are no copies of
each other; of several labels of one doc_id any good or toxic one counts; very long texts are read whole; an empty
table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Words, pieces, utf8

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 3, "#$%&*|"
COPY, SALTS = 1 << FILTERS.index("E"), 8
_CAPITAL, _SIGN, _FOLLOWS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN[[ord(c) for c in SIGNS]] = True
_FOLLOWS[0x80:0xC0] = True  # bytes of a character after its first


def failed(text: pa.Array) -> np.ndarray:
    """The mask (bit 0 is A) of the filters A to D that each text fails."""
    data, offsets = utf8(text)
    among = lambda kind: np.diff(np.r_[0, np.cumsum(kind[data])][offsets])
    words = Words(data, offsets)
    n, (codes, size) = words.counts, words.coded
    pairs = np.unique(np.repeat(np.arange(len(n)), n) * max(size, 1) + codes)
    distinct = np.bincount(pairs // max(size, 1), minlength=len(n))
    chars = np.diff(offsets) - among(_FOLLOWS)
    tests = n < FEWEST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * among(_CAPITAL) > CAPITALS_PERCENT * chars, among(_SIGN) > 0
    return sum(t.astype(np.int32) << i for i, t in enumerate(tests))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail, and how many of them have a label of quality, of toxicity."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text = part.column(2)
                keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass") if t else b"", digest_size=16).digest() for t in text.to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(failed(text), pa.int32())], ["doc_id", "part", "key", "mask"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {id_type}, part string, key binary, mask int")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = found.withColumn("spread", F.pmod(F.hash("key"), F.when(F.col("doc_id").isNull(), F.lit(1 << 20)).otherwise(F.lit(SALTS))))
    # merged whatever the labels' size is thought to be: a file of 7 MB holds a million of them, SALTS rows each, which no driver should broadcast
    salted = known.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    joined = found.join(salted, ["doc_id", "spread"], "left")
    kind = ["key", "part", "mask", "good", "toxic"]
    joined = joined.select("doc_id", "spread", "key", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    by_doc = joined.groupBy("doc_id", "spread", *kind).agg(F.count("*").alias("n"))
    by_key = by_doc.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"),
    )
    by_key = by_key.withColumn("first", F.min("least").over(Window.partitionBy("key")))
    originals = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    two = F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - originals).alias("n")))
    split = by_key.select("part", "good", "toxic", F.explode(two).alias("c")).where("c.n > 0")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic")
    )


def plain_changes(n: int) -> list[list[int]]:
    """All orders of n things, each one swap of neighbours after the one before."""
    orders = [[0]] if n else [[]]
    for last in range(1, n):
        orders = [o[:at] + [last] + o[at:] for i, o in enumerate(orders) for at in (range(last, -1, -1) if i % 2 == 0 else range(last + 1))]
    return orders


def walked(counts: np.ndarray, n: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Of counts[part, what, mask], for all orders of n filters: the orders, counts[order, step, part, what] of what each step removes, and sums[filter, part] of its removed documents over all orders."""
    masks = np.arange(1 << n)
    orders = plain_changes(n)
    taken = np.zeros((len(orders), n, *counts.shape[:2]), np.int64)
    sums = np.zeros((n, counts.shape[0]), np.int64)

    def step(order, k):
        before = sum(1 << f for f in order[:k])
        return counts[:, :, (masks & before == 0) & (masks >> order[k] & 1 == 1)].sum(2)

    for k in range(n):
        taken[0, k] = step(orders[0], k)
    for i, order in enumerate(orders):
        if i:
            swapped = next(k for k in range(n) if order[k] != orders[i - 1][k])
            taken[i] = taken[i - 1]
            taken[i, swapped], taken[i, swapped + 1] = step(order, swapped), step(order, swapped + 1)
        for k in range(n):
            sums[order[k]] += taken[i, k, :, 0]
    assert all(sum(a != b for a, b in zip(x, y, strict=True)) == 2 for x, y in pairwise(orders))
    return orders, taken, sums


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(mask_cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step (from 1) in it: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (the filter's removed, over all orders), from cells(part, mask, n, good, toxic)."""
    n = len(filters)
    packed = mask_cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** n cells a part at most

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                parts, counts = rows.column(0).to_pylist(), np.zeros((rows.num_rows, 3, 1 << n), np.int64)
                for p, group in enumerate(rows.column(1).to_pylist()):
                    for c in group:
                        counts[p, :, c["mask"]] += (c["n"], c["good"], c["toxic"])
                orders, taken, sums = walked(counts, n)
                total = counts[:, 0].sum(1)
                fails = np.stack([counts[:, 0, np.arange(1 << n) >> f & 1 == 1].sum(1) for f in range(n)])
                only = np.stack([counts[:, 0, 1 << f] for f in range(n)])
                order = np.array(orders)  # [order, step]
                removed = taken[..., 0]
                kept = total - np.cumsum(removed, 1)
                columns = kept, removed, fails[order] - removed, only[order], taken[..., 1], taken[..., 2], sums[order]
                flat = [np.ascontiguousarray(c.transpose(2, 0, 1)).ravel() for c in columns]
                names = np.repeat(["".join(filters[f] for f in o) for o in orders], n)
                cols = [pa.array(np.repeat(np.array(parts, object), len(names)), pa.string()), pa.array(np.tile(names, len(parts)).tolist(), pa.string()), pa.array(np.tile(np.arange(1, n + 1), len(orders) * len(parts)), pa.int32())]
                yield pa.record_batch([*cols, *[pa.array(c, pa.int64()) for c in flat]], [c.split()[0] for c in AUDIT.split(", ")])

    return packed.mapInArrow(run, AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(cells(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS f FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cell AS (SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS filter, o[1:i - 1] AS before FROM o, x),
r AS (SELECT p.part, s.o, s.step, s.filter,
  coalesce(sum(n) FILTER (WHERE NOT f[s.filter] AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE f[s.filter] AND NOT hit), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE f[s.filter] AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE f[s.filter] AND len(list_filter(f, lambda v: v)) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE f[s.filter] AND NOT hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE f[s.filter] AND NOT hit), 0)::BIGINT AS toxic_lost
  FROM (SELECT DISTINCT part FROM cell) p CROSS JOIN s JOIN (SELECT s2.o AS o2, s2.step AS step2, c.*, len(list_filter(s2.before, lambda v: c.f[v])) > 0 AS hit FROM cell c, s s2) c
    ON c.part = p.part AND c.o2 = s.o AND c.step2 = s.step GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda v: substr('ABCDE', v, 1)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
