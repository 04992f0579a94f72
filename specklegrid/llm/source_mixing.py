"""Mixing sources to target weights, by temperature.

Shares of tokens by source are raised to an exponent and normalised; the exponent is bisected (in sections, each
pass one aggregate over the sources) to the largest in [0, 1] that meets a target entropy, and to the least that meets a
limit of repetition where that is larger: however small a source is, it is read no more often than the limit. Each source then gets its
part of the token budget, realised by block permutations: epoch after epoch, its documents stand in the order of a hash of
(epoch, doc_id, text) and are taken until the budget is used; the place of a copy in its source's budget gives its block,
so each block holds every source in the target weights, and a hash gives its place in the block.

Running token sums are taken in two levels (spans of hash order, then within a span), so a source that holds a
third of all rows is one task's work nowhere. Only ids, digests and lengths move. Epochs beyond EPOCHS (of a budget many times the
corpus) are dealt in ranges to other tasks before they are copied out. DataFrame functions only.

Cases: a null source is a source of its own; a null or empty text has no tokens, counts as one word for its place
and is kept like others; a very long text is one copy like others; rows of equal doc_id are each placed by their texts (rows of
equal text too, side by side); a null doc_id counts as the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import written

SECTIONS, PASSES = 32, 6
ENTROPY, REPEATS, BLOCKS, BLOCK_TOKENS, SPAN_ROWS = 0.98, 4.0, 64, 1 << 32, 2000
EPOCHS = 64
MOST_BROADCAST = 100_000


def words():
    return F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def exponent(sources: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = 1.0) -> float:
    """The exponent in [0, 1], to six decimals, of sources(t): the largest that reaches `entropy` (a share of the most possible), but no less than the least with which the smallest source is read `repeats` times at most.

    budget: times the corpus's tokens; None: as many as let every document in once at least. A budget over `repeats` reads every source alike.
    """
    n, total, least, most = sources.agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    if n < 2:
        return 1.0
    p = F.col("t") / F.lit(float(total))

    def sums(points):
        row = sources.agg(*[F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(points)], *[F.sum(F.pow(p, F.lit(a)) * F.lit(a) * F.log(p)).alias(f"s{i}") for i, a in enumerate(points)]).first()
        return [(row[f"z{i}"], row[f"s{i}"]) for i in range(len(points))]

    def even(points):  # H of q = p**a / z is log z - sum(p**a * a * log p) / z: met up to some exponent
        return [math.log(z) - s / z >= entropy * math.log(n) for z, s in sums(points)]

    def often(points):  # reads of the smallest source: met from some exponent upwards
        if budget is None:  # the largest one is read once
            return [(most / least) ** (1 - a) <= repeats for a in points]
        return [budget * (least / total) ** (a - 1) / z <= repeats for a, (z, _) in zip(points, sums(points), strict=True)]

    def bisected(met, rising):
        if met([0.0 if rising else 1.0])[0]:
            return 0.0 if rising else 1.0
        if rising and not met([1.0])[0]:
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            points = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
            found = met(points)
            k = next((i for i, m in enumerate(found) if m), SECTIONS) if rising else max((i for i, m in enumerate(found) if m), default=0)
            lo, hi = (points[max(k - 1, 0)], points[k]) if rising else (points[k], points[min(k + 1, SECTIONS)])
        return round(hi if rising else lo, 6)

    return max(bisected(even, False) if entropy is not None else 0.0, bisected(often, True) if repeats is not None else 0.0)


def text_key():
    """A digest of the text; a null text is empty."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def copied(planned: DataFrame) -> DataFrame:
    """A row for each epoch, 0 to `last`, of each row."""
    few = planned.where(F.col("last") < EPOCHS).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    many = planned.where(F.col("last") >= EPOCHS).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(EPOCHS).cast("long")))).repartition("doc_id", "key", "from")
    return few.unionByName(many.withColumn("epoch", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + EPOCHS - 1, F.col("last"))))).drop("from"))


def mix_sources(docs: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | None = 1.0, blocks: int | None = None) -> DataFrame:
    """A row for each copy that the mixture takes: doc_id, source, key (of the text), n_tokens, weight (the source's target), epoch (from 0), block, place (hash order in the block).

    budget: times the corpus's tokens; None: as many as let every document in once at least. blocks: by default BLOCKS,
    or more where a block would pass BLOCK_TOKENS.
    """
    # the words are counted once; all later steps read these three small columns
    rows = written(docs.select("doc_id", "source", text_key().alias("key"), words().alias("n_tokens")), "lengths")
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    totals = sources.agg(F.count("*").alias("k"), F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not totals["k"]:
        return rows.select("doc_id", "source", "key", "n_tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit("").alias("place"))
    a = exponent(sources, entropy, repeats, budget)
    z, least = sources.agg(F.sum(F.pow("t", F.lit(a))), F.min(F.pow("t", F.lit(a)) / F.col("t"))).first()
    tokens = budget * totals["t"] if budget is not None else z / least
    blocks = blocks or max(BLOCKS, math.ceil(tokens / BLOCK_TOKENS))
    spans = max(1, totals["n"] // SPAN_ROWS)
    weight = F.pow("t", F.lit(a)) / F.lit(z)
    plan = sources.select(F.col("source").alias("s"), "t", weight.alias("weight"), F.floor(weight * F.lit(float(tokens)) + 1e-3).cast("long").alias("b"))
    plan = plan.withColumn("last", F.greatest(F.ceil(F.col("b") / F.col("t")) - 1, F.lit(0)))
    if totals["k"] <= MOST_BROADCAST:  # a few dozen bytes a source
        plan = F.broadcast(plan)
    each = copied(rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    name = F.concat_ws("/", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key")
    each = each.withColumn("h", F.md5(name.cast("binary"))).withColumn("span", F.floor(F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * spans / F.lit(1 << 28)))
    by_span = each.groupBy("source", "epoch", "span").agg(F.sum("n_tokens").alias("st"))
    begin = F.sum("st").over(Window.partitionBy("source", "epoch").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("st")
    by_span = by_span.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("span").alias("sp"), begin.alias("begin"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "epoch", "span").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = each.withColumn("within", within).join(by_span, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("span") == F.col("sp")))
    start = F.col("epoch") * F.col("t") + F.col("begin") + F.col("within")
    taken = placed.withColumn("start", start).where(F.col("start") < F.col("b"))
    return taken.select("doc_id", "source", "key", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", F.floor(F.col("start") * blocks / F.col("b")).alias("block"), F.col("h").alias("place"))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS key, greatest(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 1)::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY source),
one AS (SELECT sum(t) AS total, count(*) AS k FROM s),
p AS (SELECT t / total AS p, k FROM s, one),
whole AS (SELECT -sum(p * ln(p)) >= 0.98 * ln(max(k)) AS met FROM p),
halves(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) >= 0.98 * ln(max(k)) FROM p) AS ok
    FROM halves WHERE i < 40)),
cuts(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT pow(min(p), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) <= 4 FROM p) AS ok FROM cuts WHERE i < 40)),
a AS (SELECT CASE WHEN k < 2 THEN 1.0 ELSE greatest(CASE WHEN met THEN 1.0 ELSE round(h.lo, 6) END, CASE WHEN free THEN 0.0 ELSE round(c.hi, 6) END) END AS a
  FROM halves h, cuts c, whole, (SELECT 1 / (min(p) * count(*)) <= 4 AS free, count(*) AS k FROM p) WHERE h.i = 40 AND c.i = 40),
z AS (SELECT sum(pow(t, a)) AS z FROM s, a),
plan AS (SELECT source, t::BIGINT AS t, pow(t, a) / z AS w, floor(pow(t, a) / z * total + 1e-3)::BIGINT AS b FROM s, a, z, one),
c AS (SELECT d.*, p.t, p.w, p.b, e.epoch, md5(e.epoch::VARCHAR || '/' || coalesce(doc_id::VARCHAR, '') || '/' || key) AS h
  FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, greatest(ceil(p.b::DOUBLE / p.t)::BIGINT, 1))) AS epoch) e),
g AS (SELECT *, epoch * t + sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM c)
SELECT doc_id, source, n_tokens, round(w, 6) AS weight, epoch, floor(start * 64.0 / b)::BIGINT AS block, h AS place FROM g WHERE start < b
"""
