"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, and sentences within them) are hashed to distinct 64-bit digests, and each digest enters
one cell in each of three subtables: its count, the XOR of digests and the XOR of their checks. The cells of the least
size are the fingerprint. Two versions' cells subtract; peeling then takes out digests that stand alone in a cell,
again and again, and what it takes out is how the versions differ. Where cells are left over (differences of over some
150 digests), each version gets a sketch sixty-four times as large, and these subtract and are peeled; beyond the largest size the digests
are compared themselves. Likeness is the shared part of all digests of both, a third of the counts of their cells: where the
first try succeeds, two fingerprints alone give it. All of it is DataFrame functions on one row: no digest ever leaves its document's row.

The next document is found from ids alone: pairs of doc_id and a hash of the text are range-partitioned and written, a
window finds the next within a partition, and only the least pair of each partition travels to the one before it. Texts
then meet by these keys, so neither clustered nor repeated doc_ids, nor many rows without one, gather texts in a task.

Cases: a null text is empty and has no paragraphs (two such texts are alike: 1); repeated paragraphs count once; rows of
equal doc_id follow each other in the order of a hash of their texts (equal rows in a row); a null doc_id comes first;
a single document is its own next; a very long text is one row like others; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import made, swept, written

SIZES = (64, 4096, 262144)  # cells of a subtable; they are kept sparse: a wide table costs no more than a narrow one and peels in fewer rounds
ROUNDS, PART_ROWS = 24, 1 << 18
NO_ID = -(2**63)  # stands for a null doc_id, and so does a doc_id of this number
_CELLS = "array<struct<cell: bigint, n: int, x: bigint, c: bigint>>"
_EMPTY = f"cast(array() as {_CELLS})"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])[ \t]+"), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _spread(items: str, size: str) -> str:
    """Cells of an array of (x, n): three for each."""
    cell = lambda j: f"named_struct('cell', {j}L * {size} + (shiftrightunsigned(i.x, {20 * j}) & ({size} - 1L)), 'n', i.n, 'x', i.x, 'c', c)"
    return f"flatten(transform({items}, i -> transform(array(xxhash64(i.x, 77)), c -> array({cell(0)}, {cell(1)}, {cell(2)}))[0]))"


def _folded(cells: str) -> str:
    """One entry for each cell that isn't empty, by cell; the runs of equal cells are cut by their starts, so the work is linear after the sort."""
    run = "slice(s, b, coalesce(get(starts, k + 1), size(s) + 1) - b)"
    added = f"aggregate({run}, named_struct('cell', s[b - 1].cell, 'n', 0, 'x', 0L, 'c', 0L), (a, e) -> named_struct('cell', a.cell, 'n', a.n + e.n, 'x', a.x ^ e.x, 'c', a.c ^ e.c))"
    one = f"if(coalesce(get(starts, k + 1), size(s) + 1) = b + 1, s[b - 1], {added})"
    starts = "filter(sequence(1, size(s)), i -> i = 1 or s[i - 1].cell <> s[i - 2].cell)"
    folded = f"filter(transform(starts, (b, k) -> {one}), e -> e.n <> 0 or e.x <> 0L or e.c <> 0L)"
    return f"transform(array(sort_array({cells})), s -> if(size(s) = 0, {_EMPTY}, transform(array({starts}), starts -> {folded})[0]))[0]"


def table(ds: str, size: int | str, sign: int = 1) -> str:
    """SQL of the cells of an array of digests."""
    return _folded(_spread(f"transform({ds}, d -> named_struct('x', d, 'n', {sign}))", f"{size}L" if isinstance(size, int) else size))


def _peeled(cells: str, size: str) -> str:
    """(cells left, found (x, n)) after peeling."""
    found = "cast(array() as array<struct<x: bigint, n: int>>)"
    # distinct numbers are found by hashing, distinct structs would be compared pair by pair
    side = lambda n: f"transform(array_distinct(transform(filter(s.cells, e -> e.n = {n} and e.c = xxhash64(e.x, 77)), e -> e.x)), x -> named_struct('x', x, 'n', {n}))"
    pure = f"concat({side(1)}, {side(-1)})"
    out = _spread("transform(p, q -> named_struct('x', q.x, 'n', -q.n))", size)
    step = f"transform(array({pure}), p -> if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'go', false), named_struct('cells', {_folded(f'concat(s.cells, {out})')}, 'found', concat(s.found, p), 'go', true)))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', {found}, 'go', true), (s, r) -> if(size(s.cells) = 0 or not s.go, s, {step}))"


def differences(a: str, b: str, cells_a: str, cells_b: str) -> Column:
    """found: digests (x) with n of 1 where only array column a has them, -1 where only b has; solved: by peeling, at size. cells_a and cells_b are their sketches of the least size; larger ones are made of each where that one fails."""
    less = lambda x, y: f"concat({x}, transform({y}, e -> named_struct('cell', e.cell, 'n', -e.n, 'x', e.x, 'c', e.c)))"
    solved = lambda cells, z: f"transform(array({_peeled(_folded(cells), z)}), s -> named_struct('solved', size(s.cells) = 0, 'size', {z}, 'found', s.found))[0]"
    first = solved(less(cells_a, cells_b), f"{SIZES[0]}L")
    sizes = ", ".join(f"{s}L" for s in SIZES[1:])
    by_peeling = f"aggregate(array({sizes}), {first}, (t, z) -> if(t.solved, t, {solved(less(table(a, 'z'), table(b, 'z')), 'z')}))"
    plain = f"named_struct('solved', false, 'size', 0L, 'found', concat(transform(array_except({a}, {b}), d -> named_struct('x', d, 'n', 1)), transform(array_except({b}, {a}), d -> named_struct('x', d, 'n', -1))))"
    return F.expr(f"transform(array({by_peeling}), t -> if(t.solved, t, {plain}))[0]")


def fingerprint(cells: str) -> Column:
    """The cells of the least size as text: cell, count, digest and check in hexadecimal."""
    return F.expr(f"concat_ws('.', transform({cells}, e -> concat(hex(e.cell), '-', hex(e.n), '-', hex(e.x), '-', hex(e.c))))")


def likeness(a: str, b: str, found: Column) -> Column:
    """Share of all digests that both have; found is used once, so it is peeled once."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(F.transform(F.array(F.size(found)), lambda k: (both - k) / (both + k))[0])


def next_keys(docs: DataFrame) -> DataFrame:
    """i, h, n (rows of this key), next_i, next_h for each distinct key of docs(doc_id, text): doc_id with a null as least number, and a hash of the text."""
    keys = docs.select(_number(), F.xxhash64("text").alias("h")).groupBy("i", "h").agg(F.count("*").alias("n"))
    keys = written(keys, "keys")
    parts = max(1, -(-keys.count() // PART_ROWS))
    # the partitions of one run are kept with the rows: another run might cut them otherwise
    x = written(keys.repartitionByRange(parts, "i", "h").withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("part").orderBy("i", "h")
    x = x.withColumn("following", F.lead(F.struct("i", "h")).over(within))
    heads = x.groupBy("part").agg(F.min(F.struct("i", "h")).alias("head"))
    order = Window.orderBy("part")  # a row for each partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    x = x.join(heads, "part").withColumn("following", F.coalesce("following", "after"))
    return x.select("i", "h", "n", F.col("following.i").alias("next_i"), F.col("following.h").alias("next_h"))


def _number() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("i")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, times (equal rows): that of the next row by doc_id; after the last, the first's."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    others = made()
    after = written(next_keys(docs), "next")
    swept(*others, after)
    # both sides of the join read one exchange of these three columns, which both need whole
    texts = docs.select(_number(), F.xxhash64("text").alias("h"), "text").repartition("i", "h")
    own = F.nullif("i", F.lit(NO_ID)).alias("doc_id")
    repeated = bool(after.where("n > 1").take(1))
    if repeated:  # equal rows are one row from here on
        texts = texts.groupBy("i", "h").agg(F.first("text").alias("text"))
    before = after.select(F.col("next_i").alias("i"), F.col("next_h").alias("h"), F.col("i").alias("of_i"), F.col("h").alias("of_h"))
    sent = texts.join(before, ["i", "h"]).select(F.col("of_i").alias("i"), F.col("of_h").alias("h"), F.col("text").alias("next_text"))
    out = texts.join(sent, ["i", "h"]).select(own, "text", "next_text", F.lit(1).cast("long").alias("times"))
    if not repeated:
        return out
    # of n equal rows, n - 1 are followed by their own text
    more = texts.join(after.where("n > 1").select("i", "h", (F.col("n") - 1).alias("times")), ["i", "h"])
    return out.unionByName(more.select(own, "text", F.col("text").alias("next_text"), "times"))


def edit(n: Column) -> Column:
    """The text whose last half is replaced by the beginning of the next."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    n = F.length("text")
    x = with_next(docs).withColumn("edited", edit(n))
    x = x.select("doc_id", "times", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next_text")).alias("c"))
    x = x.withColumns({f"c{k}": F.expr(table(k, SIZES[0])) for k in "abc"})
    near = lambda k: likeness("a", k, differences("a", k, "ca", f"c{k}")["found"])
    x = x.select("doc_id", "times", "n_chars", "edited_sha256", fingerprint("ca").alias("fingerprint"), fingerprint("cb").alias("edited_fingerprint"), near("b").alias("near_edited"), near("c").alias("near_next"))
    return x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
