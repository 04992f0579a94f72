"""Exact order statistics without a sort: radix selection on the ordered bits of doubles.

The bits of a double, with the lower 63 flipped for negative ones, are in the order of the numbers. Each of four passes counts, among
the values that share the bits found so far, those of each next 16 bits, keeps by group the one that holds the wanted
place, and subtracts what lies below. Counts are made in the tasks that read the values, so what is shuffled is
65,536 counts a group and task at most, however many values a group has; no pass sorts or moves a value.

Cases: null values don't count; NaN is the largest; -0.0 equals 0.0; ties need nothing; a place below the first or beyond the last
is the first or the last; a group without values has no row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT, PASSES = 16, 4


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of doubles."""
    v = np.where(np.isnan(v), np.nan, v + 0.0)  # one NaN, one zero
    bits = np.ascontiguousarray(v, np.float64).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, ~bits, bits | sign)


def doubles(bits: np.ndarray) -> np.ndarray:
    """The doubles of ordered bits."""
    bits, sign = np.ascontiguousarray(bits, np.uint64), np.uint64(1 << 63)
    return np.where(bits & sign, bits & ~sign, ~bits).view(np.float64)


def _counts(rows: DataFrame, done: int) -> DataFrame:
    """by, prefix, left, digit, n: how many values of each next digit there are among those that begin with prefix; digits of `done` passes are known."""
    shift = np.uint64(64 - DIGIT * (done + 1))
    kind = rows.schema["by"].dataType.simpleString()
    listed = rows.schema["v"].dataType.typeName() == "array"

    def run(batches):
        for batch in batches:
            key, v = batch.column(0), batch.column(1)
            if listed:
                owner = np.repeat(np.arange(len(v)), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                v = v.flatten()
            else:
                owner = np.arange(len(v))
            there = np.asarray(v.is_valid())
            owner, bits = owner[there], ordered_bits(v.drop_null().to_numpy(zero_copy_only=False))
            if done:
                prefix = batch.column(2).to_numpy(zero_copy_only=False)
                same = (bits >> (shift + np.uint64(DIGIT))).astype(np.int64) == prefix[owner]
                owner, bits = owner[same], bits[same]
            # rows of one key are counted together
            codes = key.dictionary_encode()
            code = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            digit = ((bits >> shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
            found, n = np.unique(code[owner].astype(np.int64) << DIGIT | digit, return_counts=True)
            first = np.full(len(codes.dictionary) + 1, -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            at = pa.array(first[found >> DIGIT])
            yield pa.record_batch([key.take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array((found & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["by", "prefix", "left", "digit", "n"])

    counted = rows.mapInArrow(run, f"by {kind}, prefix long, left long, digit int, n long")
    return counted.groupBy("by", "prefix", "left", "digit").agg(F.sum("n").alias("n"))


def selected(rows: DataFrame, by: str, values: str, place: Callable[[Column], Column], from_top: bool = False) -> DataFrame:
    """by, level: of the values (a column of doubles, or of arrays of them) of each group the one at place(n), from 0 on; counted from the least, or from the largest."""
    v = F.transform(values, lambda x: x.cast("double")) if rows.schema[values].dataType.typeName() == "array" else F.col(values).cast("double")
    source, narrowed = rows.select(F.col(by).alias("by"), v.alias("v")), None
    for done in range(PASSES):
        if narrowed is None:
            asked = source.withColumns({"prefix": F.lit(0).cast("long"), "left": F.lit(None).cast("long")})
        else:  # one row a group: sent to all where it is small, as measured when it is there
            asked = source.join(narrowed.withColumnRenamed("by", "of"), F.col("by").eqNullSafe(F.col("of")))
        counts = _counts(asked.select("by", "v", "prefix", "left"), done)
        packed = counts.groupBy("by", "prefix", "left").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("h"))
        if narrowed is None:
            n = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["n"])
            at = F.least(F.greatest(place(n).cast("long"), F.lit(0).cast("long")), n - 1)
            packed = packed.withColumn("left", n - 1 - at if from_top else at)
        start = F.struct(F.col("left").alias("left"), F.lit(-1).alias("digit"))
        passed = lambda a, x: F.when(a["digit"] >= 0, a).when(a["left"] < x["n"], F.struct(a["left"].alias("left"), x["digit"].alias("digit"))).otherwise(F.struct((a["left"] - x["n"]).alias("left"), F.lit(-1).alias("digit")))
        hit = packed.withColumn("hit", F.aggregate("h", start, passed))
        narrowed = hit.select("by", (F.shiftleft("prefix", DIGIT) + F.col("hit.digit")).alias("prefix"), F.col("hit.left").alias("left"))

    @F.arrow_udf("double")
    def back(bits: pa.Array) -> pa.Array:
        return pa.array(doubles(bits.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return narrowed.select(F.col("by").alias(by), back("prefix").alias("level"))
