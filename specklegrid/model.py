"""The data model: packed images, one row each, and pixel tables, one row a pixel.

A packed image is image_id, nx, ny, nz, re, im (array<double>, x fastest) and mask (array<int>, 0: not measured), with
flags phased, scaled and shifted where they matter. A pixel table is image_id, i, x, y, z, re, im, mask.
Unpacking is a generator and needs no shuffle; packing groups by image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "image_id long, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>"
SIDE = 8


def images(spark, sf_dir: str) -> DataFrame:
    """The 64-long vectors of `embeddings` as packed real 8 x 8 images; label stays as the group of the exposure."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.size("embedding") == SIDE * SIDE)
    re = F.transform("embedding", lambda v: rounded(v.cast("double") * 1000, 3))
    return e.select(
        F.col("vec_id").alias("image_id"), "label", F.lit(SIDE).alias("nx"), F.lit(SIDE).alias("ny"), F.lit(1).alias("nz"), re.alias("re"),
        F.transform("embedding", lambda v: F.lit(0.0)).alias("im"), F.transform("embedding", lambda v: F.lit(1)).alias("mask"),
    )


def unpack(packed: DataFrame, *keep: str) -> DataFrame:
    """Pixel table of packed images, with the columns of `keep`."""
    cells = packed.select("image_id", *keep, "nx", "ny", F.posexplode(F.arrays_zip("re", "im", "mask")).alias("i", "c"))
    return cells.select("image_id", *keep, "i", *coordinates(F.col("i"), F.col("nx"), F.col("ny")), "c.re", "c.im", "c.mask")


def coordinates(i: Column, nx: Column, ny: Column) -> list[Column]:
    return [(i % nx).alias("x"), (F.floor(i / nx) % ny).cast("int").alias("y"), F.floor(i / (nx * ny)).cast("int").alias("z")]


def pack(pixels: DataFrame, nx: int, ny: int, nz: int = 1) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("i", "re", "im", "mask"))).alias("c")
    return pixels.groupBy("image_id").agg(cells).select(
        "image_id", F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(nz).alias("nz"), F.col("c.re").alias("re"), F.col("c.im").alias("im"), F.col("c.mask").alias("mask")
    )


def pixels(spark, sf_dir: str) -> DataFrame:
    """Pixel table of images(), with label; what the queries run over."""
    return unpack(images(spark, sf_dir), "label")


#: The same pixel table in DuckDB.
PX = """px AS (SELECT vec_id AS image_id, label, i::INT AS i, (i % 8)::INT AS x, (i // 8)::INT AS y, 0 AS z,
  round(embedding[i + 1]::DOUBLE * 1000, 3) AS re, 0.0::DOUBLE AS im, 1 AS mask
  FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) = 64)"""


def modulus() -> Column:
    return F.hypot("re", "im")


def rounded(v: Column, digits: int) -> Column:
    """v rounded half up; what becomes zero keeps its sign, as it does in SQL (Spark's round drops it)."""
    r = F.round(v, digits)
    return F.when(r == 0, v * F.lit(0.0)).otherwise(r)


def angle(im: Column, re: Column) -> Column:
    """The phase from -pi to pi. A negative zero as real part has phase pi, as atan2 has it everywhere but in Spark; the sign of a zero imaginary part doesn't matter."""
    negative_zero = (re == 0) & (im == 0) & (re.cast("string") == "-0.0")
    return F.when(negative_zero, F.lit(math.pi)).otherwise(F.atan2(im, re))


def center_distance(nx: int, ny: int) -> Column:
    """Distance of a pixel to the image's centre ((nx - 1) / 2, (ny - 1) / 2)."""
    return F.hypot(F.col("x") - (nx - 1) / 2, F.col("y") - (ny - 1) / 2)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written by checkpoint to the shared folder: lineage ends there."""
    from .sources.frames import scratch

    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def ordered_scan(df: DataFrame, by: str, order: str, columns: list[str], first, step, schema: str) -> DataFrame:
    """Rows of step(state, key, order value, *values) -> (state, rows) along each group in its order; a group starts with first().

    Groups are sorted within partitions and read batch by batch, so a group of any length holds one batch and its state.
    A row holds `by`, `order` and what step gives.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.field(c.split()[0], {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")]

    def run(batches):
        key, state = object(), None
        for batch in batches:
            out = []
            for k, at, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, state = k, first()
                state, rows = step(state, *values)
                out += [(k, at, *r) for r in rows]
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], names)

    return df.select(by, order, *columns).repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)
