"""Neighbourhood, resampling and index-rewriting operators over pixel tables.

Coordinate rewrites are projections; neighbourhoods explode a fixed number of offsets and group by pixel, so their cost
is a constant times the pixels. Images join on (image_id, pixel) only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ["image_id", "x", "y"]


def index(nx: int) -> Column:
    return (F.col("y") * nx + F.col("x")).cast("int")


def fftshift(px: DataFrame, nx: int, ny: int) -> DataFrame:
    out = px.withColumns({"x": (F.col("x") + nx // 2) % nx, "y": (F.col("y") + ny // 2) % ny})
    return out.withColumn("i", index(nx))


def rotate_quarters(px: DataFrame, nx: int, ny: int, quarters: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 1: (F.lit(ny - 1) - y, x), 2: (F.lit(nx - 1) - x, F.lit(ny - 1) - y), 3: (y, F.lit(nx - 1) - x)}[quarters % 4]
    return px.withColumns({"x": to[0], "y": to[1]}).withColumn("i", index(nx if quarters % 2 == 0 else ny))


def reflect(px: DataFrame, nx: int, ny: int) -> DataFrame:
    return rotate_quarters(px, nx, ny, 2)


def translate(px: DataFrame, nx: int, ny: int, dx: int, dy: int) -> DataFrame:
    """A cyclic shift."""
    return px.withColumns({"x": F.pmod(F.col("x") + dx, F.lit(nx)), "y": F.pmod(F.col("y") + dy, F.lit(ny))}).withColumn("i", index(nx))


def translate_in_fourier(px: DataFrame, nx: int, ny: int, tx: float, ty: float) -> DataFrame:
    """Times exp(-2 pi i f.t / n), with signed frequencies of an unshifted transform."""
    f = lambda c, n: F.when(F.col(c) < (n + 1) // 2, F.col(c)).otherwise(F.col(c) - n)
    a = -2 * math.pi * (f("x", nx) * tx / nx + f("y", ny) * ty / ny)
    return px.withColumns({"re": F.col("re") * F.cos(a) - F.col("im") * F.sin(a), "im": F.col("re") * F.sin(a) + F.col("im") * F.cos(a)})


def neighbours(px: DataFrame, nx: int, ny: int, reach: int, periodic: bool = True) -> DataFrame:
    """Each value at each pixel of its (2 reach + 1) square: columns image_id, x, y, dx, dy, v."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    e = px.select("image_id", "x", "y", F.col("re").alias("v"), F.explode(steps).alias("d"))
    x, y = F.col("x") + F.col("d.dx"), F.col("y") + F.col("d.dy")
    if periodic:
        x, y = F.pmod(x, F.lit(nx)), F.pmod(y, F.lit(ny))
    out = e.select("image_id", x.alias("x"), y.alias("y"), "d.dx", "d.dy", "v")
    return out if periodic else out.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))


def box_blur(px: DataFrame, nx: int, ny: int, reach: int) -> DataFrame:
    """Mean of the square around each pixel, periodic."""
    return neighbours(px, nx, ny, reach).groupBy(*AT).agg(F.avg("v").alias("re"))


def gaussian_blur_direct(px: DataFrame, nx: int, ny: int, sigma: float, reach: int) -> DataFrame:
    """Direct sum of a Gaussian cut at `reach`, periodic; the Fourier form is fourier.gaussian_blur."""
    w = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * sigma * sigma))
    return neighbours(px, nx, ny, reach).groupBy(*AT).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("re"))


def zero_near_negative(px: DataFrame, nx: int, ny: int) -> DataFrame:
    """Poor man's median: a pixel becomes 0 if any of its 3 x 3 neighbours (periodic) is below 0."""
    least = neighbours(px, nx, ny, 1).groupBy(*AT).agg(F.min("v").alias("least"))
    return px.join(least, AT).withColumn("re", F.when(F.col("least") < 0, 0.0).otherwise(F.col("re"))).drop("least")


def point_blur(px: DataFrame, x: int, y: int, sigma: float, reach: int) -> DataFrame:
    """The Gaussian mean at one pixel, clipped at the edges: a row for each image."""
    dx, dy = F.col("x") - x, F.col("y") - y
    w = F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
    return px.where((F.abs(dx) <= reach) & (F.abs(dy) <= reach)).groupBy("image_id").agg((F.sum(w * F.col("re")) / F.sum(w)).alias("re"))


def bilinear(px: DataFrame, points: DataFrame) -> DataFrame:
    """Values at points(image_id, p, fx, fy): four equi-joins in one, weights by nearness; outside the image mask is 0 and the value 0."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    c = points.withColumns({"bx": F.floor("fx"), "by": F.floor("fy"), "c": corner})
    u, v = F.col("fx") - F.col("bx"), F.col("fy") - F.col("by")
    c = c.select("image_id", "p", "fx", "fy", (F.col("bx") + F.col("c.a")).cast("int").alias("x"), (F.col("by") + F.col("c.b")).cast("int").alias("y"), (F.when(F.col("c.a") == 1, u).otherwise(1 - u) * F.when(F.col("c.b") == 1, v).otherwise(1 - v)).alias("w"))
    got = c.join(px.select(*AT, "re"), AT, "left")
    missing = F.max(F.when(F.col("re").isNull() & (F.col("w") > 1e-12), 1).otherwise(0))
    return got.groupBy("image_id", "p").agg(F.when(missing == 1, 0.0).otherwise(F.sum(F.coalesce(F.col("re"), F.lit(0.0)) * F.col("w"))).alias("re"), (1 - missing).alias("mask"))


def grid_points(px: DataFrame, nx: int, ny: int, new_nx: int, new_ny: int) -> DataFrame:
    """Where the pixels of a rescaled grid stand in the old one."""
    ids = px.select("image_id").distinct()
    p = F.explode(F.sequence(F.lit(0), F.lit(new_nx * new_ny - 1)))
    step = lambda n, m: (n - 1) / (m - 1) if m > 1 else 0.0
    return ids.withColumn("p", p).select("image_id", "p", ((F.col("p") % new_nx) * step(nx, new_nx)).alias("fx"), (F.floor(F.col("p") / new_nx) * step(ny, new_ny)).alias("fy"))


def line_out(px: DataFrame, x0: float, y0: float, x1: float, y1: float, samples: int = 100) -> DataFrame:
    ids = px.select("image_id").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    t = F.col("p") / (samples - 1)
    return bilinear(px, ids.select("image_id", "p", (x0 + t * (x1 - x0)).alias("fx"), (y0 + t * (y1 - y0)).alias("fy")))


def rotate(px: DataFrame, nx: int, ny: int, angle: float) -> DataFrame:
    """Rotation about the centre by inverse lookup."""
    cx, cy, c, s = (nx - 1) / 2, (ny - 1) / 2, math.cos(angle), math.sin(angle)
    ids = px.select("image_id").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))))
    x, y = F.col("p") % nx - cx, F.floor(F.col("p") / nx) - cy
    return bilinear(px, ids.select("image_id", "p", (c * x + s * y + cx).alias("fx"), (-s * x + c * y + cy).alias("fy")))


def centrosymmetric(px: DataFrame, nx: int, ny: int) -> DataFrame:
    """Both members of a pair mirrored at the centre get the mean of the measured ones; without any: 0, not measured."""
    other = px.select("image_id", (F.lit(nx - 1) - F.col("x")).alias("x"), (F.lit(ny - 1) - F.col("y")).alias("y"), F.col("re").alias("re2"), F.col("mask").alias("mask2"))
    x = px.join(other, AT, "left")
    ok1, ok2 = (F.col("mask") != 0).cast("int"), (F.coalesce("mask2", F.lit(0)) != 0).cast("int")
    mean = (F.when(ok1 == 1, F.col("re")).otherwise(0.0) + F.when(ok2 == 1, F.col("re2")).otherwise(0.0)) / F.nullif(ok1 + ok2, F.lit(0))
    return x.withColumns({"re": F.coalesce(mean, F.lit(0.0)), "mask": F.greatest(ok1, ok2)}).drop("re2", "mask2")


def mesh_background(px: DataFrame, cell: int) -> DataFrame:
    """Adaptive-mesh background: the median of each cell is subtracted from its pixels."""
    w = Window.partitionBy("image_id", F.floor(F.col("x") / cell), F.floor(F.col("y") / cell))
    return px.withColumn("re", F.col("re") - F.percentile("re", F.lit(0.5)).over(w))


# ---- affine transforms and stitching


def affine(x: Column, y: Column, dx: Column, dy: Column, zoom: Column, alpha: Column, theta: Column) -> tuple[Column, Column]:
    """Rotation by theta in the plane and by alpha about the vertical axis, scale 1 / zoom, then a shift."""
    u, v = x * F.cos(theta) - y * F.sin(theta), x * F.sin(theta) + y * F.cos(theta)
    u, w = u * F.cos(alpha), 1 + u * F.sin(alpha) / 1024
    return u / w / zoom + dx, v / w / zoom + dy


def line_distance(x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    """The nearest point of the line through the origin at angle theta."""
    t = x * F.cos(theta) + y * F.sin(theta)
    return t * F.cos(theta), t * F.sin(theta)
