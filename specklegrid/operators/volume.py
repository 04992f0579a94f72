"""Volumes, projective transforms and simulated exposures, as batches over packed images."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PACKED
from .fourier import complex_of, fftn, ifftn, packed_batch, per_image, shaped


def euler(a: float, b: float = 0.0, c: float = 0.0) -> np.ndarray:
    """Rotation by a about z, then b about x, then c about z; for vectors (x, y, z)."""
    turn = lambda t: np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1.0]])
    tilt = np.array([[1.0, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    return turn(c) @ tilt @ turn(a)


def trilinear(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of (nz, ny, nx) at points (n, 3) of x, y, z; 0 where a point lies outside."""
    size = np.array(v.shape[::-1])
    ok = ((at > -1e-9) & (at <= size - 1 + 1e-9)).all(1)
    at = np.clip(at, 0, size - 1)
    lo = np.minimum(np.floor(at).astype(int), np.maximum(size - 2, 0))
    out = np.zeros(len(at), v.dtype)
    for corner in range(8):
        step = np.array([corner & 1, corner >> 1 & 1, corner >> 2])
        p = np.minimum(lo + step, size - 1)
        weight = np.where(step == 1, at - lo, 1 - (at - lo)).prod(1)
        out += weight * v[p[:, 2], p[:, 1], p[:, 0]]
    return np.where(ok, out, 0)


def turned(v: np.ndarray, rotation: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """An image or volume, turned about its centre by looking up where each pixel comes from."""
    cube = v if v.ndim == 3 else v[None]
    centre = (np.array(cube.shape[::-1]) - 1) / 2 if centre is None else np.asarray(centre, float)
    z, y, x = np.indices(cube.shape)
    at = np.stack([x, y, z], -1).reshape(-1, 3) - centre
    return trilinear(cube, at @ rotation.T + centre).reshape(v.shape)


def rotate(packed: DataFrame, a: float, b: float = 0.0, c: float = 0.0) -> DataFrame:
    """Images turned by Euler angles about their centres."""
    back = euler(a, b, c).T
    return per_image(packed, lambda v, m: (np.stack([turned(x, back) for x in v]), m))


def common_lines(packed: DataFrame, steps: int) -> DataFrame:
    """For each image and step of a full turn about z, the turned image less the image: a row each, with step. Steps are exploded first, so they run in parallel."""
    rows = packed.select("image_id", "nx", "ny", "nz", "re", "im", "mask", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))

    def run(batches):
        for part, shape in shaped(batches):
            v = complex_of(part, shape)
            k = part.column(part.schema.get_field_index("step")).to_numpy()
            d = np.stack([turned(x, euler(-2 * np.pi * s / steps)) - x for x, s in zip(v, k, strict=True)])
            out = packed_batch(part.column(0), d, np.ones(d.shape, int))
            yield pa.record_batch([*out.columns, pa.array(k)], [*out.schema.names, "step"])

    return rows.mapInArrow(run, PACKED + ", step int")


def exposures(packed: DataFrame, shots: int, position: float, width: float, intensity: float, period: float, seed: int = 0) -> DataFrame:
    """The summed diffraction intensities of each object over many shots of a Gaussian beam whose place and strength vary and whose phase grows with the distance from it. Numbers depend on seed, image and shot alone."""

    def run(batches):
        for part, shape in shaped(batches):
            v = complex_of(part, shape)
            ids = part.column(0).to_numpy()
            x = np.arange(shape[-1])[None, :]
            y = np.arange(shape[-2])[:, None]
            out = np.zeros(v.shape)
            for n, (image, obj) in enumerate(zip(ids, v, strict=True)):
                for k in range(shots):
                    rng = np.random.default_rng([seed, int(image) & (2**63 - 1), k])
                    base, bx, by = abs(rng.normal(1, intensity)), rng.normal(shape[-1] / 2, position), rng.normal(shape[-2] / 2, position)
                    d = np.hypot(x - bx, y - by)
                    beam = np.sqrt(base / (np.sqrt(2 * np.pi) * width) * np.exp(-d * d / (2 * width * width)))
                    out[n] += np.abs(np.fft.fftn(obj * beam * np.exp(1j * d / period))) ** 2
            yield packed_batch(part.column(0), out + 0j, np.ones(out.shape, int))

    return packed.select("image_id", "nx", "ny", "nz", "re", "im", "mask").mapInArrow(run, PACKED)


def with_phases_of(intensities: np.ndarray, objects: np.ndarray) -> np.ndarray:
    """Objects back from intensities with the phases of the objects' own transforms."""
    f = fftn(objects)
    size = np.abs(f)
    return ifftn(np.where(size > 0, f / np.where(size > 0, size, 1), 1) * np.sqrt(np.maximum(intensities, 0)))


# ---- projective transforms of the plane: nine numbers a row, points as rows times the matrix


def matrix(nx: Column, ny: Column, dx: Column, dy: Column, zoom: Column, alpha: Column, theta: Column) -> Column:
    """array<double> of 9: the transform of an image placed at dx, dy, scaled by 1 / zoom, turned by theta in the plane and by alpha out of it, and re-based to the image's middle."""
    c, s, ca, sa = F.cos(theta), F.sin(theta), F.cos(alpha), F.sin(alpha)
    k = 1 / zoom
    # turn out of the plane first, then in it; the third column is the perspective, -sin(alpha) / 1024
    a = [[ca * c * k, ca * s * k, -sa / 1024 * k], [-s * k, c * k, F.lit(0.0)]]
    tx, ty = dx - nx / 2, dy - ny / 2
    last = [tx * a[0][j] + ty * a[1][j] for j in range(3)]
    return F.array(*a[0], *a[1], last[0], last[1], last[2] + 1)


def multiply(p: Column, q: Column) -> Column:
    """The transform of p's matrix times q's: first q, then p, as rows times matrices go from the left."""
    at = lambda m, i, j: F.element_at(m, 3 * i + j + 1)
    return F.array(*[sum((at(p, i, k) * at(q, k, j) for k in range(1, 3)), at(p, i, 0) * at(q, 0, j)) for i in range(3) for j in range(3)])


def inverse(m: Column) -> Column:
    """The inverse by cofactors; null where there is none."""
    a = [[F.element_at(m, 3 * i + j + 1) for j in range(3)] for i in range(3)]
    minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    det = a[0][0] * minor(0, 0) + a[0][1] * minor(0, 1) + a[0][2] * minor(0, 2)
    return F.when(det != 0, F.array(*[minor(j, i) / det for i in range(3) for j in range(3)]))


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda i, j: F.element_at(m, 3 * i + j + 1)
    w = at(0, 2) * x + at(1, 2) * y + at(2, 2)
    return (at(0, 0) * x + at(1, 0) * y + at(2, 0)) / w, (at(0, 1) * x + at(1, 1) * y + at(2, 1)) / w


def _panel(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid pixels that one placed image contains, and its values there."""
    gx, gy = (k.ravel() for k in np.meshgrid(np.arange(r.x0, r.x1 + 1), np.arange(r.y0, r.y1 + 1)))
    at = np.stack([gx, gy, np.ones(len(gx))], 1) @ np.linalg.inv(np.asarray(r.m).reshape(3, 3))
    fx, fy = np.round(at[:, 0] / at[:, 2], 9), np.round(at[:, 1] / at[:, 2], 9)
    ok = (fx >= 0) & (fy >= 0) & (fx <= r.nx - 1) & (fy <= r.ny - 1)
    v = trilinear(np.asarray(r.re).reshape(1, r.ny, r.nx), np.stack([fx, fy, np.zeros(len(fx))], 1)[ok])
    return gx[ok].astype(np.int64), gy[ok].astype(np.int64), v


def stitch(packed: DataFrame, frames: DataFrame, *by: str, overlap: str = "first") -> DataFrame:
    """Panels placed by frames(image_id, seq, dx, dy, zoom, theta), on one grid for each group `by`: x, y, re, mask.

    The grid spans the transformed corners. Each panel fills the pixels of the grid that it contains, by bilinear
    lookup through the inverse transform, from its own bounding box only; where several do, the least seq wins, or (sum)
    they add up and mask counts them. Pixels that no panel contains have mask 0. All zooms of a group must be equal.
    """
    if overlap not in ("first", "sum"):
        raise ValueError("overlap is first or sum")
    if frames.groupBy(*by).agg(F.count_distinct("zoom").alias("n")).where("n > 1").take(1):
        raise ValueError("images of different zoom can't be stitched")
    one = F.lit(1.0)
    p = packed.select("image_id", "nx", "ny", "re").join(frames, "image_id")
    p = p.withColumn("m", matrix(F.col("nx"), F.col("ny"), F.col("dx"), F.col("dy"), one, F.lit(0.0), F.col("theta")))
    corners = [apply(F.col("m"), x, y) for x in (F.lit(0), F.col("nx") - 1) for y in (F.lit(0), F.col("ny") - 1)]
    ends = {"x0": F.floor(F.least(*[c[0] for c in corners]) + 1e-9), "y0": F.floor(F.least(*[c[1] for c in corners]) + 1e-9), "x1": F.ceil(F.greatest(*[c[0] for c in corners]) - 1e-9), "y1": F.ceil(F.greatest(*[c[1] for c in corners]) - 1e-9)}
    p = p.withColumns(ends)
    def panels(frames):
        for pdf in frames:
            cells = [_panel(r) for r in pdf.itertuples(index=False)]
            yield pdf[[*by, "seq"]].assign(x=[c[0] for c in cells], y=[c[1] for c in cells], v=[c[2] for c in cells])

    kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, "seq")) + ", x array<long>, y array<long>, v array<double>"
    cells = p.select(*by, "seq", "nx", "ny", "re", "m", *ends).mapInPandas(panels, schema).select(*by, "seq", F.explode(F.arrays_zip("x", "y", "v")).alias("c"))
    won = cells.select(*by, "seq", "c.x", "c.y", "c.v").groupBy(*by, "x", "y").agg((F.min_by("v", "seq") if overlap == "first" else F.sum("v")).alias("re"), F.count("*").alias("n"))
    box = p.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    grid = box.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).select(*by, "x", "y")
    out = grid.join(won, [*by, "x", "y"], "left")
    return out.select(*by, "x", "y", F.coalesce("re", F.lit(0.0)).alias("re"), F.when(F.col("re").isNull(), 0).otherwise(F.lit(1) if overlap == "first" else F.col("n")).cast("int").alias("mask"))
