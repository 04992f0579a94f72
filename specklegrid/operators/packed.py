"""Operators on one image, or on a pair of images of equal id, over packed rows: batches in numpy, and never a shuffle but the join of pairs on their id.

The same semantics as the pixel-table forms in pixel, spatial and aggregate, which serve where pixels meet other tables.
Functions from packed to packed rows go through fourier.per_image and per_pair; those that give rows of numbers go through rows().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fourier import complex_of, flat, lists, per_image, shaped


def rows(packed: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows of f(arrays, masks): columns of one value an image, or of k values an image (k rows then). image_id comes first."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for part, shape in shaped(batches):
            mask = flat(part.column(part.schema.get_field_index("mask"))).reshape(part.num_rows, *shape)
            got = f(complex_of(part, shape), mask)
            each = [np.asarray(got[n]).reshape(part.num_rows, -1) for n in names]
            k = max(x.shape[1] for x in each)
            ids = pa.array(np.repeat(part.column(0).to_numpy(), k))
            # a row without a value (nan) is null
            yield pa.record_batch([ids, *[_column(np.broadcast_to(x, (part.num_rows, k)).reshape(-1), t) for x, t in zip(each, kinds, strict=True)]], ["image_id", *names])

    return packed.select("image_id", "nx", "ny", "nz", "re", "im", "mask").mapInArrow(run, f"image_id long, {schema}")


def _column(v: np.ndarray, kind: pa.DataType) -> pa.Array:
    if v.dtype.kind == "f":
        empty = np.isnan(v)
        return pa.array(np.where(empty, 0, v), pa.float64(), mask=empty).cast(kind)
    return pa.array(v).cast(kind)


def pair_rows(a: DataFrame, b: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows of f(arrays of a, arrays of b, masks of a) for images of equal id: packed rows meet on their id, pixels never."""
    other = b.select("image_id", F.col("re").alias("re2"), F.col("im").alias("im2"))
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for part, shape in shaped(batches):
            mask = flat(part.column(part.schema.get_field_index("mask"))).reshape(part.num_rows, *shape)
            got = f(complex_of(part, shape), complex_of(part, shape, "re2", "im2"), mask)
            each = [np.asarray(got[n]).reshape(part.num_rows, -1) for n in names]
            k = max(x.shape[1] for x in each)
            yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(), k)), *[_column(np.broadcast_to(x, (part.num_rows, k)).reshape(-1), t) for x, t in zip(each, kinds, strict=True)]], ["image_id", *names])

    return a.select("image_id", "nx", "ny", "nz", "re", "im", "mask").join(other, "image_id").mapInArrow(run, f"image_id long, {schema}")


def packed_pairs(a: DataFrame, b: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """image_id and an array<double> `v` of f(arrays of a, arrays of b)."""
    other = b.select("image_id", F.col("re").alias("re2"), F.col("im").alias("im2"))

    def run(batches):
        for part, shape in shaped(batches):
            v = np.asarray(f(complex_of(part, shape), complex_of(part, shape, "re2", "im2")))
            yield pa.record_batch([part.column(0), lists(v.reshape(part.num_rows, -1), np.float64)], ["image_id", "v"])

    return a.select("image_id", "nx", "ny", "nz", "re", "im").join(other, "image_id").mapInArrow(run, "image_id long, v array<double>")


def flat_images(v: np.ndarray) -> np.ndarray:
    return v.reshape(len(v), -1)


def distance(v: np.ndarray) -> np.ndarray:
    """Of each pixel to the centre of its image."""
    grid = np.meshgrid(*[np.arange(n) - (n - 1) / 2 for n in v.shape[1:]], indexing="ij")
    return np.sqrt(sum(k * k for k in grid)).ravel()


def shells(v: np.ndarray, bins: int, most: float) -> np.ndarray:
    return np.minimum(np.floor(distance(v) * bins / most).astype(int), bins - 1)


def by_shell(values: np.ndarray, shell: np.ndarray, bins: int) -> np.ndarray:
    """Sums of flat images by shell."""
    return np.stack([values[:, shell == k].sum(1) for k in range(bins)], 1)


def division(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, nan where b is 0."""
    return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


# ---- numbers of an image


def integrate(packed: DataFrame) -> DataFrame:
    def f(v, m):
        a = np.abs(flat_images(v))
        return {"sum_re": flat_images(v.real).sum(1), "sum_im": flat_images(v.imag).sum(1), "sum_abs": a.sum(1), "mean_abs": a.mean(1), "sigma_abs": a.std(1)}

    return rows(packed, f, "sum_re double, sum_im double, sum_abs double, mean_abs double, sigma_abs double")


def panel_integrate(packed: DataFrame, width: int) -> DataFrame:
    """Sums of vertical panels of `width` pixels."""

    def f(v, m):
        panels = -(-v.shape[-1] // width)
        return {"panel": np.broadcast_to(np.arange(panels), (len(v), panels)), "sum_re": np.stack([flat_images(v.real[..., k * width : (k + 1) * width]).sum(1) for k in range(panels)], 1)}

    return rows(packed, f, "panel long, sum_re double")


def extremes(packed: DataFrame) -> DataFrame:
    return rows(packed, lambda v, m: {"least": flat_images(v.real).min(1), "most": flat_images(v.real).max(1), "at": flat_images(v.real).argmax(1)}, "least double, most double, at long")


def radial_profile(packed: DataFrame, bins: int, most: float, measured: bool = False) -> DataFrame:
    """Mean, relative sample deviation (null for a single pixel) and count of moduli by shell; shells without pixels have no row."""

    def f(v, m):
        s, a = shells(v, bins, most), np.abs(flat_images(v))
        use = flat_images(m) != 0 if measured else np.ones(a.shape, bool)
        n = by_shell(use, s, bins)
        mean = division(by_shell(a * use, s, bins), n)
        spread = by_shell(np.where(use, a - np.nan_to_num(mean)[:, s], 0) ** 2, s, bins)
        return {"shell": np.broadcast_to(np.arange(bins), n.shape), "mean": mean, "rel_sigma": division(np.sqrt(division(spread, n - 1)), mean), "n": n}

    return rows(packed, f, "shell int, mean double, rel_sigma double, n long").where("n > 0")


def wilson(packed: DataFrame, bins: int, most: float) -> DataFrame:
    """The mean by shell, and its logarithm (null where it isn't positive); shells without pixels have no row."""

    def f(v, m):
        s, a = shells(v, bins, most), flat_images(v.real)
        n = np.bincount(s, minlength=bins)
        mean = division(by_shell(a, s, bins), n[None])
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.where(mean > 0, np.log(np.where(mean > 0, mean, 1)), np.nan)
        return {"shell": np.broadcast_to(np.arange(bins), mean.shape), "mean": mean, "log_mean": log}

    return rows(packed, f, "shell int, mean double, log_mean double").where("mean IS NOT NULL")


def right_half_mean(packed: DataFrame) -> DataFrame:
    return rows(packed, lambda v, m: {"background": flat_images(v.real[..., v.shape[-1] // 2 :]).mean(1)}, "background double")


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, re, im: the sum of a conj(b) over pixels."""

    def f(x, y, m):
        total = (flat_images(x) * np.conj(flat_images(y))).sum(1)
        return {"re": total.real, "im": total.imag}

    return pair_rows(a, b, f, "re double, im double")


def real_space_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, r (the share of the moduli in which superimposed images differ), cc."""

    def f(x, y, m):
        x, y = np.abs(flat_images(x)), np.abs(flat_images(y))
        dx, dy = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
        return {"r": division(np.abs(x - y).sum(1), (x + y).sum(1)), "cc": division((dx * dy).sum(1), np.sqrt((dx * dx).sum(1) * (dy * dy).sum(1)))}

    return pair_rows(a, b, f, "r double, cc double")


def snapshot_difference(packed: DataFrame, by: str, order: str) -> DataFrame:
    """For each snapshot of a run, the sum over pixels of the modulus' change since the one before (null for the first); packed rows are ordered, not pixels."""
    size = F.zip_with("re", "im", lambda a, b: F.hypot(a, b))
    z = packed.select(by, order, size.alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy(by).orderBy(order)))
    change = F.aggregate(F.zip_with("a", "b", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, c: t + c)
    return z.select(by, order, F.when(F.col("b").isNotNull(), change).alias("int_cum_fluctuation"))


def box_signal(packed: DataFrame, x: int, y: int, reach: int) -> DataFrame:
    at = lambda c: slice(max(c - reach, 0), c + reach + 1)
    return rows(packed, lambda v, m: {"signal": flat_images(v.real[..., at(y), at(x)]).sum(1)}, "signal double")


def photons(packed: DataFrame) -> DataFrame:
    """Mean over population variance of the measured pixels; null without any."""

    def f(v, m):
        use, a = flat_images(m) != 0, flat_images(v.real)
        n = use.sum(1)
        mean = division((a * use).sum(1), n)
        return {"factor": division(mean, division((np.where(use, a - np.nan_to_num(mean)[:, None], 0) ** 2).sum(1), n))}

    return rows(packed, f, "factor double")


# ---- images


def real(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """An operator of real parts alone."""
    return lambda packed: per_image(packed, lambda v, m: (f(v.real) + 0j, m))


def _over(v: np.ndarray, f) -> np.ndarray:
    """A number of each image, shaped to meet its pixels."""
    return f(flat_images(v), axis=1).reshape(-1, *[1] * (v.ndim - 1))


def normalise(packed: DataFrame) -> DataFrame:
    return real(lambda v: division(v, _over(v, np.sum)))(packed)


def cap(packed: DataFrame, share: float) -> DataFrame:
    return per_image(packed, lambda v, m: (np.minimum(np.abs(v), share * _over(np.abs(v), np.max)) + 0j, m))


def charge_flip(packed: DataFrame, share: float) -> DataFrame:
    return per_image(packed, lambda v, m: (np.where(np.abs(v) < share * _over(np.abs(v), np.max), -v, v), m))


def threshold_support(packed: DataFrame, level: float, strict: bool = False) -> DataFrame:
    def f(v, m):
        a, at = np.abs(v), level * _over(np.abs(v), np.max)
        return ((a > at) if strict else (a >= at)) + 0j, m

    return per_image(packed, f)


def area_threshold_support(packed: DataFrame, area: float) -> DataFrame:
    def f(v, m):
        a = flat_images(np.abs(v))
        level = -np.sort(-a, axis=1)[:, min(int(a.shape[1] * area), a.shape[1] - 1)]
        return (a >= level[:, None]).reshape(v.shape) + 0j, m

    return per_image(packed, f)


def mask_at_maximum(packed: DataFrame) -> DataFrame:
    return per_image(packed, lambda v, m: (v, np.where(np.abs(v) >= _over(np.abs(v), np.max), 0, m)))


def radial_minimum_subtract(packed: DataFrame, bins: int, most: float) -> DataFrame:
    def f(v, m):
        s, a = shells(v, bins, most), flat_images(np.abs(v))
        least = np.stack([a[:, s == k].min(1, initial=np.inf) for k in range(bins)], 1)
        return v - least[:, s].reshape(v.shape), m

    return per_image(packed, f)


def row_median_subtract(packed: DataFrame, width: int) -> DataFrame:
    """Common mode: the median of each row of each panel of `width` pixels is subtracted."""

    def f(v):
        out = v.copy()
        for x in range(0, v.shape[-1], width):
            out[..., x : x + width] -= np.median(v[..., x : x + width], axis=-1, keepdims=True)
        return out

    return real(f)(packed)


def mesh_background(packed: DataFrame, cell: int) -> DataFrame:
    def f(v):
        out = v.copy()
        for y in range(0, v.shape[-2], cell):
            for x in range(0, v.shape[-1], cell):
                out[..., y : y + cell, x : x + cell] -= np.median(v[..., y : y + cell, x : x + cell], axis=(-2, -1), keepdims=True)
        return out

    return real(f)(packed)


def smooth_mesh_background(packed: DataFrame, cell: int) -> DataFrame:
    """The medians of cells, bilinear between their centres (and constant beyond the outer ones), are subtracted."""

    def f(v):
        ny, nx = v.shape[-2:]
        marks = [list(range(0, n, cell)) for n in (ny, nx)]
        medians = np.stack([np.stack([np.median(v[..., y : y + cell, x : x + cell], axis=(-2, -1)) for x in marks[1]], -1) for y in marks[0]], -2)
        weights = []
        for n, begin in zip((ny, nx), marks, strict=True):
            at = np.array([(a + min(a + cell, n) - 1) / 2 for a in begin])
            weights.append(np.stack([np.interp(np.arange(n), at, np.eye(len(at))[k]) for k in range(len(at))], 1))
        return v - np.einsum("ya,xb,...ab->...yx", weights[0], weights[1], medians)

    return real(f)(packed)


def smooth_mask_edges(packed: DataFrame, sigma: float) -> DataFrame:
    """Values times their mask, blurred and kept within itself: 1 well inside, falling towards its edges."""
    from .fourier import blur_arrays

    return per_image(packed, lambda v, m: (v * np.where(m != 0, np.clip(blur_arrays((m != 0) + 0j, sigma).real, 0, 1), 0), m))


def find_centre(packed: DataFrame) -> DataFrame:
    """x, y of the point about which an image is most alike to itself turned by half: where its convolution with itself is largest, halved; ties go to the first."""
    from .fourier import fftn, ifftn

    def f(v, m):
        wide = np.pad(np.abs(v), [(0, 0), (0, v.shape[1]), (0, v.shape[2])])
        c = flat_images(np.round(ifftn(fftn(wide) ** 2).real, 6))
        at = c.argmax(1)
        return {"x": (at % wide.shape[2]) / 2, "y": (at // wide.shape[2]) / 2}

    return rows(packed, f, "x double, y double")


def column_mean_subtract(packed: DataFrame, rows_: int) -> DataFrame:
    """The mean of the first rows of each column is subtracted from all of it."""
    return real(lambda v: v - v[..., :rows_, :].mean(-2, keepdims=True))(packed)


def strip_background(packed: DataFrame, top: int, side: int) -> DataFrame:
    """Column means of a top strip, then row means of a left band, both subtracted."""

    def f(v):
        v = v - v[..., :top, :].mean(-2, keepdims=True)
        return v - v[..., :side].mean(-1, keepdims=True)

    return real(f)(packed)


def mirror_subtract(packed: DataFrame) -> DataFrame:
    def f(v):
        half = v.shape[-1] // 2
        out = np.zeros_like(v)
        out[..., :half] = v[..., :half] - v[..., ::-1][..., :half]
        return out

    return real(f)(packed)


def square(v: np.ndarray, reach: int) -> np.ndarray:
    """Each pixel's neighbours of a square, periodic, along a new first axis, with their offsets' squares."""
    return np.stack([np.roll(v, (dy, dx), (-2, -1)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])


def box_blur(packed: DataFrame, reach: int) -> DataFrame:
    return real(lambda v: square(v, reach).mean(0))(packed)


def gaussian_blur_direct(packed: DataFrame, sigma: float, reach: int) -> DataFrame:
    w = np.array([np.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)])
    return real(lambda v: np.tensordot(w, square(v, reach), 1) / w.sum())(packed)


def zero_near_negative(packed: DataFrame) -> DataFrame:
    return real(lambda v: np.where(square(v, 1).min(0) < 0, 0.0, v))(packed)


def centrosymmetric(packed: DataFrame) -> DataFrame:
    def f(v, m):
        turn = tuple([slice(None)] + [slice(None, None, -1)] * (v.ndim - 1))
        a, b = (m != 0).astype(int), (m[turn] != 0).astype(int)
        return np.nan_to_num(division(v.real * a + v.real[turn] * b, a + b)) + 0j, np.maximum(a, b)

    return per_image(packed, f)


def sampled(packed: DataFrame, places: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """image_id, p, re, mask: bilinear values at places(nx, ny), arrays of x and y; 0 with mask 0 where a corner that counts lies outside."""

    def f(v, m):
        ny, nx = v.shape[-2:]
        fx, fy = places(nx, ny)
        bx, by = np.floor(fx).astype(int), np.floor(fy).astype(int)
        u, w = fx - bx, fy - by
        total, outside = np.zeros((len(v), len(fx))), np.zeros(len(fx), bool)
        for a in (0, 1):
            for b in (0, 1):
                weight = (u if a else 1 - u) * (w if b else 1 - w)
                x, y = bx + a, by + b
                inside = (x >= 0) & (x < nx) & (y >= 0) & (y < ny)
                outside |= ~inside & (weight > 1e-12)
                total += np.where(inside, weight, 0) * v.real[:, np.clip(y, 0, ny - 1), np.clip(x, 0, nx - 1)]
        each = lambda x: np.broadcast_to(x, total.shape)
        return {"p": each(np.arange(len(fx))), "re": np.where(outside, 0.0, total), "mask": each((~outside).astype(int))}

    return rows(packed, f, "p long, re double, mask int")


def line_out(packed: DataFrame, x0: float, y0: float, x1: float, y1: float, samples: int = 100) -> DataFrame:
    t = np.arange(samples) / (samples - 1)
    return sampled(packed, lambda nx, ny: (x0 + t * (x1 - x0), y0 + t * (y1 - y0)))


def rotate(packed: DataFrame, angle: float) -> DataFrame:
    """Rotation about the centre by inverse lookup."""
    c, s = np.cos(angle), np.sin(angle)

    def places(nx, ny):
        p = np.arange(nx * ny)
        x, y = p % nx - (nx - 1) / 2, p // nx - (ny - 1) / 2
        return c * x + s * y + (nx - 1) / 2, -s * x + c * y + (ny - 1) / 2

    return sampled(packed, places)


def bilinear_arrays(v: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """Real images on a grid of another size, corners onto corners."""
    at = [np.arange(n) * ((k - 1) / (n - 1) if n > 1 else 0.0) for k, n in zip(v.shape[-2:], (ny, nx), strict=True)]
    lo = [np.minimum(np.floor(a).astype(int), max(k - 2, 0)) for a, k in zip(at, v.shape[-2:], strict=True)]
    hi = [np.minimum(a + 1, k - 1) for a, k in zip(lo, v.shape[-2:], strict=True)]
    u, w = at[0] - lo[0], at[1] - lo[1]
    row = lambda r: v[..., r, :][..., lo[1]] * (1 - w) + v[..., r, :][..., hi[1]] * w
    return row(lo[0]) * (1 - u)[:, None] + row(hi[0]) * u[:, None]


def rescale(packed: DataFrame, nx: int, ny: int) -> DataFrame:
    """Bilinear, corners onto corners."""

    def f(v, m):
        out = bilinear_arrays(v.real, nx, ny)
        return out + 0j, np.ones(out.shape, int)

    return per_image(packed, f)


def stretch(packed: DataFrame, max_angle: float) -> DataFrame:
    """Pixels of a flat detector, brought to equal steps of the scattering angle's tangent over its sine: each looks up, bilinearly, a place nearer to the centre by cos(max_angle) / cos(angle); places without four neighbours are not measured."""

    def f(v, m):
        ny, nx = v.shape[-2:]
        d = distance(v).reshape(ny, nx)
        r = d.max() / np.sin(max_angle * np.cos(max_angle))
        factor = np.where(d > 0, np.cos(max_angle) / np.cos(np.arcsin(d / r)), 1.0)
        y, x = ((k - (n - 1) / 2) * factor + (n - 1) / 2 for k, n in zip(np.indices((ny, nx)), (ny, nx), strict=True))
        qy, qx = np.floor(y).astype(int), np.floor(x).astype(int)
        ok = (qy >= 0) & (qx >= 0) & (qy + 1 < ny) & (qx + 1 < nx)
        cy, cx = np.where(ok, qy, 0), np.where(ok, qx, 0)
        u, w = y - qy, x - qx
        out = sum(v.real[..., cy + b, cx + a] * (u if b else 1 - u) * (w if a else 1 - w) for a in (0, 1) for b in (0, 1))
        return np.where(ok, out, 0) + 0j, np.where(ok, m, 0)

    return per_image(packed, f)


# ---- pairs


def r_factor(a: DataFrame, b: DataFrame) -> DataFrame:
    def f(x, y, m):
        p, q = flat_images(np.abs(x)), flat_images(np.abs(y))
        return {"r": division(np.abs(p - q).sum(1), (p + q).sum(1))}

    return pair_rows(a, b, f, "r double")


def shell_r_factor(a: DataFrame, b: DataFrame, bins: int, most: float) -> DataFrame:
    def f(x, y, m):
        s, p, q = shells(x, bins, most), flat_images(np.abs(x)), flat_images(np.abs(y))
        r = division(by_shell(np.abs(p - q), s, bins), by_shell(p + q, s, bins))
        return {"shell": np.broadcast_to(np.arange(bins), r.shape), "r": r, "n": np.broadcast_to(np.bincount(s, minlength=bins), r.shape)}

    return pair_rows(a, b, f, "shell long, r double, n long").where("n > 0").drop("n")


def pearson(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Correlations of the last axis; nan without spread."""
    p, q = p - p.mean(-1, keepdims=True), q - q.mean(-1, keepdims=True)
    return division((p * q).sum(-1), np.sqrt((p * p).sum(-1) * (q * q).sum(-1)))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    return pair_rows(a, b, lambda x, y, m: {"r": pearson(flat_images(x.real), flat_images(y.real))}, "r double")


def regression_scale(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, v: b on the scale of a by a regression of moduli; what is under the intercept becomes 0."""

    def f(x, y):
        p, q, v = flat_images(np.abs(x)), flat_images(np.abs(y)), flat_images(y.real)
        mp, mq = p.mean(1, keepdims=True), q.mean(1, keepdims=True)
        slope = division(((q - mq) * (p - mp)).sum(1, keepdims=True), ((p - mp) ** 2).sum(1, keepdims=True))
        inter = mq - slope * mp
        return np.where((q < inter) | (q == 0), 0.0, v * (q - inter) / np.where(q == 0, 1, q) / slope)

    return packed_pairs(a, b, f)


def sliding_correlation(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """image_id, v: the correlation of the `width` values from each place on; fewer at the end."""

    def f(x, y):
        p, q = flat_images(x.real), flat_images(y.real)
        out = np.full(p.shape, np.nan)
        for i in range(p.shape[1] - 1):
            out[:, i] = pearson(p[:, i : i + width], q[:, i : i + width])
        return out

    return packed_pairs(a, b, f)


def best_rotation(a: DataFrame, b: DataFrame) -> DataFrame:
    """The quarter turn of b that correlates best with a (ties: the least)."""

    def f(x, y, m):
        r = np.stack([pearson(flat_images(x.real), flat_images(np.rot90(y.real, -k, (-2, -1)))) for k in range(4)], 1)
        best = np.nanargmax(np.where(np.isnan(r), -2, r), axis=1)
        return {"rot": best, "r": r[np.arange(len(r)), best]}

    return pair_rows(a, b, f, "rot long, r double")
