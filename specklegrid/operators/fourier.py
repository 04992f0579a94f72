"""Fourier operators over packed images: Arrow batches to numpy, parallel over images, never a shuffle.

Images of one shape in a batch are transformed together: arrays are (images, ny, nx) or (images, nz, ny, nx). The
forward transform is exp(-2 pi i), unnormalised; so is the inverse (divide by the pixels for the identity).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PACKED

PIXELS = 1 << 20  # that a task transforms at once


def axes(v: np.ndarray) -> tuple[int, ...]:
    return tuple(range(1, v.ndim))


def fftn(v: np.ndarray) -> np.ndarray:
    return np.fft.fftn(v, axes=axes(v))


def ifftn(v: np.ndarray) -> np.ndarray:
    return np.fft.ifftn(v, axes=axes(v))


def grid(v: np.ndarray, spacing: float = 1.0) -> list[np.ndarray]:
    """Signed frequencies of each axis, broadcast over one image."""
    return np.meshgrid(*[np.fft.fftfreq(n, spacing) for n in v.shape[1:]], indexing="ij")


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def lists(v: np.ndarray, kind) -> pa.Array:
    """A list column of the rows of v."""
    n, width = len(v), v.size // max(len(v), 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(v).reshape(-1).astype(kind)))


def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[int, ...]]]:
    """Rows of one shape, with that shape."""
    for batch in batches:
        every = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("nz", "ny", "nx")], 1)
        step = max(1, PIXELS // int(every.prod(1).max(initial=1)))
        for at in range(0, batch.num_rows, step):
            part, dims = batch.slice(at, step), every[at : at + step]
            for shape in np.unique(dims, axis=0):
                rows = part.filter(pa.array((dims == shape).all(1)))
                yield rows, tuple(int(x) for x in (shape if shape[0] > 1 else shape[1:]))


def complex_of(rows: pa.RecordBatch, shape: tuple[int, ...], re: str = "re", im: str = "im") -> np.ndarray:
    get = lambda c: flat(rows.column(rows.schema.get_field_index(c)))
    return (get(re) + 1j * get(im)).reshape(rows.num_rows, *shape)


def packed_batch(ids: pa.Array, v: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    n, (ny, nx), nz = len(v), v.shape[-2:], 1 if v.ndim == 3 else v.shape[1]
    dims = [pa.array(np.full(n, x, np.int32)) for x in (nx, ny, nz)]
    return pa.record_batch([ids, *dims, lists(v.real, np.float64), lists(v.imag, np.float64), lists(np.broadcast_to(mask, v.shape), np.int32)], [c.split()[0] for c in PACKED.split(", ")])


def per_image(packed: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Applies f(complex arrays, masks) -> (arrays, masks) to images of one shape at a time; the first axis counts images."""

    def run(batches):
        for rows, shape in shaped(batches):
            mask = flat(rows.column(rows.schema.get_field_index("mask"))).reshape(rows.num_rows, *shape)
            v, m = f(complex_of(rows, shape), mask)
            yield packed_batch(rows.column(0), v, m)

    return packed.select("image_id", "nx", "ny", "nz", "re", "im", "mask").mapInArrow(run, PACKED)


def per_pair(a: DataFrame, b: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Applies f(arrays of a, arrays of b) to images of equal id; packed rows meet, not pixels. The mask is a's."""
    z = a.select("image_id", "nx", "ny", "nz", "re", "im", "mask").join(b.select("image_id", F.col("re").alias("re2"), F.col("im").alias("im2")), "image_id")

    def run(batches):
        for rows, shape in shaped(batches):
            mask = flat(rows.column(rows.schema.get_field_index("mask"))).reshape(rows.num_rows, *shape)
            yield packed_batch(rows.column(0), f(complex_of(rows, shape), complex_of(rows, shape, "re2", "im2")), mask)

    return z.mapInArrow(run, PACKED)


def fft(packed: DataFrame) -> DataFrame:
    return per_image(packed, lambda v, m: (fftn(v), np.ones_like(m)))


def ifft(packed: DataFrame) -> DataFrame:
    return per_image(packed, lambda v, m: (ifftn(v) * v[0].size, np.ones_like(m)))


def patterson(packed: DataFrame, cap: float | None = None) -> DataFrame:
    """Autocorrelation of the object: the modulus of the transform of its intensities; those over `cap` become 0 first."""

    def f(v, m):
        a = np.abs(v)
        return np.abs(fftn(np.where(a > cap, 0, a) if cap else a)) + 0j, np.ones_like(m)

    return per_image(packed, f)


def correlate(a: DataFrame, b: DataFrame, convolve: bool = False) -> DataFrame:
    """Cyclic cross-correlation (or convolution) of images of equal id."""
    return per_pair(a, b, lambda x, y: ifftn(fftn(x) * (fftn(y) if convolve else np.conj(fftn(y)))))


def blur_arrays(v: np.ndarray, sigma: float) -> np.ndarray:
    """Periodic Gaussian blur of each image."""
    return v if sigma <= 0 else ifftn(fftn(v) * np.exp(-2 * np.pi**2 * sigma**2 * sum(k * k for k in grid(v))))


def blur_array(v: np.ndarray, sigma: float) -> np.ndarray:
    """Periodic Gaussian blur of one image."""
    return blur_arrays(v[None], sigma)[0]


def gaussian_blur(packed: DataFrame, sigma: float) -> DataFrame:
    return per_image(packed, lambda v, m: (blur_arrays(v, sigma), m))


def roughness(packed: DataFrame, sigma: float = 2.0) -> DataFrame:
    def f(v, m):
        b = blur_arrays(v, sigma)
        return np.abs(b - v) / np.maximum(np.abs(b), 1e-300) + 0j, m

    return per_image(packed, f)


def band(packed: DataFrame, radius: float, keep: str = "low") -> DataFrame:
    """Low or high pass in Fourier space: frequencies up to `radius` pixels from zero stay, or go."""

    def f(v, m):
        d = np.sqrt(sum((k * n) ** 2 for k, n in zip(grid(v), v.shape[1:], strict=True)))
        return ifftn(fftn(v) * ((d <= radius) if keep == "low" else (d > radius))), m

    return per_image(packed, f)


def propagate(packed: DataFrame, dz: float, wavelength: float, pixel: float) -> DataFrame:
    """Fresnel propagation over dz."""

    def f(v, m):
        k2 = sum((2 * np.pi * k) ** 2 for k in grid(v, pixel))
        return ifftn(fftn(v) * np.exp(1j * dz * wavelength / (4 * np.pi) * k2)), m

    return per_image(packed, f)


def rescaled(v: np.ndarray, nx: int, ny: int) -> np.ndarray:
    """2D images on another grid, by cropping or padding their transforms."""
    k = np.fft.fftshift(fftn(v), axes=axes(v))
    out = np.zeros((len(v), ny, nx), complex)
    h, w = min(ny, v.shape[1]), min(nx, v.shape[2])
    a, b = (slice(n // 2 - s // 2, n // 2 - s // 2 + s) for n, s in ((ny, h), (nx, w)))
    c, d = (slice(n // 2 - s // 2, n // 2 - s // 2 + s) for n, s in ((v.shape[1], h), (v.shape[2], w)))
    out[:, a, b] = k[:, c, d]
    return ifftn(np.fft.ifftshift(out, axes=(1, 2))) * (nx * ny / v[0].size)


def fourier_rescale(packed: DataFrame, nx: int, ny: int) -> DataFrame:
    return per_image(packed, lambda v, m: (rescaled(v, nx, ny), np.ones((len(v), ny, nx), int)))


def friendly(n: int) -> int:
    """The least size from n on with no prime factor over 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def pad_to_friendly(packed: DataFrame) -> DataFrame:
    """Zeros (not measured) after each axis, up to a size that transforms quickly."""

    def f(v, m):
        width = [(0, 0), *[(0, friendly(n) - n) for n in v.shape[1:]]]
        return np.pad(v, width), np.pad(m, width)

    return per_image(packed, f)


def limit_sampling(packed: DataFrame, oversampling: float = 1.0, cutoff: float = 0.05, sigma: float = 5.0) -> DataFrame:
    """Square images, resampled to what their object needs: of the Patterson function of the blurred image, zero in the middle, the outermost square ring that holds more than `cutoff` of the largest value bounds the object; the new side is the ring's, times the oversampling."""
    from .packed import bilinear_arrays

    def run(batches):
        for rows, shape in shaped(batches):
            v = complex_of(rows, shape).real
            p = np.abs(fftn(blur_arrays(v + 0j, sigma)))
            p = np.fft.fftshift(p, axes=axes(v))
            n = v.shape[-1]
            y, x = np.indices(v.shape[1:])
            ring = np.minimum(np.minimum(x, n - 1 - x), np.minimum(y, n - 1 - y))
            most = np.stack([p[:, ring == k].max(1) for k in range((n + 1) // 2)], 1)
            first = (most > cutoff * most.max(1, keepdims=True)).argmax(1)
            sides = np.maximum(((n // 2 - first) * oversampling * 2).astype(int), 1)
            for side in np.unique(sides):
                out = bilinear_arrays(v[sides == side], side, side)
                yield packed_batch(rows.column(0).filter(pa.array(sides == side)), out + 0j, np.ones(out.shape, int))

    return packed.select("image_id", "nx", "ny", "nz", "re", "im", "mask").mapInArrow(run, PACKED)


def rolled(v: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """One image, cyclically shifted by any (not only whole) numbers of pixels; whole ones are exact."""
    if np.allclose(shift, np.round(shift)):
        return np.roll(v, tuple(np.round(shift).astype(int)), range(v.ndim))
    turn = sum(k * t for k, t in zip(np.meshgrid(*[np.fft.fftfreq(n) for n in v.shape], indexing="ij"), shift, strict=True))
    return np.fft.ifftn(np.fft.fftn(v) * np.exp(-2j * np.pi * turn))


def _peak(c: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    """Where a parabola through the largest value and its neighbours along each axis has its top."""
    out = np.array(at, float)
    for k, n in enumerate(c.shape):
        step = lambda d, k=k, n=n: c[tuple((x + d * (j == k)) % c.shape[j] for j, x in enumerate(at))]
        low, mid, high = (abs(step(d)) for d in (-1, 0, 1))
        bend = low - 2 * mid + high
        out[k] += 0.5 * (low - high) / bend if n > 2 and bend < 0 else 0.0
    return out


def align_arrays(a: np.ndarray, b: np.ndarray, mirror: bool = True, phase: bool = True, sub_pixel: bool = False) -> np.ndarray:
    """b, or its mirror image, cyclically shifted to the highest correlation with a, and its phase matched."""
    fa, best = np.fft.fftn(a), None
    for c in (b, np.conj(b[tuple([slice(None, None, -1)] * b.ndim)]))[: 1 + mirror]:
        cc = np.fft.ifftn(fa * np.conj(np.fft.fftn(c)))
        at = np.unravel_index(np.abs(cc).argmax(), cc.shape)
        if best is None or abs(cc[at]) > best[0] * (1 + 1e-12):
            moved = rolled(c, _peak(cc, at) if sub_pixel else np.array(at))
            best = abs(cc[at]), moved * (np.exp(1j * np.angle(np.vdot(moved, a))) if phase else 1)
    return best[1]


def superimpose(a: DataFrame, b: DataFrame, mirror: bool = True, phase: bool = True, sub_pixel: bool = False) -> DataFrame:
    """Each image of b, aligned to a's of the same id."""
    return per_pair(a, b, lambda x, y: np.stack([align_arrays(p, q, mirror, phase, sub_pixel) for p, q in zip(x, y, strict=True)]))


def overlap_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b, reflected if its convolution with a has a higher peak than its correlation, at the best whole shift."""
    cc, cv = (np.fft.ifftn(np.fft.fftn(a) * x) for x in (np.conj(np.fft.fftn(b)), np.fft.fftn(b)))
    if np.abs(cv).max() > np.abs(cc).max() * (1 + 1e-12):
        b = np.roll(b[tuple([slice(None, None, -1)] * b.ndim)], 1, range(b.ndim))
        cc = np.fft.ifftn(np.fft.fftn(a) * np.conj(np.fft.fftn(b)))
    return np.roll(b, np.unravel_index(np.abs(cc).argmax(), cc.shape), range(b.ndim))


def maximise_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return per_pair(a, b, lambda x, y: np.stack([overlap_arrays(p, q) for p, q in zip(x, y, strict=True)]))


def phase_error(a: np.ndarray, b: np.ndarray) -> float:
    """Mean modulus of the phase difference, wrapped to half a turn."""
    return float(np.abs(np.angle(a * np.conj(b))).mean())


def phase_overlap_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b at the one of all shifts by -1, 0 and 1 pixels along each axis whose transform's phases differ least from a's."""
    fa = np.fft.fftn(a)
    steps = np.stack(np.meshgrid(*[(-1, 0, 1) if n > 1 else (0,) for n in b.shape], indexing="ij"), -1).reshape(-1, b.ndim)
    moved = [np.roll(b, tuple(s), range(b.ndim)) for s in steps]
    return min(moved, key=lambda m: phase_error(fa, np.fft.fftn(m)))


def maximise_phase_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return per_pair(a, b, lambda x, y: np.stack([phase_overlap_arrays(p, q) for p, q in zip(x, y, strict=True)]))


def tv_denoise(packed: DataFrame, weight: float = 0.1, step: float = 0.1, rounds: int = 50) -> DataFrame:
    """Poisson total-variation denoising by gradient descent with periodic differences; values stay positive."""

    def f(v, m):
        data = np.maximum(v.real, 0)
        u = np.maximum(data.copy(), 1e-6)
        half = lambda x, k: (np.roll(x, -1, k) - np.roll(x, 1, k)) / 2
        for _ in range(rounds):
            d = [half(u, k) for k in axes(u)]
            size = np.sqrt(sum(x * x for x in d) + 1e-8)
            curl = sum(half(x / size, k) for k, x in zip(axes(u), d, strict=True))
            u = np.maximum(u - step * (1 - data / u - weight * curl), 1e-6)
        return u + 0j, m

    return per_image(packed, f)


def interpolate_blanks(packed: DataFrame, sigma: float = 1.0, rounds: int = 40, kernel: str = "gaussian", start: float | None = None) -> DataFrame:
    """Pixels that are not measured become what a blur leaves there, again and again; the others stay. kernel: gaussian, or sinc (an ideal low pass of 1 / (2 sigma)). start: what stands in the holes at first."""
    if kernel not in ("gaussian", "sinc"):
        raise ValueError("kernel is gaussian or sinc")

    def f(v, m):
        k2 = sum(k * k for k in grid(v))
        keep = np.exp(-2 * np.pi**2 * sigma**2 * k2) if kernel == "gaussian" else (k2 <= (0.5 / sigma) ** 2)
        out = np.where(m == 0, v if start is None else start, v)
        for _ in range(rounds):
            out = np.where(m == 0, ifftn(fftn(out) * keep), v)
        return out, m

    return per_image(packed, f)


def localised_blur(packed: DataFrame, sigma: float = 1.0, rounds: int = 40) -> DataFrame:
    """Holes, zero at first, filled by repeated blurs."""
    return interpolate_blanks(packed, sigma, rounds, start=0.0)


def autocorrelation_filter(packed: DataFrame, a: float) -> DataFrame:
    """Times (r / 2a)**4 exp(2 - r**2 / (2 a**2)) within 2a pixels of the origin of an unshifted image, 1 beyond."""

    def f(v, m):
        r2 = sum((k * n) ** 2 for k, n in zip(grid(v), v.shape[1:], strict=True))
        return v * np.where(r2 < 4 * a * a, (r2 / (4 * a * a)) ** 2 * np.exp(2 - r2 / (2 * a * a)), 1.0), m

    return per_image(packed, f)


def deautocorrelate(packed: DataFrame, rounds: int = 200, seed: int = 0) -> DataFrame:
    """A nonnegative image whose cyclic autocorrelation is the given one, by the multiplicative iteration of Schulz and Snyder from a random start."""

    def f(v, m):
        ac = np.maximum(v.real, 0)
        total = np.sqrt(np.maximum(ac.sum(axes(ac), keepdims=True), 1e-300))
        x = np.random.default_rng(seed).random(ac.shape[1:])[None] * np.ones_like(ac) + 0.1
        x *= total / x.sum(axes(x), keepdims=True)
        for _ in range(rounds):
            fx = fftn(x)
            ratio = fftn(ac / np.maximum(ifftn(np.abs(fx) ** 2).real, 1e-12))
            x = np.maximum(x * ifftn(fx * (ratio + np.conj(ratio))).real / (2 * total), 0)
        return x + 0j, np.ones_like(m)

    return per_image(packed, f)


def benchmark(spark, sizes: tuple[int, ...] = (191, 256, 500, 512), repeats: int = 3) -> DataFrame:
    """size, microseconds of one forward and inverse transform of a square image of random numbers: the least of a few, each size in a task of its own."""
    import time

    def run(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                v = np.random.default_rng(n).random((n, n)) + 0j
                took = []
                for _ in range(repeats):
                    began = time.perf_counter()
                    np.fft.ifft2(np.fft.fft2(v))
                    took.append((time.perf_counter() - began) * 1e6)
                yield pa.record_batch([pa.array([n]), pa.array([min(took)])], ["size", "microseconds"])

    return spark.createDataFrame([(n,) for n in sizes], "size long").repartition(len(sizes)).mapInArrow(run, "size long, microseconds double")


def direct_transform(px: DataFrame, nx: int, ny: int) -> DataFrame:
    """The transform as a sum over pixels in DataFrame operations, for small images and as a check: each pixel meets each of the nx * ny frequencies of its own image."""
    import math

    k = px.select("image_id", "x", "y", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("k"))
    a = -2 * math.pi * ((F.col("k") % nx) * F.col("x") / nx + F.floor(F.col("k") / nx) * F.col("y") / ny)
    return k.groupBy("image_id", F.col("k").alias("i")).agg(F.sum(F.col("re") * F.cos(a) - F.col("im") * F.sin(a)).alias("re"), F.sum(F.col("re") * F.sin(a) + F.col("im") * F.cos(a)).alias("im"))


def spherical_transform(profile: DataFrame, length: int, oversampling: int = 20) -> DataFrame:
    """F(R) = 1 / R sum of 2 r f(r) sin(2 pi r R) of profile(image_id, r, f), R = k / (oversampling * length); F(0) = 0."""
    import math

    k = profile.select("image_id", "r", "f", F.explode(F.sequence(F.lit(0), F.lit(length * oversampling - 1))).alias("k"))
    big = F.col("k") / float(oversampling * length)
    return k.groupBy("image_id", "k").agg(F.sum(2 * F.col("r") * F.col("f") * F.sin(2 * math.pi * F.col("r") * big)).alias("s")).select("image_id", "k", F.when(F.col("k") == 0, 0.0).otherwise(F.col("s") / big).alias("value"))

