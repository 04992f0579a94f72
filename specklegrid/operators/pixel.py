"""Pixel-wise projections over pixel tables: single Catalyst projections, plus equi-joins on the pixel where two images meet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import angle, modulus

KEY = ["image_id", "i"]


def dephase(px: DataFrame) -> DataFrame:
    return px.withColumns({"re": modulus(), "im": F.lit(0.0)})


# Products of numbers under PRIME stay within 63 bits.
PRIME, MIX_A, MIX_B, MIX_C = 2147483647, 1103515245, 1597334677, 12345


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone, so partitioning doesn't matter: the columns are mixed modulo a prime, and the fifth power of that, which permutes it, spreads them."""
    h = F.lit(seed).cast("long")
    for c in columns:
        h = (h * MIX_A + F.col(c).cast("long") % PRIME * MIX_B + MIX_C) % PRIME
    square = h * h % PRIME
    return ((square * square % PRIME) * h % PRIME) / F.lit(float(PRIME))


def rephase(px: DataFrame, seed: int | None = None) -> DataFrame:
    """Zero phases, or random ones by a hash of seed, image and pixel."""
    if seed is None:
        return dephase(px)
    phase = 2 * math.pi * uniform(seed, "image_id", "i")
    return px.withColumns({"re": modulus() * F.cos(phase), "im": modulus() * F.sin(phase)})


def add_noise(px: DataFrame, level: float, seed: int = 0) -> DataFrame:
    """Normal noise of the given deviation relative to each value (Box-Muller over hashed uniforms)."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, "image_id", "i")))
    return px.withColumn("re", F.col("re") * (1 + level * radius * F.cos(2 * math.pi * uniform(seed + 1, "image_id", "i"))))


def to_amplitudes(px: DataFrame) -> DataFrame:
    """Square roots of measured intensities (of negative ones 0); pixels that are not measured become 0."""
    return px.withColumns({"re": F.when(F.col("mask") != 0, F.sqrt(F.greatest("re", F.lit(0.0)))).otherwise(0.0), "im": F.lit(0.0)})


def to_intensities(px: DataFrame) -> DataFrame:
    return px.withColumns({"re": F.col("re") * F.col("re") + F.col("im") * F.col("im"), "im": F.lit(0.0)})


def dark_subtract(px: DataFrame, dark: DataFrame, on: list[str]) -> DataFrame:
    """dark(on..., dark): its modulus is subtracted; what falls below 0 becomes 0 + 0i."""
    left = F.col("re") - F.abs("dark")
    return px.join(dark, on).withColumns({"im": F.when(left < 0, 0.0).otherwise(F.col("im")), "re": F.greatest(left, F.lit(0.0))}).drop("dark")


def background_constant(px: DataFrame, level: float) -> DataFrame:
    return px.withColumn("re", F.greatest(F.col("re") - level, F.lit(0.0)))


def noise_removal(px: DataFrame, noise: DataFrame, on: list[str]) -> DataFrame:
    """noise(on..., noise): values that it leaves below their own root become 0."""
    left = F.col("re") - F.col("noise")
    return px.join(noise, on).withColumn("re", F.when(left < F.sqrt(F.abs("re")), 0.0).otherwise(left)).drop("noise")


def scale(px: DataFrame, factor: float) -> DataFrame:
    return px.withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor})


def normalise(px: DataFrame) -> DataFrame:
    total = F.sum("re").over(Window.partitionBy("image_id"))
    return px.withColumn("re", F.col("re") / F.nullif(total, F.lit(0.0)))


def fermi_high_pass(px: DataFrame, radius: float, width: float, distance: Column) -> DataFrame:
    """Times 1 - 1 / (1 + exp((d - r) / w)); where that is below 1e-4 the value is known (to be zero)."""
    factor = 1 - 1 / (1 + F.exp((distance - radius) / width))
    return px.withColumns({"re": F.col("re") * factor, "im": F.col("im") * factor, "mask": F.when(factor < 1e-4, 1).otherwise(F.col("mask"))})


def radial_bin(distance: Column, bins: int, most: float) -> Column:
    return F.least(F.floor(distance * bins / most), F.lit(bins - 1)).cast("int")


def radial_minimum_subtract(px: DataFrame, distance: Column, bins: int, most: float) -> DataFrame:
    least = F.min(modulus()).over(Window.partitionBy("image_id", radial_bin(distance, bins, most)))
    return px.withColumn("re", F.col("re") - least)


def cap(px: DataFrame, share: float) -> DataFrame:
    """Moduli; those over a share of the image's largest become that share of it."""
    most = F.max(modulus()).over(Window.partitionBy("image_id"))
    return px.withColumns({"re": F.least(modulus(), share * most), "im": F.lit(0.0)})


def bayer_channel(px: DataFrame, channel: str) -> DataFrame:
    """Red: even x and y; green: even x and odd y; half size."""
    if channel not in ("red", "green"):
        raise ValueError("only the red and green channels are defined")
    at = (F.col("x") % 2 == 0) & (F.col("y") % 2 == (0 if channel == "red" else 1))
    return px.where(at).withColumns({"x": F.floor(F.col("x") / 2).cast("int"), "y": F.floor(F.col("y") / 2).cast("int"), "im": F.lit(0.0)})


def solid_angle_stretch(px: DataFrame, distance: Column, pixel: float, length: float) -> DataFrame:
    """Intensity factor 1 / cos(a)**3 of a flat detector, a the scattering angle."""
    return px.withColumn("re", F.col("re") / F.pow(F.cos(F.atan(distance * pixel / length)), F.lit(3.0)))


def resolution(distance: Column, pixel: float, length: float, wavelength: float) -> Column:
    return 2 * F.sin(F.atan(distance * pixel / length) / 2) / wavelength


def reciprocal_planar(px: DataFrame, nx: int, ny: int, pixel: float, length: float, wavelength: float) -> DataFrame:
    k = pixel / (length * wavelength)
    return px.withColumns({"kx": (F.col("x") - (nx - 1) / 2) * k, "ky": (F.col("y") - (ny - 1) / 2) * k})


def reciprocal_ewald(px: DataFrame, nx: int, ny: int, pixel: float, length: float, wavelength: float) -> DataFrame:
    """Coordinates projected on the Ewald sphere."""
    rx, ry = (F.col("x") - (nx - 1) / 2) * pixel, (F.col("y") - (ny - 1) / 2) * pixel
    path = F.sqrt(rx * rx + ry * ry + length * length)
    return px.withColumns({"kx": rx / path / wavelength, "ky": ry / path / wavelength, "kz": (length / path - 1) / wavelength})


def reciprocal_grid(px: DataFrame, center: tuple[float, float, float], pixel: float, length: float, wavelength: float) -> DataFrame:
    """Coordinates of a three-dimensional grid around the centre, rounded to a whole pixel; y and z point the other way."""
    k = pixel / (length * wavelength)
    cx, cy, cz = (float(math.floor(c + 0.5)) for c in center)
    return px.withColumns({"kx": (F.col("x") - cx) * k, "ky": (cy - F.col("y")) * k, "kz": (cz - F.col("z")) * k})


def miller(px: DataFrame, stride_x: float, stride_y: float) -> DataFrame:
    return px.withColumns({"h": F.col("kx") / abs(stride_x), "k": F.col("ky") / abs(stride_y)})


def photons(px: DataFrame) -> DataFrame:
    """For each image the factor from values to photons: mean over population variance of the measured pixels."""
    return px.where("mask <> 0").groupBy("image_id").agg((F.avg("re") / F.nullif(F.var_pop("re"), F.lit(0.0))).alias("factor"))


def fresnel_phase(px: DataFrame, dz: float, wavelength: float, kx: Column, ky: Column) -> DataFrame:
    """Times exp(i dz wavelength / (4 pi) (kx**2 + ky**2)): the propagator in Fourier space."""
    a = dz * wavelength / (4 * math.pi) * (kx * kx + ky * ky)
    return px.withColumns({"re": F.col("re") * F.cos(a) - F.col("im") * F.sin(a), "im": F.col("re") * F.sin(a) + F.col("im") * F.cos(a)})


def charge_flip(px: DataFrame, share: float) -> DataFrame:
    """Values whose modulus is below a share of the image's largest change sign."""
    weak = modulus() < share * F.max(modulus()).over(Window.partitionBy("image_id"))
    return px.withColumns({"re": F.when(weak, -F.col("re")).otherwise(F.col("re")), "im": F.when(weak, -F.col("im")).otherwise(F.col("im"))})


def phase(px: DataFrame) -> DataFrame:
    return px.withColumns({"re": angle(F.col("im"), F.col("re")), "im": F.lit(0.0)})


def mask_image(px: DataFrame) -> DataFrame:
    return px.withColumns({"re": F.col("mask").cast("double"), "im": F.lit(0.0)})


def mirror_subtract(px: DataFrame, nx: int) -> DataFrame:
    """Herringbone removal: the left half less the mirrored right half; the right half becomes 0."""
    right = px.where(F.col("x") >= nx // 2).select("image_id", (F.lit(nx - 1) - F.col("x")).alias("x"), "y", "z", F.col("re").alias("other"))
    x = px.join(right, ["image_id", "x", "y", "z"], "left")
    return x.withColumn("re", F.when(F.col("x") < nx // 2, F.col("re") - F.col("other")).otherwise(0.0)).drop("other")


def with_detector(df: DataFrame, center: tuple[float, float, float], pixel: tuple[float, float, float], distance: float = -1.0, wavelength: float = -1.0) -> DataFrame:
    """A detector struct in metres; -1 stands for unknown."""
    return df.withColumn("detector", F.struct(F.array(*map(F.lit, center)).alias("center"), F.array(*map(F.lit, pixel)).alias("pixel_size"), F.lit(distance).alias("distance"), F.lit(wavelength).alias("wavelength")))


# ---- masks and predicates


def mask_overexposed(px: DataFrame, saturation: float, clear: bool = True) -> DataFrame:
    """clear: values at or over saturation become 0 and not measured; otherwise moduli over it lose their mask and keep their value."""
    over = F.col("re") >= saturation if clear else modulus() > saturation
    out = px.withColumn("mask", F.when(over, 0).otherwise(F.col("mask")))
    return out.withColumns({c: F.when(F.col("re" if c == "im" else c) >= saturation, 0.0).otherwise(F.col(c)) for c in ("im", "re")}) if clear else out


def mask_external(px: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """other(on..., m): where m is 0 the pixel loses its mask."""
    return px.join(other, on).withColumn("mask", F.when(F.col("m") == 0, 0).otherwise(F.col("mask"))).drop("m")


def invert_mask(px: DataFrame) -> DataFrame:
    return px.withColumn("mask", F.when(F.col("mask") == 0, 1).otherwise(0))


def beamstop(px: DataFrame, distance: Column, radius: float, cross: float = 0.0, nx: int = 0, ny: int = 0) -> DataFrame:
    at = distance < radius
    if cross:
        at = at | (F.abs(F.col("x") - (nx - 1) / 2) < cross) | (F.abs(F.col("y") - (ny - 1) / 2) < cross)
    return px.withColumns({"re": F.when(at, 0.0).otherwise(F.col("re")), "im": F.when(at, 0.0).otherwise(F.col("im")), "mask": F.when(at, 0).otherwise(F.col("mask"))})


def mask_at_maximum(px: DataFrame) -> DataFrame:
    at = modulus() >= F.max(modulus()).over(Window.partitionBy("image_id"))
    return px.withColumn("mask", F.when(at, 0).otherwise(F.col("mask")))


def draw_mask(px: DataFrame, where: Column, value: int = 0) -> DataFrame:
    """Sets the mask where a predicate holds: lines (on x or y), disks of a pencil, or everything (to clear it)."""
    return px.withColumn("mask", F.when(where, value).otherwise(F.col("mask")))


def fill_blanks(px: DataFrame, filler: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """filler(x, y, v), moved by dx, dy: its modulus replaces pixels that are not measured; where it has none they stay."""
    f = filler.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.abs("v").alias("v"))
    hit = (F.col("mask") == 0) & F.col("v").isNotNull()
    x = px.join(f, ["x", "y"], "left")
    return x.withColumns({"re": F.when(hit, F.col("v")).otherwise(F.col("re")), "im": F.when(hit, 0.0).otherwise(F.col("im")), "mask": F.when(hit, 1).otherwise(F.col("mask"))}).drop("v")


def split_by_mask(px: DataFrame) -> DataFrame:
    """Each image twice: inside its mask and outside."""
    inside = F.explode(F.array(F.lit(True), F.lit(False)))
    out = px.withColumn("inside", inside)
    keep = (F.col("mask") != 0) == F.col("inside")
    return out.withColumns({"re": F.when(keep, F.col("re")).otherwise(0.0), "im": F.when(keep, F.col("im")).otherwise(0.0)})


def crop(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The rectangle with both ends, re-based to 0."""
    return px.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0, "i": (F.col("y") - y0) * (x1 - x0 + 1) + F.col("x") - x0})


def threshold_support(px: DataFrame, level: float, strict: bool = False) -> DataFrame:
    """1 where the modulus reaches (strict: passes) a level times the image's largest, else 0."""
    at = level * F.max(modulus()).over(Window.partitionBy("image_id"))
    return px.withColumns({"re": F.when((modulus() > at) if strict else (modulus() >= at), 1.0).otherwise(0.0), "im": F.lit(0.0)})


def area_threshold_support(px: DataFrame, area: float) -> DataFrame:
    """1 from the modulus that stands at place int(N * area) in descending order upwards; ties all stay."""
    w = Window.partitionBy("image_id")
    order = F.row_number().over(w.orderBy(modulus().desc(), "i")) - 1
    ranked = px.withColumns({"a": modulus(), "k": order, "n": F.count("*").over(w)})
    level = F.max(F.when(F.col("k") == F.least(F.floor(F.col("n") * area), F.col("n") - 1), F.col("a"))).over(w)
    return ranked.withColumn("level", level).withColumns({"re": F.when(F.col("a") >= F.col("level"), 1.0).otherwise(0.0), "im": F.lit(0.0)}).drop("a", "k", "n", "level")
