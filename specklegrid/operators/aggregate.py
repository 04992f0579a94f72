"""Aggregations over pixel tables: by image, by pixel across images, by radial shell, and between pairs of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import modulus


def integrate(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.sum("re").alias("sum_re"), F.sum("im").alias("sum_im"), F.sum(modulus()).alias("sum_abs"), F.avg(modulus()).alias("mean_abs"), F.stddev_pop(modulus()).alias("sigma_abs"))


def panel_integrate(px: DataFrame, panel: Column) -> DataFrame:
    return px.groupBy("image_id", panel.alias("panel")).agg(F.sum("re").alias("sum_re"))


def extremes(px: DataFrame, where: Column | None = None) -> DataFrame:
    """Least and largest value and where the largest is (ties: the least index)."""
    px = px.where(where) if where is not None else px
    return px.groupBy("image_id").agg(F.min("re").alias("least"), F.max("re").alias("most"), F.max_by("i", F.struct("re", -F.col("i"))).alias("at"))


def shell(distance: Column, bins: int, most: float) -> Column:
    return F.least(F.floor(distance * bins / most), F.lit(bins - 1)).cast("int")


def radial_profile(px: DataFrame, distance: Column, bins: int, most: float, measured: bool = False) -> DataFrame:
    """Mean, relative sample deviation (null for a single pixel) and count of moduli by shell."""
    px = px.where("mask <> 0") if measured else px
    a = modulus()
    return px.groupBy("image_id", shell(distance, bins, most).alias("shell")).agg(F.avg(a).alias("mean"), (F.stddev_samp(a) / F.nullif(F.avg(a), F.lit(0.0))).alias("rel_sigma"), F.count("*").alias("n"))


def pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Positional zip of two pixel tables: an equi-join on the pixel; values a and b."""
    return a.select(*on, F.col("re").alias("a"), *[c for c in ("x", "y", "mask") if c not in on]).join(b.select(*on, F.col("re").alias("b")), on)


def r_factor(z: DataFrame, *by: Column | str) -> DataFrame:
    return z.groupBy(*by).agg((F.sum(F.abs(F.abs("a") - F.abs("b"))) / F.nullif(F.sum(F.abs("a") + F.abs("b")), F.lit(0.0))).alias("r"))


def regression(z: DataFrame, *by: str) -> DataFrame:
    """|b| = slope * |a| + inter."""
    a, b = F.abs("a"), F.abs("b")
    return z.groupBy(*by).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("inter"))


def regression_scale(z: DataFrame, *by: str) -> DataFrame:
    """b on the scale of a, by its modulus: what is under the intercept becomes 0, signs stay."""
    x = z.join(regression(z, *by), list(by))
    m = F.abs("b")
    return x.withColumn("scaled", F.when((m < F.col("inter")) | (m == 0), 0.0).otherwise(F.col("b") * (m - F.col("inter")) / m / F.nullif(F.col("slope"), F.lit(0.0))))


def correlation(z: DataFrame, *by: str) -> DataFrame:
    return z.groupBy(*by).agg(F.corr("a", "b").alias("r"))


def inner_product(z: DataFrame, *by: str) -> DataFrame:
    """Sum of a conj(b) over pixels of z(by..., re, im, re2, im2)."""
    return z.groupBy(*by).agg(F.sum(F.col("re") * F.col("re2") + F.col("im") * F.col("im2")).alias("re"), F.sum(F.col("im") * F.col("re2") - F.col("re") * F.col("im2")).alias("im"))


def histogram(df: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))


def average(px: DataFrame, *by: str) -> DataFrame:
    return px.groupBy(*by, "i").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.count("*").alias("n"))


def weighted_merge(shots: DataFrame, *by: str) -> DataFrame:
    """shots(by..., v, back, time, saturation): the mean of (v - back) / time over unsaturated shots; without any, 2 * saturation and mask 0."""
    ok = F.col("v") < F.col("saturation")
    n = F.sum(ok.cast("int"))
    mean = F.sum(F.when(ok, (F.col("v") - F.col("back")) / F.nullif(F.col("time"), F.lit(0.0)))) / F.nullif(n, F.lit(0))
    return shots.groupBy(*by).agg(F.coalesce(mean, 2 * F.max("saturation")).alias("re"), F.when(n > 0, 1).otherwise(0).alias("mask"))


def row_median_subtract(px: DataFrame, panel: Column) -> DataFrame:
    """Common mode: the exact median of each panel's row is subtracted."""
    return px.withColumn("re", F.col("re") - F.percentile("re", F.lit(0.5)).over(Window.partitionBy("image_id", panel, "y")))


def line_mean_subtract(px: DataFrame, axis: str, where: Column) -> DataFrame:
    """The mean of the selected part of each column (axis x) or row (axis y) is subtracted from all of it."""
    mean = F.avg(F.when(where, F.col("re"))).over(Window.partitionBy("image_id", axis))
    return px.withColumn("re", F.col("re") - F.coalesce(mean, F.lit(0.0)))


def strip_background(px: DataFrame, top: Column, side: Column) -> DataFrame:
    """Column means of a top strip, then row means of side bands, both subtracted."""
    return line_mean_subtract(line_mean_subtract(px, "x", top), "y", side)


def box_signal(px: DataFrame, x: Column, y: Column, reach: int, *keep: str) -> DataFrame:
    """The sum in a box of each image; columns of `keep` are the same in all of an image's rows."""
    at = (F.abs(F.col("x") - x) <= reach) & (F.abs(F.col("y") - y) <= reach)
    return px.groupBy("image_id", *keep).agg(F.sum(F.when(at, F.col("re")).otherwise(0.0)).alias("signal"))


def prtf(px: DataFrame, *by: str) -> DataFrame:
    """Phase retrieval transfer function by pixel: modulus of the mean unit phase over runs; 0 where a run has no modulus."""
    m = modulus()
    unit = lambda c: F.avg(F.col(c) / F.nullif(m, F.lit(0.0)))
    return px.groupBy(*by, "i").agg(F.when(F.min(m) == 0, 0.0).otherwise(F.hypot(unit("re"), unit("im"))).alias("prtf"))


def convergence(px: DataFrame) -> DataFrame:
    """Of run(image_id, re, im, support, fourier_abs, amplitude, mask): ereal, efourier, fcfo and sup_size."""
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    of = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    s, m = F.col("support") != 0, F.col("mask") != 0
    gap = F.col("fourier_abs") - F.col("amplitude")
    some = lambda v: F.nullif(v, F.lit(0.0))
    return px.groupBy("image_id").agg(
        (of(~s, power) / some(of(s, power))).alias("ereal"), (of(m, gap * gap) / some(of(m, F.col("amplitude") * F.col("amplitude")))).alias("efourier"),
        (F.sum("fourier_abs") / some(F.sum("amplitude"))).alias("fcfo"), (100.0 * F.sum(s.cast("int")) / F.count("*")).alias("sup_size"),
    )


def hits(signals: DataFrame, by: str, sigmas: float = 1 / 3) -> DataFrame:
    """Statistical hit finder: signals over the group's mean + sigmas * population deviation."""
    stats = signals.groupBy(by).agg(F.avg("signal").alias("mean"), F.stddev_pop("signal").alias("sigma"))
    return signals.join(stats, by).withColumn("hit", F.col("signal") > F.col("mean") + F.col("sigma") * sigmas)


# ---- series


def running_mean(df: DataFrame, by: str, order: list[str], value: str, width: int = 500) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    mean = F.avg(value).over(w.rowsBetween(1 - width, 0))
    return df.withColumns({"running": mean, "delta": F.col(value) - F.lag(value).over(w)})


def sliding_correlation(z: DataFrame, by: str, order: str, width: int = 20) -> DataFrame:
    """The correlation of `width` values from each place on, fewer at the end; NaN where either side is constant (corr() divides by zero there)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(0, width - 1)
    a, b = F.when(F.col("b").isNotNull(), F.col("a")), F.when(F.col("a").isNotNull(), F.col("b"))
    moved = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return z.withColumn("r", F.when(moved == 0, float("nan")).otherwise(F.covar_pop("a", "b").over(w) / F.nullif(moved, F.lit(0.0))))


def interpolate_missing(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """A null becomes the mean of its left and right neighbour, left to right: a filled one counts as a left neighbour, a null on the right takes the left one; at the start the next value, where there is one.

    In a gap that k nulls after value a end with b, the j-th one is a for j < k and (a + b) / 2 for the last.
    """
    w = Window.partitionBy(by).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("filled", F.coalesce(value, F.when(before.isNull(), F.lead(value).over(w)), (before + F.lead(value).over(w)) / 2, before))


def decimate(df: DataFrame, by: str, order: list[str], samples: int = 20) -> DataFrame:
    w = Window.partitionBy(by)
    k, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    stride = F.greatest(F.ceil(F.col("n_all") / samples), F.lit(1))
    return df.withColumns({"k": k, "n_all": n}).where(F.col("k") % stride == 0).drop("k", "n_all")


def newest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each group, as a partial aggregate."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, "r.*")


def asof(left: DataFrame, right: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The right side's last value at or before each left row's order: one union and one window, no range join."""
    both = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("v")).unionByName(right.select(by, order, F.lit(0).alias("side"), F.col(value).alias("v")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("v", ignorenulls=True).over(w)).where("side = 1").drop("side", "v")
