"""Merging of exposures, real-space agreement, flags of frames and relations between image lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import checkpointed, modulus
from .aggregate import shell
from .selection import selected


def ordered_by_exposure(px: DataFrame) -> DataFrame:
    """image_id, exposure (sum of values), place from 0, least exposed first; ties by image_id. Only one row an image is sorted, in ranges of exposures whose sizes are then added up."""
    sums = px.groupBy("image_id").agg(F.sum("re").alias("exposure"))
    ranged = checkpointed(sums.repartitionByRange("exposure", "image_id").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("exposure", "image_id")) - 1
    return ranged.withColumn("within", within).join(before, "range").select("image_id", "exposure", (F.col("before") + F.col("within")).alias("place"))


def wilson(px: DataFrame, distance: Column, bins: int, most: float, *by: str) -> DataFrame:
    """The radial mean by shell, and its logarithm (null where it isn't positive)."""
    mean = F.avg("re")
    return px.groupBy(*by, shell(distance, bins, most).alias("shell")).agg(mean.alias("mean"), F.when(mean > 0, F.log(mean)).alias("log_mean"))


def plot_background(plots: DataFrame, *by: str) -> DataFrame:
    """The least mean of each Wilson plot: what lies under all of it."""
    return plots.groupBy(*by).agg(F.min("mean").alias("background"))


def relative_scale(plots: DataFrame, agreement: DataFrame, series: str, least: float = 0.95) -> DataFrame:
    """series, place, scale to the most exposed image of a series.

    plots(series, place, shell, mean); agreement(series, place, shell, cc) of an image with the next one. The scale of an
    image to the next is the mean ratio of their plots over their backgrounds, over the first run of shells in which they
    agree; scales multiply from the top down.
    """
    p = plots.join(plot_background(plots, series, "place"), [series, "place"]).select(series, "place", "shell", (F.col("mean") - F.col("background")).alias("v"))
    up = p.select(series, (F.col("place") - 1).alias("place"), "shell", F.col("v").alias("above"))
    z = p.join(up, [series, "place", "shell"]).join(agreement, [series, "place", "shell"])
    w = Window.partitionBy(series, "place").orderBy("shell")
    good = (F.col("cc") > least).cast("int")
    run = F.sum(F.when((F.col("good") == 1) & (F.coalesce(F.lag("good").over(w), F.lit(0)) == 0), 1).otherwise(0)).over(w)
    first = z.withColumn("good", good).withColumn("run", run).where("good = 1 and run = 1")
    step = first.groupBy(series, "place").agg(F.avg(F.col("above") / F.nullif(F.col("v"), F.lit(0.0))).alias("step"))
    places = plots.select(series, "place").distinct().join(step, [series, "place"], "left")
    below = Window.partitionBy(series).orderBy(F.desc("place"))
    size = F.abs(F.coalesce("step", F.lit(1.0)))
    product = F.when(F.min(size).over(below) == 0, 0.0).otherwise(F.exp(F.sum(F.log(size)).over(below)))
    return places.select(series, "place", product.alias("scale"))


def ramp_weights(agreement: DataFrame, series: str, bins: int, least: float = 0.95) -> DataFrame:
    """series, place, shell, weight: the weaker exposure for the shells inside, the stronger outside, and a linear ramp over the outermost run in which both agree. Weights of a shell add up to 1."""
    w = Window.partitionBy(series, "place").orderBy(F.desc("shell"))
    good = (F.col("cc") > least).cast("int")
    run = F.sum(F.when((F.col("good") == 1) & (F.coalesce(F.lag("good").over(w), F.lit(0)) == 0), 1).otherwise(0)).over(w)
    ends = agreement.withColumn("good", good).withColumn("run", run).where("good = 1 and run = 1").groupBy(series, "place").agg(F.max("shell").alias("begin"), (F.min("shell") - 1).alias("end"))
    shells = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    # the share of all shells' weight that goes to the image above `place`
    above = F.when(F.col("shell") > F.col("begin"), 1.0).when(F.col("shell") > F.col("end"), (F.col("shell") - F.col("end")) / (F.col("begin") - F.col("end"))).otherwise(0.0)
    passed = agreement.select(series, "place").distinct().join(ends, [series, "place"], "left").withColumn("shell", shells).select(series, "place", "shell", F.coalesce(above, F.lit(0.0)).alias("up"))
    w = Window.partitionBy(series, "shell").orderBy("place")
    # image 0 keeps 1 - up of its border; image p gets what passed all borders below it
    reach = F.coalesce(F.exp(F.sum(F.log(F.nullif("up", F.lit(0.0)))).over(w)), F.lit(0.0))
    blocked = F.max(F.when(F.col("up") == 0, 1).otherwise(0)).over(w)
    got = passed.withColumn("into", F.when(blocked == 1, 0.0).otherwise(reach))
    into = got.select(series, (F.col("place") + 1).alias("place"), "shell", "into").unionByName(got.where("place = 0").select(series, F.lit(0).cast(got.schema["place"].dataType).alias("place"), "shell", F.lit(1.0).alias("into")))
    out = into.join(passed, [series, "place", "shell"], "left")
    return out.select(series, "place", "shell", (F.col("into") * (1 - F.coalesce("up", F.lit(0.0)))).alias("weight"))


def ramp_merge(px: DataFrame, scales: DataFrame, backgrounds: DataFrame, weights: DataFrame, series: str) -> DataFrame:
    """Pixel table of each series: the sum over its images of (value - background) * scale * weight of the pixel's shell. px(series, place, i, shell, re), on one centre."""
    z = px.join(scales, [series, "place"]).join(backgrounds, [series, "place"]).join(weights, [series, "place", "shell"])
    return z.groupBy(series, "i").agg(F.sum((F.col("re") - F.col("background")) * F.col("scale") * F.col("weight")).alias("re"))


def recentred(px: DataFrame, shifts: DataFrame) -> DataFrame:
    """Pixels moved by their image's offset of centres: shifts(image_id, dx, dy); what leaves the grid stays outside it (no wrap)."""
    return px.join(shifts, "image_id").withColumns({"x": F.col("x") - F.col("dx"), "y": F.col("y") - F.col("dy")}).drop("dx", "dy")


def pairwise_ratio(px: DataFrame, series: str, saturation: float) -> DataFrame:
    """For each pixel of a series, the mean ratio of consecutive images where both are unsaturated and not zero; 0 without any."""
    w = Window.partitionBy(series, "i").orderBy("image_id")
    z = px.withColumn("before", F.lag("re").over(w))
    ok = (F.col("re") != 0) & (F.col("before") != 0) & (F.col("re") < saturation) & (F.col("before") < saturation)
    return z.groupBy(series, "i").agg(F.coalesce(F.avg(F.when(ok, F.col("before") / F.col("re"))), F.lit(0.0)).alias("ratio"))


def right_half_mean(px: DataFrame, nx: int) -> DataFrame:
    return px.where(F.col("x") >= nx // 2).groupBy("image_id").agg(F.avg("re").alias("background"))


def pair_correlations(px: DataFrame, series: str, most: int = 5) -> DataFrame:
    """series, r: the mean correlation of all pairs i < j of the first `most` images of each series."""
    firsts = px.select(series, "image_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy(series).orderBy("image_id"))).where(F.col("k") <= most)
    z = px.join(firsts, [series, "image_id"]).select(series, "i", "k", "re")
    pairs = z.join(z.select(series, "i", F.col("k").alias("k2"), F.col("re").alias("re2")), [series, "i"]).where("k < k2")
    return pairs.groupBy(series, "k", "k2").agg(F.corr("re", "re2").alias("r")).groupBy(series).agg(F.avg("r").alias("r"))


def flagged_background(px: DataFrame, flags: DataFrame, series: str) -> DataFrame:
    """Mean by pixel of the frames that flags(image_id, background) marks, each first brought to its series' mean intensity."""
    marked = px.join(flags.where("background"), "image_id")
    means = marked.groupBy(series, "image_id").agg(F.avg("re").alias("own"))
    level = means.groupBy(series).agg(F.avg("own").alias("level"))
    z = marked.join(means.drop(series), "image_id").join(level, series)
    return z.groupBy(series, "i").agg(F.avg(F.col("re") * F.col("level") / F.nullif(F.col("own"), F.lit(0.0))).alias("re"))


def set_flags(frames: DataFrame, hit: Column, background: Column) -> DataFrame:
    """Flags of frames that predicates set; a hit is no background."""
    return frames.withColumns({"hit": F.coalesce(hit, F.lit(False)), "background": F.coalesce(background, F.lit(False)) & ~F.coalesce(hit, F.lit(False))})


def real_space_agreement(z: DataFrame, *by: str) -> DataFrame:
    """r and cc of superimposed images: z(by..., a, b) of moduli. r is the share of the moduli in which they differ."""
    return z.groupBy(*by).agg((F.sum(F.abs(F.col("a") - F.col("b"))) / F.nullif(F.sum(F.col("a") + F.col("b")), F.lit(0.0))).alias("r"), F.corr("a", "b").alias("cc"))


def phase_error_profile(z: DataFrame, distance: Column, bins: int, most: float) -> DataFrame:
    """Mean phase difference, wrapped to half a turn, by shell: z(image_id, re, im, re2, im2) of two transforms."""
    import math

    gap = F.pmod(F.atan2("im", "re") - F.atan2("im2", "re2"), F.lit(2 * math.pi))
    return z.groupBy("image_id", shell(distance, bins, most).alias("shell")).agg(F.avg(F.least(gap, 2 * math.pi - gap)).alias("error"), F.count("*").alias("n"))


def snapshot_difference(px: DataFrame, by: str, order: str) -> DataFrame:
    """For each snapshot of a run, the sum over pixels of the modulus' change since the one before (null for the first)."""
    w = Window.partitionBy(by, "i").orderBy(order)
    a = modulus()
    return px.withColumn("change", F.abs(a - F.lag(a).over(w))).groupBy(by, order).agg(F.sum("change").alias("int_cum_fluctuation"))


def weak_pixels(px: DataFrame, share: float) -> DataFrame:
    """Marks measured pixels up to the modulus at place int(n share) from the top of their image; the level is selected without sorting an image's pixels."""
    z = px.withColumn("a", modulus())
    level = selected(z, "image_id", "a", lambda n: F.least(F.floor(n * share), n - 1), from_top=True)
    return z.join(level, "image_id").withColumn("weak", (F.col("mask") != 0) & (F.col("a") <= F.col("level"))).drop("a", "level")


def neighbours_in_list(files: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """The file before and after each in its category."""
    w = Window.partitionBy(by).orderBy(order)
    return files.withColumns({"previous": F.lag(name).over(w), "next": F.lead(name).over(w)})


def unseen(files: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    return files.join(seen, on, "left_anti")


def with_log(runs: DataFrame, logs: DataFrame, on: str) -> DataFrame:
    return runs.join(logs, on, "left_semi")


def unite_regions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels (image_id, i) of either region."""
    return a.select("image_id", "i").union(b.select("image_id", "i")).distinct()


def subtract_region(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("image_id", "i").join(b.select("image_id", "i"), ["image_id", "i"], "left_anti").distinct()


def list_union(a: Column | str, b: Column | str) -> Column:
    return F.array_union(a, b)


def asof_both(left: DataFrame, right: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Both neighbours of each left row in the right side and the line between them: value_before, value_after, value (linear; at an end the one there is)."""
    kind = right.schema[value].dataType
    both = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("v"), F.lit(None).cast("double").alias("at")).unionByName(
        right.select(by, order, F.lit(0).alias("side"), F.col(value).alias("v"), F.col(order).cast("double").alias("at")), allowMissingColumns=True)
    w = Window.partitionBy(by)
    lo = w.orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0)
    hi = w.orderBy(order, F.desc("side")).rowsBetween(0, Window.unboundedFollowing)
    z = both.withColumns({f"{value}_before": F.last("v", True).over(lo), "k0": F.last("at", True).over(lo), f"{value}_after": F.first("v", True).over(hi), "k1": F.first("at", True).over(hi)}).where("side = 1")
    v0, v1, t = F.col(f"{value}_before"), F.col(f"{value}_after"), F.col(order).cast("double")
    line = F.when(F.col("k0") == F.col("k1"), v0).otherwise(v0 + (v1 - v0) * (t - F.col("k0")) / F.nullif(F.col("k1") - F.col("k0"), F.lit(0.0)))
    return z.withColumn(value, F.coalesce(line, v0, v1)).drop("side", "v", "at", "k0", "k1")


def mean_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) / len(columns)
