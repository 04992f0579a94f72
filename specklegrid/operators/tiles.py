"""Images and volumes that are larger than a row, as tables of tiles.

A tile is a row: image_id, tz, ty, tx (its place in the grid of tiles), nz, ny, nx (the size of the whole image), d, h, w (its own
size) and v (array<double>, x fastest; of complex images re and im instead). All tiles have the side of the first one but the
last along each axis, which may be smaller.

Neighbourhood operators exchange halos: each tile sends the strips of its borders to its neighbours (periodically), which
join them by key, so what is shuffled in a round is in proportion to the edges of tiles, not to their areas. dealt() lays
tiles by their key once; rounds after it only move strips. An operator of many rounds takes a halo as wide as several
rounds reach, does these in the task, and exchanges again; each exchange's tiles are written in buckets of their key. Tiles that were
dealt have a column `key` more, by which they lie.

Transforms go one axis at a time. A pass gathers the tiles of a line along its axis in a task, transforms the lines of
pixels there and cuts the strip into tiles again: one shuffle an axis, and none along an axis that single tiles
span (as strips of whole rows do). A task holds a strip, whatever the size of the image.

Cases: a halo must not be wider than the smallest tile (an error says so where it is); tiles of no neighbours along an
axis are their own; an empty table gives no rows; a null v is an error of the data and fails; missing tiles fail too, with the
number of strips that came.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frames import scratch
from .selection import selected

KEYS = ["image_id", "tz", "ty", "tx"]
PLACE = "image_id long, tz int, ty int, tx int, nz int, ny int, nx int, d int, h int, w int"
TILES, COMPLEX_TILES = f"{PLACE}, v array<double>", f"{PLACE}, re array<double>, im array<double>"
_NAMES = [c.split()[0] for c in PLACE.split(", ")]


def arrays_of(column: pa.Array, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    """The arrays of a list column, each in its shape."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return [flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)]


def list_of(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([a.size for a in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)))


def cut(packed: DataFrame, side: int) -> DataFrame:
    """Packed images as tiles of their real parts (for images that still fit a row)."""
    names = [c.split()[0] for c in TILES.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                image, nx, ny, nz, re = (batch.column(i)[k].as_py() if i < 4 else batch.column(i).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for i in range(5))
                yield pa.record_batch(_columns(image, re.reshape(nz, ny, nx), (nz, ny, nx), side, (0, 0, 0)), names)

    return packed.select("image_id", "nx", "ny", "nz", "re").mapInArrow(run, TILES)


def _columns(image, whole: np.ndarray, shape, side, at) -> list:
    """Columns of the tiles of an array that begins at place `at` (in tiles) of its image."""
    places, parts = [], []
    step = (side,) * 3 if isinstance(side, int) else side
    for z in range(0, whole.shape[0], step[0]):
        for y in range(0, whole.shape[1], step[1]):
            for x in range(0, whole.shape[2], step[2]):
                part = whole[z : z + step[0], y : y + step[1], x : x + step[2]]
                places.append((at[0] + z // step[0], at[1] + y // step[1], at[2] + x // step[2], *shape, *part.shape))
                parts.append(part)
    ints = np.array(places, np.int32).reshape(len(places), 9)
    head = [pa.array([image] * len(places), pa.int64()), *[pa.array(ints[:, i]) for i in range(9)]]
    if np.iscomplexobj(whole):
        return [*head, list_of([p.real for p in parts]), list_of([p.imag for p in parts])]
    return [*head, list_of(parts)]


def key_of(*place: Column) -> Column:
    return F.concat_ws("/", *[c.cast("string") for c in place])


def dealt(tiles: DataFrame, partitions: int | None = None) -> DataFrame:
    """Tiles laid by their key, a column of its own (one column, so that joins on it find it as it lies); as they are where they have it."""
    if "key" in tiles.columns:
        return tiles
    return tiles.withColumn("key", key_of(*map(F.col, KEYS))).repartition(*([partitions] if partitions else []), "key")


def kept(tiles: DataFrame) -> DataFrame:
    """Tiles written to the shared folder, in buckets of their key: lineage ends, and later joins by key find them as they lie."""
    spark = tiles.sparkSession
    path = scratch(spark, "tiles")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    dealt(tiles).write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame reads them
    return out


# ---- halos


def _strip(v: Column, parts: list[tuple[Column, Column]], h: Column, w: Column) -> Column:
    """The part [z0, z1) x [y0, y1) x [x0, x1) of a tile's array."""
    (z0, z1), (y0, y1), (x0, x1) = parts
    lines = F.transform(F.sequence(z0 * (y1 - y0), z1 * (y1 - y0) - 1), lambda k: F.slice(v, (F.floor(k / (y1 - y0)) * h + y0 + k % (y1 - y0)).cast("int") * w + x0 + 1, x1 - x0))
    return F.flatten(lines)


def halos(tiles: DataFrame, reach: int, values: str = "v") -> DataFrame:
    """tiles (of gridded()) with `halo`, an array of (dz, dy, dx, strip): what lies beyond each side of a tile, reach pixels wide. Only the strips are shuffled (and tiles that don't lie by their key yet)."""
    sides = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) != (0, 0, 0)]
    size = {"z": F.col("d"), "y": F.col("h"), "x": F.col("w")}

    def sent(dz, dy, dx):
        """The strip that the neighbour at (dz, dy, dx) needs: it lies beyond that one's side (-dz, -dy, -dx)."""
        parts = [(F.lit(0), n) if step == 0 else (n - reach, n) if step > 0 else (F.lit(0), F.lit(reach)) for step, n in zip((dz, dy, dx), size.values(), strict=True)]
        to = [F.pmod(F.col(f"t{a}") + step, F.col(f"tiles{a}")) for a, step in zip("zyx", (dz, dy, dx), strict=True)]
        return F.struct(key_of(F.col("image_id"), *[t.cast("int") for t in to]).alias("key"), F.struct(F.lit(-dz).alias("dz"), F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), _strip(F.col(values), parts, F.col("h"), F.col("w")).alias("strip")).alias("s"))

    flat = [s for s in sides if s[0] == 0]  # images of one layer have no neighbours above and below
    small = F.least(F.col("h"), F.col("w"), F.when(F.col("nz") > 1, F.col("d")).otherwise(F.col("h"))) < reach
    wide = F.when(small, F.raise_error(F.lit(f"a tile is smaller than the halo of {reach}"))).otherwise(F.array(*[sent(*s) for s in flat]))
    cubes = F.when(small, F.raise_error(F.lit(f"a tile is smaller than the halo of {reach}"))).otherwise(F.array(*[sent(*s) for s in sides]))
    strips = tiles.select(F.explode(F.when(F.col("nz") == 1, wide).otherwise(cubes)).alias("e")).select("e.key", "e.s")
    return tiles.join(strips.groupBy("key").agg(F.collect_list("s").alias("halo")), "key")  # 8 or 26 strips a tile


def gridded(tiles: DataFrame, side: int) -> DataFrame:
    """Dealt tiles with tilesz, tilesy, tilesx, the number of tiles along each axis."""
    return dealt(tiles).withColumns({f"tiles{a}": F.ceil(F.col(f"n{a}") / side).cast("int") for a in "zyx"})


def _widened(v: np.ndarray, halo: list[dict], reach: int) -> np.ndarray:
    """A tile within its halo."""
    layers = reach if v.shape[0] > 1 or any(s["dz"] for s in halo) else 0
    out = np.empty((v.shape[0] + 2 * layers, v.shape[1] + 2 * reach, v.shape[2] + 2 * reach))
    margins = (layers, reach, reach)
    out[tuple(slice(m, m + n) for m, n in zip(margins, v.shape, strict=True))] = v
    if len(halo) != (26 if layers else 8):
        raise ValueError(f"a tile got {len(halo)} strips; there are tiles missing")
    for s in halo:
        at = tuple(slice(m, m + n) if step == 0 else slice(0, m) if step < 0 else slice(m + n, n + 2 * m) for step, m, n in zip((s["dz"], s["dy"], s["dx"]), margins, v.shape, strict=True))
        out[at] = np.asarray(s["strip"]).reshape(out[at].shape)
    return out


def stencil(tiles: DataFrame, side: int, reach: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles after f, which takes a tile within its halo of `reach` and gives the tile (its halo gone)."""
    wide = halos(gridded(tiles, side), reach)

    @F.arrow_udf("array<double>")
    def apply(d: pa.Array, h: pa.Array, w: pa.Array, v: pa.Array, halo: pa.Array) -> pa.Array:
        shapes = list(zip(d.to_pylist(), h.to_pylist(), w.to_pylist(), strict=True))
        out = []
        for k, whole in enumerate(arrays_of(v, shapes)):
            out.append(f(_widened(whole, _halo_of(halo, k), reach)))
        return list_of(out)

    return wide.select("key", *_NAMES, apply("d", "h", "w", "v", "halo").alias("v"))


def _halo_of(halo: pa.Array, k: int) -> list[dict]:
    one = halo.slice(k, 1).flatten()
    steps = [one.field(n).to_pylist() for n in ("dz", "dy", "dx")]
    strips, ends = one.field("strip").flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(one.field("strip").value_lengths().to_numpy(zero_copy_only=False))]
    return [{"dz": a, "dy": b, "dx": c, "strip": strips[i:j]} for a, b, c, i, j in zip(*steps, ends[:-1], ends[1:], strict=True)]


def _sums(v: np.ndarray, reach: int) -> np.ndarray:
    """Sums of the boxes of 2 reach + 1 pixels along each axis that has a halo."""
    for axis in range(3):
        if axis or v.shape[0] > 2 * reach:
            n = v.shape[axis] - 2 * reach
            v = sum(np.take(v, range(k, k + n), axis) for k in range(2 * reach + 1))
    return v


def box_blur(tiles: DataFrame, side: int, reach: int) -> DataFrame:
    """The mean of each pixel's box, periodic."""
    flat = lambda wide: wide.shape[0] == 1
    return stencil(tiles, side, reach, lambda wide: _sums(wide, reach) / (2 * reach + 1) ** (2 if flat(wide) else 3))


def zero_near_negative(tiles: DataFrame, side: int) -> DataFrame:
    """Pixels with a negative one among their eight neighbours or themselves become 0 (images of one layer)."""

    def f(wide):
        h, w = wide.shape[1] - 2, wide.shape[2] - 2
        least = np.min([wide[:, y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0)
        return np.where(least < 0, 0.0, wide[:, 1:-1, 1:-1])

    return stencil(tiles, side, 1, f)


def gaussian_blur(tiles: DataFrame, side: int, sigma: float, reach: int) -> DataFrame:
    """A Gaussian cut at `reach`, by sums over rows and then columns, periodic (images of one layer)."""
    weight = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    weight /= weight.sum()

    def f(wide):
        for axis in (1, 2):
            n = wide.shape[axis] - 2 * reach
            wide = sum(c * np.take(wide, range(k, k + n), axis) for k, c in enumerate(weight))
        return wide

    return stencil(tiles, side, reach, f)


def tv_denoise(tiles: DataFrame, side: int, weight: float = 0.1, step: float = 0.1, rounds: int = 50, together: int = 4) -> DataFrame:
    """Poisson total-variation denoising with periodic differences; `together` rounds are done between two exchanges of halos, each reaching two pixels (images of one layer)."""
    together = max(1, min(together, rounds))
    margin = 2 * together
    half = lambda x, k: (np.roll(x, -1, k) - np.roll(x, 1, k)) / 2  # noqa: E731  # what is rolled around the ends is cut off below

    @F.arrow_udf("array<double>")
    def widen(d: pa.Array, h: pa.Array, w: pa.Array, v: pa.Array, halo: pa.Array) -> pa.Array:
        shapes = list(zip(d.to_pylist(), h.to_pylist(), w.to_pylist(), strict=True))
        return list_of([_widened(x, _halo_of(halo, k), margin) for k, x in enumerate(arrays_of(v, shapes))])

    def descended(n: int):
        @F.arrow_udf("array<double>")
        def descend(d: pa.Array, h: pa.Array, w: pa.Array, v: pa.Array, halo: pa.Array, data: pa.Array) -> pa.Array:
            out, shapes = [], list(zip(d.to_pylist(), h.to_pylist(), w.to_pylist(), strict=True))
            whole = [(a, b + 2 * margin, c + 2 * margin) for a, b, c in shapes]
            for k, (x, seen) in enumerate(zip(arrays_of(v, shapes), arrays_of(data, whole), strict=True)):
                u = _widened(x, _halo_of(halo, k), margin)
                for _ in range(n):
                    g = [half(u, a) for a in (1, 2)]
                    length = np.sqrt(g[0] ** 2 + g[1] ** 2 + 1e-8)
                    curl = half(g[0] / length, 1) + half(g[1] / length, 2)
                    u = np.maximum(u - step * (1 - seen / u - weight * curl), 1e-6)
                out.append(u[:, margin:-margin, margin:-margin])
            return list_of(out)

        return descend("d", "h", "w", "v", "halo", "data")

    positive = tiles.withColumn("v", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))))
    first = F.transform("v", lambda x: F.greatest(x, F.lit(1e-6)))
    now = kept(halos(gridded(positive, side), margin).select("key", *_NAMES, first.alias("v"), widen("d", "h", "w", "v", "halo").alias("data")))
    for done in range(0, rounds, together):
        last = done + together >= rounds
        now = halos(gridded(now, side), margin).select("key", *_NAMES, descended(min(together, rounds - done)).alias("v"), "data")
        now = now if last else kept(now)
    return now.drop("data")


def area_support(tiles: DataFrame, area: float) -> DataFrame:
    """1 where the modulus is at least the one that a share `area` of the image's pixels passes, else 0; the level is selected exactly over all tiles of an image."""
    size = F.transform("v", F.abs)
    levels = selected(tiles.select("image_id", size.alias("a")), "image_id", "a", lambda n: F.least(F.floor(n * area), n - 1), from_top=True)
    return tiles.join(levels, "image_id").withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) >= F.col("level"), 1.0).otherwise(0.0))).drop("level")


# ---- transforms


def complex_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles of real values as complex ones."""
    return tiles.select(*_NAMES, F.col("v").alias("re"), F.transform("v", lambda x: F.lit(0.0)).alias("im"))


def _along(tiles: DataFrame, axis: int, side: tuple[int, int, int], inverse: bool, spanned: bool) -> DataFrame:
    """The transform along one axis (0: z, 1: y, 2: x) of tiles, cut into tiles of `side` (z, y, x)."""
    names = [c.split()[0] for c in COMPLEX_TILES.split(", ")]
    place = ["tz", "ty", "tx"][axis]

    def line(image: int, rows: list) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r[0][axis])
        whole = np.concatenate([r[2] for r in rows], axis)
        shape = rows[0][1]
        if whole.shape[axis] != shape[axis]:
            raise ValueError(f"tiles of image {image} hold {whole.shape[axis]} of {shape[axis]} pixels along axis {axis}")
        whole = np.fft.ifft(whole, axis=axis) * shape[axis] if inverse else np.fft.fft(whole, axis=axis)
        step = [n if k != axis else side[k] for k, n in enumerate(whole.shape)]
        at = [0 if k == axis else rows[0][0][k] for k in range(3)]
        return _columns(image, whole, shape, tuple(step), at)

    def rows_of(t):
        ints = [t.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(10)]
        shapes = list(zip(*ints[7:10], strict=True))
        re, im = (arrays_of(t.column(i).combine_chunks() if isinstance(t.column(i), pa.ChunkedArray) else t.column(i), shapes) for i in (10, 11))
        return [(image, (r[0], r[1], r[2]), (r[3], r[4], r[5]), a + 1j * b) for image, *r, a, b in zip(ints[0], *ints[1:7], re, im, strict=True)]

    if spanned:

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    for image, at, shape, v in rows_of(batch.slice(k, 1)):
                        yield pa.record_batch(line(image, [(at, shape, v)]), names)

        return tiles.select(*names).mapInArrow(run, COMPLEX_TILES)

    def gathered(t: pa.Table) -> pa.Table:
        found = rows_of(t)
        return pa.table(line(found[0][0], [r[1:] for r in found]), names)

    by = [k for k in KEYS if k != place]
    return tiles.select(*names).groupBy(*by).applyInArrow(gathered, COMPLEX_TILES)


def transform(tiles: DataFrame, side: int, inverse: bool = False, spanned: str = "", volume: bool = False) -> DataFrame:
    """The unnormalised transform of complex tiles, forward or inverse: along x, then y (then z, for a volume). spanned: axes that single tiles span, along which nothing is shuffled. The result has tiles of `side` (along z, those of the input unless it is a volume)."""
    for axis in (2, 1, 0) if volume else (2, 1):
        tiles = _along(tiles, axis, (side,) * 3, inverse, "zyx"[axis] in spanned)
    return tiles
