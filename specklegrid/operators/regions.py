"""Regions without their pixels: boxes by dyadic cells, and masks as runs.

A box is covered by at most four cells of a grid whose cells are powers of two as wide and as high as it, or wider; a point
looks up the one cell that holds it in each of the grids that boxes use. So a join of points with any number of boxes is an
equality on cells, of four rows a box and one a point and grid, and an exact test; no row stands for a pixel or a line
of a box. Coordinates are integers and may be negative.

Points are what is many, and each grid shuffles all of them once more. So sizes of boxes share grids where that is cheaper: counts of
boxes by size and of points, and the extent of the points, say how many rows a choice of grids shuffles and about how many
points each box will be tried with. Any choice gives the same result; a box of another size by far keeps a grid of its own.

A run is image_id, y, start, end (both within). Sets of runs are combined by a sweep along each line of an image: borders of
all runs are added up by place, running sums say which sets hold there, and segments that touch become one run. Rows
are in proportion to runs, and lines of an image are swept in different tasks.

Cases: boxes whose ends are the wrong way round, or null, hold nothing; equal boxes stay apart by their names; a run may
overlap others of its set; empty runs (end before start) count for nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What choices of grids are weighed: blocks of so many levels that share one, and what it costs to try a point with a box, where a row of the shuffle costs 1.
BLOCKS, TRIED = (1, 2, 3, 4, 6, 8, 16, 32, 64), 0.02
#: Which places belong to a combination of the sets a and b.
COMBINATIONS = {"union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "either": lambda a, b: (a | b) & ~(a & b)}


def _level(size: Column) -> Column:
    """The least power of two that isn't less than a size."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(F.lit(0)).cast("int")


def _levels(boxes: DataFrame) -> DataFrame:
    """Boxes that hold anything, with the levels lx and ly of their sizes."""
    return boxes.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))).withColumns({"lx": _level(F.col("x1").cast("long") - F.col("x0") + 1), "ly": _level(F.col("y1").cast("long") - F.col("y0") + 1)})


def chosen_grids(sizes: dict[tuple[int, int], int], points: int, extent: tuple[float, float], apart: int = 1) -> dict[tuple[int, int], tuple[int, int]]:
    """The grid of each size (levels lx, ly) of boxes, from how many boxes have it, how many points there are, in what extent, and how many images (apart) they are spread over: the cheapest of joining neighbouring levels by blocks of 1 to 64."""
    best = None
    for kx in BLOCKS:
        for ky in BLOCKS:
            groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for size in sizes:
                groups.setdefault((size[0] // kx, size[1] // ky), []).append(size)
            grid = {s: (max(g[0] for g in group), max(g[1] for g in group)) for group in groups.values() for s in group}
            cost = float(points * len(groups))
            for (lx, ly), n in sizes.items():
                gx, gy = grid[lx, ly]
                covers = (1 + 2.0 ** (lx - gx)) * (1 + 2.0 ** (ly - gy))
                tried = points / apart * min(1.0, 2.0**gx / extent[0]) * min(1.0, 2.0**gy / extent[1])
                cost += n * covers * (1 + TRIED * tried)
            if best is None or cost < best[0]:
                best = cost, grid
    return best[1]


def cells(boxes: DataFrame, grids: dict[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """boxes(x0, y0, x1, y1, ...) with the cells of their grids: lx, ly, cx, cy; up to four rows a box. grids: the grid of each size, where it isn't the size's own."""
    levels = _levels(boxes)
    if grids:
        of = lambda k: F.element_at(F.create_map(*[c for s, g in grids.items() for c in (F.lit(s[0] * 64 + s[1]), F.lit(g[k]))]), F.col("lx") * 64 + F.col("ly"))
        levels = levels.withColumns({"lx": of(0), "ly": of(1)})
    span = lambda a: F.explode(F.expr(f"sequence(shiftright(cast({a}0 AS long), l{a}), shiftright(cast({a}1 AS long), l{a}))"))
    return levels.withColumn("cx", span("x")).withColumn("cy", span("y"))


def in_boxes(points: DataFrame, boxes: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y, ...) with each of boxes(box, x0, y0, x1, y1; ends within) that holds them; on: columns that must be equal, as image_id where boxes belong to images."""
    sizes = {(r["lx"], r["ly"]): r["n"] for r in _levels(boxes).groupBy("lx", "ly").agg(F.count("*").alias("n")).collect()}  # 64 levels of width by 64 of height at most
    grids = [(0, 0)]
    if len(sizes) > 1:
        apart = F.approx_count_distinct(F.struct(*on)) if on else F.lit(1)
        p = points.agg(F.count("*").alias("n"), *[(F.max(c).cast("double") - F.min(c).cast("double") + 1).alias(c) for c in "xy"], apart.alias("apart")).first()
        chosen = chosen_grids(sizes, p["n"], (p["x"] or 1, p["y"] or 1), max(1, p["apart"]))
        cover, grids = cells(boxes, chosen), sorted(set(chosen.values()))
    else:
        cover, grids = cells(boxes), list(sizes) or grids
    within = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    same = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in on]
    wanted = [*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in boxes.columns if c not in on]]
    if len(grids) == 1:  # points are shuffled as they are
        equal = [F.shiftright(F.col(f"p.{c}").cast("long"), g) == F.col(f"b.c{c}") for c, g in zip("xy", grids[0], strict=True)]
        return points.alias("p").join(cover.alias("b"), [*same, *equal], "inner").where(within).select(*wanted)
    looked = F.explode(F.array(*[F.struct(F.lit(g[0]).alias("lx"), F.lit(g[1]).alias("ly")) for g in grids]))
    keyed = points.withColumn("grid_", looked).select("*", F.col("grid_.lx").alias("lx_"), F.col("grid_.ly").alias("ly_"), F.expr("shiftright(cast(x AS long), grid_.lx)").alias("cx_"), F.expr("shiftright(cast(y AS long), grid_.ly)").alias("cy_")).drop("grid_")
    equal = [F.col(f"{c}_") == F.col(c) for c in ("lx", "ly", "cx", "cy")]
    joined = keyed.alias("p").join(cover.alias("b"), [*same, *equal], "inner").where(within)
    return joined.select(*wanted)


# ---- runs


def runs_of(packed: DataFrame, inside) -> DataFrame:
    """Runs of the pixels of packed images (one layer) whose value satisfies inside(value); no shuffle."""
    p = packed.select("image_id", "nx", F.transform("re", inside).alias("p")).withColumn("n", F.size("p"))
    at = lambda i: F.coalesce(F.get("p", i), F.lit(False))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    starts = F.filter(every, lambda i: at(i) & ((i % F.col("nx") == 0) | ~at(i - 1)))
    ends = F.filter(every, lambda i: at(i) & (((i + 1) % F.col("nx") == 0) | ~at(i + 1)))
    found = p.where("n > 0").select("image_id", "nx", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r"))
    return found.select("image_id", F.floor(F.col("r.s") / F.col("nx")).cast("int").alias("y"), (F.col("r.s") % F.col("nx")).alias("start"), (F.col("r.e") % F.col("nx")).alias("end"))


def disc(images: DataFrame, x: Column, y: Column, radius: Column, nx: Column, ny: Column) -> DataFrame:
    """Runs of the pixels within a radius of a place, for each row of images(image_id, ...)."""
    first, last = F.greatest(F.ceil(y - radius), F.lit(0)), F.least(F.floor(y + radius), ny - 1)
    lines = images.select("image_id", x.alias("x"), y.alias("cy"), radius.alias("r"), nx.alias("nx"), F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))).alias("y"))
    half = F.sqrt(F.greatest(F.col("r") * F.col("r") - (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")), F.lit(0.0)))
    return lines.select("image_id", "y", F.greatest(F.ceil(F.col("x") - half), F.lit(0)).cast("int").alias("start"), F.least(F.floor(F.col("x") + half), F.col("nx") - 1).cast("int").alias("end")).where("start <= end")


def combined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """The union, intersection, difference or either-or of two sets of runs, as disjoint runs that don't touch."""
    if how not in COMBINATIONS:
        raise ValueError(f"no such combination: {how}; there are {', '.join(COMBINATIONS)}")
    border = lambda of, end, da, db: of.where(F.col("start") <= F.col("end")).select("image_id", "y", (F.col("end") + 1 if end else F.col("start")).cast("long").alias("x"), F.lit(da).alias("da"), F.lit(db).alias("db"))
    borders = border(a, False, 1, 0).unionByName(border(a, True, -1, 0)).unionByName(border(b, False, 0, 1)).unionByName(border(b, True, 0, -1))
    places = borders.repartition("image_id", "y").groupBy("image_id", "y", "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    line = Window.partitionBy("image_id", "y").orderBy("x")
    swept = places.select("image_id", "y", "x", F.lead("x").over(line).alias("next"), (F.sum("da").over(line) > 0).alias("a"), (F.sum("db").over(line) > 0).alias("b"))
    held = swept.where(COMBINATIONS[how](F.col("a"), F.col("b")))
    fresh = F.coalesce(F.col("x") != F.lag("next").over(line), F.lit(True))
    pieces = held.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(line))
    merged = pieces.groupBy("image_id", "y", "run").agg(F.min("x").alias("start"), (F.max("next") - 1).alias("end"))
    return merged.select("image_id", "y", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def area(runs: DataFrame) -> DataFrame:
    """image_id, n (pixels), runs: of disjoint runs."""
    return runs.groupBy("image_id").agg(F.sum(F.col("end").cast("long") - F.col("start") + 1).alias("n"), F.count("*").alias("runs"))
