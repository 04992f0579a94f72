"""Queries over images that are larger than a row (mosaics of the 8 x 8 images of `embeddings`), over stores of frames and files, and of exact selection, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..model import images, unpack
from ..operators import regions, selection, tiles, volume
from ..sources import frames
from .pixel_queries import r6, sql6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIDE, ACROSS = 8, 4
WIDE = SIDE * ACROSS


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def mosaics(spark, sf_dir: str):
    """Every 16 images by id as one of 32 x 32 in tiles of 8 x 8; places without an image are dark."""
    p = images(spark, sf_dir).select(F.floor(F.col("image_id") / 16).alias("image_id"), F.pmod("image_id", F.lit(16)).cast("int").alias("k"), F.col("re").alias("v"))
    places = p.select("image_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    whole = places.join(p, ["image_id", "k"], "left")
    ints = {"tz": F.lit(0), "ty": F.floor(F.col("k") / ACROSS).cast("int"), "tx": F.col("k") % ACROSS, "nz": F.lit(1), "ny": F.lit(WIDE), "nx": F.lit(WIDE), "d": F.lit(1), "h": F.lit(SIDE), "w": F.lit(SIDE)}
    return whole.select("image_id", *[c.cast("int").alias(n) for n, c in ints.items()], F.coalesce("v", F.array_repeat(F.lit(0.0), SIDE * SIDE)).alias("v"))


def pixels_of(t, *values: str, deep: bool = False):
    """image_id, x, y (and z) and values of tiles."""
    cells = t.select("image_id", "tz", "ty", "tx", "d", "h", "w", F.posexplode(F.arrays_zip(*values)).alias("i", "c"))
    at = {"x": F.col("tx") * SIDE + F.col("i") % F.col("w"), "y": F.col("ty") * SIDE + F.floor(F.col("i") / F.col("w")) % F.col("h")}
    if deep:
        at["z"] = F.col("tz") * SIDE + F.floor(F.col("i") / (F.col("w") * F.col("h")))
    return cells.select("image_id", *[c.cast("long").alias(n) for n, c in at.items()], *[F.col(f"c.{v}") for v in values])


BIG = f"""ids AS (SELECT DISTINCT vec_id // 16 AS image_id FROM embeddings WHERE len(embedding) = 64),
big AS (SELECT g.image_id, ((k % {ACROSS}) * 8 + i % 8)::BIGINT AS x, ((k // {ACROSS}) * 8 + i // 8)::BIGINT AS y, coalesce(round(e.embedding[i + 1]::DOUBLE * 1000, 3), 0) AS re
  FROM ids g CROSS JOIN (SELECT unnest(range(16)) AS k) CROSS JOIN (SELECT unnest(range(64)) AS i) LEFT JOIN embeddings e ON e.vec_id = g.image_id * 16 + k AND len(e.embedding) = 64)"""


def near(reach: int) -> str:
    """Each pixel with all of its box, periodic."""
    n = 2 * reach + 1
    return f"""near AS (SELECT b.image_id, (b.x + dx + {WIDE}) % {WIDE} AS x, (b.y + dy + {WIDE}) % {WIDE} AS y, dx, dy, b.re AS v
  FROM big b, (SELECT unnest(range({n})) - {reach} AS dx), (SELECT unnest(range({n})) - {reach} AS dy))"""


@query("tiled_box_blur", f"WITH {BIG}, {near(2)} SELECT image_id, x, y, {sql6('avg(v)')} AS re FROM near GROUP BY image_id, x, y")
def tiled_box_blur(spark, sf_dir):
    return pixels_of(tiles.box_blur(tiles.dealt(mosaics(spark, sf_dir)), SIDE, 2), "v").select("image_id", "x", "y", r6(F.col("v")).alias("re"))


@query("tiled_min_filter", f"WITH {BIG}, {near(1)}, m AS (SELECT image_id, x, y, min(v + 150) AS least, max(CASE WHEN dx = 0 AND dy = 0 THEN v + 150 END) AS own FROM near GROUP BY image_id, x, y) SELECT image_id, x, y, {sql6('CASE WHEN least < 0 THEN 0 ELSE own END')} AS re FROM m")
def tiled_min_filter(spark, sf_dir):
    lifted = mosaics(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x + 150))
    return pixels_of(tiles.zero_near_negative(tiles.dealt(lifted), SIDE), "v").select("image_id", "x", "y", r6(F.col("v")).alias("re"))


_GAUSS = "exp(-(dx * dx + dy * dy) / 4.5)"


@query("tiled_gaussian_blur", f"WITH {BIG}, {near(4)} SELECT image_id, x, y, round(sum({_GAUSS} * v) / sum({_GAUSS}) / {math.pi!r}, 6) + 0.0 AS re FROM near GROUP BY image_id, x, y")
def tiled_gaussian_blur(spark, sf_dir):
    return pixels_of(tiles.gaussian_blur(tiles.dealt(mosaics(spark, sf_dir)), SIDE, 1.5, 4), "v").select("image_id", "x", "y", r6(F.col("v") / math.pi).alias("re"))


@query("tiled_area_support", f"WITH {BIG}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY abs(re) DESC) - 1 AS place, count(*) OVER (PARTITION BY image_id) AS n FROM big), l AS (SELECT image_id, abs(re) AS level FROM r WHERE place = least(floor(n * 0.3), n - 1)) SELECT image_id, x, y, CASE WHEN abs(re) >= level THEN 1.0 ELSE 0.0 END::DOUBLE AS re FROM big JOIN l USING (image_id)")
def tiled_area_support(spark, sf_dir):
    return pixels_of(tiles.area_support(mosaics(spark, sf_dir), 0.3), "v").select("image_id", "x", "y", F.col("v").alias("re"))


TV_ROUNDS = 8


def _tv_sql() -> str:
    """Rounds as steps over one list of 1,024 pixels an image."""
    n, at = WIDE * WIDE, lambda a, x, y: f"{a}[(i // {WIDE} + {y}) % {WIDE} * {WIDE} + (i % {WIDE} + {x}) % {WIDE} + 1]"
    half = lambda a, x, y: f"({at(a, x, y)} - {at(a, (WIDE - x) % WIDE, (WIDE - y) % WIDE)}) / 2"
    each = lambda e: f"list_transform(range({n}), lambda i: {e})"
    steps = ["u0 AS MATERIALIZED (SELECT image_id, list(greatest(re + 500, 0.0) ORDER BY y, x) AS data, list(greatest(re + 500, 1e-6) ORDER BY y, x) AS u FROM big GROUP BY image_id)"]
    for k in range(TV_ROUNDS):
        steps += [
            f"g{k} AS MATERIALIZED (SELECT image_id, data, u, {each(half('u', 1, 0))} AS gx, {each(half('u', 0, 1))} AS gy FROM u{k})",
            f"p{k} AS MATERIALIZED (SELECT image_id, data, u, {each('gx[i + 1] / sqrt(gx[i + 1] * gx[i + 1] + gy[i + 1] * gy[i + 1] + 1e-8)')} AS px, {each('gy[i + 1] / sqrt(gx[i + 1] * gx[i + 1] + gy[i + 1] * gy[i + 1] + 1e-8)')} AS py FROM g{k})",
            f"u{k + 1} AS MATERIALIZED (SELECT image_id, data, {each(f'greatest(u[i + 1] - 0.5 * (1 - data[i + 1] / u[i + 1] - 0.2 * ({half("px", 1, 0)} + {half("py", 0, 1)})), 1e-6)')} AS u FROM p{k})",
        ]
    return f"WITH {BIG}, {', '.join(steps)} SELECT image_id, (i % {WIDE})::BIGINT AS x, (i // {WIDE})::BIGINT AS y, round(u[i + 1], 5) + 0.0 AS re FROM u{TV_ROUNDS}, (SELECT unnest(range({n})) AS i)"


@query("tiled_tv_denoise", _tv_sql())
def tiled_tv_denoise(spark, sf_dir):
    """Lifted, so that no pixel comes near the floor, where a round amplifies the last bits."""
    bright = mosaics(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x + 500))
    return pixels_of(tiles.tv_denoise(tiles.dealt(bright), SIDE, 0.2, 0.5, TV_ROUNDS, 2), "v").select("image_id", "x", "y", (F.round("v", 5) + 0.0).alias("re"))


def _turn(k: str, at: str, n: int, sign: int = -1) -> tuple[str, str]:
    angle = f"{sign * 2 * math.pi / n!r} * (({k} * {at}) % {n})"
    return f"cos({angle})", f"sin({angle})"


def _pass_sql(name: str, source: str, axis: str, others: str, n: int) -> str:
    """One axis after the other: sums over a line for each of its frequencies."""
    c, s = _turn("k", axis, n)
    return f"{name} AS MATERIALIZED (SELECT {others}, k AS {axis}, sum(re * {c} - im * {s}) AS re, sum(re * {s} + im * {c}) AS im FROM {source}, (SELECT unnest(range({n})) AS k) GROUP BY {others}, k)"


_DIGITS = "round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im"


@query("tiled_transform", f"WITH {BIG}, z AS (SELECT image_id, x, y, re, 0.0::DOUBLE AS im FROM big), {_pass_sql('fx', 'z', 'x', 'image_id, y', WIDE)}, {_pass_sql('fy', 'fx', 'y', 'image_id, x', WIDE)} SELECT image_id, x, y, {_DIGITS} FROM fy")
def tiled_transform(spark, sf_dir):
    t = tiles.transform(tiles.complex_tiles(mosaics(spark, sf_dir)), SIDE)
    return pixels_of(t, "re", "im").select("image_id", "x", "y", *[(F.round(c, 3) + 0.0).alias(c) for c in ("re", "im")])


_LAYERS = "SELECT vec_id // 8 AS image_id, vec_id % 8 AS z, i % 8 AS x, i // 8 AS y, round(embedding[i + 1]::DOUBLE * 1000, 3) AS re FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) = 64"
_VOLUME = f"""l AS ({_LAYERS}), v AS (SELECT g.image_id, x, y, z, coalesce(l.re, 0) AS re, 0.0::DOUBLE AS im FROM (SELECT DISTINCT image_id FROM l) g CROSS JOIN (SELECT unnest(range(8)) AS x)
  CROSS JOIN (SELECT unnest(range(8)) AS y) CROSS JOIN (SELECT unnest(range(8)) AS z) LEFT JOIN l USING (image_id, x, y, z))"""


@query("volume_transform", f"WITH {_VOLUME}, {_pass_sql('fx', 'v', 'x', 'image_id, y, z', 8)}, {_pass_sql('fy', 'fx', 'y', 'image_id, x, z', 8)}, {_pass_sql('fz', 'fy', 'z', 'image_id, x, y', 8)} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {_DIGITS} FROM fz")
def volume_transform(spark, sf_dir):
    """Every eight images by id as the layers of a volume, each layer a tile."""
    p = images(spark, sf_dir).select(F.floor(F.col("image_id") / SIDE).alias("image_id"), F.pmod("image_id", F.lit(SIDE)).cast("int").alias("tz"), F.col("re").alias("v"))
    whole = p.select("image_id").distinct().withColumn("tz", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).join(p, ["image_id", "tz"], "left")
    ints = {"ty": 0, "tx": 0, "nz": SIDE, "ny": SIDE, "nx": SIDE, "d": 1, "h": SIDE, "w": SIDE}
    layers = whole.select("image_id", "tz", *[F.lit(n).cast("int").alias(c) for c, n in ints.items()], F.coalesce("v", F.array_repeat(F.lit(0.0), SIDE * SIDE)).alias("v"))
    t = tiles.transform(tiles.complex_tiles(layers), SIDE, spanned="yx", volume=True)
    return pixels_of(t, "re", "im", deep=True).select("image_id", "x", "y", "z", *[(F.round(c, 3) + 0.0).alias(c) for c in ("re", "im")])


_ANGLES = (0.4, 0.3, 0.2)
_BACK = volume.euler(*_ANGLES).T
_FROM = ", ".join(f"{' + '.join(f'({_BACK[r, k]!r}) * ({c} - 3.5)' for k, c in enumerate('xyz'))} + 3.5 AS f{'xyz'[r]}" for r in range(3)).replace("np.float64(", "(")
_LOWEST = ", ".join(f"least(floor(f{c}), 6)::INT AS l{c}" for c in "xyz")
_WEIGHT = " * ".join(f"CASE WHEN s{c} = 1 THEN f{c} - l{c} ELSE 1 - (f{c} - l{c}) END" for c in "xyz")


@query("rotated_volumes", f"""WITH {_VOLUME}, q AS (SELECT image_id, x, y, z, {_FROM} FROM v), o AS (SELECT *, {_LOWEST} FROM q WHERE least(fx, fy, fz) >= 0 AND greatest(fx, fy, fz) <= 7),
t AS (SELECT o.image_id, o.x, o.y, o.z, sum(v.re * {_WEIGHT}) AS re FROM o, (SELECT unnest([0, 1]) AS sx), (SELECT unnest([0, 1]) AS sy), (SELECT unnest([0, 1]) AS sz)
  JOIN v ON v.image_id = o.image_id AND v.x = lx + sx AND v.y = ly + sy AND v.z = lz + sz GROUP BY ALL)
SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {sql6('coalesce(t.re, 0)')} AS re FROM v LEFT JOIN t USING (image_id, x, y, z)""")
def rotated_volumes(spark, sf_dir):
    """Every eight images by id as a volume, turned by three Euler angles."""
    p = images(spark, sf_dir).select(F.floor(F.col("image_id") / SIDE).alias("image_id"), F.pmod("image_id", F.lit(SIDE)).cast("int").alias("z"), "re")
    whole = p.select("image_id").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).join(p, ["image_id", "z"], "left")
    layers = F.array_sort(F.collect_list(F.struct("z", F.coalesce("re", F.array_repeat(F.lit(0.0), SIDE * SIDE)).alias("re"))))  # eight layers a volume
    v = whole.groupBy("image_id").agg(layers.alias("l")).select("image_id", *[F.lit(SIDE).alias(n) for n in ("nx", "ny", "nz")], F.flatten("l.re").alias("re"))
    v = v.select("image_id", "nx", "ny", "nz", "re", F.transform("re", lambda x: F.lit(0.0)).alias("im"), F.transform("re", lambda x: F.lit(1)).alias("mask"))
    return unpack(volume.rotate(v, *_ANGLES)).select("image_id", *[F.col(c).cast("long").alias(c) for c in "xyz"], r6(F.col("re")).alias("re"))


@query("exact_quantiles", "WITH r AS (SELECT l_shipmode_ AS part, v, row_number() OVER (PARTITION BY l_shipmode_ ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY l_shipmode_) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, l_extendedprice * (1 - l_discount) - 30000 AS v FROM lineitem)) SELECT part, max(CASE WHEN place = floor(n * 0.5) THEN v END) AS middle, max(CASE WHEN place = floor(n * 0.99) THEN v END) AS high FROM r GROUP BY part".replace("l_shipmode_", "g"))
def exact_quantiles(spark, sf_dir):
    """Order statistics of prices by flag and status, exact to the last bit."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("part"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000).alias("v"))
    at = lambda share: selection.selected(rows, "part", "v", lambda n: F.floor(n * share))
    return at(0.5).withColumnRenamed("level", "middle").join(at(0.99).withColumnRenamed("level", "high"), "part")


@query("frames_through_files", """WITH f AS (SELECT vec_id AS bunch, i, floor(abs(round(embedding[i + 1]::DOUBLE * 1000, 3)))::BIGINT % 256 AS v FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) = 64),
s AS (SELECT bunch, sum(v)::DOUBLE AS total, sum(v * i)::DOUBLE AS weighted FROM f GROUP BY bunch), e AS (SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0)
SELECT bunch, total, weighted, e.value AS hall, 'image-' || bunch || '-' || CASE WHEN e.value IS NULL THEN 'xxxx' ELSE printf('%.6f', e.value) END AS name FROM s LEFT JOIN e ON e.event_id = bunch""")
def frames_through_files(spark, sf_dir):
    """Images written as files of frames, read again in ranges and joined with the shot energies of their bunch."""
    p = images(spark, sf_dir).select(F.col("image_id").alias("bunch"), "nx", "ny", F.transform("re", lambda v: (F.floor(F.abs(v)) % 256).cast("double")).alias("re"))
    store = frames.scratch(spark, "frames")
    frames.write_frames(p, store, file_bytes=1 << 14)
    shots = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 <> 0").select(F.col("event_id").cast("int").alias("ts"), F.col("user_id").cast("double").alias("tunnel"), F.col("value").alias("hall"), F.col("event_id").alias("seq"))
    joined = frames.with_shot_energy(frames.read_frames(spark, store, split_bytes=1 << 12), shots)
    total = F.aggregate("re", F.lit(0.0), lambda a, v: a + v)
    weighted = F.aggregate(F.transform("re", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return joined.select(F.col("bunch").cast("long").alias("bunch"), total.alias("total"), weighted.alias("weighted"), "hall", "name")


@query("files_written", "WITH t AS (SELECT o_orderpriority AS p, string_agg(o_orderkey || ' ' || printf('%.2f', o_totalprice), chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY o_orderpriority) SELECT 'orders-' || left(p, 1) || '.txt' AS name, length(content)::BIGINT AS n_bytes, md5(content) AS digest FROM t")
def files_written(spark, sf_dir):
    """A text a priority, written as files by the committing sink; what the files hold."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = F.array_sort(F.collect_list(F.struct("o_orderkey", F.format_string("%d %.2f", "o_orderkey", "o_totalprice").alias("line"))))
    texts = o.groupBy(F.concat(F.lit("orders-"), F.left("o_orderpriority", F.lit(1)), F.lit(".txt")).alias("name")).agg(F.encode(F.concat_ws("\n", lines["line"]), "utf-8").alias("content"))
    store = frames.scratch(spark, "files")
    frames.write_files(texts, store)
    return frames.read_files(spark, store).select("name", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


_BOXES = "SELECT o_orderkey AS box, o_custkey % 50 AS x0, o_orderkey AS y0, o_custkey % 50 + o_custkey % 7 AS x1, o_orderkey + o_custkey % 30 AS y1 FROM orders"
_POINTS = "SELECT l_quantity::BIGINT AS x, l_orderkey AS y, l_linenumber AS v FROM lineitem"


@query("many_boxes", f"WITH b AS ({_BOXES}), p AS ({_POINTS}) SELECT box, count(*) AS n, sum(v)::BIGINT AS total FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY box")
def many_boxes(spark, sf_dir):
    """A box of quantities and following orders for every order, against a point for every line: what lies in each."""
    o, l = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    x0, y0 = F.col("o_custkey") % 50, F.col("o_orderkey")
    boxes = o.select(y0.alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("o_custkey") % 7).alias("x1"), (y0 + F.col("o_custkey") % 30).alias("y1"))
    points = l.select(F.col("l_quantity").cast("long").alias("x"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("v"))
    return regions.in_boxes(points, boxes).groupBy("box").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


_HOWS = {"union": "a OR b", "intersection": "a AND b", "difference": "a AND NOT b", "either": "a <> b"}
_SETS = """px AS (SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, round(embedding[i + 1]::DOUBLE * 1000, 3) > 20 AS a, pow(i % 8 - 3.5, 2) + pow(i // 8 - 3.0, 2) <= 2.6 * 2.6 AS b FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE len(embedding) = 64)"""
_RUNS = " UNION ALL ".join(
    f"SELECT image_id, '{name}' AS kind, y::BIGINT AS y, min(x)::BIGINT AS start, max(x)::BIGINT AS stop FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM px WHERE {rule}) GROUP BY image_id, y, g" for name, rule in _HOWS.items()
)


@query("mask_runs", f"WITH {_SETS} {_RUNS}")
def mask_runs(spark, sf_dir):
    """Bright pixels and a disc as runs, in all combinations, without a row for a pixel."""
    p = images(spark, sf_dir)
    bright = regions.runs_of(p, lambda v: v > 20)
    round_ = regions.disc(p.select("image_id"), F.lit(3.5), F.lit(3.0), F.lit(2.6), F.lit(8), F.lit(8))
    show = lambda how: regions.combined(bright, round_, how).select("image_id", F.lit(how).alias("kind"), F.col("y").cast("long").alias("y"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))
    out = show("union")
    for how in ("intersection", "difference", "either"):
        out = out.unionByName(show(how))
    return out


def streamed(spark, parts: list, read):
    """What read(streams of the parts) gives out, run to its end over the parts as files that arrive in turns; a row far in the future comes last, so that all others are settled."""
    folders = []
    for k, (rows, last) in enumerate(parts):
        folder = frames.scratch(spark, f"arrivals{k}")
        rows.repartition(4).write.parquet(folder)
        spark.createDataFrame([last], rows.schema).coalesce(1).write.mode("append").parquet(folder)
        folders.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder))
    out = frames.scratch(spark, "streamed")
    stream = read(*folders)
    query_ = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", frames.scratch(spark, "progress")).outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_STAMP = "epoch_ms(ts) // 21600000 * 21600"


@query("streamed_pulses", f"""WITH m AS (SELECT event_type AS name, ({_STAMP})::INT AS ts, event_id AS seq, row_number() OVER (PARTITION BY {_STAMP} ORDER BY event_id) AS k FROM events WHERE event_id % 3 <> 0),
s AS (SELECT ({_STAMP})::INT AS ts, user_id::DOUBLE AS tunnel, value AS hall, row_number() OVER (PARTITION BY {_STAMP} ORDER BY event_id) AS k FROM events WHERE event_id % 3 = 0)
SELECT m.seq, m.ts::BIGINT AS ts, m.name, s.tunnel, s.hall FROM m LEFT JOIN s ON m.ts = s.ts AND m.k = s.k""")
def streamed_pulses(spark, sf_dir):
    """Events as pulses and shots of six-hour stamps, which arrive as two streams in any order."""
    from ..streaming.pulses import joined_pulses

    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("stamp", (F.floor(F.unix_timestamp("ts") / 21600) * 21600).cast("int"))
    most = e.agg(F.max("stamp"), F.min("stamp")).first()
    if most[0] is None:
        most = (0, 0)
    span = most[0] - most[1] + 21600  # rows may come as late as all of the time there is
    master = e.where("event_id % 3 <> 0").select(F.col("event_type").alias("name"), F.col("stamp").alias("ts"), F.col("event_id").alias("seq"))
    shots = e.where("event_id % 3 = 0").select(F.col("stamp").alias("ts"), F.col("user_id").cast("double").alias("tunnel"), F.col("value").alias("hall"), F.col("event_id").alias("seq"))
    future = most[0] + 3 * span
    found = streamed(spark, [(master, ("end", future, -1)), (shots, (future, 0.0, 0.0, -1))], lambda m, s: joined_pulses(m, s, f"{span} seconds"))
    return found.where("NOT late").select("seq", F.col("ts").cast("long").alias("ts"), "name", "tunnel", "hall")
