"""Queries through text files: what tables hold is written in a format and read again by its reader, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import PX, images, pixels
from ..sources import binary, formats, frames, text
from .pixel_queries import r6, sql6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark, rows, name, *order: str) -> str:
    """rows(line, ...) as a text file for each `name`, its lines in the order given; the folder."""
    lines = F.array_sort(F.collect_list(F.struct(*order, "line")))
    blobs = rows.groupBy(name.alias("name")).agg(F.encode(F.concat_ws("\n", lines["line"]), "utf-8").alias("content"))
    folder = frames.scratch(spark, "texts")
    frames.write_files(blobs, folder)
    return folder


def number(c: str, digits: int = 2):
    return F.format_string(f"%.{digits}f", F.col(c).cast("double"))


@query("matrices_through_files", f"WITH {PX} SELECT label || '.txt' AS name, i::BIGINT AS x, (dense_rank() OVER (PARTITION BY label ORDER BY image_id) - 1)::BIGINT AS y, re FROM px")
def matrices_through_files(spark, sf_dir):
    """The images of a label as the lines of a matrix."""
    line = F.concat_ws(" ", F.transform("re", lambda v: F.format_string("%.3f", v)))
    folder = stored(spark, images(spark, sf_dir).select("label", "image_id", line.alias("line")), F.concat(F.col("label").cast("string"), F.lit(".txt")), "image_id")
    return text.read_matrices(spark, folder).select("name", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "re")


@query("geometry_through_files", "SELECT s_nationkey || '.txt' AS file, s_name AS id, round(s_acctbal, 2) AS dx, s_suppkey::DOUBLE AS dy, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 END::DOUBLE AS dz, -1.25::DOUBLE AS theta FROM supplier")
def geometry_through_files(spark, sf_dir):
    """Suppliers as positioned images, a geometry file a nation; every third has a depth."""
    depth = F.when(F.col("s_suppkey") % 3 == 0, F.lit("dz: 0.5\n")).otherwise(F.lit(""))
    block = F.concat(F.lit("Identifier: "), "s_name", F.lit("\ndx: "), number("s_acctbal"), F.lit("\ndy = "), F.col("s_suppkey").cast("string"), F.lit("\n"), depth, F.lit("Theta: -1.25"))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", block.alias("line"))
    return text.read_geometry(spark, stored(spark, rows, F.concat(F.col("s_nationkey").cast("string"), F.lit(".txt")), "s_suppkey"))


@query("control_points_through_files", "SELECT s_nationkey || '.hicp' AS file, s_name AS id, n::INT AS n, (s_suppkey * n)::DOUBLE AS x, round(s_acctbal, 2) AS y FROM supplier, (SELECT unnest([1, 2, 3]) AS n)")
def control_points_through_files(spark, sf_dir):
    points = F.concat(*[F.concat(F.lit("\nx: "), (F.col("s_suppkey") * n).cast("string"), F.lit("\ny: "), number("s_acctbal")) for n in (1, 2, 3)])
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.concat(F.lit("Identifier: "), F.col("s_name"), points).alias("line"))
    return formats.control_points(spark, stored(spark, rows, F.concat(F.col("s_nationkey").cast("string"), F.lit(".hicp")), "s_suppkey"))


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("it_out"), F.lit(0).alias("it_in"), F.col("value").alias("ereal"), (F.col("value") * 2).alias("efourier"), (F.col("event_id") % 7).alias("algorithm"))


@query("logs_through_files", "SELECT event_id::DOUBLE AS it_out, round(value, 2) AS ereal, round(value * 2, 2) AS efourier, (event_id % 7)::DOUBLE AS algorithm, 0.0::DOUBLE AS iter_per_s FROM events")
def logs_through_files(spark, sf_dir):
    """Events as the metric rows of a log a user, written with header and legends."""
    folder = stored(spark, formats.log_lines(_metrics(spark, sf_dir)).withColumnRenamed("value", "line"), F.concat(F.col("run_id").cast("string"), F.lit(".log")), "n")
    return text.parse_log(spark.read.text(folder)).select("it_out", "ereal", "efourier", "algorithm", "iter_per_s")


@query("log_legends", "SELECT user_id AS n_runs_of, c::INT AS \"column\", legend FROM (SELECT count(DISTINCT user_id) AS user_id FROM events), (SELECT unnest(range(19)) AS c), (SELECT unnest({}) AS legend, unnest(range(19)) AS k) WHERE c = k".format(text.LOG_COLUMNS))
def log_legends(spark, sf_dir):
    """The legends of all logs, and how many have each."""
    legends = text.parse_legends(formats.log_lines(_metrics(spark, sf_dir)).select("value"))
    return legends.groupBy("column", "legend").agg(F.count("*").alias("n_runs_of")).select("n_runs_of", "column", "legend")


@query("file_lists", "SELECT c_nationkey || '.lst' AS list, (2 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1))::BIGINT AS n, '/data/' || c_name || '.h5' AS path FROM customer")
def file_lists(spark, sf_dir):
    """Customers as files, a list a nation, with empty lines between."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit(" /data/"), "c_name", F.lit(".h5 \n")).alias("line"))
    return formats.file_list(spark, stored(spark, rows, F.concat(F.col("c_nationkey").cast("string"), F.lit(".lst")), "c_custkey")).select("list", F.col("n").cast("long").alias("n"), "path")


@query("sidecar_comments", "SELECT '/frames/n' || n.n_nationkey || '.cxi' AS path, CASE WHEN c.k > 0 THEN 'Master_comment: ' || c.k || ' suppliers' END AS comment FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY s_nationkey) c ON c.s_nationkey = n.n_nationkey")
def sidecar_comments(spark, sf_dir):
    """A text beside each nation's frames says how many suppliers there are; a later comment doesn't count."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    line = F.concat(F.lit("first\nMaster_comment: "), F.col("k").cast("string"), F.lit(" suppliers\nMaster_comment: later"))
    folder = stored(spark, s.select("s_nationkey", line.alias("line")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".txt")), "s_nationkey")
    shots = table(spark, sf_dir, "nation").select(F.concat(F.lit("/frames/n"), F.col("n_nationkey").cast("string"), F.lit(".cxi")).alias("path"))
    return formats.with_comments(shots, spark, folder)


_CELL = (5e-9, 6e-9, 7e-9, 90.0, 90.0, 90.0)
_HEAD = [*formats._LIST_HEAD, "CELL " + " ".join(f"{x * (1e10 if i < 3 else 1):f}" for i, x in enumerate(_CELL)), *formats._LIST_PLAIN]


@query("reflection_lists", f"""WITH {PX}, h AS (SELECT unnest({[s.replace("'", "§") for s in _HEAD]}) AS value, unnest(range({len(_HEAD)})) AS n)
SELECT image_id, n::BIGINT AS n, replace(value, '§', chr(39)) AS value FROM (SELECT DISTINCT image_id FROM px), h
UNION ALL SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 + {len(_HEAD)})::BIGINT, printf('%5d%5d%5d %10.3e', x::INT - 4, y::INT - 4, 0, re) FROM px WHERE x % 2 = 0""")
def reflection_lists(spark, sf_dir):
    """Pixels as reflections; those in odd columns have no whole index."""
    px = pixels(spark, sf_dir).withColumns({"h": F.col("x") - 4 + F.when(F.col("x") % 2 == 1, 0.5).otherwise(0.0), "k": F.col("y") - 4.0, "l": F.lit(0.0)})
    return formats.reflection_list(px, _CELL).select("image_id", F.col("n").cast("long").alias("n"), "value")


@query("observation_lists", f"WITH {PX} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, {sql6('abs(re)')} AS amp, {sql6('sqrt(abs(re))')} AS sig, count(*) OVER (PARTITION BY image_id) AS n FROM px")
def observation_lists(spark, sf_dir):
    return formats.speden(pixels(spark, sf_dir)).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r6(F.col("amp")).alias("amp"), r6(F.col("sig")).alias("sig"), "n")


@query("plot_texts", f"WITH {PX} SELECT label AS image_id, x::BIGINT AS x, x || chr(9) || printf('%.6f', sum(re) / 7) || chr(9) || count(*) AS value FROM px GROUP BY label, x")
def plot_texts(spark, sf_dir):
    """Columns' sums of all images of a label, as the lines of a plot."""
    sums = pixels(spark, sf_dir).groupBy(F.col("label").alias("image_id"), F.col("x").cast("long").alias("x")).agg((F.sum(F.col("re").cast("decimal(20,3)")).cast("double") / 7).alias("s"), F.count("*").alias("n"))
    return formats.plot_lines(sums, "x", "s", "n")


@query("panels", f"WITH {PX} SELECT image_id, x // 4 AS frame, y // 4 AS panel, (x % 4)::BIGINT AS x, (y % 4)::BIGINT AS y, re FROM px")
def panels(spark, sf_dir):
    """Two frames side by side, each of an upper and a lower panel."""
    p = binary.split_panels(pixels(spark, sf_dir), 4, 4)
    return p.select("image_id", F.col("frame").cast("long").alias("frame"), F.col("panel").cast("long").alias("panel"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "re")


@query("images_through_files", f"""WITH {PX} SELECT image_id, 'tiff' AS kind, i::BIGINT AS i, round(abs(re)::FLOAT::DOUBLE, 6) + 0.0 AS re FROM px
UNION ALL SELECT image_id, 'png', i::BIGINT, round(abs(re) / max(abs(re)) OVER (PARTITION BY image_id) * 255) + 0.0 FROM px""")
def images_through_files(spark, sf_dir):
    """Every image as a TIFF of floats and as a grey PNG, each a file of its own, read again by what its first bytes say."""
    p = images(spark, sf_dir)
    out = None
    for kind, digits in (("tiff", 6), ("png", 0)):
        folder = frames.scratch(spark, kind)
        frames.write_files(formats.encoded(p, kind).select(frames.in_folders(F.col("name")).alias("name"), "content"), folder)
        read = formats.decoded(frames.read_folders(spark, folder))
        cells = read.select(F.regexp_extract("path", r"([0-9]+)\.\w+$", 1).cast("long").alias("image_id"), F.lit(kind).alias("kind"), F.posexplode("re").alias("i", "re"))
        part = cells.select("image_id", "kind", F.col("i").cast("long").alias("i"), (F.round("re", digits) + 0.0).alias("re"))
        out = part if out is None else out.unionByName(part)
    return out
