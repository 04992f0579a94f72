"""Queries of merging, agreement, relations between lists, placed panels, options and schedules, each with its DuckDB SQL where there is one."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import options as O
from ..functions import schedules
from ..model import PX, images, pixels, unpack
from ..operators import aggregate as G
from ..operators import fourier as FT
from ..operators import merging as M
from ..operators import packed as K
from ..operators import pixel as P
from ..operators import regions as R
from ..operators import spatial as N
from ..operators import volume as V
from .engine_queries import K2, OFF, PLACES, back, forward
from .pixel_queries import BIN, IDS, MOST, SQL_D, ZIP, D, _next, bilinear_sql, r6, sql6

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def long(c: str):
    return F.col(c).cast("long").alias(c)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("order_by_exposure", f"WITH {PX}, s AS (SELECT image_id, sum(re) AS e FROM px GROUP BY image_id) SELECT image_id, {sql6('e')} AS exposure, (row_number() OVER (ORDER BY round(e, 6), image_id) - 1)::BIGINT AS place FROM s")
def order_by_exposure(spark, sf_dir):
    sums = pixels(spark, sf_dir)
    return M.ordered_by_exposure(sums.withColumn("re", F.col("re").cast("decimal(20,3)"))).select("image_id", r6(F.col("exposure").cast("double")).alias("exposure"), long("place"))


@query("wilson_plot", f"WITH {PX} SELECT image_id, {BIN}::BIGINT AS shell, round(avg(re * re) * {OFF!r}, 4) AS mean, {sql6('ln(avg(re * re))')} AS log_mean FROM px GROUP BY image_id, {BIN}")
def wilson_plot(spark, sf_dir):
    bright = images(spark, sf_dir).withColumn("re", F.transform("re", lambda v: v * v))
    return K.wilson(bright, 4, MOST).select("image_id", long("shell"), F.round(F.col("mean") * OFF, 4).alias("mean"), r6(F.col("log_mean")).alias("log_mean"))


_SERIES = f"s AS (SELECT image_id // 3 AS series, image_id % 3 AS place, i, {BIN}::INT AS shell, re * re AS re FROM px)"


def _series(spark, sf_dir):
    """Runs of three images as series of exposures, with the agreement of neighbours by shell."""
    px = P.to_intensities(pixels(spark, sf_dir)).select(F.floor(F.col("image_id") / 3).alias("series"), (F.col("image_id") % 3).alias("place"), "i", G.shell(D(), 4, MOST).alias("shell"), "re")
    up = px.select("series", (F.col("place") - 1).alias("place"), "i", F.col("re").alias("b"))
    agreement = px.join(up, ["series", "place", "i"]).groupBy("series", "place", "shell").agg(F.corr("re", "b").alias("cc"))
    return px, agreement


@query(
    "ramp_weights",
    f"WITH {PX}, {_SERIES}, c AS (SELECT a.series, a.place, a.shell, corr(a.re, b.re) AS cc FROM s a JOIN s b ON a.series = b.series AND b.place = a.place + 1 AND a.i = b.i GROUP BY a.series, a.place, a.shell), "
    "g AS (SELECT *, (cc > 0.1)::INT AS good FROM c), r AS (SELECT *, sum(CASE WHEN good = 1 AND coalesce(o, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series, place ORDER BY shell DESC ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(good) OVER (PARTITION BY series, place ORDER BY shell DESC) AS o FROM g)), "
    "e AS (SELECT series, place, max(shell) AS b, min(shell) - 1 AS z FROM r WHERE good = 1 AND run = 1 GROUP BY series, place), "
    "u AS (SELECT k.series, k.place, shell, CASE WHEN shell > b THEN 1.0::DOUBLE WHEN shell > z THEN (shell - z)::DOUBLE / (b - z) ELSE 0 END AS up FROM (SELECT DISTINCT series, place FROM c) k LEFT JOIN e USING (series, place), (SELECT unnest(range(4)) AS shell)), "
    "w AS (SELECT a.series, a.shell, a.up AS u0, b.up AS u1 FROM u a LEFT JOIN u b ON a.series = b.series AND a.shell = b.shell AND b.place = 1 WHERE a.place = 0) "
    "SELECT series, place::BIGINT AS place, shell::BIGINT AS shell, round(CASE place WHEN 0 THEN 1 - u0 WHEN 1 THEN u0 * (1 - coalesce(u1, 0)) ELSE u0 * u1 END, 6) + 0.0 AS weight FROM w, (SELECT unnest(range(3)) AS place) WHERE place < 2 OR u1 IS NOT NULL",
)
def ramp_weights(spark, sf_dir):
    _, agreement = _series(spark, sf_dir)
    return M.ramp_weights(agreement, "series", 4, 0.1).select("series", long("place"), long("shell"), r6(F.col("weight")).alias("weight"))


_AGREE = "c AS (SELECT a.series, a.place, a.shell, corr(a.re, b.re) AS cc FROM s a JOIN s b ON a.series = b.series AND b.place = a.place + 1 AND a.i = b.i GROUP BY a.series, a.place, a.shell)"
_RUN = "sum(CASE WHEN good = 1 AND coalesce(o, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series, place ORDER BY shell {down} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(good) OVER (PARTITION BY series, place ORDER BY shell {down}) AS o FROM {of})"


@query(
    "ramp_merge",
    f"""WITH {PX}, {_SERIES}, {_AGREE}, m AS (SELECT series, place, shell, avg(re) AS mean FROM s GROUP BY ALL), b AS (SELECT series, place, min(mean) AS background FROM m GROUP BY ALL),
v AS (SELECT m.*, mean - background AS v FROM m JOIN b USING (series, place)),
g AS (SELECT a.series, a.place, a.shell, a.v, n.v AS above, (cc > 0.1)::INT AS good FROM v a JOIN v n ON n.series = a.series AND n.place = a.place + 1 AND n.shell = a.shell JOIN c ON c.series = a.series AND c.place = a.place AND c.shell = a.shell),
t AS (SELECT series, place, avg(above / nullif(v, 0)) AS step FROM (SELECT *, {_RUN.format(down="", of="g")}) WHERE good = 1 AND run = 1 GROUP BY series, place),
p AS (SELECT k.series, k.place, coalesce(step, 1) AS step FROM (SELECT DISTINCT series, place FROM s) k LEFT JOIN t USING (series, place)),
sc AS (SELECT a.series, a.place, product(abs(z.step)) AS scale FROM p a JOIN p z ON a.series = z.series AND z.place >= a.place GROUP BY a.series, a.place),
e AS (SELECT series, place, max(shell) AS hi, min(shell) - 1 AS lo FROM (SELECT *, {_RUN.format(down="DESC", of="(SELECT *, (cc > 0.1)::INT AS good FROM c)")}) WHERE good = 1 AND run = 1 GROUP BY series, place),
u AS (SELECT k.series, k.place, shell, CASE WHEN shell > hi THEN 1.0::DOUBLE WHEN shell > lo THEN (shell - lo)::DOUBLE / (hi - lo) ELSE 0 END AS up FROM (SELECT DISTINCT series, place FROM c) k LEFT JOIN e USING (series, place), (SELECT unnest(range(4)) AS shell)),
w AS (SELECT a.series, a.shell, a.up AS u0, n.up AS u1 FROM u a LEFT JOIN u n ON a.series = n.series AND a.shell = n.shell AND n.place = 1 WHERE a.place = 0),
wt AS (SELECT series, place, shell, CASE place WHEN 0 THEN 1 - u0 WHEN 1 THEN u0 * (1 - coalesce(u1, 0)) ELSE u0 * u1 END AS weight FROM w, (SELECT unnest(range(3)) AS place) WHERE place < 2 OR u1 IS NOT NULL),
x AS (SELECT series, i, sum((re - background) * scale * weight) AS re FROM s JOIN sc USING (series, place) JOIN b USING (series, place) JOIN wt USING (series, place, shell) GROUP BY series, i)
SELECT series, i::BIGINT AS i, round(sign(re) * log10(1 + abs(re)), 5) + 0.0 AS log_re FROM x""",
)
def ramp_merge(spark, sf_dir):
    """The merged values, as signed logarithms: scales of noisy series span many orders."""
    px, agreement = _series(spark, sf_dir)
    plots = px.groupBy("series", "place", "shell").agg(F.avg("re").alias("mean"))
    scales, backgrounds, weights = M.relative_scale(plots, agreement, "series", 0.1), M.plot_background(plots, "series", "place"), M.ramp_weights(agreement, "series", 4, 0.1)
    merged = M.ramp_merge(px, scales, backgrounds, weights, "series")
    return merged.select("series", long("i"), (F.round(F.sign("re") * F.log10(1 + F.abs("re")), 5) + 0.0).alias("log_re"))


@query(
    "relative_scale",
    f"WITH {PX}, {_SERIES}, c AS (SELECT a.series, a.place, a.shell, corr(a.re, b.re) AS cc FROM s a JOIN s b ON a.series = b.series AND b.place = a.place + 1 AND a.i = b.i GROUP BY a.series, a.place, a.shell), "
    "m AS (SELECT series, place, shell, avg(re) AS mean FROM s GROUP BY ALL), v AS (SELECT *, mean - min(mean) OVER (PARTITION BY series, place) AS v FROM m), "
    "g AS (SELECT a.series, a.place, a.shell, a.v, b.v AS above, (cc > 0.1)::INT AS good FROM v a JOIN v b ON b.series = a.series AND b.place = a.place + 1 AND b.shell = a.shell JOIN c ON c.series = a.series AND c.place = a.place AND c.shell = a.shell), "
    "r AS (SELECT *, sum(CASE WHEN good = 1 AND coalesce(o, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series, place ORDER BY shell ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(good) OVER (PARTITION BY series, place ORDER BY shell) AS o FROM g)), "
    "t AS (SELECT series, place, avg(above / nullif(v, 0)) AS step FROM r WHERE good = 1 AND run = 1 GROUP BY series, place), "
    "p AS (SELECT k.series, k.place, abs(coalesce(step, 1)) AS step FROM (SELECT DISTINCT series, place FROM s) k LEFT JOIN t USING (series, place)) "
    "SELECT a.series, a.place::BIGINT AS place, round(CASE WHEN min(b.step) > 0 THEN log10(product(b.step)) END, 6) + 0.0 AS scale FROM p a JOIN p b ON a.series = b.series AND b.place >= a.place GROUP BY a.series, a.place",
)
def relative_scale(spark, sf_dir):
    px, agreement = _series(spark, sf_dir)
    plots = px.groupBy("series", "place", "shell").agg(F.avg("re").alias("mean"))
    return M.relative_scale(plots, agreement, "series", 0.1).select("series", long("place"), (F.round(F.when(F.col("scale") > 0, F.log10("scale")), 6) + 0.0).alias("scale"))


@query("pixel_ratio", f"WITH {PX}, z AS (SELECT label, i, re, lag(re) OVER (PARTITION BY label, i ORDER BY image_id) AS b FROM px) SELECT label, i::BIGINT AS i, round(coalesce(avg(CASE WHEN re <> 0 AND b <> 0 AND re < 150 AND b < 150 THEN b / re END), 0), 4) + 0.0 AS ratio FROM z GROUP BY label, i")
def pixel_ratio(spark, sf_dir):
    return M.pairwise_ratio(pixels(spark, sf_dir), "label", 150.0).select("label", long("i"), (F.round("ratio", 4) + 0.0).alias("ratio"))


@query("right_half_mean", f"WITH {PX} SELECT image_id, {sql6(f'avg(re) * {OFF!r}')} AS background FROM px WHERE x >= 4 GROUP BY image_id")
def right_half_mean(spark, sf_dir):
    return K.right_half_mean(images(spark, sf_dir)).select("image_id", r6(F.col("background") * OFF).alias("background"))


@query(
    "pair_correlations",
    f"WITH {PX}, k AS (SELECT vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE len(embedding) = 64), z AS (SELECT label, i, k, re FROM px JOIN k USING (image_id) WHERE k <= 5), "
    f"c AS (SELECT a.label, a.k, b.k AS k2, corr(a.re, b.re) AS r FROM z a JOIN z b ON a.label = b.label AND a.i = b.i AND a.k < b.k GROUP BY a.label, a.k, b.k) SELECT label, {sql6('avg(r)')} AS r FROM c GROUP BY label",
)
def pair_correlations(spark, sf_dir):
    return M.pair_correlations(pixels(spark, sf_dir), "label").select("label", r6(F.col("r")).alias("r"))


_LEVEL = "own AS (SELECT label, image_id, avg(abs(re)) AS own FROM px WHERE image_id % 4 = 1 GROUP BY label, image_id), lev AS (SELECT label, avg(own) AS level FROM own GROUP BY label)"


@query("flagged_background", f"WITH {PX}, {_LEVEL} SELECT px.label, i::BIGINT AS i, {sql6('avg(abs(re) * level / nullif(own, 0))')} AS re FROM px JOIN own USING (image_id) JOIN lev ON lev.label = px.label GROUP BY px.label, i")
def flagged_background(spark, sf_dir):
    p = images(spark, sf_dir)
    flags = M.set_flags(p.select("image_id"), F.col("image_id") % 4 == 0, F.col("image_id") % 4 <= 1)
    return M.flagged_background(P.dephase(unpack(p, "label")), flags, "label").select("label", long("i"), r6(F.col("re")).alias("re"))


_BRIGHT = f"b AS (SELECT image_id, label, sum(re) AS total, max(re) AS most FROM px GROUP BY image_id, label)"


def _flagged(spark, sf_dir):
    """Frames with a bright pixel as hits; frames of little light as background, if they aren't hits."""
    most, total = F.array_max("re"), F.aggregate(F.transform("re", lambda v: v.cast("decimal(20,3)")), F.lit(0).cast("decimal(30,3)"), lambda a, v: (a + v).cast("decimal(30,3)"))
    frames = images(spark, sf_dir).select("image_id", "label", most.alias("most"), total.alias("total"))
    return M.set_flags(frames, F.col("most") > 250, F.col("total") < 400)


@query("frame_flags", f"WITH {PX}, {_BRIGHT} SELECT image_id, most > 250 AS hit, round(total, 3) < 400 AND NOT most > 250 AS background FROM b")
def frame_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("image_id", "hit", "background")


@query("hits_only", f"WITH {PX}, {_BRIGHT} SELECT image_id, label FROM b WHERE most > 250")
def hits_only(spark, sf_dir):
    """The frames that an export of hits takes, by the flag of their row."""
    return images(spark, sf_dir).select("image_id", "label").join(_flagged(spark, sf_dir).where("hit"), "image_id", "left_semi")


@query("real_space_agreement", f"WITH {PX}, {ZIP} SELECT image_id, {sql6('sum(abs(abs(a) - abs(b))) / nullif(sum(abs(a) + abs(b)), 0)')} AS r, {sql6('corr(abs(a), abs(b))')} AS cc FROM z GROUP BY image_id")
def real_space_agreement(spark, sf_dir):
    p = images(spark, sf_dir)
    return K.real_space_agreement(p, p.withColumn("image_id", F.col("image_id") - 1)).select("image_id", r6(F.col("r")).alias("r"), r6(F.col("cc")).alias("cc"))


_GAP = f"(atan2(a.fi, a.fr) - atan2(b.fi, b.fr) + {4 * math.pi!r}) % {2 * math.pi!r}"
_FREQUENCY = "sqrt(pow((i % 8) - 3.5, 2) + pow((i // 8) - 3.5, 2))"


@query("phase_error_profile", f"WITH {PX}, {forward()}, t AS (SELECT * FROM {PLACES}), z AS (SELECT a.image_id, a.i, {_GAP} AS gap FROM t a JOIN t b ON b.image_id = a.image_id + 1 AND a.i = b.i WHERE a.i NOT IN (0, 4, 32, 36)) SELECT image_id, least(floor({_FREQUENCY} * 4 / {MOST!r}), 3)::BIGINT AS shell, round(avg(least(gap, {2 * math.pi!r} - gap)), 5) AS error, count(*) AS n FROM z GROUP BY image_id, least(floor({_FREQUENCY} * 4 / {MOST!r}), 3)")
def phase_error_profile(spark, sf_dir):
    """The four frequencies that are real for real images (and so of no certain phase sign) are left out of the comparison."""
    t = FT.fft(images(spark, sf_dir))
    other = t.withColumn("image_id", F.col("image_id") - 1).select("image_id", F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = t.join(other, "image_id").select("image_id", F.posexplode(F.arrays_zip("re", "im", "re2", "im2")).alias("i", "c")).select("image_id", "i", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), "c.*")
    both = both.where(~F.col("i").isin(0, 4, 32, 36))
    return M.phase_error_profile(both, D(), 4, MOST).select("image_id", long("shell"), F.round("error", 5).alias("error"), "n")


@query("snapshot_difference", f"WITH {PX}, z AS (SELECT label, image_id, abs(abs(re) - lag(abs(re)) OVER (PARTITION BY label, i ORDER BY image_id)) AS c FROM px) SELECT label, image_id, {sql6('sum(c)')} AS int_cum_fluctuation FROM z GROUP BY label, image_id")
def snapshot_difference(spark, sf_dir):
    return K.snapshot_difference(images(spark, sf_dir), "label", "image_id").select("label", "image_id", r6(F.col("int_cum_fluctuation")).alias("int_cum_fluctuation"))


@query("weak_pixels", f"WITH {PX}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY abs(re) DESC, i) - 1 AS k FROM px), l AS (SELECT *, max(CASE WHEN k = 19 THEN abs(re) END) OVER (PARTITION BY image_id) AS level FROM k) SELECT image_id, i::BIGINT AS i, abs(re) <= level AS weak FROM l")
def weak_pixels(spark, sf_dir):
    return M.weak_pixels(pixels(spark, sf_dir), 0.3).select("image_id", long("i"), "weak")


@query("neighbours_in_list", "SELECT event_id, coalesce(lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id), -1) AS previous, coalesce(lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id), -1) AS next FROM events")
def neighbours_in_list(spark, sf_dir):
    return M.neighbours_in_list(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", "event_id").select("event_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("previous", "next")])


@query("unseen_files", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)")
def unseen_files(spark, sf_dir):
    return M.unseen(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("runs_with_log", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)")
def runs_with_log(spark, sf_dir):
    return M.with_log(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("regions", f"WITH {PX} SELECT image_id, i::BIGINT AS i, 'united' AS kind FROM px WHERE re > 50 OR x < 3 UNION ALL SELECT image_id, i::BIGINT, 'left' FROM px WHERE re > 50 AND NOT x < 3")
def regions(spark, sf_dir):
    p = pixels(spark, sf_dir)
    a, b = p.where("re > 50"), p.where("x < 3")
    show = lambda d, kind: d.select("image_id", long("i"), F.lit(kind).alias("kind"))
    return show(M.unite_regions(a, b), "united").unionByName(show(M.subtract_region(a, b), "left"))


@query("list_union", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), list(o_orderkey) FILTER (WHERE o_totalprice > 100000)))), ',') AS keys FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND count(*) FILTER (WHERE o_totalprice > 100000) > 0")
def list_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("a"))
    b = o.where("o_totalprice > 100000").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("b"))
    return a.join(b, "o_custkey").select("o_custkey", F.concat_ws(",", F.array_sort(M.list_union("a", "b")).cast("array<string>")).alias("keys"))


@query("box_join", f"WITH {PX}, b AS (SELECT * FROM (VALUES (0, 0, 0, 3, 2), (1, 2, 1, 6, 5), (2, 7, 7, 9, 9)) AS t(box, x0, y0, x1, y1)) SELECT image_id, box::BIGINT AS box, count(*) AS n, {sql6('sum(re)')} AS sum_re FROM px JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY image_id, box")
def box_join(spark, sf_dir):
    boxes = spark.createDataFrame([(0, 0, 0, 3, 2), (1, 2, 1, 6, 5), (2, 7, 7, 9, 9)], "box long, x0 int, y0 int, x1 int, y1 int")
    return R.in_boxes(pixels(spark, sf_dir), boxes).groupBy("image_id", "box").agg(F.count("*").alias("n"), r6(F.sum("re")).alias("sum_re"))


_POINTS = "r AS (SELECT user_id, event_id, value FROM events WHERE event_id % 3 = 0)"


@query(
    "interpolated_lookup",
    f"WITH {_POINTS}, l AS (SELECT user_id, event_id FROM events), b AS (SELECT l.*, (SELECT max(event_id) FROM r WHERE r.user_id = l.user_id AND r.event_id <= l.event_id) AS k0, (SELECT min(event_id) FROM r WHERE r.user_id = l.user_id AND r.event_id >= l.event_id) AS k1 FROM l) "
    f"SELECT b.event_id, {sql6('coalesce(CASE WHEN k0 = k1 THEN x.value ELSE x.value + (y.value - x.value) * (b.event_id - k0) / nullif(k1 - k0, 0) END, x.value, y.value)')} AS value FROM b LEFT JOIN r x ON x.event_id = k0 LEFT JOIN r y ON y.event_id = k1",
)
def interpolated_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return M.asof_both(e.select("user_id", "event_id"), e.where("event_id % 3 = 0"), "user_id", "event_id", "value").select("event_id", r6(F.col("value")).alias("value"))


# ---- placed panels

_T = "theta AS (SELECT vec_id AS image_id, label, ((vec_id % 5) * 3)::DOUBLE AS dx, ((vec_id % 3) * 4)::DOUBLE AS dy, (vec_id % 4) * 0.3 AS theta, embedding FROM embeddings WHERE len(embedding) = 64)"
_FORE = [f"(cos(theta) * ({x} + dx - 4) - sin(theta) * ({y} + dy - 4), sin(theta) * ({x} + dx - 4) + cos(theta) * ({y} + dy - 4))" for x in (0, 7) for y in (0, 7)]
_EDGE = lambda f, k: f"{f}({', '.join(c[1:-1].split(', ')[k] for c in _FORE)})"
_VALUE = " + ".join(f"({wx}) * ({wy}) * round(embedding[least(qy + {b}, 7) * 8 + least(qx + {a}, 7) + 1]::DOUBLE * 1000, 3)" for a, wx in ((0, "1 - (fx - qx)"), (1, "fx - qx")) for b, wy in ((0, "1 - (fy - qy)"), (1, "fy - qy")))


_STITCH = (
    f"WITH {_T}, c AS (SELECT *, floor({_EDGE('least', 0)} + 1e-9)::BIGINT AS x0, floor({_EDGE('least', 1)} + 1e-9)::BIGINT AS y0, ceil({_EDGE('greatest', 0)} - 1e-9)::BIGINT AS x1, ceil({_EDGE('greatest', 1)} - 1e-9)::BIGINT AS y1 FROM theta), "
    "g AS (SELECT c.*, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT c.*, unnest(range(x0, x1 + 1)) AS x FROM c) c), "
    "f AS (SELECT *, round(cos(theta) * x + sin(theta) * y - dx + 4, 9) AS fx, round(-sin(theta) * x + cos(theta) * y - dy + 4, 9) AS fy FROM g), "
    f"v AS (SELECT label, x, y, image_id, {_VALUE} AS v FROM (SELECT *, floor(fx)::INT AS qx, floor(fy)::INT AS qy FROM f WHERE fx BETWEEN 0 AND 7 AND fy BETWEEN 0 AND 7)), "
    "w AS (SELECT label, x, y, arg_min(v, image_id) AS re FROM v GROUP BY label, x, y), b AS (SELECT label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY label), "
    "a AS (SELECT label, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM b)) "
    "SELECT a.label, a.x, a.y, round(coalesce(re, 0), 4) + 0.0 AS re, (re IS NOT NULL)::BIGINT AS mask FROM a LEFT JOIN w USING (label, x, y)"
)


def _stitched(spark, sf_dir, overlap):
    """All images, one stitched canvas a label; panels are placed and turned by their number."""
    p = images(spark, sf_dir)
    k = F.col("image_id")
    frames = p.select("image_id", "label", k.alias("seq"), ((k % 5) * 3).cast("double").alias("dx"), ((k % 3) * 4).cast("double").alias("dy"), F.lit(1.0).alias("zoom"), ((k % 4) * 0.3).alias("theta"))
    return V.stitch(p.drop("label"), frames, "label", overlap=overlap).select("label", long("x"), long("y"), (F.round("re", 4) + 0.0).alias("re"), long("mask"))


@query("stitch_first", _STITCH)
def stitch_first(spark, sf_dir):
    return _stitched(spark, sf_dir, "first")


@query("stitch_sum", _STITCH.replace("arg_min(v, image_id) AS re", "sum(v) AS re, count(*) AS n").replace("(re IS NOT NULL)::BIGINT", "coalesce(n, 0)"))
def stitch_sum(spark, sf_dir):
    return _stitched(spark, sf_dir, "sum")


@query("smooth_mesh_background", f"WITH {PX}, m AS (SELECT image_id, x // 4 AS a, y // 4 AS b, quantile_cont(re, 0.5) AS m FROM px GROUP BY ALL), w AS (SELECT px.image_id, i, sum(m * (CASE a WHEN 0 THEN 1 - u ELSE u END) * (CASE b WHEN 0 THEN 1 - v ELSE v END)) AS back FROM (SELECT *, least(greatest((x - 1.5) / 4, 0), 1) AS u, least(greatest((y - 1.5) / 4, 0), 1) AS v FROM px) px JOIN m ON m.image_id = px.image_id GROUP BY px.image_id, i) SELECT image_id, i::BIGINT AS i, {sql6(f'(re - back) * {OFF!r}')} AS re FROM px JOIN w USING (image_id, i)")
def smooth_mesh_background(spark, sf_dir):
    return unpack(K.smooth_mesh_background(images(spark, sf_dir), 4)).select("image_id", long("i"), r6(F.col("re") * OFF).alias("re"))


@query("centre_of_symmetry", f"WITH {PX}, c AS (SELECT a.image_id, a.x + b.x AS cx, a.y + b.y AS cy, round(sum(abs(a.re) * abs(b.re)), 6) AS c FROM px a JOIN px b USING (image_id) GROUP BY ALL) SELECT image_id, arg_max(cx, (c, -(cy * 16 + cx))) / 2.0::DOUBLE AS x, arg_max(cy, (c, -(cy * 16 + cx))) / 2.0::DOUBLE AS y FROM c GROUP BY image_id")
def centre_of_symmetry(spark, sf_dir):
    return K.find_centre(images(spark, sf_dir))


_KEEP = f"exp({-2 * math.pi**2!r} * {K2} / 64.0)"


@query("smooth_mask_edges", f"WITH {PX}, m AS (SELECT image_id, i, CASE WHEN x < 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS re FROM px), {forward('m')}, {back('f', 'g', f'fr * {_KEEP}', f'fi * {_KEEP}')} SELECT image_id, i::BIGINT AS i, round(px.re * CASE WHEN x < 2 THEN 0 ELSE least(greatest(g.re, 0), 1) END, 4) + 0.0 AS re FROM px JOIN g USING (image_id, i)")
def smooth_mask_edges(spark, sf_dir):
    p = images(spark, sf_dir).withColumn("mask", F.transform("mask", lambda m, i: F.when(i % 8 < 2, 0).otherwise(1)))
    return unpack(K.smooth_mask_edges(p, 1.0)).select("image_id", long("i"), (F.round("re", 4) + 0.0).alias("re"))


@query("affine_round_trip", "SELECT p_partkey, round(p_size::DOUBLE, 6) + 0.0 AS x, round(p_partkey % 17, 6) + 0.0 AS y, 1.0::DOUBLE AS one FROM part")
def affine_round_trip(spark, sf_dir):
    """Points through a transform of their own and back; the product of a transform with its inverse is the unit matrix."""
    c = lambda v: F.lit(float(v))
    m = V.matrix(c(8), c(6), F.col("p_size").cast("double"), c(2), c(2), (F.col("p_partkey") % 5) * 0.1, (F.col("p_partkey") % 7) * 0.2)
    p = table(spark, sf_dir, "part").withColumn("m", m).withColumn("back", V.inverse(F.col("m")))
    x, y = V.apply(F.col("m"), F.col("p_size").cast("double"), (F.col("p_partkey") % 17).cast("double"))
    p = p.withColumns({"u": x, "v": y})
    x, y = V.apply(F.col("back"), F.col("u"), F.col("v"))
    unit = V.multiply(F.col("m"), F.col("back"))
    one = F.aggregate(F.transform(unit, lambda v, i: F.abs(v - F.when(i % 4 == 0, 1.0).otherwise(0.0))), F.lit(0.0), lambda a, v: a + v) < 1e-6
    return p.select("p_partkey", r6(x).alias("x"), r6(y).alias("y"), F.when(one, 1.0).otherwise(0.0).alias("one"))


@query("point_blur", f"WITH {PX} SELECT image_id, {sql6('sum(exp(-((x - 2) * (x - 2) + (y - 3) * (y - 3)) / 4.5) * re) / sum(exp(-((x - 2) * (x - 2) + (y - 3) * (y - 3)) / 4.5))')} AS re FROM px WHERE abs(x - 2) <= 3 AND abs(y - 3) <= 3 GROUP BY image_id")
def point_blur(spark, sf_dir):
    return N.point_blur(pixels(spark, sf_dir), 2, 3, 1.5, 3).select("image_id", r6(F.col("re")).alias("re"))


@query("line_projection", f"SELECT p_partkey, {sql6('(p_size * cos(0.7) + (p_partkey % 17) * sin(0.7)) * cos(0.7)')} AS x, {sql6('(p_size * cos(0.7) + (p_partkey % 17) * sin(0.7)) * sin(0.7)')} AS y FROM part")
def line_projection(spark, sf_dir):
    x, y = N.line_distance(F.col("p_size"), F.col("p_partkey") % 17, F.lit(0.7))
    return table(spark, sf_dir, "part").select("p_partkey", r6(x).alias("x"), r6(y).alias("y"))


@query("miller_indices", f"WITH {PX} SELECT image_id, i::BIGINT AS i, {sql6('(x - 3.5) * (0.01 / (0.1 * 0.5)) / 0.1')} AS h, {sql6('(y - 3.5) * (0.01 / (0.1 * 0.5)) / 0.2')} AS k FROM px")
def miller_indices(spark, sf_dir):
    p = P.miller(P.reciprocal_planar(pixels(spark, sf_dir), 8, 8, 0.01, 0.1, 0.5), -0.1, 0.2)
    return p.select("image_id", long("i"), r6(F.col("h")).alias("h"), r6(F.col("k")).alias("k"))


@query("reciprocal_grid", f"WITH {PX} SELECT image_id, i::BIGINT AS i, {sql6('(x - 4) * (0.01 / (0.1 * 0.5))')} AS kx, {sql6('(4 - y) * (0.01 / (0.1 * 0.5))')} AS ky, {sql6('(0 - z) * (0.01 / (0.1 * 0.5))')} AS kz FROM px")
def reciprocal_grid(spark, sf_dir):
    p = P.reciprocal_grid(pixels(spark, sf_dir), (3.5, 3.5, 0.0), 0.01, 0.1, 0.5)
    return p.select("image_id", long("i"), *[r6(F.col(c)).alias(c) for c in ("kx", "ky", "kz")])


@query("scaled_and_halved", f"WITH {PX} SELECT image_id, i::BIGINT AS i, {sql6('re * 1.25')} AS re FROM px")
def scaled_and_halved(spark, sf_dir):
    return P.scale(P.scale(pixels(spark, sf_dir), 2.5), 0.5).select("image_id", long("i"), r6(F.col("re")).alias("re"))


@query("mask_as_image", f"WITH {PX} SELECT image_id, i::BIGINT AS i, CASE WHEN abs(re) > 100 THEN 0 ELSE 1 END::DOUBLE AS re FROM px")
def mask_as_image(spark, sf_dir):
    return P.mask_image(P.mask_overexposed(pixels(spark, sf_dir), 100.0, clear=False)).select("image_id", long("i"), "re")


@query("measured_profile", f"WITH {PX} SELECT image_id, k::BIGINT AS shell, {sql6('coalesce(avg(CASE WHEN abs(re) <= 100 THEN abs(re) END), 0)')} AS mean FROM (SELECT image_id, k, re, {BIN}::INT AS b FROM px, (SELECT unnest(range(4)) AS k)) WHERE b = k GROUP BY image_id, k")
def measured_profile(spark, sf_dir):
    """Shell means of measured pixels; a shell without any is 0."""
    p = images(spark, sf_dir).withColumn("mask", F.transform("re", lambda v: F.when(F.abs(v) > 100, 0).otherwise(1)))
    got = K.radial_profile(p, 4, MOST, measured=True)
    spine = images(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shell"))
    return spine.join(got, ["image_id", "shell"], "left").select("image_id", long("shell"), r6(F.coalesce("mean", F.lit(0.0))).alias("mean"))


@query("rescaled_mask", f"WITH {PX}, m AS (SELECT c AS x, r AS y, CASE WHEN c >= 2 AND r < 3 THEN 0 ELSE 1 END AS m FROM (SELECT unnest(range(4)) AS c), (SELECT unnest(range(4)) AS r)), w AS (SELECT p % 8 AS x, p // 8 AS y, sum(m * (1 - abs((p % 8) * (3.0::DOUBLE / 7) - m.x)) * (1 - abs((p // 8) * (3.0::DOUBLE / 7) - m.y))) AS v FROM (SELECT unnest(range(64)) AS p), m WHERE abs((p % 8) * (3.0::DOUBLE / 7) - m.x) < 1 AND abs((p // 8) * (3.0::DOUBLE / 7) - m.y) < 1 GROUP BY p) SELECT image_id, i::BIGINT AS i, (v >= 0.5)::BIGINT AS mask FROM px JOIN w USING (x, y)")
def rescaled_mask(spark, sf_dir):
    """A 4 x 4 mask, brought to the images' grid by bilinear lookup and halved at 0.5, then applied."""
    small = spark.range(16).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % 4).cast("int").alias("x"), F.floor(F.col("id") / 4).cast("int").alias("y"))
    small = small.withColumn("re", F.when((F.col("x") >= 2) & (F.col("y") < 3), 0.0).otherwise(1.0))
    wide = N.bilinear(small, N.grid_points(small, 4, 4, 8, 8)).select(F.col("p").alias("i"), F.when(F.col("re") >= 0.5, 1).otherwise(0).alias("m"))
    return P.mask_external(pixels(spark, sf_dir), wide, ["i"]).select("image_id", long("i"), long("mask"))


_PART = "CASE WHEN (abs(re) <= 100) = {} THEN re ELSE 0 END"


@query("split_transforms", f"WITH {PX}, {forward('px', 'f1', _PART.format('true'))}, {forward('px', 'f0', _PART.format('false'))} SELECT image_id, true AS inside, k::BIGINT AS i, round(fr, 4) + 0.0 AS re, round(fi, 4) + 0.0 AS im FROM f1 UNION ALL SELECT image_id, false, k::BIGINT, round(fr, 4) + 0.0, round(fi, 4) + 0.0 FROM f0")
def split_transforms(spark, sf_dir):
    """The transforms of what lies inside and outside each image's mask; they add up to the image's own."""
    p = images(spark, sf_dir).withColumn("mask", F.transform("re", lambda v: F.when(F.abs(v) <= 100, 1).otherwise(0)))
    part = lambda inside: FT.fft(p.withColumn("re", F.zip_with("re", "mask", lambda v, m: F.when((m == 1) == F.lit(inside), v).otherwise(0.0))))
    show = lambda d, inside: unpack(d).select("image_id", F.lit(inside).alias("inside"), long("i"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("re", "im")])
    return show(part(True), True).unionByName(show(part(False), False))


@query("prtf_profile", f"WITH {PX}, q AS (SELECT label, i, x, y, CASE WHEN min(abs(re)) = 0 THEN 0 ELSE abs(avg(re / nullif(abs(re), 0))) END AS p FROM px GROUP BY label, i, x, y) SELECT label, floor(99 * {SQL_D} / {MOST!r})::BIGINT AS bin, {sql6('avg(p)')} AS prtf, count(*) AS n FROM q GROUP BY label, floor(99 * {SQL_D} / {MOST!r})")
def prtf_profile(spark, sf_dir):
    """The transfer function in 100 radial bins."""
    q = G.prtf(pixels(spark, sf_dir), "label").withColumns({"x": F.col("i") % 8, "y": F.floor(F.col("i") / 8)})
    return q.groupBy("label", F.floor(99 * D() / MOST).alias("bin")).agg(r6(F.avg("prtf")).alias("prtf"), F.count("*").alias("n"))


@query("frobenius", f"WITH {PX}, {ZIP} SELECT image_id, {sql6('sum(a * b)')} AS re, 0.0::DOUBLE AS im FROM z GROUP BY image_id")
def frobenius(spark, sf_dir):
    p = images(spark, sf_dir)
    x = K.inner_product(p, p.withColumn("image_id", F.col("image_id") - 1))
    return x.select("image_id", r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


_CONV = f"s AS (SELECT *, CASE WHEN x < 5 AND y < 5 THEN 1 ELSE 0 END AS s, abs(re) * 1.1 AS f, abs(re) AS a FROM px)"


@query("convergence_metrics", f"WITH {PX}, {_CONV} SELECT image_id, {sql6('sum(CASE WHEN s = 0 THEN re * re ELSE 0 END) / sum(CASE WHEN s = 1 THEN re * re ELSE 0 END)')} AS ereal, {sql6('sum(pow(f - a, 2)) / sum(a * a)')} AS efourier, {sql6('sum(f) / sum(a)')} AS fcfo, {sql6('100.0 * sum(s) / count(*)')} AS sup_size FROM s GROUP BY image_id")
def convergence_metrics(spark, sf_dir):
    inside = (F.col("x") < 5) & (F.col("y") < 5)
    p = pixels(spark, sf_dir).withColumns({"support": F.when(inside, 1).otherwise(0), "fourier_abs": F.abs("re") * 1.1, "amplitude": F.abs("re")})
    x = G.convergence(p)
    return x.select("image_id", *[r6(F.col(c)).alias(c) for c in x.columns[1:]])


# ---- options and schedules


@query("option_defaults")
def option_defaults(spark, sf_dir):
    """The options of a configuration for each user: algorithm, seed and an unknown name, validated."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    names = F.array(*[F.lit(a) for a in O.ALGORITHMS])
    text = F.concat(F.lit('phasing_method = { algorithm = "'), F.element_at(names, (F.col("user_id") % len(O.ALGORITHMS) + 1).cast("int")), F.lit('"; };\nrandom_seed = '), F.col("user_id").cast("string"), F.lit(";\nnonsense = 1;"))
    return O.validate(users.select(F.col("user_id").alias("config_id"), text.alias("text")))


@query(
    "options_given",
    "WITH u AS (SELECT DISTINCT user_id AS config_id FROM events), n AS (SELECT ['hio', 'raar', 'diff_map', 'hpr', 'cflip', 'raar_cflip', 'espresso', 'haar', 'so2d', 'raar_proj', 'hio_proj'] AS n) "
    "SELECT config_id, 'phasing_method.algorithm' AS path, '\"' || n[config_id % 11 + 1] || '\"' AS value FROM u, n UNION ALL SELECT config_id, 'random_seed', config_id::VARCHAR FROM u UNION ALL SELECT config_id, NULL, 'no such option: nonsense' FROM u",
)
def options_given(spark, sf_dir):
    return option_defaults(spark, sf_dir).where("given or path is null").select("config_id", "path", "value")


@query("linear_schedule", f"SELECT event_id, {sql6('2 + (5 - 2) * ((event_id % 100) - 10) / 80.0')} AS v FROM events")
def linear_schedule(spark, sf_dir):
    c = lambda v: F.lit(float(v))
    return table(spark, sf_dir, "events").select("event_id", r6(schedules.linear(F.col("event_id") % 100, c(10), c(90), c(2), c(5))).alias("v"))


@query("region_rows", f"WITH {PX} SELECT image_id, CASE WHEN x < 4 THEN 'left' ELSE 'right' END AS region, count(*) AS n, round(sum(re), 3) + 0.0 AS total, max(i)::BIGINT AS last FROM px WHERE re > 0 GROUP BY ALL")
def region_rows(spark, sf_dir):
    """The image-to-pixels table function, used in SQL over a table."""
    from ..functions.tables import register

    register(spark)
    images(spark, sf_dir).select("image_id", "nx", "ny", "re", "im", "mask").createOrReplaceTempView("packed_images")
    found = spark.sql("SELECT image_id, CASE WHEN x < 4 THEN 'left' ELSE 'right' END AS region, count(*) AS n, round(sum(re), 3) + 0.0 AS total, cast(max(i) AS long) AS last FROM image_pixels(TABLE(packed_images)) WHERE re > 0 GROUP BY 1, 2")
    spark.catalog.dropTempView("packed_images")
    return found


@query("image_moments", f"WITH {PX} SELECT label, i::BIGINT AS i, count(*) AS n, {sql6('avg(re)')} AS mean, round(var_pop(re), 4) + 0.0 AS variance FROM px GROUP BY label, i".replace("round(avg(re), 6)", f"round(avg(re) / {math.pi!r}, 6)").replace("round(var_pop(re), 4)", f"round(var_pop(re) / {math.pi!r}, 4)"))
def image_moments(spark, sf_dir):
    """A user's aggregate: moments of all pixels of the images of a label, from partial states."""
    from ..functions.tables import Moments, aggregated

    found = aggregated(images(spark, sf_dir), "label", ["re"], Moments()).select("label", "n", F.posexplode(F.arrays_zip("mean", "variance")).alias("i", "c"))
    return found.select("label", long("i"), "n", r6(F.col("c.mean") / math.pi).alias("mean"), (F.round(F.col("c.variance") / math.pi, 4) + 0.0).alias("variance"))


@query("expr_user_functions", f"WITH {PX} SELECT image_id, i::BIGINT AS i, {sql6('least(greatest(re, -50.0), 80.0) + re * re / (1 + abs(re))')} AS re, {sql6('0.5 * re')} AS im FROM px")
def expr_user_functions(spark, sf_dir):
    """Functions of a user's own in expressions: of Columns, and of a body in SQL."""
    from ..functions import expression

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION soft(re DOUBLE, im DOUBLE) RETURNS STRUCT<re: DOUBLE, im: DOUBLE> RETURN named_struct('re', re * re / (1 + abs(re)), 'im', 0.5D * re)")
    expression.define("clip", 3, lambda a, low, high: (F.least(F.greatest(a[0], low[0]), high[0]), a[1]))
    expression.define("soft", 1, "soft")
    return expression.evaluate("clip(A, -50, 80) + soft(A)", pixels(spark, sf_dir)).select("image_id", long("i"), r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


# ---- volumes and simulated exposures; tests hold them against other ways


def _turned_points(cos: str, sin: str, p: str, source: str) -> str:
    return f"SELECT image_id, {p} AS p, {cos} * (x - 3.5) + {sin} * (y - 3.5) + 3.5 AS fx, -{sin} * (x - 3.5) + {cos} * (y - 3.5) + 3.5 AS fy FROM {source}"


_GRID = "(SELECT i % 8 AS x, i // 8 AS y, i FROM (SELECT unnest(range(64)) AS i))"


@query("rotated_euler", f"SELECT image_id, p::BIGINT AS i, {sql6('CASE WHEN out = 1 THEN 0 ELSE re END')} AS re FROM ({bilinear_sql(_turned_points(repr(math.cos(0.6)), repr(math.sin(0.6)), 'i', f'{IDS}, {_GRID}'))})")
def rotated_euler(spark, sf_dir):
    return unpack(V.rotate(images(spark, sf_dir), 0.6)).select("image_id", long("i"), r6(F.col("re")).alias("re"))


@query("common_lines", f"WITH {PX}, t AS ({bilinear_sql(_turned_points(f'cos({2 * math.pi / 6!r} * s)', f'sin({2 * math.pi / 6!r} * s)', 's * 64 + i', f'{IDS}, {_GRID}, (SELECT unnest(range(6)) AS s)'))}) SELECT t.image_id, (p // 64)::BIGINT AS step, (p % 64)::BIGINT AS i, {sql6('CASE WHEN out = 1 THEN 0 ELSE t.re END - px.re')} AS re FROM t JOIN px ON px.image_id = t.image_id AND px.i = p % 64")
def common_lines(spark, sf_dir):
    d = V.common_lines(images(spark, sf_dir), 6)
    cells = d.select("image_id", long("step"), F.posexplode("re").alias("i", "re"))
    return cells.select("image_id", "step", long("i"), r6(F.col("re")).alias("re"))


@query("multi_shot_exposure")
def multi_shot_exposure(spark, sf_dir):
    return unpack(V.exposures(images(spark, sf_dir), 3, 0.5, 3.0, 0.1, 10.0)).select("image_id", "i", F.round("re", 2).alias("re"))


def _deautocorrelated(rounds: int) -> str:
    """The same start, and rounds over lists of 64 values, with transforms as products with the matrices of cosines and sines."""
    each = lambda e: f"list_transform(range(64), lambda i: {e})"
    onto = lambda v, of: f"list_transform({of}, lambda r: list_dot_product({v}, r))"
    start = np.random.default_rng(0).random((8, 8)).ravel() + 0.1
    seed = f"[{', '.join(repr(float(v)) for v in start)}]"
    turn = f"{2 * math.pi / 8!r} * ((i % 8) * (k % 8) + (i // 8) * (k // 8))"
    lines = f"SELECT i, list(cos({turn}) ORDER BY k) AS c, list(sin({turn}) ORDER BY k) AS s FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS k) GROUP BY i"
    matrices = f"m AS MATERIALIZED (SELECT list(c ORDER BY i) AS cm, list(s ORDER BY i) AS sm FROM ({lines}))"
    power = each("p[i + 1] * p[i + 1] + q[i + 1] * q[i + 1]")
    modulus = f"SELECT image_id, cm, sm, {onto('v', 'cm')} AS p, {onto('v', 'sm')} AS q FROM (SELECT image_id, list(abs(re) ORDER BY i) AS v FROM px GROUP BY image_id), m"
    wanted = f"ac AS MATERIALIZED (SELECT image_id, list_transform({onto(power, 'cm')}, lambda a: greatest(a / 64, 0.0)) AS ac FROM ({modulus}))"
    first = f"SELECT 0, image_id, ac, sqrt(list_sum(ac)), {each(f'({seed})[i + 1] * sqrt(list_sum(ac)) / {float(start.sum())!r}')} FROM ac"
    transform = f"SELECT n, image_id, ac, total, x, cm, sm, {onto('x', 'cm')} AS p, {onto('x', 'sm')} AS q FROM r, m WHERE n < {rounds}"
    own = f"SELECT *, {onto(power, 'cm')} AS own FROM ({transform})"
    ratio = f"SELECT *, {onto(each('ac[i + 1] / greatest(own[i + 1] / 64, 1e-12)'), 'cm')} AS g FROM ({own})"
    back = f"SELECT *, {onto(each('p[i + 1] * g[i + 1]'), 'cm')} AS bc, {onto(each('q[i + 1] * g[i + 1]'), 'sm')} AS bs FROM ({ratio})"
    step = each("greatest(x[i + 1] * (bc[i + 1] + bs[i + 1]) / (64 * total), 0)")
    return f"WITH RECURSIVE {PX}, {matrices}, {wanted}, r(n, image_id, ac, total, x) AS ({first} UNION ALL SELECT n + 1, image_id, ac, total, {step} FROM ({back})) SELECT image_id, i::BIGINT AS i, round(x[i + 1], 2) + 0.0 AS re FROM r, (SELECT unnest(range(64)) AS i) WHERE n = {rounds}"


@query("deautocorrelate", _deautocorrelated(50))
def deautocorrelate(spark, sf_dir):
    p = images(spark, sf_dir).withColumn("re", F.transform("re", F.abs))
    return unpack(FT.deautocorrelate(FT.correlate(p, p), 50)).select("image_id", long("i"), (F.round("re", 2) + 0.0).alias("re"))


_CUT_ROWS = f"SELECT image_id, x, y, re FROM px WHERE x < 7 AND y < 1 + image_id % 7"


@query("padded_for_fft", f"WITH {PX}, f(h, ny) AS (VALUES (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 8)), c AS ({_CUT_ROWS}) SELECT px.image_id, 8::BIGINT AS nx, f.ny::BIGINT AS ny, px.x::BIGINT AS x, px.y::BIGINT AS y, coalesce(c.re, 0.0) AS re, CASE WHEN c.re IS NULL THEN 0 ELSE 1 END::BIGINT AS mask FROM px JOIN f ON f.h = 1 + image_id % 7 LEFT JOIN c USING (image_id, x, y) WHERE px.y < f.ny")
def padded_for_fft(spark, sf_dir):
    """Images cut to seven columns and one to seven rows, padded to sizes that transform quickly."""
    cut = images(spark, sf_dir).withColumn("ny", (1 + F.col("image_id") % 7).cast("int")).withColumn("nx", F.lit(7))
    inside = lambda c: F.filter(F.col(c), lambda v, i: (i % 8 < 7) & (F.floor(i / 8) < F.col("ny")))
    cut = cut.select("image_id", "label", "nx", "ny", "nz", *[inside(c).alias(c) for c in ("re", "im", "mask")])
    return unpack(FT.pad_to_friendly(cut), "nx", "ny").select("image_id", long("nx"), long("ny"), long("x"), long("y"), "re", long("mask"))


_SOFT = f"exp({-2 * math.pi**2 * 0.25!r} * {K2} / 64.0)"
_RINGS = f"""{forward()}, p AS (SELECT image_id, (k % 8 + 4) % 8 AS x, (k // 8 + 4) % 8 AS y, sqrt(fr * fr + fi * fi) * {_SOFT} AS p FROM f), r AS (SELECT image_id, least(x, 7 - x, y, 7 - y) AS ring, max(p) AS p FROM p GROUP BY ALL),
s AS (SELECT image_id, 2 * (4 - min(ring) FILTER (WHERE p > 0.3 * most)) AS side FROM (SELECT *, max(p) OVER (PARTITION BY image_id) AS most FROM r) GROUP BY image_id)"""
_RESAMPLED = "SELECT image_id, y * side + x AS p, x * 7.0::DOUBLE / (side - 1) AS fx, y * 7.0::DOUBLE / (side - 1) AS fy FROM s, (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y) WHERE x < side AND y < side"


@query("limited_sampling", f"WITH {PX}, {_RINGS} SELECT t.image_id, side::BIGINT AS side, p::BIGINT AS i, {sql6('t.re')} AS re FROM ({bilinear_sql(_RESAMPLED)}) t JOIN s ON s.image_id = t.image_id")
def limited_sampling(spark, sf_dir):
    """Images resampled to the extent of their softened Patterson function."""
    return unpack(FT.limit_sampling(images(spark, sf_dir), 1.0, 0.3, 0.5), "nx").select("image_id", F.col("nx").cast("long").alias("side"), long("i"), r6(F.col("re")).alias("re"))


@query("overlap_of_moved", f"WITH {PX} SELECT image_id, i::BIGINT AS i, round(abs(re), 3) + 0.0 AS re FROM px")
def overlap_of_moved(spark, sf_dir):
    """Each image's moduli, moved and (every other one of a batch) reflected, are brought back onto themselves."""
    p = images(spark, sf_dir).withColumn("re", F.transform("re", F.abs))

    def move(v, m):
        v = v.copy()
        v[::2] = v[::2, ::-1, ::-1]
        return np.roll(v, (2, 3), (1, 2)), m

    moved = FT.per_image(p, move)
    return unpack(FT.maximise_overlap(p, moved)).select("image_id", long("i"), (F.round("re", 3) + 0.0).alias("re"))


@query("phase_overlap_of_moved", f"WITH {PX} SELECT image_id, i::BIGINT AS i, round(re, 3) + 0.0 AS re FROM px")
def phase_overlap_of_moved(spark, sf_dir):
    p = images(spark, sf_dir)
    moved = FT.per_image(p, lambda v, m: (np.roll(v, (1, -1), (1, 2)), m))
    return unpack(FT.maximise_phase_overlap(p, moved)).select("image_id", long("i"), (F.round("re", 3) + 0.0).alias("re"))


_FAR = "sqrt(pow(p % 8 - 3.5, 2) + pow(p // 8 - 3.5, 2))"
_NEARER = f"(cos(0.6) / cos(asin({_FAR} * {math.sin(0.6 * math.cos(0.6))!r} / {math.hypot(3.5, 3.5)!r})))"
_STRETCHED = f"SELECT image_id, p, (p % 8 - 3.5) * {_NEARER} + 3.5 AS fx, (p // 8 - 3.5) * {_NEARER} + 3.5 AS fy FROM {IDS}, (SELECT unnest(range(64)) AS p)"


@query("angle_stretch", f"SELECT image_id, p::BIGINT AS i, {sql6('re')} AS re FROM ({bilinear_sql(_STRETCHED)})")
def angle_stretch(spark, sf_dir):
    return unpack(K.stretch(images(spark, sf_dir), 0.6)).select("image_id", long("i"), r6(F.col("re")).alias("re"))


@query("centre_shift", f"WITH {PX} SELECT image_id, (x - image_id % 3)::BIGINT AS x, (y + image_id % 2)::BIGINT AS y, {sql6('re')} AS re FROM px")
def centre_shift(spark, sf_dir):
    """Pixels on a common centre, by the offsets of their images."""
    p = pixels(spark, sf_dir)
    shifts = images(spark, sf_dir).select("image_id", (F.col("image_id") % 3).cast("int").alias("dx"), (-(F.col("image_id") % 2)).cast("int").alias("dy"))
    return M.recentred(p, shifts).select("image_id", long("x"), long("y"), r6(F.col("re")).alias("re"))


@query("fft_benchmark")
def fft_benchmark(spark, sf_dir):
    return FT.benchmark(spark).select("size")


_KEYS, _VALUES = "[0.0, 50.0 + user_id % 40, 300.0]", "[user_id % 7, user_id % 5, user_id % 3]"
_INSIDE = "len(list_filter(k, lambda a: a <= value))"


@query("mapped_schedules", f"""WITH e AS (SELECT event_id, value, {_KEYS}::DOUBLE[] AS k, {_VALUES}::DOUBLE[] AS v FROM events), p AS (SELECT *, {_INSIDE} AS n FROM e),
u AS (SELECT *, (value - k[n]) / (k[n + 1] - k[n]) AS u FROM p), t AS (SELECT *, 0.5 + sinh(asinh(4 * u - 2) / 3) AS t FROM u)
SELECT event_id, round(CASE WHEN n = 0 THEN v[1] WHEN n = 3 THEN v[3] ELSE v[n] + (3 * t * t - 2 * t * t * t) * (v[n + 1] - v[n]) END, 6) + 0.0 AS mapped,
  round(CASE WHEN n = 0 THEN v[1] WHEN n = 3 THEN v[3] ELSE v[n + 1] + (v[n] - v[n + 1]) / (exp(10 * (u - 0.5)) + 1) END, 6) + 0.0 AS between FROM t""")
def mapped_schedules(spark, sf_dir):
    """A map and checkpoints of each user, read at each event's value."""
    keys = F.array(F.lit(0.0), 50.0 + F.col("user_id") % 40, F.lit(300.0))
    values = F.array(*[(F.col("user_id") % k).cast("double") for k in (7, 5, 3)])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(schedules.mapped(F.col("value"), keys, values)).alias("mapped"), r6(schedules.shifted(F.col("value"), keys, values)).alias("between"))


_UPDATES = """u AS (SELECT user_id AS run, event_id AS seq, event_id % 500 AS from_iteration,
  CASE event_type WHEN 'view' THEN 'phasing_method.beta' WHEN 'error' THEN 'logging.output_period' WHEN 'signup' THEN 'input_data.beamstop_radius' WHEN 'purchase' THEN 'phasing_method.algorithm' ELSE 'no.such' END AS option,
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN (event_id % 97)::VARCHAR ELSE event_id % 97 || '.5' END WHEN 'purchase' THEN ['raar', 'hio', 'er'][event_id % 3 + 1] ELSE (event_id % 89)::VARCHAR END AS value FROM events),
f AS (SELECT *, CASE WHEN option = 'no.such' THEN 'no such option' WHEN option = 'input_data.beamstop_radius' THEN 'can''t be set during a run' WHEN option = 'logging.output_period' AND value LIKE '%.5' THEN 'is of type int'
    WHEN option = 'phasing_method.algorithm' AND value = 'er' THEN 'is one of hio, raar, diff_map, hpr, cflip, raar_cflip, espresso, haar, so2d, raar_proj, hio_proj' END AS wrong,
  CASE WHEN from_iteration <= 400 THEN (from_iteration + 99) // 100 * 100 END AS met FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY run, option, met, wrong IS NULL ORDER BY from_iteration DESC, seq DESC) AS k FROM f),
a AS (SELECT run, seq, option, value, from_iteration, met, coalesce(wrong, CASE WHEN met IS NULL THEN 'no chunk yet' WHEN k > 1 THEN 'overtaken' END, '') AS reason FROM r)"""


def _updates(spark, sf_dir):
    """Events as updates of options of a run a user, and chunks of 100 iterations."""
    e, kind, k = table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    names = {"view": "phasing_method.beta", "error": "logging.output_period", "signup": "input_data.beamstop_radius", "purchase": "phasing_method.algorithm"}
    option = F.coalesce(*[F.when(kind == n, F.lit(o)) for n, o in names.items()], F.lit("no.such"))
    period = F.when(k % 2 == 0, (k % 97).cast("string")).otherwise(F.concat((k % 97).cast("string"), F.lit(".5")))
    value = F.when(kind == "error", period).when(kind == "purchase", F.element_at(F.array(F.lit("raar"), F.lit("hio"), F.lit("er")), (k % 3 + 1).cast("int"))).otherwise((k % 89).cast("string"))
    updates = e.select(F.col("user_id").alias("run"), k.alias("seq"), option.alias("option"), value.alias("value"), (k % 500).alias("from_iteration"))
    return updates, e.select(F.col("user_id").alias("run")).distinct().withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(400), F.lit(100))))


@query("option_updates", f"WITH {_UPDATES} SELECT run, seq, option, value, from_iteration, met AS \"at\", reason = '' AS taken, reason FROM a")
def option_updates(spark, sf_dir):
    """What becomes of each update of an option during its run."""
    from ..functions.updates import audited

    return audited(*_updates(spark, sf_dir))


@query("options_in_force", f"WITH {_UPDATES}, c AS (SELECT DISTINCT user_id AS run FROM events), s AS (SELECT run, unnest(range(0, 500, 100)) AS start FROM c) SELECT s.run, s.start::BIGINT AS start, a.option, arg_max(a.value, a.met) AS value FROM s JOIN a ON a.run = s.run AND a.reason = '' AND a.met <= s.start GROUP BY s.run, s.start, a.option")
def options_in_force(spark, sf_dir):
    """The options that updates have set by each chunk of each run."""
    from ..functions.updates import audited, in_force

    updates, chunks = _updates(spark, sf_dir)
    return in_force(audited(updates, chunks), chunks)
