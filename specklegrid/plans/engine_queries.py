"""Queries that run the Fourier, phasing, geometry, learning and stream operators. Transforms of the 8 x 8 images and single phasing steps carry SQL that sums directly; iterations are held against other checks in tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import expression
from ..model import PX, images, pixels, unpack
from ..operators import fourier as FT
from ..operators import geometry, learning, phasing
from ..operators import pixel as P
from ..streaming.frames import track_batch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def with_sql(name: str, sql: str, f) -> None:
    QUERIES[name], ORACLE_SQL[name] = f, sql


#: Values that are multiples of a power of two of 0.001 are divided by pi before they are rounded, so that none stands half-way.
OFF = 1 / math.pi


def _values(packed, digits: int = 4, by: float = 1.0):
    return unpack(packed).select("image_id", F.col("i").cast("long").alias("i"), *[(F.round(F.col(c) * by, digits) + 0.0).alias(c) for c in ("re", "im")])


def shown(re: str, im: str, digits: int = 4) -> str:
    return f"image_id, i::BIGINT AS i, round({re}, {digits}) + 0.0 AS re, round({im}, {digits}) + 0.0 AS im"


# ---- direct sums: K counts frequencies (or places), TURN is the angle between place i and frequency k

K = "(SELECT unnest(range(64)) AS k)"
TURN = f"({2 * math.pi!r} * ((i % 8) * (k % 8) + (i // 8) * (k // 8)) / 8.0)"
KX, KY = "(CASE WHEN k % 8 < 4 THEN k % 8 ELSE k % 8 - 8 END)", "(CASE WHEN k // 8 < 4 THEN k // 8 ELSE k // 8 - 8 END)"
K2 = f"({KX} * {KX} + {KY} * {KY})"


def forward(source: str = "px", name: str = "f", re: str = "re", im: str = "0.0", sign: int = -1) -> str:
    """A CTE of the transform of (image_id, i, re, im)."""
    turn = f"({sign} * {TURN})"
    return f"{name} AS MATERIALIZED (SELECT image_id, k, sum(({re}) * cos{turn} - ({im}) * sin{turn}) AS fr, sum(({re}) * sin{turn} + ({im}) * cos{turn}) AS fi FROM {source}, {K} GROUP BY image_id, k)"


def back(source: str, name: str, fr: str = "fr", fi: str = "fi") -> str:
    """A CTE of the inverse transform (divided by the pixels) of (image_id, k, fr, fi)."""
    return f"{name} AS MATERIALIZED (SELECT image_id, i, sum(({fr}) * cos{TURN} - ({fi}) * sin{TURN}) / 64 AS re, sum(({fr}) * sin{TURN} + ({fi}) * cos{TURN}) / 64 AS im FROM {source}, (SELECT unnest(range(64)) AS i) GROUP BY image_id, i)"


def filtered(hr: str, hi: str = "0.0", re: str = "re", im: str = "im", digits: int = 4) -> str:
    return f"WITH {PX}, {forward()}, {back('f', 'g', f'fr * ({hr}) - fi * ({hi})', f'fr * ({hi}) + fi * ({hr})')} SELECT {shown(re, im, digits)} FROM g"


def _over(f, digits: int = 4, by: float = 1.0):
    return lambda spark, sf_dir: _values(f(images(spark, sf_dir)), digits, by)


PLACES = "(SELECT image_id, k AS i, fr, fi FROM f)"
with_sql("fft_forward", f"WITH {PX}, {forward()} SELECT {shown('fr', 'fi')} FROM {PLACES}", _over(FT.fft))
with_sql("fft_inverse", f"WITH {PX}, {forward(sign=1)} SELECT {shown('fr', 'fi')} FROM {PLACES}", _over(FT.ifft))
with_sql("patterson", f"WITH {PX}, {forward(re='abs(re)')} SELECT {shown('sqrt(fr * fr + fi * fi)', '0.0::DOUBLE')} FROM {PLACES}", _over(FT.patterson))
with_sql("gaussian_blur", filtered(f"exp({-2 * math.pi**2!r} * {K2} / 64.0)"), _over(lambda p: FT.gaussian_blur(p, 1.0)))
with_sql("low_pass", filtered(f"CASE WHEN {K2} <= 4 THEN 1 ELSE 0 END"), _over(lambda p: FT.band(p, 2.0)))
with_sql("high_pass", filtered(f"CASE WHEN {K2} > 4 THEN 1 ELSE 0 END"), _over(lambda p: FT.band(p, 2.0, "high")))
_P = f"({1e-3 * 1e-9 / (4 * math.pi) * (2 * math.pi / 1e-6) ** 2!r} * {K2} / 64.0)"
with_sql("propagate", filtered(f"cos{_P}", f"sin{_P}"), _over(lambda p: FT.propagate(p, 1e-3, 1e-9, 1e-6)))
_ROUGH = f"WITH {PX}, {forward()}, {back('f', 'g', f'fr * exp({-8 * math.pi**2!r} * {K2} / 64.0)', f'fi * exp({-8 * math.pi**2!r} * {K2} / 64.0)')}"
with_sql("roughness", f"{_ROUGH} SELECT image_id, g.i::BIGINT AS i, round(least(abs(g.re - px.re) / abs(g.re), 100), 3) AS re FROM g JOIN px USING (image_id, i)",
         lambda spark, sf_dir: unpack(FT.roughness(images(spark, sf_dir))).select("image_id", F.col("i").cast("long").alias("i"), F.round(F.least("re", F.lit(100.0)), 3).alias("re")))
_WIDE = f"({2 * math.pi!r} * ((i % 16) * {KX} + (i // 16) * {KY}) / 16.0)"
with_sql("fourier_rescale", f"WITH {PX}, {forward()} SELECT {shown(f'sum(fr * cos{_WIDE} - fi * sin{_WIDE}) / 64 * {OFF!r}', f'sum(fr * sin{_WIDE} + fi * cos{_WIDE}) / 64 * {OFF!r}')} FROM f, (SELECT unnest(range(256)) AS i) GROUP BY image_id, i", _over(lambda p: FT.fourier_rescale(p, 16, 16), by=OFF))


def _tv_sql(rounds: int) -> str:
    """Rounds over lists of 64 values: differences, their unit vectors, and the step against their divergence."""
    at = lambda a, x, y: f"{a}[(i // 8 + {y}) % 8 * 8 + (i % 8 + {x}) % 8 + 1]"
    half = lambda a, x, y: f"({at(a, x, y)} - {at(a, (8 - x) % 8, (8 - y) % 8)}) / 2"
    each = lambda e: f"list_transform(range(64), lambda i: {e})"
    size = "sqrt(gx[i + 1] * gx[i + 1] + gy[i + 1] * gy[i + 1] + 1e-8)"
    step = f"greatest(u[i + 1] - 0.1 * (1 - data[i + 1] / u[i + 1] - 0.1 * ({half('px', 1, 0)} + {half('py', 0, 1)})), 1e-6)"
    first = "SELECT 0, image_id, list(greatest(re, 0.0) ORDER BY i), list(greatest(re, 1e-6) ORDER BY i) FROM px GROUP BY image_id"
    gradient = f"SELECT n, image_id, data, u, {each(half('u', 1, 0))} AS gx, {each(half('u', 0, 1))} AS gy FROM r WHERE n < {rounds}"
    unit = f"SELECT n, image_id, data, u, {each(f'gx[i + 1] / {size}')} AS px, {each(f'gy[i + 1] / {size}')} AS py FROM ({gradient})"
    return f"WITH RECURSIVE {PX}, r(n, image_id, data, u) AS ({first} UNION ALL SELECT n + 1, image_id, data, {each(step)} FROM ({unit})) SELECT image_id, i::BIGINT AS i, round(u[i + 1], 4) + 0.0 AS re, 0.0::DOUBLE AS im FROM r, (SELECT unnest(range(64)) AS i) WHERE n = {rounds}"


with_sql("tv_denoise", _tv_sql(20), _over(lambda p: FT.tv_denoise(p, rounds=20)))


def _next(p):
    return p.withColumn("image_id", F.col("image_id") - 1)


_SUM = "WITH {px} SELECT a.image_id, k::BIGINT AS i, round(sum(a.re * b.embedding[1 + {at}]::DOUBLE) * {off!r}, 2) + 0.0 AS re FROM px a JOIN {k} ON true JOIN (SELECT vec_id AS image_id, list_transform(embedding, lambda v: round(v::DOUBLE * 1000, 3)) AS embedding FROM embeddings WHERE len(embedding) = 64) b ON b.image_id = a.image_id + 1 GROUP BY a.image_id, k"
_BACK, _FOLD = "((x - k % 8 + 8) % 8 + 8 * ((y - k // 8 + 8) % 8))::INT", "((k % 8 - x + 8) % 8 + 8 * ((k // 8 - y + 8) % 8))::INT"


def _re(packed):
    return unpack(packed).select("image_id", F.col("i").cast("long").alias("i"), (F.round(F.col("re") * OFF, 2) + 0.0).alias("re"))


def _correlated(convolve):
    def run(spark, sf_dir):
        p = images(spark, sf_dir)
        return _re(FT.correlate(p, _next(p), convolve))

    return run


with_sql("cross_correlation", _SUM.format(px=PX, k=K, at=_BACK, off=OFF), _correlated(False))
with_sql("convolution", _SUM.format(px=PX, k=K, at=_FOLD, off=OFF), _correlated(True))

_HOLE = "CASE WHEN sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) < 1.5 THEN 0 ELSE 1 END"
_GAUSS = f"exp({-2 * math.pi**2!r} * {K2} / 64.0)"


def _filled(rounds: int, start: str, keep: str = _GAUSS) -> str:
    """Rounds over a list of 64 values an image; a blur is a row of one matrix for each place, made from the filter's frequencies."""
    turn = f"cos({2 * math.pi / 8!r} * ((i % 8 - j % 8) * (k % 8) + (i // 8 - j // 8) * (k // 8)))"
    matrix = f"w AS (SELECT i, j, sum({keep} * {turn}) / 64 AS w FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j), {K} GROUP BY i, j)"
    rows = "m AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(w ORDER BY j) AS r FROM w GROUP BY i))"
    first = f"h AS MATERIALIZED (SELECT image_id, list({_HOLE} ORDER BY i) AS open, list(re ORDER BY i) AS v, list(CASE WHEN {_HOLE} = 0 THEN {start} ELSE re END ORDER BY i) AS x FROM px GROUP BY image_id)"
    step = "list_transform(range(64), lambda i: CASE WHEN open[i + 1] = 0 THEN list_dot_product(x, m[i + 1]) ELSE v[i + 1] END)"
    again = f"r(n, image_id, open, v, x) AS (SELECT 0, image_id, open, v, x FROM h UNION ALL SELECT n + 1, image_id, open, v, {step} FROM r, m WHERE n < {rounds})"
    return f"WITH RECURSIVE {PX}, {matrix}, {rows}, {first}, {again} SELECT image_id, i::BIGINT AS i, round(x[i + 1], 4) + 0.0 AS re FROM r, (SELECT unnest(range(64)) AS i) WHERE n = {rounds}"


def _holes(spark, sf_dir):
    hole = F.transform("mask", lambda m, i: F.when(F.hypot(i % 8 - 3.5, F.floor(i / 8) - 3.5) < 1.5, 0).otherwise(1))
    return images(spark, sf_dir).withColumn("mask", hole)


def _real(packed):
    return unpack(packed).select("image_id", F.col("i").cast("long").alias("i"), (F.round("re", 4) + 0.0).alias("re"))


with_sql("interpolate_empty", _filled(40, "re"), lambda spark, sf_dir: _real(FT.interpolate_blanks(_holes(spark, sf_dir), 1.0)))
with_sql("localised_blur", _filled(40, "0.0"), lambda spark, sf_dir: _real(FT.localised_blur(_holes(spark, sf_dir), 1.0)))
with_sql("interpolate_sinc", _filled(20, "re", f"CASE WHEN {K2} <= 4 THEN 1 ELSE 0 END"), lambda spark, sf_dir: _real(FT.interpolate_blanks(_holes(spark, sf_dir), 2.0, 20, "sinc")))
_R2 = "(pow(CASE WHEN x < 4 THEN x ELSE x - 8 END, 2) + pow(CASE WHEN y < 4 THEN y ELSE y - 8 END, 2))"
with_sql("autocorrelation_filter", f"WITH {PX} SELECT image_id, i::BIGINT AS i, round(re * CASE WHEN {_R2} < 16 THEN pow({_R2} / 16, 2) * exp(2 - {_R2} / 8) ELSE 1 END, 4) + 0.0 AS re FROM px", lambda spark, sf_dir: _real(FT.autocorrelation_filter(images(spark, sf_dir), 2.0)))


def _expression(text: str):
    return lambda spark, sf_dir: _values(expression.evaluate_packed(text, images(spark, sf_dir)), 3, OFF)


with_sql("expr_fft", f"WITH {PX}, {forward()} SELECT {shown(f'(sqrt(fr * fr + fi * fi) + 2) * {OFF!r}', '0.0::DOUBLE', 3)} FROM {PLACES}", _expression("abs(fft(A)) + 2"))
with_sql("expr_fft_filter", f"WITH {PX}, {forward()}, t AS (SELECT image_id, k, CASE WHEN k % 8 < 4 THEN fr ELSE 0 END AS fr, CASE WHEN k % 8 < 4 THEN fi ELSE 0 END AS fi FROM f), {back('t', 'g')} SELECT {shown(f're * {OFF!r}', f'im * {OFF!r}', 3)} FROM g", _expression("ifft(fft(A) * (posx < 4)) / 64"))


# ---- one step of each algorithm from x = (i % 3 + 1) re, against amplitudes |F(re)|, in the support x < 5 and y < 5

_INSIDE = "(x < 5 AND y < 5)"
_STEP = f"WITH {PX}, x0 AS (SELECT image_id, i, x, y, re * (i % 3 + 1) AS re FROM px), {forward('px', 'm')}, {forward('x0', 'f')}"
_ONTO = "u AS (SELECT image_id, k, f.fr * sqrt(m.fr * m.fr + m.fi * m.fi) / sqrt(f.fr * f.fr + f.fi * f.fi) AS fr, f.fi * sqrt(m.fr * m.fr + m.fi * m.fi) / sqrt(f.fr * f.fr + f.fi * f.fi) AS fi FROM f JOIN m USING (image_id, k))"
_P_AND_X = f"p AS (SELECT image_id, i, x0.x, x0.y, x0.re AS a, 0.0 AS b, g.re AS pr, g.im AS pi FROM g JOIN x0 USING (image_id, i))"


def _step_sql(re: str, im: str) -> str:
    return f"{_STEP}, {_ONTO}, {back('u', 'g')}, {_P_AND_X} SELECT {shown(re, im, 3)} FROM p"


_ELSE = lambda inside, outside: f"CASE WHEN {_INSIDE} THEN {inside} ELSE {outside} END"
_B = 0.9
_FAR = "2 * pr - a"
_STEPS = {
    "er": (_ELSE("pr", "0"), _ELSE("pi", "0")),
    "hio": (_ELSE("pr", f"a - {_B} * pr"), _ELSE("pi", f"-{_B} * pi")),
    "raar": (_ELSE("pr", f"{1 - 2 * _B!r} * pr + {_B} * a"), _ELSE("pi", f"{1 - 2 * _B!r} * pi")),
    "hpr": tuple(f"CASE WHEN {_INSIDE} AND sqrt(pow(2 * pr - a, 2) + pow(2 * pi, 2)) >= {1 - _B!r} * sqrt(pr * pr + pi * pi) THEN {v} ELSE {w} END" for v, w in (("pr", f"a - {_B} * pr"), ("pi", f"-{_B} * pi"))),
}
_MOST = "max(sqrt(pr * pr + pi * pi)) OVER (PARTITION BY image_id)"
_STEPS["cflip"] = tuple(f"CASE WHEN sqrt(pr * pr + pi * pi) < 0.05 * {_MOST} THEN -{v} ELSE {v} END" for v in ("pr", "pi"))
_IS_FAR = f"(sqrt(pow(pr - a, 2) + pi * pi) > 0.05 * {_MOST})"
_STEPS["espresso"] = (f"CASE WHEN {_IS_FAR} AND pr > 0 THEN pr ELSE 0 END + CASE WHEN {_IS_FAR} THEN 0 ELSE a END - {_B} * pr", f"CASE WHEN {_IS_FAR} AND pr > 0 THEN pi ELSE 0 END - {_B} * pi")


def _one_step(algorithm):
    def run(spark, sf_dir):
        p = images(spark, sf_dir)
        runs = p.select(
            "image_id", F.lit(0).alias("seed"), "nx", "ny", "nz", "re", "mask", F.transform("re", lambda v, i: v * (i % 3 + 1)).alias("x"),
            F.transform("re", lambda v, i: F.when((i % 8 < 5) & (i < 40), 1).otherwise(0)).alias("support"),
        )
        amplitudes = FT.per_image(p, lambda v, m: (np.abs(FT.fftn(v)) + 0j, m)).select("image_id", F.col("re").alias("amplitude"))
        runs = runs.drop("re").join(amplitudes, "image_id").select("image_id", "seed", "nx", "ny", "nz", "amplitude", "mask", F.col("x").alias("re"), F.transform("x", lambda v: F.lit(0.0)).alias("im"), "support", F.lit(0).alias("iteration"), F.lit("{}").alias("state"))
        return _values(phasing.advance(runs, phasing.Settings(algorithm=algorithm, beta=_B), 1).select("image_id", "nx", "ny", "nz", "re", "im", "mask"), 3)

    return run


for _a, (_r, _i) in _STEPS.items():
    with_sql(f"step_{_a}", _step_sql(_r, _i), _one_step(_a))
_G1, _G2 = -(4 + 2.9 * 0.1 + 0.9 * 0.01) / (0.9 * (4 - 0.1 + 0.01)), 2.1 / 1.8
_DM = _STEP.replace(forward("x0", "f"), f"{forward('x0', 'f')}, w0 AS (SELECT image_id, i, {_ELSE('re', f'{-_G1!r} * re')} AS re FROM x0), {forward('w0', 'f1')}")
_ONTO1 = _ONTO.replace("u AS", "u1 AS").replace("FROM f JOIN", "FROM f1 AS f JOIN")
with_sql(
    "step_dm", f"{_DM}, {_ONTO}, {_ONTO1}, {back('u', 'g')}, {back('u1', 'g1')}, {_P_AND_X} SELECT "
    + shown(f"a + 0.9 * ({_ELSE(f'{1 + _G2!r} * pr - {_G2!r} * a', '0')} - g1.re)", f"0.9 * ({_ELSE(f'{1 + _G2!r} * pi', '0')} - g1.im)", 3) + " FROM p JOIN g1 USING (image_id, i)", _one_step("dm"),
)


def superimpose(spark, sf_dir):
    p = images(spark, sf_dir)
    return _values(FT.superimpose(p, _next(p)))


_MOVED = "b[((i // 8 - s // 8 + 8) % 8) * 8 + (i % 8 - s % 8 + 8) % 8 + 1]"
with_sql(
    "superimpose",
    f"""WITH {PX}, l AS MATERIALIZED (SELECT image_id, list(re ORDER BY i) AS v FROM px GROUP BY image_id),
c AS (SELECT a.image_id, a.v AS a, m, CASE WHEN m = 1 THEN list_reverse(o.v) ELSE o.v END AS b FROM l a JOIN l o ON o.image_id = a.image_id + 1, (SELECT unnest([0, 1]) AS m)),
k AS (SELECT image_id, m, b, s, list_sum(list_transform(range(64), lambda i: a[i + 1] * {_MOVED})) AS cc FROM c, (SELECT unnest(range(64)) AS s)),
best AS (SELECT image_id, m, arg_max(s, (round(abs(cc), 6), -s)) AS s, arg_max(cc, (round(abs(cc), 6), -s)) AS cc, any_value(b) AS b FROM k GROUP BY image_id, m),
t AS (SELECT image_id, arg_max(s, (round(abs(cc), 6), -m)) AS s, arg_max(cc, (round(abs(cc), 6), -m)) AS cc, arg_max(b, (round(abs(cc), 6), -m)) AS b FROM best GROUP BY image_id)
SELECT image_id, i::BIGINT AS i, round(CASE WHEN cc < 0 THEN -1 ELSE 1 END * {_MOVED}, 4) + 0.0 AS re, 0.0::DOUBLE AS im FROM t, (SELECT unnest(range(64)) AS i)""",
    superimpose,
)


def _start(spark, sf_dir, seeds=2):
    p = images(spark, sf_dir).withColumn("re", F.transform("re", lambda v: F.abs(v)))
    amplitudes = FT.per_image(p, lambda v, m: (np.abs(FT.fftn(v)) + 0j, np.ones_like(m)))
    support = p.select("image_id", F.transform("re", lambda v, i: F.when((i % 8 < 5) & (i < 40), 1).otherwise(0)).alias("support"))
    return phasing.start(amplitudes, support, seeds)


for _a in phasing.ALGORITHMS:
    QUERIES[f"phasing_{_a}"] = lambda spark, sf_dir, a=_a: phasing.advance(_start(spark, sf_dir), phasing.Settings(algorithm=a), 20, logs=True).select("image_id", "seed", "iteration", *[F.round(c, 6).alias(c) for c in ("ereal", "efourier", "fcfo", "sup_size")])


@query
def phasing_shrinking_support(spark, sf_dir):
    o = phasing.Settings(algorithm="raar", support_every=5, support="area", area_map=((0, 0.5), (20, 0.2)), blur_map=((0, 2.0), (20, 0.7)), real=True)
    return phasing.advance(_start(spark, sf_dir, 1), o, 20, logs=True).select("image_id", "seed", "iteration", "sup_size")


def uniform_sql(seed: int, *columns: str) -> str:
    """pixel.uniform in SQL."""
    h = f"{seed}::BIGINT"
    for c in columns:
        h = f"((({h}) * {P.MIX_A} + ({c})::BIGINT % {P.PRIME} * {P.MIX_B} + {P.MIX_C}) % {P.PRIME})"
    return f"(SELECT (((h * h % {P.PRIME}) * (h * h % {P.PRIME}) % {P.PRIME}) * h % {P.PRIME}) / {float(P.PRIME)!r} FROM (SELECT ({h})::BIGINT AS h))"


_U = uniform_sql(5, "image_id", "i")
with_sql("random_phases", f"WITH {PX} SELECT image_id, i::BIGINT AS i, round(abs(re) * cos({2 * math.pi!r} * u), 4) + 0.0 AS re, round(abs(re) * sin({2 * math.pi!r} * u), 4) + 0.0 AS im FROM (SELECT *, {_U} AS u FROM px)",
         lambda spark, sf_dir: P.rephase(pixels(spark, sf_dir), seed=5).select("image_id", F.col("i").cast("long").alias("i"), (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im")))
with_sql("added_noise", f"WITH {PX} SELECT image_id, i::BIGINT AS i, round(re * (1 + 0.1 * sqrt(-2 * ln(1 - u)) * cos({2 * math.pi!r} * w)), 4) + 0.0 AS re FROM (SELECT *, {uniform_sql(0, 'image_id', 'i')} AS u, {uniform_sql(1, 'image_id', 'i')} AS w FROM px)",
         lambda spark, sf_dir: P.add_noise(pixels(spark, sf_dir), 0.1).select("image_id", F.col("i").cast("long").alias("i"), (F.round("re", 4) + 0.0).alias("re")))


def background_tracking(spark, sf_dir):
    frames = images(spark, sf_dir).select(F.col("label").cast("long").alias("stream"), F.col("image_id").alias("seq"), F.col("re").alias("v"))
    return track_batch(frames).select("stream", "seq", F.round("correlation", 6).alias("correlation"), "hit")


_CENTRED = "list_transform({0}, lambda c: c - list_avg({0}))"
with_sql(
    "background_tracking",
    f"""WITH RECURSIVE {PX}, f AS MATERIALIZED (SELECT label, image_id, v, row_number() OVER (PARTITION BY label ORDER BY image_id) AS k FROM (SELECT label, image_id, list(re ORDER BY i) AS v FROM px GROUP BY label, image_id)),
t(label, k, image_id, back, run, r, hit) AS (SELECT label, k, image_id, v, 0, 1.0::DOUBLE, false FROM f WHERE k = 1 UNION ALL
  SELECT label, k, image_id, CASE WHEN r >= 0.95 THEN list_transform(range(64), lambda i: (back[i + 1] * 2 + v[i + 1]) / 3) WHEN run >= 10 THEN v ELSE back END, CASE WHEN r >= 0.95 OR run >= 10 THEN 0 ELSE run + 1 END, r, r < 0.95
  FROM (SELECT *, list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 1e-300) AS r FROM (
    SELECT f.label, f.k, f.image_id, f.v, t.back, t.run, {_CENTRED.format('t.back')} AS a, {_CENTRED.format('f.v')} AS b FROM t JOIN f ON f.label = t.label AND f.k = t.k + 1)))
SELECT label::BIGINT AS stream, image_id AS seq, round(r, 6) AS correlation, hit FROM t""",
    background_tracking,
)


def incremental_pca(spark, sf_dir):
    x = images(spark, sf_dir).select("label", "image_id", "re")
    return learning.incremental_pca(x, "label", "image_id", "re").select("label", "component", F.round("value", 4).alias("value"))


def _pca_sql() -> str:
    """The stream's state is its mean and two vectors; a step subtracts the mean, turns the first vector and, with what is left, the second."""
    each = lambda e: f"list_transform(range(64), lambda i: {e})"
    norm = lambda v: f"sqrt(list_dot_product({v}, {v}))"
    turned = lambda v, u: each(f"(n - 1 - a) / n * {v}[i + 1] + (1 + a) / n * {u}[i + 1] * list_dot_product({u}, {v}) / {norm(v)}")
    mean = f"SELECT label, k::DOUBLE AS n, k, x, {each('mean[i + 1] + (x[i + 1] - mean[i + 1]) / k')} AS mean, v1, v2 FROM (SELECT f.label, f.k, f.x, t.mean, t.v1, t.v2 FROM t JOIN f ON f.label = t.label AND f.k = t.k + 1)"
    gap = f"SELECT *, {each('x[i + 1] - mean[i + 1]')} AS u, CASE WHEN n > 2 THEN least(2.0, n - 2) ELSE 0 END AS a FROM ({mean})"
    first = f"SELECT label, n, k, mean, a, u, v2, v1 IS NULL AS fresh, CASE WHEN v1 IS NULL THEN u ELSE {turned('v1', 'u')} END AS v1 FROM ({gap})"
    rest = f"SELECT *, {each(f'u[i + 1] - list_dot_product(u, v1) / list_dot_product(v1, v1) * v1[i + 1]')} AS w FROM ({first})"
    step = f"SELECT label, k, mean, v1, CASE WHEN fresh THEN v2 WHEN v2 IS NULL THEN w ELSE {turned('v2', 'w')} END AS v2 FROM ({rest})"
    rows = "f AS MATERIALIZED (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY image_id) AS k FROM (SELECT label, image_id, list(re ORDER BY i) AS x FROM px GROUP BY label, image_id))"
    last = "l AS (SELECT t.* FROM t JOIN (SELECT label, max(k) AS k FROM f GROUP BY label) m ON m.label = t.label AND m.k = t.k)"
    show = " UNION ALL ".join(f"SELECT label, {c}::INT AS component, round({norm(f'v{c + 1}')}, 4) AS value FROM l WHERE v{c + 1} IS NOT NULL" for c in (0, 1))
    return f"WITH RECURSIVE {PX}, {rows}, t(label, k, mean, v1, v2) AS (SELECT label, k, x, NULL::DOUBLE[], NULL::DOUBLE[] FROM f WHERE k = 1 UNION ALL {step}), {last} {show}"


with_sql("incremental_pca", _pca_sql(), incremental_pca)


def gtm_step(spark, sf_dir):
    centres = 100 * np.sin(7.0 * np.arange(6)[:, None] + 3.0 * np.arange(64)[None, :])
    return learning.gtm_step(images(spark, sf_dir).select(F.col("re").alias("v")), centres, 1e-4).select(F.col("k").cast("long").alias("k"), F.round("w", 4).alias("w"))


with_sql("gtm_step", f"WITH {PX}, d AS (SELECT image_id, k, sum(pow(re - 100 * sin(7.0 * k + 3.0 * i), 2)) AS d FROM px, (SELECT unnest(range(6)) AS k) GROUP BY image_id, k), e AS (SELECT image_id, k, exp(-0.5e-4 * (d - min(d) OVER (PARTITION BY image_id))) AS e FROM d) SELECT k::BIGINT AS k, round(sum(r), 4) AS w FROM (SELECT k, e / sum(e) OVER (PARTITION BY image_id) AS r FROM e) GROUP BY k", gtm_step)


def sample_compression(spark, sf_dir):
    px = pixels(spark, sf_dir).where(F.abs("re") >= 250)
    return learning.compress(px.select(F.col("image_id").alias("sample_id"), F.col("i").alias("idx"), F.floor(F.abs("re") / 250).cast("int").alias("n"))).select("key", "weight", "first")


with_sql("sample_compression", f"WITH {PX}, k AS (SELECT image_id, string_agg('{{' || i || ', ' || floor(abs(re) / 250)::INT || '}}', ';' ORDER BY i) AS key FROM px WHERE abs(re) >= 250 GROUP BY image_id) SELECT key, count(*) AS weight, min(image_id) AS first FROM k GROUP BY key", sample_compression)


def geometry_solve(spark, sf_dir):
    """A system for each user of `events`: two frames, the second turned by an angle that follows from the number; control points lie on two radial lines, and the solver finds the angle again."""
    turn = (F.col("user_id") % 40 - 20) / 100.0
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("system"), turn.alias("turn")).distinct()
    none = {"dx": 0.0, "dy": 0.0, "zoom": 1.0, "alpha": 0.0, "theta": 0.0}
    rows = []
    for frame in (0, 1):
        rows.append(F.struct(*[F.lit(v).alias(c) for c, v in (("kind", "frame"), ("frame", frame), ("constraint", ""), ("shape", ""))], F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit("").alias("name")))
        for c, angle in (("a", 0.5), ("b", 1.4)):
            for r in (2.0, 5.0):
                t = F.lit(angle) - (F.col("turn") if frame else F.lit(0.0))
                rows.append(F.struct(*[F.lit(v).alias(k) for k, v in (("kind", "point"), ("frame", frame), ("constraint", c), ("shape", "line"))], (r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"), F.lit("").alias("name")))
    rows.append(F.struct(*[F.lit(v).alias(c) for c, v in (("kind", "variable"), ("frame", 1), ("constraint", ""), ("shape", ""))], F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit("theta").alias("name")))
    df = users.select("system", F.explode(F.array(*rows)).alias("r")).select("system", "r.kind", F.col("r.frame").cast("long").alias("frame"), "r.constraint", "r.shape", "r.x", "r.y", *[F.lit(v).alias(c) for c, v in none.items()], "r.name")
    found = geometry.solve_systems(df)
    return found.select("system", F.col("frame").cast("long").alias("frame"), (F.round("theta", 4) + 0.0).alias("theta"), (F.round("rms", 5) + 0.0).alias("rms"))


with_sql("geometry_solve", "SELECT DISTINCT user_id AS system, frame::BIGINT AS frame, round(CASE WHEN frame = 1 THEN (user_id % 40 - 20) / 100.0 ELSE 0 END, 4)::DOUBLE + 0.0 AS theta, 0.0::DOUBLE AS rms FROM events, (SELECT unnest([0, 1]) AS frame)", geometry_solve)
