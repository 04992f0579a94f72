"""Queries over the 8 x 8 images of `embeddings`: pixel-wise, mask, neighbourhood, join and aggregate operators, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expression
from ..model import PX, center_distance, images, pixels, unpack
from ..operators import aggregate as G
from ..operators import fourier as FT
from ..operators import learning as L
from ..operators import packed as K
from ..operators import pixel as P
from ..operators import spatial as N

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
def D():
    return center_distance(8, 8)


SQL_D = "sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5))"
MOST = math.hypot(8, 8) / 2


def r6(c):
    return F.round(c, 6) + 0.0


def sql6(text: str) -> str:
    return f"round({text}, 6) + 0.0"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def simple(name: str, make, sql_re: str, *, sql_im: str | None = None, sql_mask: str | None = None, source: str = "px", ctes: str = "", where: str = "", form=pixels, off: bool = False):
    """A query of pixel values: image_id, x, y, re and, where given, im and mask. off: values of means are divided by pi, so that none stands half-way between two roundings."""
    sql_re, by = (f"({sql_re}) * {1 / math.pi!r}", 1 / math.pi) if off else (sql_re, 1.0)
    columns = ["re"] + ["im"] * bool(sql_im) + ["mask"] * bool(sql_mask)

    def run(spark, sf_dir):
        rows = make(form(spark, sf_dir))
        return (unpack(rows) if form is images else rows).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *[r6(F.col(c) * by if off and c == "re" else F.col(c)).alias(c) if c != "mask" else F.col(c).cast("long").alias(c) for c in columns])

    fields = [f"{sql6(sql_re)} AS re"] + ([f"{sql6(sql_im)} AS im"] if sql_im else []) + ([f"({sql_mask})::BIGINT AS mask"] if sql_mask else [])
    query(name, f"WITH {PX}{', ' + ctes if ctes else ''} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, {', '.join(fields)} FROM {source}{' WHERE ' + where if where else ''}")(run)


def packed(name: str, make, *rest, **more):
    """simple() for an operator of packed rows, which never shuffles."""
    return simple(name, make, *rest, form=images, **more)


W = "OVER (PARTITION BY image_id)"
AT = "round(e.embedding[({at})::INT + 1]::DOUBLE * 1000, 3)"  # a value of the same image, read from its array
BIN = f"least(floor({SQL_D} * 4 / {MOST!r}), 3)"
simple("dephase", P.dephase, "abs(re)", sql_im="0.0::DOUBLE")
simple("to_amplitudes", P.to_amplitudes, "sqrt(greatest(re, 0))")
simple("to_intensities", P.to_intensities, "re * re")
simple("background_constant", lambda p: P.background_constant(p, 50.0), "greatest(re - 50, 0)")
packed("normalise", lambda p: K.normalise(p.withColumn("re", F.transform("re", lambda v: v * v))), f"re * re / nullif(sum(re * re) {W}, 0)")
simple("fermi_high_pass", lambda p: P.fermi_high_pass(P.draw_mask(p, F.lit(True), 0), 3.0, 0.25, D()), f"re * (1 - 1 / (1 + exp(({SQL_D} - 3.0) / 0.25)))", sql_mask=f"CASE WHEN 1 - 1 / (1 + exp(({SQL_D} - 3.0) / 0.25)) < 1e-4 THEN 1 ELSE 0 END")
packed("radial_minimum_subtract", lambda p: K.radial_minimum_subtract(p, 4, MOST), f"re - min(abs(re)) OVER (PARTITION BY image_id, {BIN})")
packed("cap_display", lambda p: K.cap(p, 0.15), f"least(abs(re), 0.15 * max(abs(re)) {W})")
simple("bayer_green", lambda p: P.bayer_channel(p, "green"), "re", source="(SELECT image_id, x // 2 AS x, y // 2 AS y, re FROM px WHERE x % 2 = 0 AND y % 2 = 1)")
simple("solid_angle_stretch", lambda p: P.solid_angle_stretch(p, D(), 0.01, 0.1), f"re / pow(cos(atan({SQL_D} * 0.01 / 0.1)), 3)")
simple("resolution_map", lambda p: p.withColumn("re", P.resolution(D(), 0.01, 0.1, 0.5)), f"2 * sin(atan({SQL_D} * 0.01 / 0.1) / 2) / 0.5")
simple("reciprocal_planar", lambda p: P.reciprocal_planar(p, 8, 8, 0.01, 0.1, 0.5).withColumns({"re": F.col("kx"), "im": F.col("ky")}), "(x - 3.5) * (0.01 / (0.1 * 0.5))", sql_im="(y - 3.5) * (0.01 / (0.1 * 0.5))")
simple("reciprocal_ewald", lambda p: P.reciprocal_ewald(p, 8, 8, 0.01, 0.1, 0.5).withColumns({"re": F.col("kx"), "im": F.col("kz")}),
       "(x - 3.5) * 0.01 / sqrt(pow((x - 3.5) * 0.01, 2) + pow((y - 3.5) * 0.01, 2) + 0.01) / 0.5", sql_im="(0.1 / sqrt(pow((x - 3.5) * 0.01, 2) + pow((y - 3.5) * 0.01, 2) + 0.01) - 1) / 0.5")
packed("charge_flip", lambda p: K.charge_flip(p, 0.2), f"CASE WHEN abs(re) < 0.2 * max(abs(re)) {W} THEN -re ELSE re END")
simple("phase_image", P.phase, "atan2(0.0, re)")
packed("mirror_subtract", K.mirror_subtract, "CASE WHEN x < 4 THEN re - o ELSE 0 END", source=f"(SELECT px.*, {AT.format(at='8 * y + 7 - x')} AS o FROM px JOIN embeddings e ON e.vec_id = image_id)")
simple("fresnel_phase", lambda p: P.fresnel_phase(p, 2.0, 0.5, F.col("x") - 3.5, F.col("y") - 3.5), f"re * cos({2.0 * 0.5 / (4 * math.pi)!r} * {SQL_D} * {SQL_D})", sql_im=f"re * sin({2.0 * 0.5 / (4 * math.pi)!r} * {SQL_D} * {SQL_D})")
simple("mask_overexposed", lambda p: P.mask_overexposed(p, 100.0), "CASE WHEN re >= 100 THEN 0 ELSE re END", sql_mask="CASE WHEN re >= 100 THEN 0 ELSE 1 END")
simple("mask_saturated", lambda p: P.mask_overexposed(p, 100.0, clear=False), "re", sql_mask="CASE WHEN abs(re) > 100 THEN 0 ELSE 1 END")
simple("invert_mask", lambda p: P.invert_mask(P.mask_overexposed(p, 100.0, clear=False)), "re", sql_mask="CASE WHEN abs(re) > 100 THEN 1 ELSE 0 END")
simple("beamstop_cross", lambda p: P.beamstop(p, D(), 2.0, 1.0, 8, 8), f"CASE WHEN {SQL_D} < 2 OR abs(x - 3.5) < 1 OR abs(y - 3.5) < 1 THEN 0 ELSE re END", sql_mask=f"CASE WHEN {SQL_D} < 2 OR abs(x - 3.5) < 1 OR abs(y - 3.5) < 1 THEN 0 ELSE 1 END")
packed("mask_at_maximum", K.mask_at_maximum, "re", sql_mask="CASE WHEN a >= m THEN 0 ELSE 1 END", source=f"(SELECT *, abs(re) AS a, max(abs(re)) {W} AS m FROM px)")
simple("mask_lines", lambda p: P.draw_mask(P.draw_mask(p, F.col("x") == 2), (F.abs(F.col("x") - 5) <= 1) & (F.abs(F.col("y") - 5) <= 1)), "re", sql_mask="CASE WHEN x = 2 OR (abs(x - 5) <= 1 AND abs(y - 5) <= 1) THEN 0 ELSE 1 END")
simple("crop_rectangle", lambda p: P.crop(p, 2, 1, 5, 6), "re", source="(SELECT image_id, x - 2 AS x, y - 1 AS y, re FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6)")
packed("threshold_support", lambda p: K.threshold_support(p, 0.5), "CASE WHEN a >= 0.5 * m THEN 1 ELSE 0 END", source=f"(SELECT *, abs(re) AS a, max(abs(re)) {W} AS m FROM px)")
packed("threshold_support_strict", lambda p: K.threshold_support(p, 0.5, strict=True), "CASE WHEN a > 0.5 * m THEN 1 ELSE 0 END", source=f"(SELECT *, abs(re) AS a, max(abs(re)) {W} AS m FROM px)")
packed("area_threshold_support", lambda p: K.area_threshold_support(p, 0.25), "CASE WHEN a >= level THEN 1 ELSE 0 END", source="(SELECT *, max(CASE WHEN k = 17 THEN a END) OVER (PARTITION BY image_id) AS level FROM (SELECT *, abs(re) AS a, row_number() OVER (PARTITION BY image_id ORDER BY abs(re) DESC, i) AS k FROM px))")
simple("fftshift", lambda p: N.fftshift(p, 8, 8), "re", source="(SELECT image_id, (x + 4) % 8 AS x, (y + 4) % 8 AS y, re FROM px)")
simple("rotate_quarter", lambda p: N.rotate_quarters(p, 8, 8, 1), "re", source="(SELECT image_id, 7 - y AS x, x AS y, re FROM px)")
simple("reflect", lambda p: N.reflect(p, 8, 8), "re", source="(SELECT image_id, 7 - x AS x, 7 - y AS y, re FROM px)")
simple("translate_cyclic", lambda p: N.translate(p, 8, 8, 3, -2), "re", source="(SELECT image_id, (x + 3) % 8 AS x, (y + 6) % 8 AS y, re FROM px)")
simple("translate_in_fourier", lambda p: N.translate_in_fourier(p, 8, 8, 1.5, 0.5), *[f"re * {f}({-2 * math.pi!r} * ((CASE WHEN x < 4 THEN x ELSE x - 8 END) * 1.5 / 8 + (CASE WHEN y < 4 THEN y ELSE y - 8 END) * 0.5 / 8))" for f in ("cos",)], sql_im=f"re * sin({-2 * math.pi!r} * ((CASE WHEN x < 4 THEN x ELSE x - 8 END) * 1.5 / 8 + (CASE WHEN y < 4 THEN y ELSE y - 8 END) * 0.5 / 8))")
NEAR = "near AS (SELECT p.image_id, (p.x + a - 1 + 8) % 8 AS x, (p.y + b - 1 + 8) % 8 AS y, a - 1 AS dx, b - 1 AS dy, p.re AS v FROM px p, (SELECT unnest(range(3)) AS a) A, (SELECT unnest(range(3)) AS b) B)"
packed("box_blur", lambda p: K.box_blur(p, 1), "re", ctes=NEAR, source="(SELECT image_id, x, y, avg(v) AS re FROM near GROUP BY ALL)")
packed("gaussian_blur_direct", lambda p: K.gaussian_blur_direct(p, 1.0, 1), "re", ctes=NEAR, source="(SELECT image_id, x, y, sum(exp(-(dx * dx + dy * dy) / 2.0) * v) / sum(exp(-(dx * dx + dy * dy) / 2.0)) AS re FROM near GROUP BY image_id, x, y)")
NINE = ", ".join(AT.format(at=f"((x + {a}) % 8) + 8 * ((y + {b}) % 8)") for a in (7, 0, 1) for b in (7, 0, 1))
packed("min3x3_filter", lambda p: K.zero_near_negative(p.withColumn("re", F.transform("re", lambda v: v + 150))), "CASE WHEN least + 150 < 0 THEN 0 ELSE re + 150 END", source=f"(SELECT px.*, least({NINE}) AS least FROM px JOIN embeddings e ON e.vec_id = image_id)")
_PAIR = f"(SELECT image_id, x, y, re, o, CASE WHEN abs(re) > 100 THEN 0 ELSE 1 END AS m1, CASE WHEN abs(o) > 100 THEN 0 ELSE 1 END AS m2 FROM (SELECT px.*, {AT.format(at='63 - i')} AS o FROM px JOIN embeddings e ON e.vec_id = image_id))"
packed("centrosym_average", lambda p: K.centrosymmetric(p.withColumn("mask", F.transform("re", lambda v: F.when(F.abs(v) > 100, 0).otherwise(1)))), "CASE WHEN m1 + m2 = 0 THEN 0 ELSE (re * m1 + o * m2) / (m1 + m2) END", sql_mask="greatest(m1, m2)", source=_PAIR)
packed("mesh_background", lambda p: K.mesh_background(p, 4), "re - m", source="(SELECT px.*, quantile_cont(re, 0.5) OVER (PARTITION BY image_id, x // 4, y // 4) AS m FROM px)")
packed("row_median_removal", lambda p: K.row_median_subtract(p, 4), "re - m", source="(SELECT px.*, quantile_cont(re, 0.5) OVER (PARTITION BY image_id, x // 4, y) AS m FROM px)")
packed("column_line_removal", lambda p: K.column_mean_subtract(p, 3), "re - m", source="(SELECT px.*, avg(CASE WHEN y < 3 THEN re END) OVER (PARTITION BY image_id, x) AS m FROM px)")
packed("strip_background", lambda p: K.strip_background(p, 2, 2), "r1 - m2", ctes=f"c1 AS (SELECT px.*, re - avg(CASE WHEN y < 2 THEN re END) OVER (PARTITION BY image_id, x) AS r1 FROM px)", source="(SELECT *, avg(CASE WHEN x < 2 THEN r1 END) OVER (PARTITION BY image_id, y) AS m2 FROM c1)")
DARK = "d AS (SELECT label, i, avg(re) AS dark FROM px GROUP BY label, i)"


def _dark(p):
    return p.groupBy("label", "i").agg(F.avg("re").alias("dark"))


simple("dark_subtract", lambda p: P.dark_subtract(p, _dark(p), ["label", "i"]), "greatest(re - abs(dark), 0)", ctes=DARK, source="px JOIN d USING (label, i)", off=True)
simple("noise_removal", lambda p: P.noise_removal(p, _dark(p).withColumn("noise", F.abs("dark")).drop("dark"), ["label", "i"]), "CASE WHEN re - abs(dark) < sqrt(abs(re)) THEN 0 ELSE re - abs(dark) END", ctes=DARK, source="px JOIN d USING (label, i)", off=True)
simple("mask_external", lambda p: P.mask_external(p, _dark(p).select("label", "i", F.when(F.col("dark") > 0, 1).otherwise(0).alias("m")), ["label", "i"]), "re", sql_mask="CASE WHEN dark > 0 THEN 1 ELSE 0 END", ctes=DARK, source="px JOIN d USING (label, i)")
simple("fill_blanks", lambda p: P.fill_blanks(P.draw_mask(p, F.col("x") > 4, 0), p.groupBy("x", "y").agg(F.avg("re").alias("v")), 1, 0), "CASE WHEN x > 4 AND v IS NOT NULL THEN abs(v) ELSE re END", sql_mask="CASE WHEN x > 4 AND v IS NULL THEN 0 ELSE 1 END", ctes="f AS (SELECT x + 1 AS x, y, avg(re) AS v FROM px GROUP BY x, y)", source="px LEFT JOIN f USING (x, y)")
simple("split_by_mask", lambda p: P.split_by_mask(P.mask_overexposed(p, 100.0, clear=False)).withColumn("mask", F.col("inside").cast("int")), "CASE WHEN (abs(re) <= 100) = inside THEN re ELSE 0 END", sql_mask="inside::INT", source="px, (SELECT unnest([true, false]) AS inside)")
packed("bilinear_half", lambda p: K.rescale(p, 4, 4), "re",
       ctes="g AS (SELECT image_id, p % 4 AS x, p // 4 AS y, (p % 4) * (7.0::DOUBLE / 3) AS fx, (p // 4) * (7.0::DOUBLE / 3) AS fy FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(16)) AS p)), c AS (SELECT g.*, floor(fx)::INT + a AS cx, floor(fy)::INT + b AS cy, (CASE WHEN a = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE WHEN b = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) AS w FROM g, (SELECT unnest([0, 1]) AS a) A, (SELECT unnest([0, 1]) AS b) B)",
       source="(SELECT c.image_id, c.x, c.y, sum(w * coalesce(px.re, 0)) AS re FROM c LEFT JOIN px ON px.image_id = c.image_id AND px.x = cx AND px.y = cy GROUP BY c.image_id, c.x, c.y)")
PROGRAMS = {
    "expr_arithmetic": ("A*2 + 3 - A/4", "re * 2 + 3 - re / 4", "0.0::DOUBLE"),
    "expr_complex": ("(A + Ai) * (1 - 2i)", "re + 2 * re", "re - 2 * re"),
    "expr_power": ("abs(A) ^ 0.5 + sqrt(abs(A))", "2 * sqrt(abs(re))", "0.0::DOUBLE"),
    "expr_if": ("if(abs(A) > 100, A, 0)", "CASE WHEN abs(re) > 100 THEN re ELSE 0 END", "0.0::DOUBLE"),
    "expr_logic": ("(A > 50 && posx < 4) || posy == 7", "CASE WHEN (abs(re) > 50 AND x < 4) OR y = 7 THEN 1 ELSE 0 END", "0.0::DOUBLE"),
    "expr_minmax": ("min(A, 10) + max(A, -10)", "least(re, 10) + greatest(re, -10)", "0.0::DOUBLE"),
    "expr_parts": ("re(A) + im(conj(A*i)) + arg(A)", "re + atan2(0.0, re)", "-re"),
    "expr_exp": ("exp(A/1000) + log(abs(A) + 1)", "exp(re / 1000) + ln(abs(re) + 1)", "0.0::DOUBLE"),
}
for _name, (_text, _re, _im) in PROGRAMS.items():
    simple(_name, lambda p, t=_text: expression.evaluate(t, p), _re, sql_im=_im)
packed("expr_sum", lambda p: expression.evaluate_packed("A / sum(abs(A))", p), "re / (sum(abs(re)) OVER (PARTITION BY image_id))", sql_im="0.0::DOUBLE")
simple("expr_set_mask", lambda p: expression.evaluate("set_mask(A, A > 50)", p), "re", sql_mask="CASE WHEN abs(re) > 50 THEN 1 ELSE 0 END")
simple("select_by_expression", lambda p: expression.select_pixels("abs(A) > 150", p), "1", where="abs(re) > 150")


def _pair(spark, sf_dir):
    """All packed images, and each under the number before its own."""
    p = images(spark, sf_dir)
    return p, p.withColumn("image_id", F.col("image_id") - 1)


def _places(rows, digits: int, name: str):
    return rows.select("image_id", F.posexplode("v").alias("i", "v")).select("image_id", F.col("i").cast("long").alias("i"), (F.round("v", digits) + 0.0).alias(name))


def _next(p, names=("image_id",)):
    """Each image zipped with that of the next number."""
    return G.pairs(p, p.withColumn("image_id", F.col("image_id") - 1), ["image_id", "i"])


ZIP = "z AS (SELECT a.image_id, a.i, a.x, a.y, a.re AS a, b.re AS b FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.i = b.i)"


@query("radial_profile", f"WITH {PX} SELECT image_id, {BIN}::BIGINT AS shell, {sql6('avg(abs(re))')} AS mean, {sql6('stddev_samp(abs(re)) / nullif(avg(abs(re)), 0)')} AS rel_sigma, count(*) AS n FROM px GROUP BY image_id, {BIN}")
def radial_profile(spark, sf_dir):
    x = K.radial_profile(images(spark, sf_dir), 4, MOST)
    return x.select("image_id", F.col("shell").cast("long").alias("shell"), r6(F.col("mean")).alias("mean"), r6(F.col("rel_sigma")).alias("rel_sigma"), "n")


@query("image_integrals", f"WITH {PX} SELECT image_id, {sql6('sum(re)')} AS sum_re, {sql6('sum(im)')} AS sum_im, {sql6('sum(abs(re))')} AS sum_abs, round(avg(abs(re)), 9) + 0.0 AS mean_abs, {sql6('stddev_pop(abs(re))')} AS sigma_abs FROM px GROUP BY image_id")
def image_integrals(spark, sf_dir):
    x = K.integrate(images(spark, sf_dir))
    return x.select("image_id", *[(F.round(c, 9 if c == "mean_abs" else 6) + 0.0).alias(c) for c in x.columns[1:]])


@query("panel_integrals", f"WITH {PX} SELECT image_id, (x // 4)::BIGINT AS panel, {sql6('sum(re)')} AS sum_re FROM px GROUP BY image_id, x // 4")
def panel_integrals(spark, sf_dir):
    return K.panel_integrate(images(spark, sf_dir), 4).select("image_id", "panel", r6(F.col("sum_re")).alias("sum_re"))


@query("image_extremes", f"WITH {PX} SELECT image_id, min(re) AS least, max(re) AS most, (arg_max(i, (re, -i)))::BIGINT AS at FROM px GROUP BY image_id".replace("arg_max(i, (re, -i))", "min(CASE WHEN re = m THEN i END)").replace("FROM px GROUP", "FROM (SELECT *, max(re) OVER (PARTITION BY image_id) AS m FROM px) GROUP"))
def image_extremes(spark, sf_dir):
    return K.extremes(images(spark, sf_dir))


@query("total_r_factor", f"WITH {PX}, {ZIP} SELECT image_id, {sql6('sum(abs(abs(a) - abs(b))) / nullif(sum(abs(a) + abs(b)), 0)')} AS r FROM z GROUP BY image_id")
def total_r_factor(spark, sf_dir):
    return K.r_factor(*_pair(spark, sf_dir)).select("image_id", r6(F.col("r")).alias("r"))


@query("shell_r_factor", f"WITH {PX}, {ZIP} SELECT image_id, {BIN}::BIGINT AS shell, {sql6('sum(abs(abs(a) - abs(b))) / nullif(sum(abs(a) + abs(b)), 0)')} AS r FROM z GROUP BY image_id, {BIN}")
def shell_r_factor(spark, sf_dir):
    return K.shell_r_factor(*_pair(spark, sf_dir), 4, MOST).select("image_id", "shell", r6(F.col("r")).alias("r"))


@query("regression_scale", f"WITH {PX}, {ZIP}, f AS (SELECT image_id, sum((abs(b) - mb) * (abs(a) - ma)) / nullif(sum((abs(a) - ma) * (abs(a) - ma)), 0) AS slope, max(ma) AS ma, max(mb) AS mb FROM (SELECT *, avg(abs(a)) OVER (PARTITION BY image_id) AS ma, avg(abs(b)) OVER (PARTITION BY image_id) AS mb FROM z) GROUP BY image_id) SELECT image_id, i::BIGINT AS i, round(CASE WHEN b = 0 OR abs(b) < mb - slope * ma THEN 0 ELSE b * (abs(b) - (mb - slope * ma)) / abs(b) / nullif(slope, 0) END, 2) + 0.0 AS scaled FROM z JOIN f USING (image_id)")
def regression_scale(spark, sf_dir):
    return _places(K.regression_scale(*_pair(spark, sf_dir)), 2, "scaled")


@query("pearson_pairs", f"WITH {PX}, {ZIP} SELECT image_id, {sql6('corr(a, b)')} AS r FROM z GROUP BY image_id")
def pearson_pairs(spark, sf_dir):
    return K.correlation(*_pair(spark, sf_dir)).select("image_id", r6(F.col("r")).alias("r"))


@query("image_average_by_label", f"WITH {PX} SELECT label, i::BIGINT AS i, {sql6(f'avg(re) * {1 / math.pi!r}')} AS re, count(*) AS n FROM px GROUP BY label, i")
def image_average_by_label(spark, sf_dir):
    return G.average(pixels(spark, sf_dir), "label").select("label", F.col("i").cast("long").alias("i"), r6(F.col("re") / math.pi).alias("re"), "n")


@query("photon_factor", f"WITH {PX} SELECT image_id, {sql6('avg(re) / nullif(var_pop(re), 0)')} AS factor FROM px GROUP BY image_id")
def photon_factor(spark, sf_dir):
    return K.photons(images(spark, sf_dir)).select("image_id", r6(F.col("factor")).alias("factor"))


@query("prtf", f"WITH {PX} SELECT label, i::BIGINT AS i, {sql6('CASE WHEN min(abs(re)) = 0 THEN 0 ELSE abs(avg(re / nullif(abs(re), 0))) END')} AS prtf FROM px GROUP BY label, i")
def prtf(spark, sf_dir):
    return G.prtf(pixels(spark, sf_dir), "label").select("label", F.col("i").cast("long").alias("i"), r6(F.col("prtf")).alias("prtf"))


@query("hit_finder", f"WITH {PX}, s AS (SELECT image_id, label, sum(CASE WHEN abs(x - 4) <= 1 AND abs(y - 4) <= 1 THEN re ELSE 0 END) AS signal FROM px GROUP BY ALL), m AS (SELECT label, avg(signal) AS mean, stddev_pop(signal) AS sigma FROM s GROUP BY label) SELECT image_id, {sql6('signal')} AS signal, signal > mean + sigma / 3 AS hit FROM s JOIN m USING (label)")
def hit_finder(spark, sf_dir):
    p = images(spark, sf_dir)
    s = K.box_signal(p, 4, 4, 1).join(p.select("image_id", "label"), "image_id")
    return G.hits(s, "label").select("image_id", r6(F.col("signal")).alias("signal"), "hit")


@query("local_cross_correlation", f"WITH {PX}, {ZIP} SELECT image_id, i::BIGINT AS i, CASE WHEN i <= 44 THEN {sql6('corr(a, b) OVER (PARTITION BY image_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)')} END AS r FROM z")
def local_cross_correlation(spark, sf_dir):
    z = _places(K.sliding_correlation(*_pair(spark, sf_dir), 20), 6, "r")
    return z.select("image_id", "i", F.when(F.col("i") <= 44, F.col("r")).alias("r"))


_K = "(SELECT unnest(range(64)) AS k)"
_A = f"({-2 * math.pi!r} * ((k % 8) * x / 8.0 + (k // 8) * y / 8.0))"


@query("dft_power", f"WITH {PX} SELECT image_id, k::BIGINT AS i, round((pow(sum(re * cos({_A})), 2) + pow(sum(re * sin({_A})), 2)) / 1000, 2) AS power FROM px, {_K} GROUP BY image_id, k")
def dft_power(spark, sf_dir):
    """By FFT on packed rows; the SQL sums directly."""
    from ..model import images

    p = unpack(FT.fft(images(spark, sf_dir)))
    return p.select("image_id", F.col("i").cast("long").alias("i"), F.round((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 1000, 2).alias("power"))


@query("direct_dft", f"WITH {PX} SELECT image_id, k::BIGINT AS i, round(sum(re * cos({_A})), 4) + 0.0 AS re, round(sum(re * sin({_A})), 4) + 0.0 AS im FROM px, {_K} GROUP BY image_id, k")
def direct_dft(spark, sf_dir):
    x = FT.direct_transform(pixels(spark, sf_dir), 8, 8)
    return x.select("image_id", F.col("i").cast("long").alias("i"), (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("spherical_transform", f"WITH {PX}, f AS (SELECT image_id, {BIN}::INT AS r, avg(abs(re)) AS f FROM px GROUP BY image_id, {BIN}) SELECT image_id, k::BIGINT AS k, round(CASE WHEN k = 0 THEN 0 ELSE sum(2 * r * f * sin({2 * math.pi!r} * r * (k / 80.0::DOUBLE))) / (k / 80.0::DOUBLE) END, 4) + 0.0 AS value FROM f, (SELECT unnest(range(80)) AS k) GROUP BY image_id, k".replace("CASE WHEN k = 0 THEN 0 ELSE sum", "CASE WHEN k = 0 THEN 0 ELSE sum").replace(") / (k / 80.0::DOUBLE) END", ") / nullif(k / 80.0::DOUBLE, 0) END"))
def spherical_transform(spark, sf_dir):
    prof = G.radial_profile(pixels(spark, sf_dir), D(), 4, MOST).select("image_id", F.col("shell").alias("r"), F.col("mean").alias("f"))
    return FT.spherical_transform(prof, 4).select("image_id", F.col("k").cast("long").alias("k"), (F.round("value", 4) + 0.0).alias("value"))


@query("support_union_intersect", f"WITH {PX}, s AS (SELECT image_id, label, i, CASE WHEN abs(re) >= 0.5 * max(abs(re)) OVER (PARTITION BY image_id) THEN 1 ELSE 0 END AS s FROM px) SELECT label, i::BIGINT AS i, max(s)::BIGINT AS united, min(s)::BIGINT AS common FROM s GROUP BY label, i")
def support_union_intersect(spark, sf_dir):
    s = P.threshold_support(pixels(spark, sf_dir), 0.5)
    return s.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.max("re").cast("long").alias("united"), F.min("re").cast("long").alias("common"))


@query("best_rotation", f"WITH {PX}, r AS (SELECT image_id, 0 AS rot, x, y, re FROM px UNION ALL SELECT image_id, 1, 7 - y, x, re FROM px UNION ALL SELECT image_id, 2, 7 - x, 7 - y, re FROM px UNION ALL SELECT image_id, 3, y, 7 - x, re FROM px), c AS (SELECT p.image_id, rot, corr(p.re, r.re) AS r FROM px p JOIN r ON r.image_id = p.image_id + 1 AND r.x = p.x AND r.y = p.y GROUP BY p.image_id, rot) SELECT image_id, arg_max(rot, r)::BIGINT AS rot, {sql6('max(r)')} AS r FROM c GROUP BY image_id")
def best_rotation(spark, sf_dir):
    return K.best_rotation(*_pair(spark, sf_dir)).select("image_id", "rot", r6(F.col("r")).alias("r"))


@query("emc_step", f"WITH {PX}, s AS (SELECT image_id AS sample_id, x, y, floor(abs(re) / 100)::INT AS n FROM px WHERE abs(re) >= 100), m AS (SELECT x, y, ln((avg(abs(re)) + 1) / 1000) AS logp FROM px GROUP BY x, y), ref AS (SELECT 0 AS rot, x, y, logp FROM m UNION ALL SELECT 1, 7 - y, x, logp FROM m UNION ALL SELECT 2, 7 - x, 7 - y, logp FROM m UNION ALL SELECT 3, y, 7 - x, logp FROM m), c AS (SELECT sample_id, rot, sum(n * greatest(logp, -50)) AS s FROM s JOIN ref USING (x, y) GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id)) AS e FROM c) SELECT sample_id, rot::BIGINT AS rot, {sql6('e / sum(e) OVER (PARTITION BY sample_id)')} AS p FROM e")
def emc_step(spark, sf_dir):
    px = pixels(spark, sf_dir)
    samples = px.where(F.abs("re") >= 100).select(F.col("image_id").alias("sample_id"), F.col("i").alias("idx"), F.floor(F.abs("re") / 100).cast("int").alias("n"))
    model = px.groupBy("x", "y").agg(F.log((F.avg(F.abs("re")) + 1) / 1000).alias("re")).withColumns({"image_id": F.lit(0), "i": N.index(8)})
    refs = None
    for k in range(4):
        part = N.rotate_quarters(model, 8, 8, k).select(F.lit(k).alias("rot"), F.col("i").alias("idx"), F.col("re").alias("logp"))
        refs = part if refs is None else refs.unionByName(part)
    return L.responsibilities(samples, refs).select("sample_id", F.col("rot").cast("long").alias("rot"), r6(F.col("p")).alias("p"))


CORNERS = "(SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)"


def bilinear_sql(points: str) -> str:
    """Values at points (image_id, p, fx, fy): the four corners from the image's array; with a corner outside 0 and mask 0."""
    value = AT.format(at="(qy + b) * 8 + qx + a")
    weight = "(CASE WHEN a = 1 THEN fx - qx ELSE 1 - (fx - qx) END) * (CASE WHEN b = 1 THEN fy - qy ELSE 1 - (fy - qy) END)"
    inside = "qx + a BETWEEN 0 AND 7 AND qy + b BETWEEN 0 AND 7"
    corners = f"SELECT image_id, p, {weight} AS w, {inside} AS inside, CASE WHEN {inside} THEN {value} END AS v FROM (SELECT *, floor(fx)::INT AS qx, floor(fy)::INT AS qy FROM ({points})) q JOIN embeddings e ON e.vec_id = image_id, {CORNERS}"
    return f"SELECT image_id, p, max(CASE WHEN NOT inside AND w > 1e-12 THEN 1 ELSE 0 END) AS out, sum(coalesce(v, 0) * w) AS re FROM ({corners}) GROUP BY image_id, p"


IDS = "(SELECT vec_id AS image_id FROM embeddings WHERE len(embedding) = 64)"


@query("line_out", f"SELECT image_id, p::BIGINT AS p, {sql6('CASE WHEN out = 1 THEN 0 ELSE re END')} AS re FROM ({bilinear_sql(f'SELECT image_id, p, 7.0::DOUBLE * (p / 99.0::DOUBLE) AS fx, 7.0::DOUBLE * (p / 99.0::DOUBLE) AS fy FROM {IDS}, (SELECT unnest(range(100)) AS p)')})")
def line_out(spark, sf_dir):
    return K.line_out(images(spark, sf_dir), 0.0, 0.0, 7.0, 7.0).select("image_id", F.col("p").cast("long").alias("p"), r6(F.col("re")).alias("re"))


_TURNED = f"SELECT image_id, p, {math.cos(0.5)!r} * (p % 8 - 3.5) + {math.sin(0.5)!r} * (p // 8 - 3.5) + 3.5 AS fx, {-math.sin(0.5)!r} * (p % 8 - 3.5) + {math.cos(0.5)!r} * (p // 8 - 3.5) + 3.5 AS fy FROM {IDS}, (SELECT unnest(range(64)) AS p)"


@query("rotate_bilinear", f"SELECT image_id, p::BIGINT AS p, {sql6('CASE WHEN out = 1 THEN 0 ELSE re END')} AS re, (1 - out)::BIGINT AS mask FROM ({bilinear_sql(_TURNED)})")
def rotate_bilinear(spark, sf_dir):
    return K.rotate(images(spark, sf_dir), 0.5).select("image_id", F.col("p").cast("long").alias("p"), r6(F.col("re")).alias("re"), F.col("mask").cast("long").alias("mask"))


# ---- pixel-table forms of some of the operators above: they serve where pixels meet other tables

simple("normalise_pixels", lambda p: P.normalise(P.to_intensities(p)), f"re * re / nullif(sum(re * re) {W}, 0)")
simple("threshold_support_pixels", lambda p: P.threshold_support(p, 0.5), "CASE WHEN a >= 0.5 * m THEN 1 ELSE 0 END", source=f"(SELECT *, abs(re) AS a, max(abs(re)) {W} AS m FROM px)")
simple("box_blur_pixels", lambda p: N.box_blur(p, 8, 8, 1), "re", ctes=NEAR, source="(SELECT image_id, x, y, avg(v) AS re FROM near GROUP BY ALL)")
simple("row_median_pixels", lambda p: G.row_median_subtract(p, F.floor(F.col("x") / 4)), "re - m", source="(SELECT px.*, quantile_cont(re, 0.5) OVER (PARTITION BY image_id, x // 4, y) AS m FROM px)")


@query("radial_profile_pixels", ORACLE_SQL["radial_profile"])
def radial_profile_pixels(spark, sf_dir):
    return G.radial_profile(pixels(spark, sf_dir), D(), 4, MOST).select("image_id", F.col("shell").cast("long").alias("shell"), r6(F.col("mean")).alias("mean"), r6(F.col("rel_sigma")).alias("rel_sigma"), "n")


@query("regression_scale_pixels", ORACLE_SQL["regression_scale"])
def regression_scale_pixels(spark, sf_dir):
    return G.regression_scale(_next(pixels(spark, sf_dir)), "image_id").select("image_id", F.col("i").cast("long").alias("i"), (F.round("scaled", 2) + 0.0).alias("scaled"))


@query("image_integrals_pixels", ORACLE_SQL["image_integrals"])
def image_integrals_pixels(spark, sf_dir):
    x = G.integrate(pixels(spark, sf_dir))
    return x.select("image_id", *[(F.round(c, 9 if c == "mean_abs" else 6) + 0.0).alias(c) for c in x.columns[1:]])


@query("best_rotation_pixels", ORACLE_SQL["best_rotation"])
def best_rotation_pixels(spark, sf_dir):
    p = pixels(spark, sf_dir)
    turned = None
    for k in range(4):
        part = N.rotate_quarters(p.withColumn("image_id", F.col("image_id") - 1), 8, 8, k).select("image_id", F.lit(k).alias("rot"), "x", "y", F.col("re").alias("b"))
        turned = part if turned is None else turned.unionByName(part)
    z = p.select("image_id", "x", "y", F.col("re").alias("a")).join(turned, ["image_id", "x", "y"])
    return L.best_rotation(G.correlation(z, "image_id", "rot")).select("image_id", F.col("rot").cast("long").alias("rot"), r6(F.col("r")).alias("r"))


@query("sliding_correlation_pixels", ORACLE_SQL["local_cross_correlation"])
def sliding_correlation_pixels(spark, sf_dir):
    z = G.sliding_correlation(_next(pixels(spark, sf_dir)), "image_id", "i", 20)
    return z.select("image_id", F.col("i").cast("long").alias("i"), F.when(F.col("i") <= 44, r6(F.col("r"))).alias("r"))


@query("hit_finder_pixels", ORACLE_SQL["hit_finder"])
def hit_finder_pixels(spark, sf_dir):
    return G.hits(G.box_signal(pixels(spark, sf_dir), F.lit(4), F.lit(4), 1, "label"), "label").select("image_id", r6(F.col("signal")).alias("signal"), "hit")


@query("r_factor_pixels", ORACLE_SQL["shell_r_factor"])
def r_factor_pixels(spark, sf_dir):
    return G.r_factor(_next(pixels(spark, sf_dir)), "image_id", G.shell(D(), 4, MOST).cast("long").alias("shell")).select("image_id", "shell", r6(F.col("r")).alias("r"))
