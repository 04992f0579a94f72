"""What users add: functions in expressions, aggregates with partial states, table functions; and options that change during runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specklegrid.functions import expression, options, tables
from specklegrid.functions.updates import audited, in_force
from specklegrid.model import images, pixels, unpack
from specklegrid.operators import fourier, learning, phasing

SF = "/root/testdata/sf0.001"


def test_functions_of_the_user_in_expressions(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(re DOUBLE, im DOUBLE) RETURNS STRUCT<re: DOUBLE, im: DOUBLE> RETURN named_struct('re', 2 * re, 'im', 2 * im)")
    expression.define("twice", 1, "twice")
    expression.define("blend", 3, lambda a, b, t: (a[0] * (1 - t[0]) + b[0] * t[0], a[1] * (1 - t[0]) + b[1] * t[0]))
    px = pixels(spark, SF).where("image_id < 3")
    got = {(r.image_id, r.i): (r.re, r.im) for r in expression.evaluate("blend(twice(A), A i, 0.25) + sum(twice(A))", px).collect()}
    total = {r.image_id: r.t for r in px.groupBy("image_id").agg(F.sum("re").alias("t")).collect()}
    for r in px.collect():
        assert np.allclose(got[r.image_id, r.i], (1.5 * r.re + 2 * total[r.image_id], 0.25 * r.re))
    plan = expression.evaluate("twice(A)", px)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan  # a body in SQL is part of the plan
    with pytest.raises(expression.ExpressionError, match="takes 3 operands"):
        expression.evaluate("blend(A, A)", px)
    with pytest.raises(expression.ExpressionError, match="unknown function"):
        expression.evaluate("nothing(A)", px)
    for bad in ("abs", "i", "No", "a1"):
        with pytest.raises(expression.ExpressionError):
            expression.define(bad, 1, lambda a: a)
    with pytest.raises(expression.ExpressionError):
        expression.define("none", 0, lambda: None)


def test_expressions_over_packed_rows_equal_those_over_pixels(spark):
    p = images(spark, SF).where("image_id < 4").withColumn("im", F.transform("re", lambda v, i: v * (i % 3 - 1))).withColumn("mask", F.transform("re", lambda v: F.when(v > 0, 2).otherwise(0)))
    other = p.withColumn("image_id", (F.col("image_id") + 1) % 4)
    texts = [
        "A*2 + 3 - B/4", "(A + Ai) * (1 - 2i)", "abs(A) ^ 0.5 + sqrt(B)", "if(abs(A) > 100, A, B)", "(A > 50 && posx < 4) || posy == 7", "min(A, 10) + max(B, -10)", "A / sum(abs(A)) + sum(2)", "re(A) + im(conj(A*i)) + arg(B)",
        "exp(A/1000) + log(abs(A) + 1)", "set_mask(A, A > 50)", "mask(A) + posz", "A / 0 + (A - A) ^ 0", "2 + A ^ (1 + 0.1i)", "-(B == B)", "abs(fft(A)) + 2", "ifft(fft(A) * (posx < 4)) / 64 + sum(fft(B))",
    ]
    keys = ("image_id", "i", "re", "im", "mask")
    for t in texts:
        by_pixel = sorted(tuple(r[c] for c in keys) for r in expression.evaluate(t, unpack(p), unpack(other)).collect())
        packed_ = sorted(tuple(r[c] for c in keys) for r in unpack(expression.evaluate_packed(t, p, other)).collect())
        assert len(by_pixel) == len(packed_) == 256
        for a, b in zip(by_pixel, packed_, strict=True):
            assert a[:2] == b[:2] and a[4] == b[4] and np.allclose(a[2:4], b[2:4], rtol=1e-9, atol=1e-6), t
    plan = expression.evaluate_packed("ifft(fft(A) * 2) + sum(A)", p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for bad in ("C + A", "A ^ A", "fft(2)"):
        with pytest.raises(expression.ExpressionError):
            expression.evaluate_packed(bad, p, other)


def test_aggregate_with_partial_states(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 50 == 0 else "hot" if k % 3 else f"g{k % 7}", (rng.normal(1e6, 1, 5)).tolist()) for k in range(3000)] + [("gone", None)]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(7)
    got = {r.g: r for r in tables.aggregated(df, "g", ["v"], tables.Moments()).collect()}
    assert set(got) == {g for g, _ in rows}
    for g in got:
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert got[g].n == len(x)
        if len(x):
            assert np.allclose(got[g].mean, x.mean(0), rtol=1e-12) and np.allclose(got[g].variance, x.var(0), rtol=1e-6)

    class Longest:
        result = "words long, letters long"

        def update(self, columns):
            texts = columns[0].to_pylist()
            return np.array([max(len((t or "").split()) for t in texts), sum(len(t or "") for t in texts)], float)

        def merge(self, a, b):
            return np.array([max(a[0], b[0]), a[1] + b[1]])

        def finish(self, state):
            return int(state[0]), int(state[1])

    texts = spark.createDataFrame([(i % 3, "word " * i) for i in range(40)] + [(1, None)], "k int, t string").repartition(5)
    assert {r.k: (r.words, r.letters) for r in tables.aggregated(texts, "k", ["t"], Longest()).collect()} == {k: (max(range(k, 40, 3)), 5 * sum(range(k, 40, 3))) for k in range(3)}
    assert tables.aggregated(texts.limit(0), "k", ["t"], Longest()).count() == 0


def test_pixels_as_a_table_function(spark):
    tables.register(spark)
    p = images(spark, SF).select("image_id", "nx", "ny", "re", "im", "mask")
    volume = spark.createDataFrame([(9000, 2, 3, [float(k) for k in range(12)], [0.5] * 12, [1] * 12), (9001, 2, 2, [], [], [])], "image_id long, nx int, ny int, re array<double>, im array<double>, mask array<int>")
    p.unionByName(volume).createOrReplaceTempView("some_images")
    got = spark.sql("SELECT * FROM image_pixels(TABLE(some_images))").where("image_id < 9000")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, unpack(images(spark, SF)).select("image_id", "i", "x", "y", "z", "re", "im", "mask").collect()))
    cells = spark.sql("SELECT i, x, y, z, re FROM image_pixels(TABLE(some_images)) WHERE image_id >= 9000 ORDER BY i").collect()
    assert [tuple(r) for r in cells] == [(i, i % 2, i // 2 % 3, i // 6, float(i)) for i in range(12)]
    spark.catalog.dropTempView("some_images")


UPDATES = "run int, seq long, option string, value string, from_iteration long"


def test_updates_are_audited(spark):
    rows = [
        (1, 1, "phasing_method.beta", "0.5", 0), (1, 2, "phasing_method.beta", "([0, 10], [0.9, 0.1])", 7), (1, 3, "phasing_method.beta", "0.7", 9), (1, 4, "phasing_method.beta", "half", 3),
        (1, 5, "max_iterations", "1.5", 1), (1, 6, "max_iterations", "Infinity", 1), (1, 7, "input_data.added_noise", "0.5", 1), (1, 8, "nothing", "1", None), (1, 9, "phasing_method.enforce_real", "TRUE", 100),
        (1, 10, "phasing_method.algorithm", "raar", 10), (2, 11, "phasing_method.algorithm", "raar", 1), (1, 12, "phasing_method.gamma1", None, 1), (None, 13, "phasing_method.beta", "1", 1),
    ]
    chunks = spark.createDataFrame([(1, 0), (1, 10), (1, 20)], "run int, start long")
    audit = audited(spark.createDataFrame(rows, UPDATES), chunks)
    got = {r.seq: (r.at, r.taken, r.reason) for r in audit.collect()}
    assert got == {
        1: (0, True, ""), 2: (10, False, "overtaken"), 3: (10, True, ""), 4: (10, False, "is of type map"), 5: (10, False, "is of type int"), 6: (10, True, ""), 7: (10, False, "can't be set during a run"),
        8: (0, False, "no such option"), 9: (None, False, "no chunk yet"), 10: (10, True, ""), 11: (None, False, "no chunk yet"), 12: (10, False, "is of type real"), 13: (None, False, "no such option"),
    }
    force = {(r.run, r.start, r.option): r.value for r in in_force(audit, chunks).collect()}
    assert force == {(1, 0, "phasing_method.beta"): "0.5", **{(1, k, o): v for k in (10, 20) for o, v in (("phasing_method.beta", "0.7"), ("max_iterations", "Infinity"), ("phasing_method.algorithm", "raar"))}}


def test_options_that_are_not_built_are_refused():
    from specklegrid.sources import text

    for line, name in (("phasing_method = { enforce_ramp = true; };", "enforce_ramp"), ("support_update_method = { square_mask = 3.0; };", "square_mask"), ("phasing_method = { enforce_centrosymmetry = true; adapt_thres = true; };", "adapt_thres")):
        with pytest.raises(ValueError, match=f"{name}.*not built"):
            phasing.from_options(options.load(text.parse_config(line)))
    assert phasing.from_options(options.load(text.parse_config("max_iterations = 7;"))).iterations == 7


def test_a_run_takes_updates_at_chunks_and_repeats_them_after_a_restart(spark, tmp_path):
    p = images(spark, SF).where("image_id < 2").withColumn("re", F.transform("re", F.abs))
    amplitudes = fourier.per_image(p, lambda v, m: (np.abs(fourier.fftn(v)) + 0j, m))
    support = p.select("image_id", F.transform("re", lambda v, i: F.when(i < 40, 1).otherwise(0)).alias("support"))
    runs = phasing.start(amplitudes, support, 1)
    from specklegrid.sources import frames, text

    base = options.load(text.parse_config('phasing_method = { algorithm = "hio"; }; max_iterations = 12; support_update_algorithm = "static";'))
    table = spark.createDataFrame([(1, "phasing_method.algorithm", "raar", 3), (2, "phasing_method.beta", "0.5", 5), (3, "phasing_method.algorithm", "er", 6)], "seq long, option string, value string, from_iteration long")
    asked = []

    def updates():
        asked.append(1)
        return table

    path = str(tmp_path / "run")
    out = {r.image_id: r for r in phasing.phase_with_updates(runs, base, updates, 4, path).collect()}
    # the same by hand: hio to 4, raar to 8, raar with another beta to 12
    first = options.changed(base, {"phasing_method.algorithm": "raar"})
    second = options.changed(first, {"phasing_method.beta": 0.5})
    by_hand = runs
    for o in (base, first, second):
        by_hand = phasing.advance(by_hand, phasing.from_options(o), 4)
    for r in by_hand.collect():
        assert np.allclose(out[r.image_id].re, r.re) and out[r.image_id].iteration == 12
    audit = {(r.at, r.seq): (r.taken, r.reason) for r in frames.read_iterations(spark, f"{path}/audit").collect()}
    assert {k: v[0] for k, v in audit.items()} == {(4, 1): True, (8, 2): True, (8, 3): False} and audit[8, 3][1].startswith("is one of")
    # a restart after a lost last chunk: what was audited before holds, a late update of an early iteration doesn't rewrite it
    import shutil

    shutil.rmtree(f"{path}/runs/iteration=000000012")
    table = table.unionByName(spark.createDataFrame([(4, "phasing_method.algorithm", "hpr", 0)], table.schema))
    again = {r.image_id: r for r in phasing.phase_with_updates(runs, base, updates, 4, path).collect()}
    assert all(again[k].re == out[k].re for k in out) and len(asked) == 3


def test_branches_of_a_chain_are_put_in_order():
    """Pieces of a curve, turned round and out of order, become one chain again, whichever way it runs."""
    assert learning.branches(np.array([0, 0, 1, 1, 0, 1, 0, 0], bool)) == [(0, 1, 3), (4, 4, 5), (6, 7, 7)] and learning.branches(np.ones(3, bool)) == []
    t = np.linspace(0, 1, 40)
    curve = np.stack([np.exp(-((t - c) ** 2) / 0.02) for c in np.linspace(0, 1, 12)], 1)
    pieces = [range(0, 13), range(13, 27), range(27, 40)]
    for order in ([1, 0, 2], [2, 1, 0], [0, 2, 1]):
        for flips in range(8):
            places, empty = [], []
            for k, p in enumerate(order):
                run = list(pieces[p])[:: -1 if flips >> k & 1 else 1]
                places, empty = places + run + [None], empty + [False] * len(run) + [True]
            means = np.array([curve[p] if p is not None else np.zeros(12) for p in places])
            got = [places[k] for k in learning.rearranged(np.array(empty), means) if places[k] is not None]
            assert got in (list(range(40)), list(range(39, -1, -1)))
    assert learning.rearranged(np.zeros(5, bool), np.eye(5)).tolist() == list(range(5))


def test_a_map_begins_anew_while_points_are_empty(spark):
    rng = np.random.default_rng(2)
    t = rng.random(600)
    centres = np.linspace(0, 1, 10)
    x = np.exp(-((t[:, None] - centres) ** 2) / 0.03) + rng.normal(size=(600, 10)) * 0.01
    v = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    line = np.linspace(-1, 1, 24)[:, None]
    basis = learning.radial_basis(line, np.linspace(-1, 1, 9)[:, None], 0.25)
    # a start whose chain runs through the curve in two pieces the wrong way, with a jump between
    path = np.r_[np.linspace(0.5, 0, 10), np.full(4, 3.0), np.linspace(1, 0.5, 10)]
    start = np.linalg.pinv(basis) @ np.exp(-((path[:, None] - centres) ** 2) / 0.03)
    kept, _, first = learning.gtm_screened(v, basis, start, trials=3, updates=2, cycles=4)
    assert first[-1][0] == 2 and first[-1][1] == 3  # the empty points stay at an end
    found, beta, history = learning.gtm_screened(v, basis, start, trials=6, updates=2, cycles=4, stretch=True)
    assert history[0][1] > 0 and all(h[1] == 0 for h in history[-4:]) and history[-1][0] < 5 and history[-1][2] > history[0][2] and beta > 100
    along = np.array([np.abs(np.exp(-((np.linspace(0, 1, 400)[:, None] - centres) ** 2) / 0.03) - c).sum(1).argmin() for c in found])
    steps = np.diff(along)
    assert (steps >= 0).all() or (steps <= 0).all()  # the chain follows the curve from one end to the other


def test_own_means(spark):
    x = np.array([[0.0, 0], [0, 2], [10, 10], [10, 12]])
    v = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(2)
    assert learning.own_means(v, np.array([[0.0, 1], [10, 11], [50, 50]])).tolist() == [[0, 1], [10, 11], [50, 50]]
