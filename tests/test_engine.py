"""Queries against their SQL on the small tables, and the invariants of operators that SQL can't express."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from specklegrid import catalog
from specklegrid.functions import expression, options, schedules
from specklegrid.model import images
from specklegrid.operators import fourier, geometry, learning, phasing, pixel, volume
from specklegrid.sources import binary, formats, frames, text
from specklegrid.streaming.frames import track

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    r = con.execute(catalog.oracle_sql()[name])
    of = [d[0] for d in r.description]
    assert sorted(of) == columns
    want = sorted((tuple(norm(x[of.index(c)]) for c in columns) for x in r.fetchall()), key=str)
    have = sorted((tuple(norm(x[c]) for c in columns) for x in got.collect()), key=str)
    assert len(have) == len(want)
    bad = [(h, w) for h, w in zip(have, want, strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(h, w, strict=True))]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("text_,part", [("A +", "too few"), ("(A", "too few"), ("A B", "left over"), ("foo(A)", "unknown"), ("min(A)", "takes 2"), ("A ? 2", "cannot read")])
def test_expression_errors(text_, part):
    with pytest.raises(expression.ExpressionError, match=part):
        expression.parse(text_)


def test_expression_precedence_and_names():
    assert expression.parse("A+B*C^2").kind == "+"
    assert expression.image_number("Z") == 25 and expression.image_number("AA") == 26


def test_schedule_is_clamped_and_rises():
    v = [schedules.bezier(x, [0, 10], [0.0, 1.0]) for x in range(-2, 13)]
    assert v[0] == 0 and v[-1] == 1 and v == sorted(v) and abs(schedules.bezier(5, [0, 10], [0.0, 1.0]) - 0.5) < 1e-9


def _problem(n=16, seed=3):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, n), complex)
    x[2:7, 3:8] = rng.random((5, 5)) + 0.2
    return x, np.abs(x) > 0, np.abs(np.fft.fftn(x)), np.ones((n, n), int)


@pytest.mark.parametrize("algorithm", ["er", "hio", "raar", "dm", "hpr", "hio_proj", "raar_proj", "automatic"])
def test_solution_is_a_fixed_point(algorithm):
    x, s, a, m = _problem()
    y, _ = phasing.step(x, s, a, m, phasing.Settings(algorithm=algorithm))
    assert np.allclose(y[s], x[s])
    if algorithm != "hpr":
        assert np.allclose(y, x, atol=1e-9)


def test_inside_the_support_er_hio_raar_agree():
    x, s, a, m = _problem()
    g = phasing.initial(a, 1)
    ys = [phasing.step(g, s, a, m, phasing.Settings(algorithm=k))[0][s] for k in ("er", "hio", "raar")]
    assert np.allclose(ys[0], ys[1]) and np.allclose(ys[0], ys[2])
    b1, _ = phasing.step(g, s, a, m, phasing.Settings(algorithm="raar", beta=1.0))
    assert np.allclose(b1[~s], (g - phasing.modulus_projection(g, a, m))[~s])


def test_reconstruction_recovers_the_object():
    x, s, a, m = _problem()
    best = 0
    for seed in range(10):
        y, _, _ = phasing.chunk(phasing.initial(a, seed), s, a, m, phasing.Settings(algorithm="hio", iterations=200), 0, 200)
        y, _, _ = phasing.chunk(y, s, a, m, phasing.Settings(algorithm="er"), 200, 50)
        v = fourier.align_arrays(x, y)
        best = max(best, np.corrcoef(np.abs(v)[s], np.abs(x)[s])[0, 1])
    assert best > 0.99


@pytest.mark.parametrize("algorithm", ["hio", "raar"])
def test_success_rate_over_starts(algorithm):
    """Over 0.1 of 30 starts reach a correlation of 0.99 with the object on 25 x 25 pixels."""
    rng = np.random.default_rng(11)
    x = np.zeros((25, 25), complex)
    x[3:12, 4:12] = rng.random((9, 8)) + 0.1
    s, a, m = np.abs(x) > 0, np.abs(np.fft.fftn(x)), np.ones((25, 25), int)
    good = 0
    for seed in range(30):
        y, _, _ = phasing.chunk(phasing.initial(a, seed), s, a, m, phasing.Settings(algorithm=algorithm, real=True, positive=algorithm == "raar"), 0, 200)
        y, _, _ = phasing.chunk(y, s, a, m, phasing.Settings(algorithm="er"), 200, 50)
        v = fourier.align_arrays(x, y)
        good += np.corrcoef(np.abs(v).ravel(), np.abs(x).ravel())[0, 1] >= 0.99
    assert good / 30 > 0.1


def test_band_projection_keeps_amplitudes_within():
    x, s, a, m = _problem()
    g = phasing.initial(a, 4) * 1.7
    width = 0.1 * a
    f = np.abs(np.fft.fftn(phasing.modulus_projection(g, a, m, width)))
    assert (f <= a + width + 1e-9).all() and (f >= a - width - 1e-9).all()
    inside = phasing.modulus_projection(x * 1.05, a, m, width)
    assert np.allclose(inside, x * 1.05)
    assert np.allclose(phasing.noise_model(a, 0.2), 0.2 * a) and np.allclose(phasing.noise_model(a), a)
    whole = np.ones_like(s)
    assert np.allclose(phasing.noise_model(a, support=whole), 0, atol=1e-6)


def test_supports():
    x, s, a, m = _problem()
    new = lambda **k: phasing.update_support(x, phasing.Settings(blur=0.0, **k), 50, {}, s)
    assert (new(support="threshold", level=0.1) == s).all() and (new(support="area", area=24 / 256) == s).all()
    assert new(support="stepped", level=0.5).sum() <= new(support="stepped", level=0.5 * 0.75).sum()
    memory = {}
    phasing.update_support(x, phasing.Settings(support="stepped"), 50, memory, s, 0.5)
    phasing.update_support(x, phasing.Settings(support="stepped"), 51, memory, s, 0.0)
    assert memory["stepped"]  # it stays
    assert new(support="real_error_capped", error=-1.0) is None
    memory = {}
    sizes = [phasing.update_support(x, phasing.Settings(support="real_error_adaptative", blur=0.0, error=0.5, level=0.1), 5, memory, s, 0.0).sum() for _ in range(3)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < s.sum()
    with pytest.raises(ValueError):
        phasing.update_support(x, phasing.Settings(algorithm="dm", support="real_error_adaptative"), 5, {}, s)
    assert (s & new(support="template", template=1.0, area=0.2)).sum() > 0.8 * s.sum()
    assert new(support="filtered", level=0.3)[s].any()
    fixed = np.zeros(s.shape)
    fixed[0, 0] = 1
    assert phasing.update_support(x, phasing.Settings(blur=0.0, level=0.1, fixed=fixed), 1)[0, 0]
    hole = s.copy()
    hole[4, 5] = False
    assert (phasing.closed(hole, 1) == s).all()
    moved = np.roll(s, (9, 4), (0, 1))
    y, t = phasing.centred(np.where(moved, 1.0 + 0j, 0), moved)
    at = np.argwhere(t).mean(0)
    assert (np.abs(at - 8) <= 1).all() and (np.abs(y) > 0).sum() == s.sum() == (t & (np.abs(y) > 0)).sum()
    p = phasing.patterson_support(a, 0.04, 0.0)
    assert p[0, 0] and (p == np.roll(p[::-1, ::-1], 1, (0, 1))).all()
    assert abs(phasing.patterson_support(a, 0, 0.0, area=0.1).mean() - 0.1) < 0.02
    assert phasing.patterson_support(a, 0, 0.0, square=True).sum() < 256
    assert (phasing.initial_support(a, given=s[::2, ::2])).shape == s.shape and (phasing.initial_support(a, given=s) == s).all()
    assert np.allclose(phasing.filtered_amplitudes(x, np.ones_like(s), a, m), a, rtol=1e-6, atol=1e-6)


def test_starts_and_settings():
    x, s, a, m = _problem()
    for kind in ("random phases", "random density", "zero phases", "starting support"):
        g = phasing.initial(a, 3, kind, s)
        assert abs((np.abs(np.fft.fftn(g)) ** 2).sum() / (a**2).sum() - 1) < 1e-9
    assert phasing.initial(a, 1, given=x[::2, ::2]).shape == a.shape
    with pytest.raises(ValueError):
        phasing.initial(a, 1, "no such")
    with pytest.raises(ValueError):
        phasing.Settings(support="no such")
    v = np.where(s, x * np.exp(0.4j), 0)
    assert np.allclose(np.abs(phasing.smooth_phases(v, 1.0)), np.abs(v)) and np.isfinite(phasing.smooth_phases(v, 1.0)).all()
    o = phasing.Settings(algorithm="raar", support_every=10, support="area", area=24 / 256, averaging=3, inner_er=2, closure=1, image_blur_every=7, image_blur=0.3, halve_every=50, phases_blur=0.2, filter=True, centre=True)
    y, t, log = phasing.chunk(phasing.initial(a, 1), s, a, m, o, 0, 60)
    assert np.isfinite(y).all() and t.any() and log[-1]["iteration"] == 60
    masked = m.copy()
    masked[0, 0] = 0
    full = phasing.restore_amplitudes(np.where(masked != 0, a, 0), masked, s, 400)
    assert np.allclose(full[masked != 0], a[masked != 0])
    auto = phasing.Settings(algorithm="automatic", support_every=5, support="area", area=0.05)
    memory = {}
    phasing.chunk(phasing.initial(a, 1), np.ones_like(s), a, m, auto, 0, 20, memory)
    assert memory["shrunk"]


def test_phasing_goes_on_from_snapshots(spark, tmp_path):
    """Two chunks through a snapshot equal one run, with a support that remembers; the output lies on the amplitudes."""
    from pyspark.sql import functions as F

    p = images(spark, SF).where("image_id < 3").withColumn("re", F.transform("re", F.abs))
    amplitudes = fourier.per_image(p, lambda v, m: (np.abs(fourier.fftn(v)) + 0j, m))
    support = p.select("image_id", F.transform("re", lambda v, i: F.when(i < 40, 1).otherwise(0)).alias("support"))
    runs = phasing.start(amplitudes, support, 2)
    o = phasing.Settings(algorithm="hio", iterations=12, support_every=4, support="real_error_adaptative", blur=1.0)
    one = {(r.image_id, r.seed): r for r in phasing.advance(runs, o, 12).collect()}
    two = phasing.phase(runs, o, 5, str(tmp_path / "run"))
    for r in two.collect():
        assert r.iteration == 12 and np.allclose(r.re, one[r.image_id, r.seed].re) and r.support == one[r.image_id, r.seed].support
    written = sorted(f for f in glob.glob(f"{tmp_path}/run/*/*") if f.endswith(".parquet"))
    assert frames.iterations(spark, f"{tmp_path}/run") == [5, 10, 12]
    again = phasing.phase(runs, o, 5, str(tmp_path / "run"))  # all is there: nothing is computed or written again
    assert sorted(map(repr, again.collect())) == sorted(map(repr, two.collect())) and sorted(f for f in glob.glob(f"{tmp_path}/run/*/*") if f.endswith(".parquet")) == written
    out = {(r.image_id, r.seed): np.array(r.re) + 1j * np.array(r.im) for r in phasing.output(two).collect()}
    for r in two.collect():
        assert np.allclose(np.abs(np.fft.fft2(out[r.image_id, r.seed].reshape(8, 8))).ravel(), r.amplitude, atol=1e-6)
    assert phasing.aligned_average(two).count() == 3
    assert {min(r.mask) for r in phasing.remove_modes(two, iterations=20).collect()} == {1}


def test_unknown_algorithm_is_refused():
    with pytest.raises(ValueError):
        phasing.Settings(algorithm="raar_cflip")


def test_options():
    o = options.load(text.parse_config('phasing_method = { algorithm = "raar"; beta = ([0, 100], [0.9, 0.5]); espresso_tau = 0.1; }; object_area = 0.02; min_object_area = 0.01; random_seed = "auto"; support_update_algorithm = "fixed"; bad = 1; max_iterations = 2.5;'))
    assert o["phasing_method.algorithm"] == "raar" and o["phasing_method.beta"] == ((0, 0.9), (100, 0.5)) and o["random_seed"] == -1
    assert o["support_update_method.support_update_algorithm"] == "threshold" and o["support_update_method.object_area"][-1][1] == 0.01
    assert o.problems == ("no such option: bad", "max_iterations is of type int, not 2.5")
    assert any("espresso_tau has no effect" in w for w in o.warnings) and any("object_area is now" in w for w in o.warnings)
    assert not o.applies("phasing_method.gamma1") and o.applies("phasing_method.beta")
    assert options.load(text.parse_config(text.write_config(options.dump(o)))).values == o.values
    s = phasing.from_options(o)
    assert s.algorithm == "raar" and s.at("beta", 0) == 0.9 and s.support == "threshold"
    assert options.changed(o, {"phasing_method.enforce_real": True})["phasing_method.enforce_real"] is True
    with pytest.raises(ValueError):
        options.changed(o, {"initial_image.image_guess": "x"})
    with pytest.raises(ValueError):
        options.checked("phasing_method.algorithm", "nonsense")
    assert len(options.CURRENT) == len({p for p, *_ in options.CURRENT})


def test_option_catalogue(spark):
    rows = options.catalogue(spark).collect()
    assert sum(not r.deprecated for r in rows) == 66 and any(r.path == "beta" and r.deprecated for r in rows)


def test_table_functions(spark):
    from specklegrid.functions.tables import register

    register(spark)
    got = [r.value for r in spark.sql("SELECT * FROM schedule_rows(array(0D, 10D), array(1D, 0D), 0, 10, 5)").collect()]
    assert got[0] == 1 and abs(got[1] - 0.5) < 1e-9 and got[2] == 0


def test_expression_transforms(spark):
    from specklegrid.model import pixels

    px = pixels(spark, SF).where("image_id < 2")
    a = {(r.image_id, r.i): r.re for r in expression.evaluate("ifft(fft(A)) / 64 + 0 * mask(A)", px).collect()}
    assert all(abs(a[r.image_id, r.i] - r.re) < 1e-9 for r in px.collect())
    with pytest.raises(expression.ExpressionError):
        expression.evaluate("fft(2)", px)
    assert expression.parse("+A").kind == "image"


def test_rotations():
    rng = np.random.default_rng(2)
    v = rng.random((5, 5, 5))
    for axis in range(3):
        r = volume.euler(*[(np.pi / 2, 0, 0), (0, np.pi / 2, 0), (0, 0, np.pi / 2)][axis])
        assert np.allclose(r @ r.T, np.eye(3)) and abs(np.linalg.det(r) - 1) < 1e-12
        assert np.allclose(volume.turned(volume.turned(v, r), r.T), v)
    assert np.allclose(volume.turned(v, np.eye(3)), v)


def test_deautocorrelation(spark):
    """The iteration lowers the misfit of the autocorrelation."""
    from pyspark.sql import functions as F

    p = images(spark, SF).where("image_id < 4").withColumn("re", F.transform("re", F.abs))
    ac = fourier.correlate(p, p)
    gap = []
    for rounds in (1, 100):
        x = fourier.deautocorrelate(ac, rounds)
        back = {r.image_id: np.array(r.re) for r in fourier.correlate(x, x).collect()}
        gap.append(np.mean([np.abs(back[r.image_id] - np.array(r.re)).mean() for r in ac.collect()]))
    assert gap[1] < 0.5 * gap[0]


def test_denoising_lowers_variation(spark):
    got = {r.image_id: np.array(r.re).reshape(8, 8) for r in fourier.tv_denoise(images(spark, SF).where("image_id < 5"), weight=0.5, rounds=100).collect()}
    rough = lambda v: sum(np.abs(np.diff(v, axis=k)).sum() for k in (0, 1))
    for r in images(spark, SF).where("image_id < 5").collect():
        v = np.maximum(np.array(r.re).reshape(8, 8), 0)
        assert rough(got[r.image_id]) < rough(v) and (got[r.image_id] > 0).all()


def test_sub_pixel_alignment():
    x, *_ = _problem()
    x = fourier.blur_array(x, 1.0)
    y = fourier.rolled(x, np.array([2.3, -1.6]))
    fine, whole = (fourier.align_arrays(x, y, mirror=False, sub_pixel=k) for k in (True, False))
    assert np.abs(fine - x).mean() < 0.3 * np.abs(whole - x).mean()


def test_formats(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.random((6, 7)).astype(np.float32)
    assert np.allclose(formats.tiff_pixels(formats.tiff_bytes(v)), v)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(formats.tiff_bytes(v))
    grey = np.round(v * 255)
    (tmp_path / "in" / "b.png").write_bytes(binary.png_bytes(grey))
    (tmp_path / "in" / "c.npy").write_bytes(_npy(v))
    codes = "".join(f"{c:09b}"[::-1] for c in [256, *grey.astype(int).ravel().tolist(), 257])
    lzw = bytes(int(codes[i : i + 8][::-1], 2) for i in range(0, len(codes), 8))
    palette = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
    head = b"GIF89a" + (7).to_bytes(2, "little") + (6).to_bytes(2, "little") + b"\xf7\0\0" + palette + b"\x2c" + bytes(4) + (7).to_bytes(2, "little") + (6).to_bytes(2, "little") + b"\0\x08"
    (tmp_path / "in" / "d.gif").write_bytes(head + bytes([len(lzw)]) + lzw + b"\0;")
    got = {r.path[-5]: np.array(r.re).reshape(r.ny, r.nx) for r in formats.read_images(spark, str(tmp_path / "in")).collect()}
    assert np.allclose(got["a"], v) and np.allclose(got["c"], v) and np.array_equal(got["b"], grey) and np.array_equal(got["d"], grey)
    r = formats.read_detector_images(spark, str(tmp_path / "in"), (3.0, 2.0), 500.0, 20.0, 10.0).first().detector
    assert r.center == [3.0, 2.0, 0.0] and abs(r.distance - 0.5) < 1e-12 and abs(r.wavelength - 1e-8) < 1e-20 and abs(r.pixel_size[0] - 2e-5) < 1e-12
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    assert {(r.key, r.value) for r in formats.metadata(files).collect() if r.path.endswith("a.tif")} >= {("256", "7"), ("257", "6")}
    assert formats.png_texts(formats.colour_png(formats.coloured(v + 0j), {"note": "x"})) == {"note": "x"}
    for ramp in ("gray", "jet", "wheel", "phase"):
        assert formats.coloured(v + 0j, ramp, log=True).shape == (6, 7, 3)
    assert (formats.coloured(v + 0j)[..., 0] == np.round(v / v.max() * 255)).all()
    lines = formats.vtk_text(v).splitlines()
    assert lines[4] == "DIMENSIONS 7 6 1" and len(lines) == 10 + 42 and abs(float(lines[10 + 8]) - v[1, 1]) < 1e-5
    p = images(spark, SF).where("image_id < 2")
    assert formats.encoded(p, "vtk", shifted=True).count() == 6 and formats.encoded(p, "png", "jet").count() == 2
    blobs = formats.encoded(p, "tiff")
    frames.write_files(blobs, str(tmp_path / "out"))
    back = {r.name: bytes(r.content) for r in frames.read_files(spark, str(tmp_path / "out")).collect()}
    assert back == {r.name: bytes(r.content) for r in blobs.collect()} == {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()}
    assert binary.with_png(p).count() == 2
    binary.write_packed(p, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 2
    assert {(r.nx, r.ny) for r in binary.read_npy(spark, str(tmp_path / "in" / "c.npy")).collect()} == {(7, 6)}


def _npy(v):
    import io

    b = io.BytesIO()
    np.save(b, v)
    return b.getvalue()


def test_raw_frames(spark, tmp_path):
    import struct

    rng = np.random.default_rng(3)
    frames = rng.integers(0, 255, (2, 4, 6), dtype=np.uint8)
    (tmp_path / "f.raw").write_bytes(struct.pack("<iii", 6, 4, 2) + b"".join(struct.pack("<i", 7 + k) + f.tobytes() for k, f in enumerate(frames)))
    got = {r.bunch: np.array(r.re).reshape(4, 6) for r in binary.read_frames(spark, str(tmp_path / "f.raw")).collect()}
    assert np.array_equal(got[7], frames[0]) and np.array_equal(got[8], frames[1])
    px = spark.createDataFrame([(5, 1, 1.0), (3, 3, 2.0)], "x int, y int, re double")
    assert {(r.frame, r.panel, r.x, r.y) for r in binary.split_panels(px, 4, 2).collect()} == {(1, 0, 1, 1), (0, 1, 3, 1)}


def test_text_formats(spark, tmp_path):
    (tmp_path / "g.txt").write_text("Total Images: 2\nIdentifier: a\ndx: 1\ndy: 2\ndz: 1\ntheta: 0.5\nIdentifier: b\ndx: -3\ndy: 0\ndz: 1\ntheta: 0\n")
    assert {(r.id, r.dx, r.theta) for r in text.read_geometry(spark, str(tmp_path / "g.txt")).collect()} == {("a", 1.0, 0.5), ("b", -3.0, 0.0)}
    (tmp_path / "p.hicp").write_text("Total Images: 1\nIdentifier: a\nTotal Points: 2\nx: 1\ny: 2\nx: 3.5\ny: 4\n")
    assert [(r.id, r.n, r.x, r.y) for r in formats.control_points(spark, str(tmp_path / "p.hicp")).orderBy("n").collect()] == [("a", 1, 1.0, 2.0), ("a", 2, 3.5, 4.0)]
    (tmp_path / "list.txt").write_text("/a/x.h5\n\n/b/y.h5\n")
    assert [r.path for r in formats.file_list(spark, str(tmp_path / "list.txt")).orderBy("n").collect()] == ["/a/x.h5", "/b/y.h5"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.txt").write_text("other\nMaster_comment: fine\nMaster_comment: late\n")
    got = formats.with_comments(spark.createDataFrame([("/a/x.cxi",), ("/a/z.cxi",)], "path string"), spark, str(tmp_path / "s")).collect()
    assert {r.path: r.comment for r in got} == {"/a/x.cxi": "Master_comment: fine", "/a/z.cxi": None}
    master = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 6, 3)], "name string, ts int, seq int")
    shots = spark.createDataFrame([(5, 0.1, 0.2, 1), (5, 0.3, 0.4, 2)], "ts int, tunnel double, hall double, seq int")
    assert {r.name: r.tunnel for r in text.pulses(master, shots).collect()} == {"a": 0.1, "b": 0.3, "c": None}
    m = spark.createDataFrame([(1, 20, 1, 0.5, 0.25), (1, 40, 2, 0.4, 0.2)], "run_id int, it_in int, it_out int, ereal double, efourier double")
    lines = formats.log_lines(m).orderBy("n").select("value")
    parsed = text.parse_log(lines).orderBy("it_in").collect()
    assert [(r.it_in, r.ereal, r.sup_size) for r in parsed] == [(20.0, 0.5, 0.0), (40.0, 0.4, 0.0)]
    px = spark.createDataFrame([(1, 0, 0, 0, 1.0, -2.0, 0.001, 12.5, 3.0, 1.0), (1, 1, 0, 0, 1.5, 0.0, 0.0, 1.0, 1.0, 0.0)], "image_id int, x int, y int, z int, h double, k double, l double, re double, fc double, phic double")
    rows = [r.value for r in formats.reflection_list(px, (1e-9, 1e-9, 1e-9, 90, 90, 90)).orderBy("n").collect()]
    assert rows[0] == "#!/bin/sh" and rows[-1] == "    1   -2    0  1.250e+01" and sum(r.startswith("CELL 10.000000") for r in rows) == 1
    assert formats.reflection_list(px, (1e-9, 1e-9, 1e-9, 90, 90, 90), sigma=0.5).where("value like '   -1%'").count() == 1
    assert [r.value for r in binary.reflections(px, 0.01).collect()] == ["1 -2 0 12.500000"]
    from specklegrid.model import pixels

    s = formats.speden(pixels(spark, SF).where("image_id = 1"))
    assert {r.n for r in s.collect()} == {64} and all(abs(r.sig**2 - r.amp) < 1e-9 for r in s.collect())
    shells = spark.createDataFrame([(1, 0, 0.5, 3)], "image_id int, shell int, mean double, n int")
    assert formats.plot_lines(shells, "shell", "mean", "n").first().value == "0\t0.500000\t3"


def test_streams_over_folders(spark, tmp_path):
    from specklegrid.streaming import frames as S

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("# c\n1 2 0.5\n2 4 0.25\n")
    q = S.tail_logs(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("tail").outputMode("append").start()
    q.processAllAvailable()
    (tmp_path / "logs" / "b.log").write_text("3 6 0.125\n")
    q.processAllAvailable()
    q.stop()
    assert sorted(r.it_in for r in spark.table("tail").collect()) == [1.0, 2.0, 3.0]


def test_windows_and_newest(spark, tmp_path):
    from pyspark.sql import functions as F

    from specklegrid.streaming import frames as S

    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = S.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "1 day", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.event_type): r.n for r in spark.table("windows").collect()}
    want = {(r.window.start, r.event_type): r.n for r in S.windowed_counts(e, "1 day", "1 hour").collect()}
    assert got == want and sum(got.values()) == e.count()
    files = spark.createDataFrame([("a", "x", 1), ("b", "x", 3), ("c", "y", 2)], "path string, category string, k int").withColumn("created", F.timestamp_seconds(F.col("k")))
    assert {r.category: r.path for r in S.newest_outputs(files).collect()} == {"x": "b", "y": "c"}
    assert {r.category for r in S.newest_outputs(files, "1970-01-01 00:00:03").collect()} == {"x"}


def test_learning_steps(spark):
    from pyspark.sql import functions as F

    p = images(spark, SF).select("image_id", "re")
    samples = p.select(F.col("image_id").alias("sample_id"), F.posexplode("re").alias("idx", "v")).where("abs(v) >= 200").select("sample_id", "idx", F.floor(F.abs("v") / 200).cast("int").alias("n"))
    refs = spark.range(2).select(F.col("id").cast("int").alias("rot"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("idx")).withColumn("logp", -F.log(F.lit(64.0)) + F.col("rot") * 0.0)
    r = learning.responsibilities(samples, refs)
    assert all(abs(x.p - 0.5) < 1e-9 for x in r.collect())
    back = spark.range(2).select(F.col("id").cast("int").alias("rot"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("idx")).withColumn("pixel", F.col("idx"))
    n = samples.select("sample_id").distinct().count()
    want = {x.idx: x.n / n for x in samples.groupBy("idx").agg(F.sum("n").alias("n")).collect()}
    got = {x.pixel: x.mean for x in learning.maximise(samples, r, back).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    turned = spark.createDataFrame([(1, 0, 2), (1, 5, 1), (2, 3, 2), (2, 4, 1), (3, 1, 1)], "sample_id long, idx int, n int")  # 4 x 4: the second is another turned
    quarter = lambda i: (3 - i // 4) + 4 * (i % 4)
    rows = [(1, 0, 2), (1, 5, 1), (2, quarter(0), 2), (2, quarter(5), 1), (3, 1, 1)]
    c = {r.first: r.weight for r in learning.compress(spark.createDataFrame(rows, turned.schema), side=4).collect()}
    assert c == {1: 2, 3: 1}


def test_emc_finds_the_turns(spark):
    """Samples of one pattern in four turns: the loop's responsibilities become certain, and its model shows the pattern."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    pattern = np.zeros((4, 4))
    pattern[0, 0], pattern[0, 1], pattern[1, 0], pattern[2, 3] = 40, 25, 5, 12
    rows = [(s, i, int(n)) for s in range(40) for i, n in enumerate(rng.poisson(np.rot90(pattern, s % 4)).ravel()) if n]
    samples = spark.createDataFrame(rows, "sample_id long, idx int, n int")
    start = spark.createDataFrame([(i, float(1 + rng.random() + pattern.ravel()[i] * 0.1)) for i in range(16)], "pixel int, mean double")
    model, p = learning.emc(samples, start, side=4, rounds=4)
    assert p.groupBy("sample_id").agg(F.max("p").alias("p")).agg(F.min("p")).first()[0] > 0.99
    got = np.zeros(16)
    for r in model.collect():
        got[r.pixel] = r["mean"]
    best = max(np.corrcoef(np.rot90(got.reshape(4, 4), k).ravel(), pattern.ravel())[0, 1] for k in range(4))
    assert best > 0.98


def test_detector_and_convolution(spark):
    d = pixel.with_detector(spark.range(1), (1.0, 2.0, 0.0), (1e-5, 1e-5, 1e-5)).first().detector
    assert d.distance == -1.0 and d.center == [1.0, 2.0, 0.0]


def test_align_undoes_shift_and_mirror():
    x, *_ = _problem()
    y = np.roll(np.conj(x[::-1, ::-1]), (3, 5), (0, 1)) * np.exp(0.7j)
    assert np.allclose(fourier.align_arrays(x, y), x)


@pytest.mark.parametrize("case,want", [((0, 0, 1, 0, 0), (0, 1)), ((0, 0, 1, 0, math.pi), (0, -1)), ((0, 0, 0.5, 0, math.pi), (0, -2)), ((1, 0, 0.5, 0, math.pi), (1, -2)), ((1, 1, 0.5, 0, math.pi), (1, -1))])
def test_affine(case, want):
    p = dict(zip(geometry.VARIABLES, case, strict=True))
    assert np.allclose(geometry.to_global(p, 0, 1), want)


def test_config_round_trip():
    o = {"a": 1, "b": 2.5, "s": 'x "y"', "g": {"t": True, "m": [[0, 1], [0.5, 2]]}}
    assert text.parse_config(text.write_config(o)) == o
    assert text.parse_config("# c\ng : { x = 1; /* d */ y = (1, [2, 3]); }; // e") == {"g": {"x": 1, "y": [1, [2, 3]]}}
    with pytest.raises(ValueError):
        text.parse_config("a = ;")


def test_png_round_trip():
    v = np.arange(48).reshape(6, 8).astype(float)
    assert np.array_equal(binary.png_pixels(binary.png_bytes(v)), v)


def test_tracking_restarts_after_many_hits():
    rng = np.random.default_rng(0)
    back, n = None, 0
    base = rng.random(64)
    back, n, _, hit = track(back, n, base)
    assert not hit
    for k in range(12):
        back, n, _, hit = track(back, n, rng.random(64) if k == 0 else np.sin(np.arange(64)))
        assert hit
        if n == 0:
            break
    assert np.allclose(back, np.sin(np.arange(64)))


def test_log_and_matrix_sources(spark, tmp_path):
    (tmp_path / "run.log").write_text('# c\n@ s0 legend "It"\n1 2 0.5 nan x 3\n2 4 0.25 1e-3 4\n')
    rows = text.parse_log(spark.read.text(str(tmp_path / "run.log"))).orderBy("it_in").collect()
    assert [r.it_out for r in rows] == [2.0, 4.0] and rows[1].efourier == 1e-3
    assert text.parse_legends(spark.read.text(str(tmp_path / "run.log"))).first().legend == "It"
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    got = {(r.x, r.y): r.re for r in text.read_matrices(spark, str(tmp_path / "m.txt")).collect()}
    assert got[2, 1] == 6.0 and len(got) == 6


def test_stream_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from specklegrid.streaming.frames import track_batch, track_stream

    df = spark.range(30).select((F.col("id") % 2).alias("stream"), F.col("id").alias("seq"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(k * (F.col("id") % 7)) + k).alias("v"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = track_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.stream, r.seq)
    assert [tuple(r) for r in sorted(spark.table("hits").collect(), key=key)] == [tuple(r) for r in sorted(track_batch(df).collect(), key=key)]


def test_topographic_map_follows_a_curve(spark):
    """The likelihood rises with each round, and the centres lie along the data."""
    rng = np.random.default_rng(6)
    t = rng.random(400)
    x = np.stack([t, np.sin(3 * t)], 1) + rng.normal(size=(400, 2)) * 0.02
    v = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    line = np.linspace(-1, 1, 12)[:, None]
    centres, beta, history = learning.gtm_fit(v, learning.radial_basis(line, np.linspace(-1, 1, 4)[:, None], 0.7), rounds=25, seed=2)
    assert all(b >= a - 1e-6 * abs(a) - 0.5 for a, b in zip(history, history[1:])) and history[-1] > history[0]
    gap = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2)).min(1)
    assert gap.mean() < 0.1 and beta > 10
    assert learning.empty_points(np.array([0.0, 10, 10, 11])).tolist() == [True, False, False, False]


def test_snapshots_show_support_and_transform(spark):
    from pyspark.sql import functions as F

    p = images(spark, SF).where("image_id < 2")
    runs = p.select("image_id", F.lit(0).alias("seed"), "nx", "ny", "nz", F.col("re").alias("amplitude"), "mask", "re", "im", F.col("mask").alias("support"), F.lit(3).alias("iteration"), F.lit("{}").alias("state"))
    for r in phasing.snapshots(runs).collect():
        assert np.allclose(r.fourier, np.abs(np.fft.fft2(np.array(r.re).reshape(8, 8))).ravel()) and r.iteration == 3


def test_schedules_by_precedence():
    assert schedules.beta_at(5, 0.9) == 0.9 and schedules.beta_at(0, 0.9, over=10) == 0.75 and schedules.beta_at(1e6, 0.9, over=10) == 0.9
    marks = [(0, 1.0), (10, 0.0)]
    assert abs(schedules.beta_at(5, 0.9, checkpoints=marks) - 0.5) < 1e-12 and schedules.beta_at(-3, 0.9, checkpoints=marks) == 1.0 and schedules.beta_at(10, 0.9, checkpoints=marks) == 0.0
    assert schedules.beta_at(5, 0.9, keys_map=marks, checkpoints=[(0, 7.0)]) == schedules.bezier(5, [0, 10], [1.0, 0.0])
    assert schedules.area_at(0, 0.3, 0.1, 100) == 0.3 and abs(schedules.area_at(1e6, 0.3, 0.1, 100) - 0.1) < 1e-9 and schedules.area_at(7, 0.3) == 0.3


def test_pulse_files(spark, tmp_path):
    (tmp_path / "m.log").write_text("# start\nFEL1, 1/2/2008, 10:11:12, a b c 77\nother\nFEL2, 1/2/2008, 10:11:13, a b c 78\nFEL3, 1/2/2008, 10:11:13, a b c 78\n")
    (tmp_path / "p.csv").write_text("78, 1/2/2008, 10:11:13, 1, 2, 0.5, 1.5, 0.25, 2.5\n78, 1/2/2008, 10:11:14, 1, 2, 0.5, 1.75, 0.25, 2.75\nbad\n")
    got = text.pulses(text.read_master(spark, str(tmp_path / "m.log")), text.read_shots(spark, str(tmp_path / "p.csv"))).collect()
    assert {r.name: (r.tunnel, r.hall) for r in got} == {"FEL1": (None, None), "FEL2": (1.5, 2.5), "FEL3": (1.75, 2.75)}


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(8)
    v = rng.integers(0, 256, (6, 5, 3))
    raw, last = b"", np.zeros((5, 3), int)
    for k, row in enumerate(v):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), last[:-1]])
        p = left + last - corner
        gaps = np.abs(np.stack([p - left, p - last, p - corner]))
        near = np.choose(gaps.argmin(0), [left, last, corner])
        kind = k % 5
        raw += bytes([kind]) + ((row - [0, left, last, (left + last) // 2, near][kind]) % 256).astype(np.uint8).tobytes()
        last = row
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert np.allclose(binary.png_pixels(data), v.mean(-1))


def test_centre_of_symmetry(spark):
    rng = np.random.default_rng(9)
    half = rng.random((5, 6))
    v = np.zeros((8, 9))
    v[1:6, 2:8] = half + half[::-1, ::-1]
    from specklegrid.operators import packed

    one = spark.createDataFrame([(1, 9, 8, 1, v.ravel().tolist(), [0.0] * 72, [1] * 72)], "image_id long, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>")
    r = packed.find_centre(one).first()
    assert (r.x, r.y) == (4.5, 3.0)


def test_panels_of_another_shape_are_refused(spark):
    with pytest.raises(Exception, match="two panels"):
        binary.split_panels(spark.createDataFrame([(0, 9, 1.0)], "x int, y int, re double"), 4, 2).collect()


def test_incremental_components(spark):
    """The first direction of a long stream is that of its largest variance; streams don't mix."""
    rng = np.random.default_rng(10)
    a, b = np.array([3.0, 1.0, 0.0]), np.array([0.0, 1.0, -2.0])
    rows = [(s, k, (rng.normal() * d + rng.normal(size=3) * 0.1).tolist()) for s, d in ((1, a), (2, b)) for k in range(400)]
    got = learning.incremental_pca(spark.createDataFrame(rows, "stream long, seq long, v array<double>"), "stream", "seq", "v").where("component = 0").collect()
    assert len(got) == 2
    for r in got:
        d = a if r.stream == 1 else b
        assert abs(np.dot(r.direction, d / np.linalg.norm(d))) > 0.99
