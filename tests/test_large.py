"""Frame sources that split files, committing sinks, tiles with halos, transforms over tiles and exact selection, against numpy and the one-row operators."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from specklegrid.model import checkpointed
from specklegrid.operators import fourier, merging, packed, selection, tiles
from specklegrid.sources import binary, frames


def _stack(path, n, w, h, seed=0):
    rng = np.random.default_rng(seed)
    v, bunch = rng.integers(0, 256, (n, w * h), dtype=np.uint8), rng.integers(0, 50, n)
    with open(path, "wb") as f:
        f.write(struct.pack("<iii", w, h, n) + b"".join(struct.pack("<i", b) + x.tobytes() for b, x in zip(bunch, v, strict=True)))
    return v, bunch


@pytest.fixture()
def stacks(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _stack(folder / "a.sss", 300, 16, 9, 1)
    _stack(folder / "b.sss", 7, 5, 4, 2)
    (folder / "note.txt").write_text("no frames")
    return folder


NAMES = ["frame", "bunch", "nx", "ny", "nz", "re", "im", "mask"]


def _key(r):
    return (os.path.basename(r["path"]), *[tuple(r[c]) if isinstance(r[c], list) else r[c] for c in NAMES])


def test_frames_are_split_within_files(spark, stacks):
    whole = sorted(map(_key, binary.read_frames(spark, str(stacks / "*.sss")).collect()))
    for split, parts in ((1 << 10, 51), (1 << 30, 2)):
        found = frames.read_frames(spark, str(stacks), split_bytes=split)
        assert sorted(map(_key, found.collect())) == whole and found.rdd.getNumPartitions() == parts
    assert frames.read_frames(spark, str(stacks / "b.sss")).count() == 7
    assert frames.read_frames(spark, "file://" + str(stacks)).count() == 307


def test_filters_reach_the_plan_of_frames(spark, stacks):
    found = frames.read_frames(spark, str(stacks), split_bytes=1 << 10)
    some = found.where((F.col("frame") >= 290) & (F.col("frame") < 295))
    assert sorted(r.frame for r in some.collect()) == list(range(290, 295)) and some.rdd.getNumPartitions() == 1
    assert found.where("frame = 6").count() == 2 and found.where("frame > 298 and frame <= 299").count() == 1
    one = found.where(F.col("path").endswith("a.sss")).select("bunch").collect()
    wanted = one[3].bunch
    assert found.where(F.col("bunch") == int(wanted)).count() == sum(r.bunch == wanted for r in found.select("bunch").collect())
    assert found.where(F.col("bunch").isin(1, 2, 3) & (F.col("frame") < 100)).count() == found.toPandas().query("bunch in (1, 2, 3) and frame < 100").shape[0]
    path = found.where("nx = 5").first().path
    assert found.where(F.col("path") == path).count() == 7 and found.where(F.col("path") == path).rdd.getNumPartitions() == 1


def test_a_file_of_4_gb_is_read_by_many_tasks(spark, tmp_path):
    """4,096 frames of a megapixel in a sparse file: the plan has a range for every 64 MB, and a filter reads only its own."""
    path, size = tmp_path / "big.sss", 1 << 20
    with open(path, "wb") as f:
        f.write(struct.pack("<iii", 1024, 1024, 4096))
        for k in (0, 4000, 4095):
            f.seek(12 + k * (4 + size))
            f.write(struct.pack("<i", k + 7) + bytes([k % 251]) * 10)
        f.truncate(12 + 4096 * (4 + size))
    plan = frames.ranges(str(path), frames.SPLIT_BYTES, False)
    assert len(plan) == 4096 // 63 + 1 and [p.first for p in plan[1:]] == [p.end for p in plan[:-1]] and plan[-1].end == 4096
    found = frames.read_frames(spark, str(path)).where("frame >= 3999 and frame <= 4001")
    rows = {r.frame: r for r in found.select("frame", "bunch", F.aggregate("re", F.lit(0.0), lambda a, v: a + v).alias("total")).collect()}
    assert sorted(rows) == [3999, 4000, 4001] and rows[4000].bunch == 4007 and rows[4000].total == 10 * (4000 % 251) and rows[3999].total == 0


def test_odd_frame_files(spark, tmp_path):
    v = np.arange(12, dtype="<i4") - 3
    trailer = np.arange(11, dtype="<i4")
    trailer[9] = 123456
    (tmp_path / "one.raw").write_bytes(struct.pack("<ii", 4, 3) + v.tobytes() + trailer.tobytes())
    r = frames.read_frames(spark, str(tmp_path)).first()
    assert (r.nx, r.ny, r.bunch, r.re) == (4, 3, 123456, v.astype(float).tolist())
    _stack(tmp_path / "cut.sss", 6, 4, 4)
    data = (tmp_path / "cut.sss").read_bytes()
    (tmp_path / "cut.sss").write_bytes(data[:-5])
    with pytest.raises(Exception, match="holds 5 frames of 6"):
        frames.read_frames(spark, str(tmp_path)).count()
    assert frames.read_frames(spark, str(tmp_path), drop_truncated=True).count() == 6
    (tmp_path / "bad.sss").write_bytes(b"abc")
    with pytest.raises(Exception, match="no header"):
        frames.read_frames(spark, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    assert frames.read_frames(spark, str(tmp_path / "none")).count() == 0


def test_frames_round_trip_and_shots(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, 4, 3, rng.integers(0, 256, 12).astype(float).tolist()) for k in range(200)] + [(900 + k, 2, 2, [300.0, -5.0, 1.9, 7.0]) for k in range(3)]
    images = spark.createDataFrame(rows, "bunch int, nx int, ny int, re array<double>").repartition(3)
    out = str(tmp_path / "out")
    frames.write_frames(images, out, file_bytes=400)
    assert len([f for f in os.listdir(out) if f.endswith(".sss")]) > 5 and not [f for f in os.listdir(out) if f.startswith("_")]
    found = frames.read_frames(spark, out, split_bytes=100)
    assert {r.bunch: r.re for r in found.collect()} == {b: v for b, _, _, v in rows[:200]} | {900 + k: [255.0, 0.0, 1.0, 7.0] for k in range(3)}
    shots = spark.createDataFrame([(5, 1.0, 2.5, 1), (5, 9.0, 9.0, 2), (7, 1.0, None, 1), (None, 0.0, 0.0, 0)], "ts int, tunnel double, hall double, seq int")
    names = {r.bunch: (r.tunnel, r.hall, r.name) for r in frames.with_shot_energy(found, shots, "run").collect()}
    assert names[5] == (1.0, 2.5, "run-5-2.500000") and names[7] == (1.0, None, "run-7-xxxx") and names[8] == (None, None, "run-8-xxxx") and len(names) == 203


def _blobs(spark, names, slices=3):
    return spark.createDataFrame([(n, bytearray(f"{n}\0\xff".encode("latin-1"))) for n in names], "name string, content binary").repartition(slices)


def test_files_are_committed_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "files"
    frames.write_files(_blobs(spark, ["a.png", "sub/b.bin", "c"]), str(out))
    assert (out / "sub" / "b.bin").read_bytes() == b"sub/b.bin\0\xff" and sorted(os.listdir(out)) == ["a.png", "c", "sub"]
    before = {p: p.read_bytes() for p in out.rglob("*") if p.is_file()}

    @F.udf("binary")
    def fails(name):
        if name == "x7":
            raise RuntimeError("lost")
        return b"new"

    many = spark.range(20).select(F.concat(F.lit("x"), "id").alias("name")).repartition(5)
    for bad, why in ((many.withColumn("content", fails("name")), "lost"), (_blobs(spark, ["d", "a.png"]), "there already"), (_blobs(spark, ["e", "e"]), "occurs twice"), (_blobs(spark, ["../f"]), "no name")):
        with pytest.raises(Exception, match=why):
            frames.write_files(bad, str(out))
        assert {p: p.read_bytes() for p in out.rglob("*") if p.is_file()} == before and not [f for f in os.listdir(out) if f.startswith("_")]
    frames.write_files(_blobs(spark, ["g"]), str(out), mode="overwrite")
    assert sorted(f for f in os.listdir(out) if (out / f).is_file()) == ["g"]
    frames.write_files(_blobs(spark, []), str(tmp_path / "nothing"))
    assert not list((tmp_path / "nothing").iterdir())


def test_iterations_are_appended_once(spark, tmp_path):
    out = str(tmp_path / "log")
    assert frames.iterations(spark, out) == []
    for i in (3, 10):
        frames.append_iteration(spark.createDataFrame([(1, [float(i)])], "image_id long, re array<double>"), out, i)
    with pytest.raises(FileExistsError):
        frames.append_iteration(spark.createDataFrame([(1, [0.0])], "image_id long, re array<double>"), out, 3)
    os.remove(f"{out}/iteration=000000010/_SUCCESS")  # as a job leaves it that was lost
    assert frames.iterations(spark, out) == [3]
    frames.append_iteration(spark.createDataFrame([(1, [11.0])], "image_id long, re array<double>"), out, 10)
    assert {r.iteration: r.re for r in frames.read_iterations(spark, out).collect()} == {3: [3.0], 10: [11.0]}
    assert frames.read_iterations(spark, out, 3).count() == 1


# ---- tiles


def _packed(spark, v, image=1):
    nz, ny, nx = v.shape
    return spark.createDataFrame([(image, nx, ny, nz, v.ravel().tolist(), [0.0] * v.size, [1] * v.size)], "image_id long, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>")


def _whole(t, shape, values=("v",)):
    """The arrays of each image, put together again."""
    out = {}
    sides = {}
    rows = t.collect()
    for r in rows:
        for a, n in (("tz", "d"), ("ty", "h"), ("tx", "w")):
            sides[a] = max(sides.get(a, 0), r[n])
    for r in rows:
        whole = out.setdefault(r.image_id, [np.full(shape, np.nan) for _ in values])
        z, y, x = r.tz * sides["tz"], r.ty * sides["ty"], r.tx * sides["tx"]
        for k, c in enumerate(values):
            whole[k][z : z + r.d, y : y + r.h, x : x + r.w] = np.reshape(r[c], (r.d, r.h, r.w))
    return out


def test_stencils_on_tiles_equal_those_on_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(40, 30, (1, 150, 210))
    p, t = _packed(spark, v), tiles.cut(_packed(spark, v), 64).cache()
    assert np.array_equal(_whole(t, v.shape)[1][0], v)
    row = lambda df: np.reshape(df.first().re, v.shape)
    cases = [
        (tiles.box_blur(t, 64, 2), packed.box_blur(p, 2)), (tiles.zero_near_negative(t, 64), packed.zero_near_negative(p)), (tiles.gaussian_blur(t, 64, 1.5, 4), packed.gaussian_blur_direct(p, 1.5, 4)),
        (tiles.tv_denoise(t, 64, 0.1, 0.2, 7, 3), fourier.tv_denoise(p, 0.1, 0.2, 7)), (tiles.area_support(t, 0.3), packed.area_threshold_support(p, 0.3)),
    ]
    for tiled, one in cases:
        assert np.allclose(_whole(tiled, v.shape)[1][0], row(one), atol=1e-9)
    with pytest.raises(Exception, match="smaller than the halo"):  # the last tiles are 22 high
        tiles.box_blur(t, 64, 23).collect()
    with pytest.raises(Exception, match="tiles missing"):
        tiles.box_blur(t.where("ty <> 1 or tx <> 1"), 64, 1).collect()
    assert tiles.box_blur(t.limit(0), 64, 1).count() == 0


def test_volumes_and_several_images(spark):
    rng = np.random.default_rng(2)
    v = {k: rng.normal(0, 5, (10, 13, 21)) for k in (3, 4)}
    t = tiles.cut(_packed(spark, v[3], 3).unionByName(_packed(spark, v[4], 4)), 7)
    got = _whole(tiles.box_blur(t, 7, 1), (10, 13, 21))
    for k, x in v.items():
        want = np.mean([np.roll(x, s, (0, 1, 2)) for s in np.ndindex(3, 3, 3) for s in [tuple(np.array(s) - 1)]], axis=0)
        assert np.allclose(got[k][0], want)


def test_only_strips_move_between_rounds(spark):
    """With tables too large to be sent to all, the one exchange of a round is that of the strips."""
    v = np.random.default_rng(4).normal(0, 1, (1, 96, 96))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t, want = tiles.kept(tiles.dealt(tiles.cut(_packed(spark, v), 32))), v
        for _ in range(3):
            once = tiles.box_blur(t, 32, 1)
            plan = once._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "partial_collect_list" in plan.split("Exchange")[1]
            t = tiles.kept(once)
            want = np.mean([np.roll(want, (dy, dx), (1, 2)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        assert np.allclose(_whole(t, v.shape)[1][0], want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_transforms_over_tiles(spark):
    v = np.random.default_rng(5).normal(0, 1, (1, 512, 512))
    t = tiles.transform(tiles.complex_tiles(tiles.cut(_packed(spark, v), 100)), 100).cache()
    re, im = _whole(t, v.shape, ("re", "im"))[1]
    assert np.allclose(re + 1j * im, np.fft.fft2(v[0])[None], atol=1e-8)
    back = _whole(tiles.transform(t, 100, inverse=True), v.shape, ("re", "im"))[1]
    assert np.allclose(back[0] / v.size, v, atol=1e-10) and np.allclose(back[1] / v.size, 0, atol=1e-10)
    with pytest.raises(Exception, match="pixels along axis"):
        tiles.transform(tiles.complex_tiles(tiles.cut(_packed(spark, v), 256)).where("tx = 0"), 256).collect()


def test_transform_of_a_volume(spark):
    z, y, x = np.meshgrid(*[np.arange(100)] * 3, indexing="ij")
    v = sum(((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2 < 80).astype(float) * (a / 50) for a, b, c in ((30, 40, 50), (60, 55, 50), (45, 70, 20)))
    layers = tiles.cut(_packed(spark, v), 25)
    re, im = _whole(tiles.transform(tiles.complex_tiles(layers), 25, volume=True), v.shape, ("re", "im"))[1]
    assert np.allclose(re + 1j * im, np.fft.fftn(v), atol=1e-7)


def test_spanned_axes_move_nothing(spark):
    v = np.random.default_rng(6).normal(0, 1, (1, 40, 30))
    rows = tiles.complex_tiles(tiles.cut(_packed(spark, v), 64))
    t = tiles.transform(rows, 64, spanned="xy")
    assert "Exchange" not in t._jdf.queryExecution().executedPlan().toString()
    re, im = _whole(t, v.shape, ("re", "im"))[1]
    assert np.allclose(re + 1j * im, np.fft.fft2(v[0])[None])


# ---- exact selection


def test_selection_is_exact(spark):
    rng = np.random.default_rng(8)
    values = np.r_[rng.normal(0, 1e3, 3000), rng.integers(-3, 4, 900) / 2, [0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324]]
    rows = [(["a", "b", None][i % 3], float(x)) for i, x in enumerate(values)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    groups = {g: np.sort([x + 0.0 for k, x in rows if k == g and x is not None]) for g in ("a", "b", None)}
    for share in (0.0, 0.37, 0.5, 0.9, 1.0, 3.0):
        for top in (False, True):
            got = {r.g: r.level for r in selection.selected(df, "g", "x", lambda n, share=share: F.floor(n * share), from_top=top).collect()}
            assert set(got) == set(groups)
            for g, v in groups.items():
                at = min(int(len(v) * share), len(v) - 1)
                assert np.array_equal([got[g]], [v[::-1][at] if top else v[at]], equal_nan=True), (g, share, top)
    assert selection.selected(df.limit(0), "g", "x", lambda n: n).count() == 0
    listed = df.groupBy("g", F.expr("pmod(hash(x), 7)")).agg(F.collect_list("x").alias("v"))
    assert {r.g: r.level for r in selection.selected(listed, "g", "v", lambda n: F.floor(n / 2)).collect()} == {g: v[len(v) // 2] for g, v in groups.items()}
    plan = selection.selected(df, "g", "x", lambda n: n)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    bits = selection.ordered_bits(np.sort(values))
    assert (bits[1:] >= bits[:-1]).all() and np.array_equal(selection.doubles(bits), np.sort(values), equal_nan=True)


def test_weak_pixels_by_selection(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, float(x), 0.0, int(rng.random() < 0.9)) for k in (1, 2) for i, x in enumerate(np.round(rng.normal(0, 3, 100), 1))]
    px = spark.createDataFrame(rows, "image_id long, i int, re double, im double, mask int")
    got = {(r.image_id, r.i): r.weak for r in merging.weak_pixels(px, 0.25).collect()}
    for k in (1, 2):
        a = np.abs([r[2] for r in rows if r[0] == k])
        level = np.sort(a)[::-1][25]
        assert {i: got[k, i] for i in range(100)} == {r[1]: r[4] != 0 and abs(r[2]) <= level for r in rows if r[0] == k}


def test_order_by_exposure_has_no_single_task(spark):
    rows = [(i, float(x)) for i, x in enumerate(np.random.default_rng(3).integers(0, 40, 500))] * 2
    ordered = merging.ordered_by_exposure(spark.createDataFrame(rows, "image_id long, re double").repartition(7))
    sums = sorted((2 * x, i) for i, x in rows[:500])
    assert [(r.exposure, r.image_id) for r in sorted(ordered.collect(), key=lambda r: r.place)] == sums
    assert sorted(r.place for r in ordered.collect()) == list(range(500))
    assert merging.ordered_by_exposure(spark.createDataFrame([], "image_id long, re double")).count() == 0
    assert checkpointed(spark.range(5)).count() == 5


def test_aligned_average_brings_moved_copies_together(spark):
    """Copies moved around the ends, one of them reflected, average to the first one."""
    from specklegrid.operators import phasing

    rng = np.random.default_rng(12)
    v = rng.random((8, 8)) ** 4
    moved = [v, np.roll(v, (2, 3), (0, 1)), np.roll(v, (-1, 4), (0, 1)), np.roll(v[::-1, ::-1], (1, 1), (0, 1))]
    rows = [(7, seed, 8, 8, 1, m.ravel().tolist(), [0.0] * 64) for seed, m in enumerate(moved)] + [(8, 0, 8, 8, 1, v.ravel().tolist(), [0.5] * 64)]
    got = {r.image_id: r for r in phasing.aligned_average(spark.createDataFrame(rows, "image_id long, seed int, nx int, ny int, nz int, re array<double>, im array<double>")).collect()}
    assert got[7].n == 4 and np.allclose(got[7].re, v.ravel(), atol=1e-6) and np.allclose(got[7].im, 0, atol=1e-6)
    assert got[8].n == 1 and np.allclose(got[8].re, v.ravel()) and np.allclose(got[8].im, 0.5)


def test_sampling_is_limited_to_the_object(spark):
    """A wide image of a small object's intensities keeps the extent of the object's autocorrelation."""
    small = np.zeros((64, 64))
    small[28:36, 28:36] = np.random.default_rng(1).random((8, 8)) + 0.5
    intensities = np.fft.fftshift(np.abs(np.fft.fft2(np.fft.ifftshift(small))) ** 2)
    wide = spark.createDataFrame([(1, 64, 64, 1, intensities.ravel().tolist(), [0.0] * 4096, [1] * 4096)], "image_id long, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>")
    sides = [fourier.limit_sampling(wide, f, 0.01, 0.0).first().nx for f in (1.0, 2.0)]
    assert sides == [16, 32] or sides == [14, 28]  # the autocorrelation of eight pixels spans fifteen


def test_pixel_tables_give_what_packed_rows_give(spark):
    """The forms that serve where pixels meet other tables."""
    from specklegrid.model import center_distance, images, pixels, unpack
    from specklegrid.operators import aggregate, spatial
    from specklegrid.operators import pixel as P

    sf = "/root/testdata/sf0.001"
    p = images(spark, sf).where("image_id < 12")
    px, after = unpack(p, "label"), p.withColumn("image_id", F.col("image_id") - 1)
    assert px.count() == pixels(spark, sf).where("image_id < 12").count()

    def same(a, b, keys, *values):
        a, b = ({tuple(r[k] for k in keys): [r[v] for v in values] for r in x.collect()} for x in (a, b))
        assert set(a) == set(b) and a
        for k in a:
            assert all((x is None and y is None) or abs(x - y) < 1e-9 * max(1, abs(x)) for x, y in zip(a[k], b[k], strict=True)), (k, a[k], b[k])

    d, most = center_distance(8, 8), float(np.hypot(8, 8) / 2)
    same(merging.wilson(px, d, 4, most, "image_id"), packed.wilson(p, 4, most), ["image_id", "shell"], "mean", "log_mean")
    same(merging.right_half_mean(px, 8), packed.right_half_mean(p), ["image_id"], "background")
    same(merging.snapshot_difference(px, "label", "image_id"), packed.snapshot_difference(p, "label", "image_id"), ["label", "image_id"], "int_cum_fluctuation")
    z = px.join(unpack(after).select("image_id", "i", F.col("re").alias("re2"), F.col("im").alias("im2")), ["image_id", "i"])
    same(aggregate.inner_product(z, "image_id"), packed.inner_product(p, after), ["image_id"], "re", "im")
    moduli = z.select("image_id", F.abs("re").alias("a"), F.abs("re2").alias("b"))
    same(merging.real_space_agreement(moduli, "image_id"), packed.real_space_agreement(p, after), ["image_id"], "r", "cc")
    masked = P.mask_overexposed(px, 100.0, clear=False)
    packed_masked = p.withColumn("mask", F.transform("re", lambda v: F.when(F.abs(v) > 100, 0).otherwise(1)))
    same(aggregate.radial_profile(masked, d, 4, most, measured=True).where("n > 0"), packed.radial_profile(packed_masked, 4, most, measured=True), ["image_id", "shell"], "mean", "n")
    same(spatial.line_out(px, 0.0, 1.0, 7.0, 6.5, 30), packed.line_out(p, 0.0, 1.0, 7.0, 6.5, 30), ["image_id", "p"], "re", "mask")
    same(spatial.rotate(px, 8, 8, 0.7), packed.rotate(p, 0.7), ["image_id", "p"], "re", "mask")


def test_files_in_folders_never_pass_through_the_driver(spark, tmp_path):
    """Tasks list the folders; a task's message has a digest a file and no path; a name that two tasks wrote is found."""
    rows = spark.range(3000).select(frames.in_folders(F.concat(F.col("id").cast("string"), F.lit(".bin"))).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    frames.write_files(rows.repartition(5), str(tmp_path / "many"))
    found = frames.read_folders(spark, str(tmp_path / "many"))
    assert {(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in found.collect()} == {(f"{i}.bin", str(i).encode()) for i in range(3000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "LocalTableScan" in plan or "ExistingRDD" in plan
    assert len(list((tmp_path / "many").iterdir())) <= 64
    writer = frames.FileWriter({"path": str(tmp_path / "other")}, False)
    said = writer.write(iter(rows.limit(100).toArrow().to_batches()))
    assert said.count == 100 and len(said.names) == 1600
    writer.abort([said])
    with pytest.raises(Exception, match="occurs twice"):
        frames.write_files(rows.limit(3).unionByName(rows.limit(3)).repartition(3), str(tmp_path / "twice"))
    assert not (tmp_path / "twice").exists() or not [p for p in (tmp_path / "twice").rglob("*") if p.is_file()]
