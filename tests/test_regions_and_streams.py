"""Boxes by cells and masks as runs against pixels; streams of pulses and of output files against their batch forms."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specklegrid.operators import regions
from specklegrid.sources import text
from specklegrid.streaming import frames, pulses, watcher


def test_many_boxes_against_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 100_000
    x0, y0 = rng.integers(-500, 500, (2, n))
    w, h = (2 ** rng.uniform(0, 7, (2, n))).astype(int)
    boxes = spark.createDataFrame([(int(i), int(a), int(b), int(a + c - 1), int(b + d - 1)) for i, (a, b, c, d) in enumerate(zip(x0, y0, w, h, strict=True))], "box long, x0 int, y0 int, x1 int, y1 int")
    points = [(int(k), int(a), int(b)) for k, (a, b) in enumerate(rng.integers(-520, 640, (300, 2)))]
    px = spark.createDataFrame(points, "id long, x int, y int")
    assert regions.cells(boxes).count() <= 4 * n
    got = {(r.id, r.box) for r in regions.in_boxes(px, boxes).select("id", "box").collect()}
    want = {(k, int(i)) for k, a, b in points for i in np.flatnonzero((x0 <= a) & (a < x0 + w) & (y0 <= b) & (b < y0 + h))}
    assert got == want and len(want) > 10_000


def test_sizes_of_boxes_share_grids(spark):
    """Points are shuffled once, not once for each size of boxes; a size by far larger doesn't take the small ones along."""
    rng = np.random.default_rng(4)
    boxes = [(int(i), int(a), int(b), int(a + i % 7), int(b + i % 30)) for i, (a, b) in enumerate(rng.integers(0, (50, 9000), (3000, 2)))]
    points = [(int(k), int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, (50, 9000), (4000, 2)))]
    make = lambda rows: spark.createDataFrame(rows, "box long, x0 long, y0 long, x1 long, y1 long")
    px = spark.createDataFrame(points, "id long, x long, y long")
    for more, most in (([], 1), ([(9999, -5, -5, 60, 9999)], 3)):
        found = regions.in_boxes(px, make(boxes + more))
        assert {(r.id, r.box) for r in found.collect()} == {(k, i) for k, a, b in points for i, x0, y0, x1, y1 in boxes + more if x0 <= a <= x1 and y0 <= b <= y1}
        sizes = {(int(r.lx), int(r.ly)): r["count"] for r in regions._levels(make(boxes + more)).groupBy("lx", "ly").count().collect()}
        assert len(sizes) >= 20 and len(set(regions.chosen_grids(sizes, 4000, (50.0, 9000.0)).values())) <= most
    plan = regions.in_boxes(px, make(boxes))._jdf.queryExecution().optimizedPlan().toString()
    assert "grid_" not in plan
    far = {(0, 0): 10**7, (20, 20): 1}
    assert regions.chosen_grids(far, 10**7, (2.0**21, 2.0**21)) == {(0, 0): (0, 0), (20, 20): (20, 20)}


def test_boxes_of_images_and_odd_boxes(spark):
    px = spark.createDataFrame([(g, x, y, 1.0, 9) for g in (1, 2) for x in range(4) for y in range(4)], "image_id long, x int, y int, re double, box int")
    boxes = spark.createDataFrame([(1, 5, 0, 0, 1, 1), (2, 6, 3, 3, 3, 3), (2, 7, 2, 2, 1, 1), (2, 8, None, 0, 3, 3), (1, 9, -5, -5, 50, 50), (1, 9, -5, -5, 50, 50)], "image_id long, b int, x0 int, y0 int, x1 int, y1 int")
    got = regions.in_boxes(px, boxes, on=("image_id",))
    assert got.columns == ["image_id", "x", "y", "re", "box", "b", "x0", "y0", "x1", "y1"]
    counts = {(r.image_id, r.b): r.n for r in got.groupBy("image_id", "b").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1, 5): 4, (2, 6): 1, (1, 9): 32}
    assert regions.in_boxes(px, boxes.limit(0), on=("image_id",)).count() == 0 and regions.in_boxes(px.limit(0), boxes, on=("image_id",)).count() == 0


def _pixels(runs):
    return {(r.image_id, r.y, x) for r in runs.collect() for x in range(r.start, r.end + 1)}


def test_runs_equal_pixels(spark):
    rng = np.random.default_rng(2)
    v = {k: rng.normal(0, 1, (23, 31)) for k in (1, 2)}
    packed = spark.createDataFrame([(k, 31, 23, 1, x.ravel().tolist()) for k, x in v.items()], "image_id long, nx int, ny int, nz int, re array<double>")
    a = regions.runs_of(packed, lambda x: x > 0.3)
    wanted = {(k, int(y), int(x)) for k, m in v.items() for y, x in zip(*np.nonzero(m > 0.3), strict=True)}
    assert _pixels(a) == wanted
    b = regions.disc(packed, F.lit(14.2), F.lit(9.0), F.lit(11.5), F.col("nx"), F.col("ny"))
    yy, xx = np.mgrid[:23, :31]
    round_ = {(k, int(y), int(x)) for k in v for y, x in zip(*np.nonzero((xx - 14.2) ** 2 + (yy - 9.0) ** 2 <= 11.5**2), strict=True)}
    assert _pixels(b) == round_
    for how, want in {"union": wanted | round_, "intersection": wanted & round_, "difference": wanted - round_, "either": wanted ^ round_}.items():
        rows = regions.combined(a, b, how).collect()
        got = [(r.image_id, r.y, x) for r in rows for x in range(r.start, r.end + 1)]
        assert len(got) == len(set(got)) and set(got) == want
        ends = {(r.image_id, r.y, r.end + 1) for r in rows}
        assert not ends & {(r.image_id, r.y, r.start) for r in rows}  # runs that touch are one
        size = {r.image_id: r.n for r in regions.area(regions.combined(a, b, how)).collect()}
        assert size == {k: sum(g == k for g, *_ in want) for k in {g for g, *_ in want}}
    with pytest.raises(ValueError):
        regions.combined(a, b, "sum")


def test_runs_that_overlap_and_wide_runs(spark):
    schema = "image_id long, y int, start int, end int"
    a = spark.createDataFrame([(1, 0, 0, 2_000_000_000), (1, 0, 5, 9), (1, 0, 9, 30), (1, 1, 4, 2)], schema)
    b = spark.createDataFrame([(1, 0, 10, 12), (1, 0, 13, 19), (1, 2, 1, 1)], schema)
    show = lambda how: sorted(map(tuple, regions.combined(a, b, how).collect()))
    assert show("difference") == [(1, 0, 0, 9), (1, 0, 20, 2_000_000_000)] and show("intersection") == [(1, 0, 10, 19)]
    assert show("union") == [(1, 0, 0, 2_000_000_000), (1, 2, 1, 1)] and regions.combined(a.limit(0), b.limit(0), "union").count() == 0


# ---- streams


def _arrivals(spark, folder, batches, schema):
    """A stream of these batches, one a trigger."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
        t = time.time() - 1000 + k
        for f in os.listdir(f"{folder}/b{k}"):
            os.utime(f"{folder}/b{k}/{f}", (t, t))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streamed_pulses_equal_the_batch_join(spark, tmp_path):
    rng = random.Random(4)
    master = [(f"FEL{i}", 1_700_000_000 + 10 * rng.randint(0, 60), i) for i in range(300)]
    shots = [(1_700_000_000 + 10 * rng.randint(0, 60), float(i), None if i % 9 == 0 else i / 4, i) for i in range(250)]
    m, s = "name string, ts int, seq long", "ts int, tunnel double, hall double, seq long"
    batch = text.pulses(spark.createDataFrame(master, m), spark.createDataFrame(shots, s))
    want = sorted(((r.ts, r.name, r.seq, r.tunnel, r.hall) for r in batch.collect()), key=repr)
    rng.shuffle(master)
    rng.shuffle(shots)
    end = 1_700_010_000
    cut = lambda rows, last: [rows[k::4] for k in range(4)] + [[last]]
    joined = pulses.joined_pulses(_arrivals(spark, str(tmp_path / "m"), cut(master, ("end", end, -1)), m), _arrivals(spark, str(tmp_path / "s"), cut(shots, (end, 0.0, 0.0, -1)), s), "2000 seconds")
    q = _run(joined, "pulses_all")
    found = spark.table("pulses_all").collect()
    assert sorted(((r.ts, r.name, r.seq, r.tunnel, r.hall) for r in found), key=repr) == want and not any(r.late for r in found)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) > 50 and sizes[-1] == 1  # only the far stamp is left


def test_late_pulses_are_reported(spark, tmp_path):
    m, s = "name string, ts int, seq long", "ts int, tunnel double, hall double, seq long"
    t = 1_700_000_000
    master = [[("a", t, 1), ("b", t + 5, 2)], [("c", t + 1000, 3)], [("late", t, 4), ("d", t + 1001, 5)], [("end", t + 9000, 6)]]
    shots = [[(t, 1.0, 1.5, 1)], [(t + 1000, 2.0, 2.5, 2)], [(t + 1001, 3.0, 3.5, 3)], [(t + 9000, 0.0, 0.0, 4)]]
    _run(pulses.joined_pulses(_arrivals(spark, str(tmp_path / "m"), master, m), _arrivals(spark, str(tmp_path / "s"), shots, s), "10 seconds"), "pulses_late")
    got = {r.name: (r.tunnel, r.hall, r.late) for r in spark.table("pulses_late").collect()}
    assert got == {"a": (1.0, 1.5, False), "b": (None, None, False), "c": (2.0, 2.5, False), "d": (3.0, 3.5, False), "late": (None, None, True)}


def test_frames_meet_pulses_by_time(spark, tmp_path):
    at = lambda k: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=k)
    frames = [[(1, at(0)), (2, at(3))], [(3, at(500))], [(9, at(5000))]]
    shots = [[(2, at(9), 5.0)], [(1, at(1), 4.0)], [(8, at(5000), 0.0)]]
    f = _arrivals(spark, str(tmp_path / "f"), frames, "bunch int, time timestamp")
    p = _arrivals(spark, str(tmp_path / "p"), shots, "ts int, at timestamp, hall double")
    _run(pulses.frames_with_pulses(f, p, "2 seconds", "1 minute"), "near")
    assert {r.bunch: r.hall for r in spark.table("near").collect()} == {1: 4.0, 2: None, 3: None}


def test_windows_drop_late_rows_and_forget(spark, tmp_path):
    """Rows behind the watermark change no window; windows leave the state when it has passed them."""
    at = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    batches = [[(at(1), "a", 1.0), (at(2), "a", 2.0), (at(6), "b", 4.0)], [(at(30), "a", 8.0)], [(at(32), "c", 5.0)], [(at(3), "a", 100.0), (at(26), "a", 16.0)], [(at(300), "z", 0.0)]]
    stream = _arrivals(spark, str(tmp_path / "events"), batches, "ts timestamp, event_type string, value double")
    q = _run(frames.windowed_counts(stream, late="10 minutes", width="5 minutes"), "windows")
    got = {((r.window.start - at(0)).total_seconds() / 60, r.event_type): (r.n, r.total) for r in spark.table("windows").collect()}
    assert got == {(0, "a"): (2, 3.0), (5, "b"): (1, 4.0), (25, "a"): (1, 16.0), (30, "a"): (1, 8.0), (30, "c"): (1, 5.0)}
    states = [o for p in q.recentProgress for o in p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in states) == 1 and states[-1]["numRowsTotal"] == 1


def _replay(batches, increment, began):
    """The watch of one run as plain Python."""
    present, newest, at, out = {}, {}, increment - 1, []
    for rows in batches:
        for name, created in rows:
            if any(c.iteration(name) is not None for c in watcher.CATEGORIES):
                present[name] = created
        while True:
            lead = f"real_space-{at:07d}.h5"
            if lead not in present or present[lead] < began or ("Real Space" in newest and present[lead] < newest["Real Space"][1]):
                break
            for c in watcher.CATEGORIES:
                name = f"{c.identifier}-{at:07d}.h5"
                if name in present and present[name] >= began and (c.name not in newest or present[name] >= newest[c.name][1]):
                    out.append(("new", c.name, name, newest[c.name][0] if c.name in newest else None, at))
                    if c.name not in newest:
                        out.append(("initial", c.name, name, None, at))
                    newest[c.name] = (name, present[name])
            at += increment
    return out


def test_watch_of_shuffled_arrivals(spark, tmp_path):
    rng = random.Random(7)
    base, began = datetime.datetime(2024, 5, 1), datetime.datetime(2024, 5, 1, 0, 1)
    batches, by_run = [[] for _ in range(6)], {}
    for run in ("a", "b", "c"):
        files = []
        for k in range(1, 13):
            for ident in ("real_space", "fourier_space", "support"):
                if ident == "support" and k % 3 == 0:
                    continue
                files.append((f"{ident}-{k * 10 - 1:07d}.h5", base + datetime.timedelta(minutes=k, seconds=rng.randint(0, 9))))
        files += [("notes.txt", base), ("real_space-0000003.h5", base)]
        if run == "c":  # the first file is of a run before the watch: nothing is ever announced
            files = [(n, base if n == "real_space-0000009.h5" else t) for n, t in files]
        by_run[run] = [[] for _ in batches]
        for n, t in files:
            k = min(5, max(0, int((t - base).total_seconds() // 150) + rng.randint(-1, 1)))
            batches[k].append((run, f"/data/{run}/{n}", t))
            by_run[run][k].append((n, t))
    batches.append([(run, f"/data/{run}/support-9999999.h5", base + datetime.timedelta(hours=2)) for run in by_run])
    stream = _arrivals(spark, str(tmp_path / "files"), batches, "run string, path string, created timestamp")
    q = _run(watcher.watch(stream, 10, "2024-05-01 00:01:00", late="10 minutes", keep="2 minutes"), "watched")
    got = {}
    for r in spark.table("watched").collect():
        got.setdefault(r.run, []).append((r.kind, r.category, r.path, r.previous, r.iteration))
    for run, arrivals in by_run.items():
        want = _replay(arrivals, 10, began)
        assert sorted(got.get(run, []), key=repr) == sorted(want, key=repr)
    assert len(got["a"]) > 20 and "c" not in got
    sizes = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert sizes[-1] < max(sizes) / 2  # what is behind was forgotten
