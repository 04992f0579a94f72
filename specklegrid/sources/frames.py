"""Detector frames as a data source that splits files, and sinks that commit.

`frames` reads files of many frames (`.sss`: width, height, count as int32, then an int32 bunch id and 8-bit pixels for
each frame) and of one (`.raw`: width, height, int32 pixels, and a trailer of eleven int32 of which the tenth is the time
stamp). The planner reads each file's header once and deals ranges of frames to partitions, so a file of any size
is read by many tasks, each by seeking to its range. Filters on frame, bunch and path are pushed: ranges beyond the frames or
paths asked for are never planned, and of frames of other bunches only the id is read. The writer of `frames` packs
images into such files; `files` writes the bytes of each row as a file of its own.

Both writers stage what tasks write in a folder beside the files and move it into place when the whole job has
ended well; a job that fails, or would replace a file that it isn't asked to, leaves nothing. Paths are anything that
Arrow's file systems open (a local or shared folder, hdfs, s3, gs, abfs).

Cases: a folder without such files gives no rows; frames that the header counts but the file doesn't hold are left
out when `truncated` is `drop`, and an error else; an empty job writes no file; names are relative and occur once.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FRAMES = "path string, frame int, bunch int, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>"
SPLIT_BYTES, READ_BYTES, FILE_BYTES = 64 << 20, 1 << 20, 64 << 20
HEAD, SINGLE_HEAD, TRAILER, STAMP = 12, 8, 11 * 4, 9
THREADS = 32


def store(path: str):
    """The Arrow file system of a path, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def listed(path: str) -> list:
    """Information on the files of a folder (staged ones aside), or on the one file of a path."""
    from pyarrow import fs

    where, at = store(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    return sorted((f for f in where.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """Frames first to end - 1 of a file; of a file of one frame, 0 to 0."""

    path: str
    kind: str
    nx: int
    ny: int
    first: int
    end: int


def ranges(path: str, split: int, drop_truncated: bool, wanted=lambda name: True, least: int = 0, most: int | None = None) -> list[Range]:
    """The plan: ranges of about `split` bytes, from headers read once a file."""
    where, _ = store(path)
    files = [f for f in listed(path) if f.extension in ("sss", "raw") and wanted(f.path)]

    def header(f):
        with where.open_input_file(f.path) as s:
            return struct.unpack("<iii", s.read(HEAD)) if f.size >= HEAD else (0, 0, 0)

    with ThreadPoolExecutor(THREADS) as pool:
        heads = list(pool.map(header, files))
    out = []
    for f, (w, h, n) in zip(files, heads, strict=True):
        if f.size < HEAD or w <= 0 or h <= 0:
            raise ValueError(f"{f.path} has no header of frames")
        if f.extension == "raw":
            n, held = 1, int(f.size >= SINGLE_HEAD + 4 * w * h + TRAILER)
        else:
            held = (f.size - HEAD) // (4 + w * h)
        if held < n and not drop_truncated:
            raise ValueError(f"{f.path} holds {held} frames of {n}")
        step, end = max(1, split // (4 + w * h)), min(n, held, n if most is None else most + 1)
        out += [Range(f.path, f.extension, w, h, k, min(k + step, end)) for k in range(max(least, 0), end, step)]
    return out


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.drop = options.get("truncated", "error") == "drop"
        self.least, self.most, self.bunches, self.paths = 0, None, None, None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on frame, equality of path and bunch are ours; the rest is Spark's."""
        one = lambda f: (f.attribute, [f.value] if isinstance(f, EqualTo) else list(f.value))
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else ()
            if name == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if name == ("frame",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound = f.value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            elif name in (("bunch",), ("path",)) and isinstance(f, (EqualTo, In)):
                values = set(one(f)[1])
                key = "bunches" if name == ("bunch",) else "paths"
                setattr(self, key, values if getattr(self, key) is None else getattr(self, key) & values)
            elif not (name == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual))):
                yield f

    def partitions(self):
        found = ranges(self.path, self.split, self.drop, lambda name: self.paths is None or name in self.paths, self.least, self.most)
        return found or [Range("", "", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == part.first:
            return
        where, _ = store(self.path)
        size = part.nx * part.ny
        with where.open_input_file(part.path) as s:
            if part.kind == "raw":
                data = s.read_at(4 * size + TRAILER, SINGLE_HEAD)
                bunch = np.frombuffer(data, "<i4", 11, 4 * size)[STAMP : STAMP + 1]
                yield from self._batch(part, np.zeros(1, np.int32), bunch, np.frombuffer(data, "<i4", size)[None].astype(float))
                return
            step = max(1, READ_BYTES // (4 + size))
            if self.bunches is not None:  # the ids alone, then the frames that are wanted
                for k in range(part.first, part.end):
                    at = HEAD + k * (4 + size)
                    bunch = np.frombuffer(s.read_at(4, at), "<i4")
                    if int(bunch[0]) in self.bunches:
                        yield from self._batch(part, np.array([k], np.int32), bunch, np.frombuffer(s.read_at(size, at + 4), np.uint8)[None].astype(float))
                return
            for k in range(part.first, part.end, step):
                n = min(step, part.end - k)
                raw = np.frombuffer(s.read_at(n * (4 + size), HEAD + k * (4 + size)), np.uint8).reshape(n, 4 + size)
                yield from self._batch(part, np.arange(k, k + n, dtype=np.int32), np.ascontiguousarray(raw[:, :4]).view("<i4")[:, 0], raw[:, 4:].astype(float))

    def _batch(self, part: Range, frame: np.ndarray, bunch: np.ndarray, v: np.ndarray):
        if self.bunches is not None and not set(bunch.tolist()) & self.bunches:
            return
        n, size = v.shape
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * size)
        whole = lambda x: pa.array(np.full(n, x, np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (v.ravel(), np.zeros(n * size), np.ones(n * size, np.int32))]
        yield pa.record_batch([pa.array([part.path] * n), pa.array(frame), pa.array(bunch.astype(np.int32)), whole(part.nx), whole(part.ny), whole(1), *lists], [c.split()[0] for c in FRAMES.split(", ")])


def _digest(name: str) -> bytes:
    return hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: its folder in the staging folder, how many files, and 16 bytes of a digest of each name."""

    folder: str
    count: int = 0
    names: bytes = b""


class Staging(DataSourceArrowWriter):
    """Tasks put files into folders of their own in a folder of the job; commit moves them to their names, abort deletes the folder. The driver sees 16 bytes a file, and lists one task's files at a time."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job, self.options = options["path"], overwrite, uuid.uuid4().hex, dict(options)
        self.made: set[str] = set()

    @property
    def folder(self) -> str:
        return posixpath.join(store(self.path)[1], f"_staged-{self.job}")

    def put(self, done: Staged, name: str, parts: list) -> None:
        if name.startswith("/") or ".." in name.split("/") or not name or name.startswith("_"):
            raise ValueError(f"{name!r} is no name of a file in the folder")
        where, _ = store(self.path)
        staged = f"{self.folder}/{done.folder}/{name}"
        if posixpath.dirname(staged) not in self.made:
            where.create_dir(posixpath.dirname(staged), recursive=True)
            self.made.add(posixpath.dirname(staged))
        with where.open_output_stream(staged) as out:
            for p in parts:
                out.write(p)
        done.names += _digest(name)
        done.count += 1

    def _staged(self, messages) -> Iterator[list[tuple[str, str]]]:
        """(staged path, name) of the files, those of one task at a time."""
        from pyarrow import fs

        where, _ = store(self.path)
        for m in messages:
            if m and m.count:
                top = f"{self.folder}/{m.folder}/"
                yield [(f.path, f.path[len(top) :]) for f in where.get_file_info(fs.FileSelector(top[:-1], recursive=True)) if f.type == fs.FileType.File]

    def commit(self, messages) -> None:
        from pyarrow import fs

        where, top = store(self.path)
        digests = np.frombuffer(b"".join(m.names for m in messages if m), "<u8").reshape(-1, 2)
        digests = digests[np.lexsort(digests.T)]
        again = digests[1:][(digests[1:] == digests[:-1]).all(1)]
        if len(again):
            raise ValueError("a name occurs twice: " + next(n for files in self._staged(messages) for _, n in files if _digest(n) == again[0].tobytes()))
        if self.overwrite:
            old = [f.path for f in where.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.type == fs.FileType.File]
            list(map(where.delete_file, old))
        else:
            for files in self._staged(messages):
                there = [i.path for i in where.get_file_info([f"{top}/{n}" for _, n in files]) if i.type != fs.FileType.NotFound]
                if there:
                    raise FileExistsError(f"{there[0]} is there already")
        where.create_dir(top, recursive=True)
        with ThreadPoolExecutor(THREADS) as pool:
            for files in self._staged(messages):
                for folder in {posixpath.dirname(n) for _, n in files if "/" in n}:
                    where.create_dir(f"{top}/{folder}", recursive=True)
                list(pool.map(lambda f: where.move(f[0], f"{top}/{f[1]}"), files))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        where, _ = store(self.path)
        if where.get_file_info(self.folder).type != fs.FileType.NotFound:
            where.delete_dir(self.folder)


class FileWriter(Staging):
    """name, content: the bytes of each row as a file."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        done = Staged(uuid.uuid4().hex)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                self.put(done, name, [content.as_buffer()] if content.is_valid else [])
        return done


class FrameWriter(Staging):
    """bunch, nx, ny, re: 8-bit frames (values are cut to 0 to 255, fractions dropped) in files of about `filebytes`, one size of frames each."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        done, most = Staged(uuid.uuid4().hex), int(self.options.get("filebytes", FILE_BYTES))
        task, shape, parts, size, count = TaskContext.get().partitionId(), None, [], 0, 0

        def close():
            nonlocal parts, size, count
            if parts:
                self.put(done, f"frames-{task:05d}-{done.count:05d}-{self.job}.sss", [struct.pack("<iii", *shape, len(parts)), *parts])
            parts, size = [], 0

        for batch in iterator:
            for bunch, nx, ny, re_ in zip(*(batch.column(c).to_pylist() for c in ("bunch", "nx", "ny")), batch.column("re"), strict=True):
                if (nx, ny) != shape or size >= most:
                    close()
                    shape = (nx, ny)
                v = np.clip(re_.values.to_numpy(zero_copy_only=False), 0, 255).astype(np.uint8)
                if len(v) != nx * ny:
                    raise ValueError(f"bunch {bunch} has {len(v)} pixels of {nx} x {ny}")
                parts.append(struct.pack("<i", bunch) + v.tobytes())
                size += 4 + nx * ny
        close()
        return done


class Frames(DataSource):
    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return FrameReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        return FrameWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


class Files(DataSource):
    @classmethod
    def name(cls):
        return "files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return FileWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark) -> None:
    """Makes the formats `frames` and `files` known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Frames)
    spark.dataSource.register(Files)


def read_frames(spark, path: str, split_bytes: int = SPLIT_BYTES, drop_truncated: bool = False) -> DataFrame:
    """A packed row a frame of the files of a folder (or of one file), with path, frame and bunch."""
    register(spark)
    return spark.read.format("frames").option("splitBytes", split_bytes).option("truncated", "drop" if drop_truncated else "error").load(path)


def write_frames(images: DataFrame, path: str, file_bytes: int = FILE_BYTES, mode: str = "append") -> None:
    """images(bunch, nx, ny, re) as files of frames; a file a task, or more beyond file_bytes."""
    register(images.sparkSession)
    images.select(F.col("bunch").cast("int").alias("bunch"), "nx", "ny", "re").write.format("frames").option("fileBytes", file_bytes).mode(mode).save(path)


def write_files(blobs: DataFrame, path: str, mode: str = "append") -> None:
    """The content of each row of blobs(name, content) as a file of that name in the folder; append never replaces a file, overwrite replaces all of the folder's."""
    register(blobs.sparkSession)
    blobs.select("name", F.col("content").cast("binary").alias("content")).write.format("files").mode(mode).save(path)


def read_files(spark, path: str) -> DataFrame:
    """name, content of the files of a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")


def in_folders(name: Column, count: int = 64) -> Column:
    """Names of files, dealt into folders 0 to count - 1 by a hash: for read_folders()."""
    return F.concat(F.pmod(F.xxhash64(name), F.lit(count)).cast("string"), F.lit("/"), name)


def read_folders(spark, path: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """path, content of the files in the folders of a folder. The driver lists the folders; a task lists and reads the files of one, so files may be many."""
    from pyarrow import fs

    where, at = store(path)
    folders = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))]

    def run(batches):
        source, _ = store(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                out, size = [], 0
                for f in source.get_file_info(fs.FileSelector(folder)):
                    if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")):
                        continue
                    with source.open_input_stream(f.path) as s:
                        out.append((f.path, s.read()))
                    size += f.size
                    if size >= batch_bytes or len(out) >= 1024:
                        yield _files(out)
                        out, size = [], 0
                yield _files(out)

    def _files(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, len(folders))).mapInArrow(run, "path string, content binary")


def with_shot_energy(frames: DataFrame, shots: DataFrame, base: str = "image") -> DataFrame:
    """Frames with the energies of the shot of their bunch: shots(ts, tunnel, hall), the first in the order of seq where a stamp occurs again. name: base-bunch-energy, with xxxx where there is no shot."""
    first = shots.where("ts is not null").groupBy("ts").agg(F.min_by(F.struct("tunnel", "hall"), "seq").alias("s"))
    joined = frames.join(first, F.col("bunch") == F.col("ts"), "left")
    energy = F.when(F.col("s.hall").isNull(), F.lit("xxxx")).otherwise(F.format_string("%f", "s.hall"))
    name = F.concat_ws("-", F.lit(base), F.col("bunch").cast("string"), energy)
    return joined.select(*frames.columns, F.col("s.tunnel").alias("tunnel"), F.col("s.hall").alias("hall"), name.alias("name"))


def scratch(spark, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, a session of one machine (tests) gets a folder of its own; a cluster must set it."""
    import tempfile

    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- iterations that are appended


def _store_of(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_iteration(table: DataFrame, path: str, iteration: int) -> None:
    """Adds an iteration to the table at path. One that is there is never replaced; one that a lost job left half-written is."""
    spark, out = table.sparkSession, f"{path.rstrip('/')}/iteration={iteration:09d}"
    fs, p = _store_of(spark, out)
    if fs.exists(p):
        if _whole(spark, out):
            raise FileExistsError(f"{out} is there already")
        fs.delete(p, True)
    table.drop("iteration").write.mode("error").parquet(out)


def _whole(spark, folder: str) -> bool:
    fs, p = _store_of(spark, folder + "/_SUCCESS")
    return fs.exists(p)


def iterations(spark, path: str) -> list[int]:
    """The iterations that were written whole, in order."""
    fs, p = _store_of(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [n for n in names if re.fullmatch(r"iteration=\d+", n) and _whole(spark, f"{path.rstrip('/')}/{n}")]
    return sorted(int(n.split("=")[1]) for n in found)


def read_iterations(spark, path: str, *which: int) -> DataFrame:
    """The rows of these iterations (of all, where none is given), with `iteration`."""
    top = path.rstrip("/")
    folders = [f"{top}/iteration={i:09d}" for i in (which or iterations(spark, path))]
    return spark.read.option("basePath", top).parquet(*folders).withColumn("iteration", F.col("iteration").cast("int"))
