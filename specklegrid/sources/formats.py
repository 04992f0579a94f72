"""Image and table formats: TIFF, GIF and PNG in, colour PNG, VTK, reflection lists, plots and run logs out.

Readers take whole files (`binaryFile`), decode each in its task and give packed rows; writers make one text or blob for
each image, so nothing gathers but the pixels of one image. Files can lie in any store that Spark reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pixel import with_detector
from .binary import png_pixels
from .text import LOG_COLUMNS

DECODED = "path string, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>"

# ---- TIFF: baseline grey or colour images in strips

#: Bytes of TIFF's field types 1 to 12.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}


def tiff_directories(data: bytes) -> list[dict[int, list]]:
    """Fields of each directory: tag to values; a text is one value."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,), out = struct.unpack_from(order + "I", data, 4), []
    while at and len(out) < 10_000:
        (n,), fields = struct.unpack_from(order + "H", data, at), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = _SIZES.get(kind, 1) * count
            place = at + 2 + 12 * k + 8
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if kind == 2:
                fields[tag] = [data[place : place + count].split(b"\0")[0].decode("latin-1")]
            elif kind in (5, 10):
                pair = struct.unpack_from(order + ("I" if kind == 5 else "i") * 2 * count, data, place)
                fields[tag] = [a / b if b else 0.0 for a, b in zip(pair[::2], pair[1::2], strict=True)]
            elif kind in _CODES:
                fields[tag] = list(struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place))
        out.append(fields | {-1: [order]})
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return out


def _unpacked(data: bytes) -> bytes:
    """PackBits."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n if n > 128 else 0)
            i += 2
    return bytes(out)


def tiff_pixels(data: bytes) -> np.ndarray:
    """The first image, (ny, nx); colours are averaged."""
    f = tiff_directories(data)[0]
    get = lambda tag, other: f.get(tag, [other])[0]
    nx, ny, bits, samples, how = get(256, 0), get(257, 0), get(258, 1), get(277, 1), get(259, 1)
    if how not in (1, 8, 32773, 32946) or get(284, 1) != 1:
        raise ValueError("this kind of TIFF isn't read")
    unpack = {1: lambda b: b, 32773: _unpacked}.get(how, zlib.decompress)
    raw = b"".join(unpack(data[a : a + n]) for a, n in zip(f[273], f[279], strict=True))
    if bits == 1:
        v = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(ny, -1), axis=1)[:, :nx].astype(float)[..., None]
    else:
        kind = {1: "u", 2: "i", 3: "f"}[get(339, 1)]
        v = np.frombuffer(raw, f"{f[-1][0]}{kind}{bits // 8}", nx * ny * samples).reshape(ny, nx, samples).astype(float)
    v = v[..., :3].mean(-1) if samples >= 3 else v[..., 0]
    return v.max() - v if get(262, 1) == 0 and bits == 1 else v


def tiff_bytes(v: np.ndarray) -> bytes:
    """A grey image as 32-bit floats in one strip."""
    ny, nx = v.shape
    raw = np.ascontiguousarray(v, "<f4").tobytes()
    fields = [(256, 4, nx), (257, 4, ny), (258, 3, 32), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, ny), (279, 4, len(raw)), (339, 3, 3)]
    body = b"".join(struct.pack("<HHII", tag, kind, 1, x) for tag, kind, x in fields)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + struct.pack("<H", len(fields)) + body + struct.pack("<I", 0)


# ---- GIF


def _lzw(data: bytes, least: int) -> bytes:
    """GIF's codes of growing width."""
    clear, out = 1 << least, bytearray()
    table: list[bytes] = []
    width, last, held, bits = least + 1, b"", 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == clear + 1:
                return bytes(out)
            word = table[code] if code < len(table) else last + last[:1]
            out += word
            if last and len(table) < 4096:
                table.append(last + word[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            last = word
    return bytes(out)


def gif_pixels(data: bytes) -> np.ndarray:
    """The first frame, colours averaged."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    flags, at, colours = data[10], 13, None
    if flags & 128:
        n = 3 * (2 << (flags & 7))
        colours, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    while data[at] == 0x21:
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    if data[at] != 0x2C:
        raise ValueError("a GIF without a frame")
    nx, ny, flags = struct.unpack_from("<HHB", data, at + 5)
    at += 10
    if flags & 128:
        n = 3 * (2 << (flags & 7))
        colours, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    least, at, parts = data[at], at + 1, []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    index = np.frombuffer(_lzw(b"".join(parts), least), np.uint8, nx * ny).reshape(ny, nx)
    if flags & 64:  # interlaced: every eighth row, then the rows between, in three more passes
        rows = np.concatenate([np.arange(a, ny, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
        index = index[np.argsort(rows)]
    return colours.mean(1)[index]


# ---- readers


def read_images(spark, path: str) -> DataFrame:
    """Packed rows of TIFF, GIF, PNG and npy files, told apart by their first bytes. The driver lists the files; decoded(frames.read_folders()) is for very many."""
    return decoded(spark.read.format("binaryFile").load(path))


def decoded(files: DataFrame) -> DataFrame:
    """Packed rows of files(path, content), as read_images() has them."""
    import io

    kinds: list[tuple[bytes, Callable[[bytes], np.ndarray]]] = [(b"II*\0", tiff_pixels), (b"MM\0*", tiff_pixels), (b"GIF8", gif_pixels), (b"\x89PNG", png_pixels), (b"\x93NUMPY", lambda b: np.load(io.BytesIO(b), allow_pickle=False))]

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                read = next((f for head, f in kinds if r.content.startswith(head)), None)
                if read is None:
                    raise ValueError(f"no image: {r.path}")
                v = read(r.content)
                nz, ny, nx = (1,) * (3 - v.ndim) + v.shape
                out.append((r.path, nx, ny, nz, v.real.astype(float).ravel(), np.imag(v).astype(float).ravel(), np.ones(v.size, np.int32)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DECODED.split(", ")])

    return files.select("path", "content").mapInPandas(run, DECODED)


def read_detector_images(spark, path: str, center: tuple[float, float], distance_mm: float, pixel_um: float, wavelength_nm: float) -> DataFrame:
    """read_images() with a detector in metres."""
    pixel = pixel_um * 1e-6
    return with_detector(read_images(spark, path), (*center, 0.0), (pixel, pixel, pixel), distance_mm * 1e-3, wavelength_nm * 1e-9)


def png_texts(data: bytes) -> dict[str, str]:
    at, out = 8, {}
    while at + 8 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if kind == b"tEXt":
            key, _, text = data[at + 8 : at + 8 + n].partition(b"\0")
            out[key.decode("latin-1")] = text.decode("latin-1")
        at += 12 + n
    return out


def metadata(files: DataFrame) -> DataFrame:
    """path, part, key, value of files(path, content): TIFF directories' fields, PNG texts; other files give no rows."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.content[:4] in (b"II*\0", b"MM\0*"):
                    for k, fields in enumerate(tiff_directories(r.content)):
                        out += [(r.path, k, str(tag), " ".join(map(str, v[:16]))) for tag, v in fields.items() if tag >= 0]
                elif r.content.startswith(b"\x89PNG"):
                    out += [(r.path, 0, k, v) for k, v in png_texts(r.content).items()]
            yield pd.DataFrame(out, columns=["path", "part", "key", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, part int, key string, value string")


def file_list(spark, path: str) -> DataFrame:
    """One path a line, in the order of the file; empty lines go."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("list"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "path"))
    return t.where(F.trim("path") != "").select("list", "n", F.trim("path").alias("path"))


def with_comments(images: DataFrame, spark, path: str, key: str = "Master_comment") -> DataFrame:
    """images(path) with the first line that holds `key`, from the text of the same name (its last four characters replaced by .txt) under `path`."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("sidecar"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    first = t.where(F.contains("line", F.lit(key))).groupBy("sidecar").agg(F.min_by("line", "n").alias("comment"))
    name = F.element_at(F.split("path", "/"), -1)
    return images.withColumn("sidecar", F.concat(F.substring(name, F.lit(1), F.length(name) - 4), F.lit(".txt"))).join(first, "sidecar", "left").drop("sidecar")


def control_points(spark, path: str) -> DataFrame:
    """file, id, n, x, y of control-point files: `Identifier:` begins an image, and each of its points is a line `x:` and a line `y:`. A file is one small text."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    kv = t.select("file", "line", F.trim(F.regexp_extract("text", r"^\s*([A-Za-z ]+):", 1)).alias("k"), F.trim(F.regexp_extract("text", r":\s*(.*)$", 1)).alias("v"))
    w = Window.partitionBy("file").orderBy("line")
    kv = kv.withColumn("image", F.count(F.when(F.col("k") == "Identifier", 1)).over(w))
    kv = kv.withColumn("n", F.count(F.when(F.col("k") == "x", 1)).over(Window.partitionBy("file", "image").orderBy("line")))
    ids = kv.where("k = 'Identifier'").select("file", "image", F.col("v").alias("id"))
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).try_cast("double").alias(k)
    points = kv.where("k in ('x', 'y') and n > 0").groupBy("file", "image", "n").agg(value("x"), value("y"))
    return points.join(ids, ["file", "image"]).select("file", "id", F.col("n").cast("int").alias("n"), "x", "y")


# ---- writers

#: Corners of colour ramps, red, green and blue from 0 to 1 at equal steps.
RAMPS = {
    "gray": [(0, 0, 0), (1, 1, 1)],
    "jet": [(0, 0, 0.5), (0, 0, 1), (0, 1, 1), (1, 1, 0), (1, 0, 0), (0.5, 0, 0)],
}


def coloured(v: np.ndarray, ramp: str = "gray", log: bool = False) -> np.ndarray:
    """Moduli of a complex image on a ramp from 0 to its largest, or (wheel) phases as hues with moduli as brightness; (ny, nx, 3) bytes. log: of modulus + 1."""
    a = np.abs(v)
    a = np.log1p(a) if log else a
    a = a / max(a.max(), 1e-300)
    if ramp in ("wheel", "phase"):
        h = (np.angle(v) / (2 * np.pi)) % 1.0
        rgb = np.stack([np.clip(np.abs((h * 6 + s) % 6 - 3) - 1, 0, 1) for s in (0, 4, 2)], -1) * (a[..., None] if ramp == "wheel" else 1)
    else:
        if ramp not in RAMPS:
            raise ValueError(f"no such colours: {ramp}; there are {', '.join(RAMPS)}, wheel, phase")
        corners = np.array(RAMPS[ramp], float)
        rgb = np.stack([np.interp(a, np.linspace(0, 1, len(corners)), corners[:, k]) for k in range(3)], -1)
    whole = np.floor(rgb * 255)
    return (whole + (rgb * 255 - whole >= 0.5)).astype(np.uint8)  # halves go up, as in SQL


def colour_png(rgb: np.ndarray, texts: dict[str, str] | None = None) -> bytes:
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    notes = b"".join(part(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (texts or {}).items())
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + notes + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def vtk_text(v: np.ndarray, name: str = "amplitudes") -> str:
    """Legacy structured points; x runs fastest."""
    nz, ny, nx = (1,) * (3 - v.ndim) + v.shape
    head = f"# vtk DataFile Version 2.0\n{name}\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {v.size}\nSCALARS {name} float 1\nLOOKUP_TABLE default\n"
    return head + "\n".join(f"{x:.6g}" for x in v.ravel()) + "\n"


def encoded(packed: DataFrame, kind: str = "png", ramp: str = "gray", log: bool = False, shifted: bool = False) -> DataFrame:
    """image_id, name and content (bytes) of each image as png, tiff or vtk (vtk also: phases and mask, as rows of their own). shifted: zero frequency goes to the middle first."""
    if kind not in ("png", "tiff", "vtk"):
        raise ValueError("png, tiff or vtk")

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                shape = (r.ny, r.nx) if r.nz == 1 else (r.nz, r.ny, r.nx)
                v, m = (np.asarray(r.re) + 1j * np.asarray(r.im)).reshape(shape), np.asarray(r.mask).reshape(shape)
                v, m = (np.fft.fftshift(v), np.fft.fftshift(m)) if shifted else (v, m)
                if kind == "png":
                    out.append((r.image_id, f"{r.image_id}.png", colour_png(coloured(v if v.ndim == 2 else v[len(v) // 2], ramp, log))))
                elif kind == "tiff":
                    out.append((r.image_id, f"{r.image_id}.tif", tiff_bytes(np.abs(v if v.ndim == 2 else v[len(v) // 2]))))
                else:
                    out += [(r.image_id, f"{r.image_id}{end}.vtk", vtk_text(x, name).encode()) for end, name, x in (("", "amplitudes", np.abs(v)), ("-phases", "phases", np.angle(v)), ("-mask", "mask", m))]
            yield pd.DataFrame(out, columns=["image_id", "name", "content"])

    return packed.select("image_id", "nx", "ny", "nz", "re", "im", "mask").mapInPandas(run, "image_id long, name string, content binary")


#: The lines around a cell in the header of a reflection list, a shell script for f2mtz.
_LIST_HEAD = ("#!/bin/sh", "# Reflections as text, which f2mtz reads when this file is run.", "f2mtz HKLIN $0 HKLOUT $0.mtz << +", "SKIP 20", "TITLE Image to MTZ")
_LIST_PLAIN = ("LABOUT H K L I", "CTYPE  H H H J", "FORMAT '(3F5.0,1X,F10.3)'", "SYMM P1", "+", "exit")
_LIST_FULL = ("LABOUT H K L IMEAN SIGIMEAN FC PHIC", "CTYPE  H H H J Q F P", "FORMAT '(3F5.0,1X,F10.3,1X,F10.3,1X,F10.3,1X,F10.3)'", "SYMM P1", "+", "exit")


def exponent(c: Column) -> Column:
    """A number as %10.3e writes it, rounded by its binary value."""

    @F.arrow_udf("string")
    def shown(v: pa.Array) -> pa.Array:
        return pa.array(np.char.mod("%10.3e", v.to_numpy(zero_copy_only=False).astype(float)), pa.string(), mask=np.asarray(v.is_null()))

    return shown(c)


def reflection_list(px: DataFrame, cell: tuple[float, float, float, float, float, float], sigma: float | None = None, tolerance: float = 0.01) -> DataFrame:
    """image_id, n, value: the lines of each image's list, header first; px(image_id, x, y, z, h, k, l, re, and with sigma fc and phic). Lengths of the cell are in metres. Only whole h, k, l within a tolerance, by z, y, x."""
    near = [F.abs(F.col(c) - F.col(c).cast("int")) < tolerance for c in "hkl"]
    numbers = [F.lpad(F.round(c).cast("int").cast("string"), 5, " ") for c in ((-F.col("h") if sigma is not None else F.col("h")), F.col("k"), F.col("l"))]
    values = [F.col("re")] + ([F.lit(float(sigma)), F.col("fc"), F.col("phic") * 180 / F.lit(np.pi)] if sigma is not None else [])
    line = F.concat_ws(" ", F.concat(*numbers), *[exponent(v) for v in values])
    head = [*_LIST_HEAD, "CELL " + " ".join(f"{x * (1e10 if i < 3 else 1):f}" for i, x in enumerate(cell)), *(_LIST_PLAIN if sigma is None else _LIST_FULL)]
    first = px.select("image_id").distinct().select("image_id", F.posexplode(F.array(*map(F.lit, head))).alias("n", "value"))
    order = Window.partitionBy("image_id").orderBy("z", "y", "x")
    body = px.where(near[0] & near[1] & near[2]).select("image_id", (F.row_number().over(order) + len(head) - 1).alias("n"), line.alias("value"))
    return first.unionByName(body)


def speden(px: DataFrame) -> DataFrame:
    """Columns of a list of observations: amp and sig, the root of the amplitude, by image and pixel, and n of each image."""
    a = F.hypot("re", "im")
    return px.select("image_id", "x", "y", "z", a.alias("amp"), F.sqrt(F.abs(a)).alias("sig"), F.count("*").over(Window.partitionBy("image_id")).alias("n"))


def plot_lines(shells: DataFrame, x: str, y: str, n: str | None = None) -> DataFrame:
    """image_id, x and the line `x y [n]` of a plot's text, tab-separated."""
    parts = [F.col(x).cast("string"), F.format_string("%.6f", F.col(y).cast("double"))] + ([F.col(n).cast("string")] if n else [])
    return shells.select("image_id", x, F.concat_ws("\t", *parts).alias("value"))


def log_lines(metrics: DataFrame, started: str = "") -> DataFrame:
    """run_id, n, value: a header block and a tab-separated line of the log's columns for each row of metrics(run_id, it_out, ...); columns that are missing are 0."""
    have = set(metrics.columns)
    head = ["# Created by specklegrid" + (f" on {started}" if started else ""), *[f'@ s{i} legend "{c}"' for i, c in enumerate(LOG_COLUMNS)]]
    first = metrics.select("run_id").distinct().select("run_id", F.posexplode(F.array(*map(F.lit, head))).alias("n", "value"))
    order = Window.partitionBy("run_id").orderBy("it_out")
    whole = {"it_in", "it_out", "algorithm"}
    show = lambda c: F.coalesce(F.col(c).cast("long").cast("string") if c in whole else F.format_string("%.6g", F.col(c).cast("double")), F.lit("0")) if c in have else F.lit("0")
    body = metrics.select("run_id", (F.row_number().over(order) + len(head) - 1).alias("n"), F.concat_ws("\t", *[show(c) for c in LOG_COLUMNS]).alias("value"))
    return first.unionByName(body)
