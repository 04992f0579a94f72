"""Binary frames and images: raw frame files, npy, PNG in and out, reflection lines; other formats are in formats."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PACKED


def read_frames(spark, path: str) -> DataFrame:
    """Files of width, height, count (int32) and then bunch id (int32) and 8-bit pixels for each frame: a packed row a frame, with file and bunch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                w, h, n = struct.unpack_from("<iii", r.content)
                at = 12
                for k in range(n):
                    (bunch,) = struct.unpack_from("<i", r.content, at)
                    v = np.frombuffer(r.content, np.uint8, w * h, at + 4).astype(float)
                    at += 4 + w * h
                    yield pd.DataFrame([(r.path, k, bunch, w, h, 1, v, np.zeros_like(v), np.ones(len(v), np.int32))], columns=["path", "frame", "bunch", "nx", "ny", "nz", "re", "im", "mask"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame int, bunch int, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>")


def read_npy(spark, path: str) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                a = np.load(io.BytesIO(r.content), allow_pickle=False)
                nz, ny, nx = (1,) * (3 - a.ndim) + a.shape
                yield pd.DataFrame([(r.path, nx, ny, nz, a.real.astype(float).ravel(), a.imag.astype(float).ravel(), np.ones(a.size, np.int32))], columns=["path", "nx", "ny", "nz", "re", "im", "mask"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, nx int, ny int, nz int, re array<double>, im array<double>, mask array<int>")


def split_panels(px: DataFrame, width: int = 1024, height: int = 512) -> DataFrame:
    """Frames laid side by side, each of an upper and a lower panel: frame, panel and re-based coordinates. Pixels outside such a shape raise an error when they are met."""
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("y") < 2 * height)
    px = px.withColumn("y", F.when(inside, F.col("y")).otherwise(F.raise_error(F.lit("these are no frames of two panels"))))
    return px.withColumns({"frame": F.floor(F.col("x") / width).cast("int"), "panel": F.floor(F.col("y") / height).cast("int")}).withColumns({"x": F.col("x") % width, "y": F.col("y") % height})


def png_bytes(v: np.ndarray) -> bytes:
    """8-bit grey (2D) PNG."""
    h, w = v.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.clip(v, 0, 255).astype(np.uint8))
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """8- or 16-bit grey or colour PNG without interlacing, as an array (colours averaged)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, colour, _, _, laced = head
    if laced or depth not in (8, 16) or colour not in (0, 2, 4, 6):
        raise ValueError("this kind of PNG isn't read")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    size = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8, h * (w * size + 1)).reshape(h, w * size + 1)
    rows, last = [], np.zeros(w * size, np.int64)
    for kind, line in zip(raw[:, 0].tolist(), raw[:, 1:].astype(np.int64), strict=True):
        if kind == 1:  # each byte is a difference from the pixel before: running sums by channel
            line = (np.cumsum(line.reshape(w, size), axis=0) % 256).ravel()
        elif kind == 2:
            line = (line + last) % 256
        elif kind:
            line, above = line.reshape(w, size), last.reshape(w, size)
            left = corner = np.zeros(size, np.int64)
            for i in range(w):  # a pixel at a time, all its bytes together
                if kind == 3:
                    near = (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    gaps = np.abs(p - np.stack([left, above[i], corner]))
                    near = np.choose(gaps.argmin(0), [left, above[i], corner])
                left, corner = (line[i] + near) % 256, above[i]
                line[i] = left
            line = line.ravel()
        rows.append(line)
        last = line
    v = np.stack(rows)
    v = v.reshape(h, w, channels) if depth == 8 else v.reshape(h, w, channels, 2) @ np.array([256, 1])
    return v[..., : 1 if channels < 3 else 3].mean(-1)


def with_png(packed: DataFrame, log: bool = False) -> DataFrame:
    """image_id, png of the moduli, scaled to the image's largest; log: their logarithms."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.hypot(np.asarray(r.re), np.asarray(r.im)).reshape(r.ny, r.nx)
                a = np.log1p(a) if log else a
                out.append((r.image_id, png_bytes(a / max(a.max(), 1e-300) * 255)))
            yield pd.DataFrame(out, columns=["image_id", "png"])

    return packed.select("image_id", "nx", "ny", "re", "im").mapInPandas(run, "image_id long, png binary")


def reflections(px: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Lines `H K L I` of pixels with whole h, k, l: px(image_id, h, k, l, re); sorted within each image's own rows by the sink."""
    whole = (F.abs(F.col("h") - F.round("h")) < tolerance) & (F.abs(F.col("k") - F.round("k")) < tolerance) & (F.abs(F.col("l") - F.round("l")) < tolerance)
    return px.where(whole).select("image_id", F.format_string("%d %d %d %.6f", F.round("h").cast("int"), F.round("k").cast("int"), F.round("l").cast("int"), "re").alias("value"))


def write_packed(df: DataFrame, path: str, mode: str = "append") -> None:
    """Packed images as Parquet, the interchange format."""
    df.select(*[c.split()[0] for c in PACKED.split(", ")]).write.mode(mode).parquet(path)
