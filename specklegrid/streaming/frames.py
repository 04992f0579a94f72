"""Streams of frames, logs and output files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import ordered_scan
from ..sources.text import parse_log


def tail_logs(spark, path: str) -> DataFrame:
    """A stream of metric rows from run logs that arrive as files in a folder."""
    return parse_log(spark.readStream.text(path))


def newest_outputs(files: DataFrame, too_old: str | None = None) -> DataFrame:
    """files(path, category, created): the newest of each category (update mode); files made before `too_old` don't count."""
    files = files.where(F.col("created") >= F.lit(too_old).cast("timestamp")) if too_old else files
    return files.groupBy("category").agg(F.max_by("path", "created").alias("path"), F.max("created").alias("created"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


WINDOW, LEAST, RESTART = 3, 0.95, 10


def track(background: np.ndarray | None, run: int, frame: np.ndarray) -> tuple[np.ndarray, int, float, bool]:
    """Background, run of hits, correlation and hit flag after one frame: frames like the background update its sliding mean, others are hits; after over RESTART hits in a row the background starts anew."""
    if background is None:
        return frame.copy(), 0, 1.0, False
    a, b = background - background.mean(), frame - frame.mean()
    r = float((a @ b) / max(np.sqrt((a @ a) * (b @ b)), 1e-300))
    if r >= LEAST:
        return (background * (WINDOW - 1) + frame) / WINDOW, 0, r, False
    return (frame.copy(), 0, r, True) if run >= RESTART else (background, run + 1, r, True)


_HITS = "stream long, seq long, correlation double, hit boolean"


def track_batch(frames: DataFrame) -> DataFrame:
    """frames(stream, seq, v array<double>): hits of each stream in the order of seq, read batch by batch."""

    def step(state, v):
        back, n, c, hit = track(*state, np.asarray(v, float))
        return (back, n), [(c, hit)]

    return ordered_scan(frames, "stream", "seq", ["v"], lambda: (None, 0), step, _HITS)


def track_stream(frames: DataFrame) -> DataFrame:
    """The same over a stream, whose background and run of hits are kept as state."""

    def run(key, frames_: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        back, n = (np.array(state.get[0]), state.get[1]) if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames_)).sort_values("seq").itertuples(index=False):
            back, n, c, hit = track(back, n, np.asarray(r.v, float))
            out.append((key[0], r.seq, c, hit))
        state.update((back.tolist(), n))
        yield pd.DataFrame(out, columns=["stream", "seq", "correlation", "hit"])

    return frames.select("stream", "seq", "v").groupBy("stream").applyInPandasWithState(run, _HITS, "back array<double>, run int", "append", GroupStateTimeout.NoTimeout)
