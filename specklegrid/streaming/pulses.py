"""Streams of pulses and frames that meet: by stamp and order, or by time.

A master log's pulses and a list of shots arrive as two streams, in any order within a watermark. Of equal stamps, the
k-th pulse belongs to the k-th shot, so a stamp is settled when the watermark has passed it: until then its rows are state, then
they are joined, given out and forgotten. Rows that come later are given out as they are, marked late. The others are the
batch join's result, whatever the order of arrival.

Cases: rows without a stamp are dropped; a pulse without a shot keeps nulls, a shot without a pulse goes; stamps past the
last watermark wait for the next rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PULSES = "ts int, name string, seq long, tunnel double, hall double, late boolean"
_NAMES = [c.split()[0] for c in PULSES.split(", ")]
_WAITING = "mseq array<long>, name array<string>, sseq array<long>, tunnel array<double>, hall array<double>"


def joined_pulses(master: DataFrame, shots: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streams master(name, ts, seq) and shots(ts, tunnel, hall, seq), ts in seconds, as text.pulses() joins them, and late rows of either side (late is true); append mode."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    stamp = F.timestamp_seconds("ts").alias("time")
    a = master.where("ts is not null").select(F.col("ts").cast("int").alias("ts"), stamp, F.lit(0).alias("side"), F.col("seq").cast("long").alias("seq"), "name", none("double", "tunnel"), none("double", "hall"))
    b = shots.where("ts is not null").select(F.col("ts").cast("int").alias("ts"), stamp, F.lit(1).alias("side"), F.col("seq").cast("long").alias("seq"), none("string", "name"), "tunnel", "hall")
    both = a.withWatermark("time", late).unionByName(b.withWatermark("time", late))

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.hasTimedOut and int(key[0]) * 1000 <= state.getCurrentWatermarkMs():  # settled already
            for pdf in frames:
                rows = [(key[0], r.name, int(r.seq), r.tunnel, r.hall, True) for r in pdf.itertuples(index=False)]
                yield pd.DataFrame(rows, columns=_NAMES)
            return
        held = [list(x) for x in state.get] if state.exists else [[], [], [], [], []]
        if state.hasTimedOut:
            pulses = sorted(zip(held[0], held[1], strict=True), key=lambda p: p[0])
            there = sorted(zip(held[2], held[3], held[4], strict=True), key=lambda s: s[0])
            rows = [(key[0], name, seq, *(there[k][1:] if k < len(there) else (None, None)), False) for k, (seq, name) in enumerate(pulses)]
            state.remove()
            yield pd.DataFrame(rows, columns=_NAMES)
            return
        number = lambda v: None if pd.isna(v) else float(v)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.side == 0:
                    held[0].append(int(r.seq))
                    held[1].append(r.name)
                else:
                    held[2].append(int(r.seq))
                    held[3].append(number(r.tunnel))
                    held[4].append(number(r.hall))
        state.update(tuple(held))
        state.setTimeoutTimestamp(int(key[0]) * 1000)

    return both.groupBy("ts").applyInPandasWithState(run, PULSES, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)


def frames_with_pulses(frames: DataFrame, pulses: DataFrame, within: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Streams frames(bunch, time, ...) and pulses(ts, at, ...): each frame with the pulses of its bunch within a time of it; frames that no pulse can reach any more are given with nulls."""
    f, p = frames.withWatermark("time", late), pulses.withWatermark("at", late)
    near = F.expr(f"bunch = ts AND at >= time - INTERVAL {within} AND at <= time + INTERVAL {within}")
    return f.join(p, near, "leftOuter")

