"""Watching the outputs of runs.

A run writes files of several categories, numbered by iteration. The watcher of a run waits for the next file of the leading
category, by an increment; when it is there, it is announced, and with it the files of the same iteration of the other
categories that are there too. A file announces itself as the initial output of its category if it is the first, and as
a new output if it isn't older than the newest one; files of a former run (made before the watch began) are never announced.
Files may arrive in any order: those that aren't awaited yet are state, of which the ones behind the awaited iteration are
forgotten by a timer, when event time has passed them by `keep`.

Cases: files of no category are ignored; a file that arrives again counts with its last time of making; a gap in the
iterations holds the watch until it is filled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "run string, kind string, category string, path string, previous string, iteration int, created timestamp"


@dataclass(frozen=True)
class Category:
    """name as shown; identifier as it begins the file's name, before a dash and the digits of the iteration."""

    name: str
    identifier: str

    def iteration(self, file: str) -> int | None:
        m = re.fullmatch(re.escape(self.identifier) + r"-(\d+)(\.\w+)", file)
        return int(m[1]) if m else None


CATEGORIES = (Category("Real Space", "real_space"), Category("Fourier Space", "fourier_space"), Category("Support", "support"))
DIGITS, SUFFIX = 7, ".h5"


def file_of(category: Category, iteration: int) -> str:
    return f"{category.identifier}-{iteration:0{DIGITS}d}{SUFFIX}"


def watched(awaited: int | None, newest: dict, present: dict, increment: int, began: float, categories=CATEGORIES) -> tuple[int, list[tuple]]:
    """What a watch announces, given the iteration it waits for, the newest file (path, created) by category and the files that are there: the iteration it waits for then, and (kind, category, path, previous, iteration, created)."""
    out, at = [], increment - 1 if awaited is None else awaited
    lead = categories[0]

    def announce(category: Category) -> bool:
        path = file_of(category, at)
        created = present.get(path)
        if created is None or created < began:
            return False
        before = newest.get(category.name)
        if before and created < before[1]:
            return False
        newest[category.name] = (path, created)
        out.append(("new", category.name, path, before[0] if before else None, at, created))
        if not before:
            out.append(("initial", category.name, path, None, at, created))
        return True

    while announce(lead):
        for c in categories[1:]:
            announce(c)
        at += increment
    return at, out


class Watch(StatefulProcessor):
    def __init__(self, increment: int, began: float, keep_ms: int, categories=CATEGORIES):
        self.increment, self.began, self.keep_ms, self.categories = increment, began, keep_ms, categories

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.awaited = handle.getValueState("awaited", "iteration int")
        self.newest = handle.getMapState("newest", "category string", "path string, created double")
        self.present = handle.getMapState("present", "path string", "iteration int, created double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            for path, created in zip(pdf["path"], pdf["created"], strict=True):
                name = str(path).rsplit("/", 1)[-1]
                iteration = next((i for c in self.categories if (i := c.iteration(name)) is not None), None)
                if iteration is None or pd.isna(created):
                    continue
                self.present.updateValue((name,), (iteration, created.timestamp()))
                latest = created.timestamp() if latest is None else max(latest, created.timestamp())
        awaited = self.awaited.get()[0] if self.awaited.exists() else None
        newest = {k[0]: tuple(v) for k, v in self.newest.iterator()}
        present = {k[0]: v[1] for k, v in self.present.iterator()}
        at, out = watched(awaited, newest, present, self.increment, self.began, self.categories)
        self.awaited.update((at,))
        for k, v in newest.items():
            self.newest.updateValue((k,), v)
        if latest is not None:
            self.handle.registerTimer(int(latest * 1000) + self.keep_ms)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Files behind the awaited iteration can't be announced any more."""
        at = self.awaited.get()[0] if self.awaited.exists() else 0
        for k, v in list(self.present.iterator()):
            if v[0] < at:
                self.present.removeKey(k)
        yield self._frame(key, [])

    def close(self) -> None:
        pass

    def _frame(self, key, out) -> pd.DataFrame:
        rows = [(key[0], kind, category, path, previous, iteration, pd.Timestamp(created, unit="s")) for kind, category, path, previous, iteration, created in out]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
        return frame.astype({"iteration": "int32", "created": "datetime64[ns]"})


def watch(files: DataFrame, increment: int, began: str | None = None, late: str = "1 hour", keep: str = "1 day", categories=CATEGORIES) -> DataFrame:
    """Events of a stream of files(run, path, created): run, kind (new or initial), category, path, previous (the newest before), iteration, created."""
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = pd.Timestamp(began).timestamp() if began else float("-inf")
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = files.select(F.col("run").cast("string").alias("run"), "path", F.col("created").cast("timestamp").alias("created")).withWatermark("created", late)
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=Watch(increment, start, keep_ms, categories), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
