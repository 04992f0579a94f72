"""What a user extends SQL with: table functions over Arrow batches, and grouped aggregates with a partial state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .schedules import bezier


@arrow_udtf(returnType="image_id long, i int, x int, y int, z int, re double, im double, mask int")
class ImagePixels:
    """image_pixels(TABLE(packed images)): a row for each pixel, a batch of images at a time."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        re = batch.column("re")
        sizes = re.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        each = np.repeat(np.arange(batch.num_rows), sizes)
        i = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        nx, ny = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[each] for c in ("nx", "ny"))
        places = {"i": i, "x": i % nx, "y": i // nx % ny, "z": i // (nx * ny)}
        values = {c: batch.column(c).flatten() for c in ("re", "im", "mask")}
        ids = batch.column("image_id").cast(pa.int64()).take(pa.array(each))
        yield pa.table({"image_id": ids, **{k: pa.array(v.astype(np.int32)) for k, v in places.items()}, **values})


@udtf(returnType="iteration int, value double")
class ScheduleRows:
    """schedule_rows(keys, values, first, last, step): a map's value at each iteration."""

    def eval(self, keys: list[float], values: list[float], first: int, last: int, step: int):
        for k in range(first, last + 1, step):
            yield k, bezier(k, keys, values)


def register(spark: SparkSession) -> None:
    spark.udtf.register("image_pixels", ImagePixels)
    spark.udtf.register("schedule_rows", ScheduleRows)


class Aggregate(Protocol):
    """An aggregate whose state is a row of doubles."""

    #: The columns that finish() gives, as a schema.
    result: str

    def update(self, columns: list[pa.Array]) -> np.ndarray:
        """The state of the rows of a batch that are in one group."""

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def finish(self, state: np.ndarray) -> tuple: ...


SALTS = 64


def aggregated(rows: DataFrame, by: str, columns: list[str], aggregate: Aggregate) -> DataFrame:
    """by, and the result of a user's aggregate of each group. States are made of Arrow batches where the rows lie; only states are shuffled, those of a group through SALTS tasks first, so that no group gathers its rows or all of its states in one."""
    kind = rows.schema[by].dataType.simpleString()

    def partial(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            code = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            at = [pa.array(order[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True)]
            states = [aggregate.update([batch.column(k + 1).take(x) for k in range(len(columns))]) for x in at]
            yield pa.record_batch([batch.column(0).take(pa.array([x[0].as_py() for x in at])), pa.array([s.tolist() for s in states], pa.list_(pa.float64()))], ["by", "state"])

    def joined(t: pa.Table) -> np.ndarray:
        state = None
        for s in t["state"]:
            s = s.values.to_numpy(zero_copy_only=False)
            state = s if state is None else aggregate.merge(state, s)
        return state

    def together(t: pa.Table) -> pa.Table:
        return pa.table({"by": t["by"].slice(0, 1), "state": pa.array([joined(t).tolist()], pa.list_(pa.float64()))})

    result = to_arrow_schema(StructType.fromDDL(aggregate.result))

    def finished(t: pa.Table) -> pa.Table:
        return pa.table([t["by"].slice(0, 1), *[pa.array([v], f.type) for v, f in zip(aggregate.finish(joined(t)), result, strict=True)]], ["by", *result.names])

    states = rows.select(F.col(by).alias("by"), *columns).mapInArrow(partial, f"by {kind}, state array<double>")
    states = states.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("by", "salt").applyInArrow(lambda key, t: together(t), f"by {kind}, state array<double>")
    return states.groupBy("by").applyInArrow(finished, f"by {kind}, {aggregate.result}").withColumnRenamed("by", by)


class Moments:
    """n, mean and variance (of the population) of each element of arrays of one length, merged without cancellation."""

    result = "n long, mean array<double>, variance array<double>"

    def update(self, columns):
        v = columns[0].drop_null()
        if not len(v):
            return np.zeros(1)
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
        mean = x.mean(0)
        return np.r_[len(x), mean, ((x - mean) ** 2).sum(0)]

    def merge(self, a, b):
        if not a[0] or not b[0]:
            return b if not a[0] else a
        n, half = a[0] + b[0], len(a) // 2
        (am, asq), (bm, bsq) = ((s[1 : half + 1], s[half + 1 :]) for s in (a, b))
        gap = bm - am
        return np.r_[n, am + gap * b[0] / n, asq + bsq + gap * gap * a[0] * b[0] / n]

    def finish(self, state):
        half = len(state) // 2
        return int(state[0]), state[1 : half + 1].tolist(), (state[half + 1 :] / max(state[0], 1)).tolist()
