"""Exchanges of packed hashes between blocks of documents and buckets of hashes.

A corpus is dealt into blocks of a few MB of text by a hash of doc_id. A step sees one block (and what
earlier steps answered to it) and sends blobs of 64-bit numbers to buckets of a hash; a judge sees one
bucket with what all blocks sent to it and answers to blocks. Each block sends a distinct hash once, so a
hash that holds a third of all positions costs its bucket one entry for each block, not one for each
position. The number of blocks and buckets follows the bytes of text, so each task's memory stays the same
at any size. The text is shuffled once: all steps read the same exchange.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, bucketed, equal_runs, unblob

BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 64
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("data", pa.binary())])


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in all rows; a scan of one column."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def shared(spark, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset, a session of one machine (tests) gets a folder of its own; a cluster must set it."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: How steps are run: shuffle files go with the step, and texts come to Python by so many rows (a batch of 10,000, the default, is 30 to 60 MB on either side).
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}
_PATH = "_written_path"
_there: list[DataFrame] = []  # tables that written() made and nothing has deleted


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends there, and lost executors cost nothing. The step's shuffle files go when it ends."""
    spark, path = df.sparkSession, shared(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in _STEP}
    try:
        for k, v in _STEP.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    _there.append(out)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes what written() wrote for tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(getattr(t, _PATH))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        _there[:] = [x for x in _there if x is not t]


def made() -> list[DataFrame]:
    """The tables that written() has made and nothing has deleted."""
    return list(_there)


def swept(*keep: DataFrame) -> None:
    """Deletes what written() has made so far, but for the tables to keep (those of others, from made() before, among them): for callers that have written down what they want of a result."""
    released(*[t for t in _there if not any(t is k for k in keep)])


def block_of(count: int):
    """The block of a row of documents; rows of one doc_id, or of none, spread over the blocks by their texts."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int").alias("block")


class Blocks:
    """docs(doc_id, text), dealt into blocks once for all steps."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        self.count = max(LEAST_BLOCKS, -(-text_bytes(docs) // block_bytes))
        self.docs = docs.select(
            block_of(self.count), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        ).repartition(self.count, "block")

    @classmethod
    def of(cls, rows: DataFrame, key: str, count: int) -> Blocks:
        """Any rows, dealt into count blocks by a hash of key; answers come back to the block they were asked from."""
        self = cls.__new__(cls)
        self.count = count
        self.docs = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")).repartition(count, "block")
        return self

    def ask(self, emit: Callable[[int, pa.Table, list[bytes], int], list[tuple[int, bytes]]], answers: DataFrame | None = None) -> DataFrame:
        """What emit(block, rows, answers, buckets) sends: (bucket, blob)s."""
        buckets = self.count

        def run(key, rows: pa.Table, got: list[bytes]) -> pa.Table:
            block = key[0].as_py()
            sent = emit(block, rows, got, buckets) if rows.num_rows else []
            return pa.table([pa.array([x[0] for x in sent], pa.int32()), pa.array([block] * len(sent), pa.int32()), pa.array([x[1] for x in sent], pa.binary())], schema=_SENT)

        return self._apply(run, answers, "bucket int, block int, data binary")

    def judge(self, sent: DataFrame, decide: Callable[[list[int], list[bytes]], list[tuple[int, bytes]]]) -> DataFrame:
        """What decide(blocks, blobs) of each bucket answers: (block, blob)s."""

        def run(rows: pa.Table) -> pa.Table:
            out = decide(rows["block"].to_pylist(), rows["data"].to_pylist())
            return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=_ANSWER)

        return sent.groupBy("bucket").applyInArrow(run, "block int, data binary")

    def finish(self, work: Callable[[int, pa.Table, list[bytes]], pa.Table], answers: DataFrame | None, schema: str) -> DataFrame:
        return self._apply(lambda key, rows, got: work(key[0].as_py(), rows, got), answers, schema)

    def _apply(self, run, answers: DataFrame | None, schema: str) -> DataFrame:
        if answers is None:
            return self.docs.groupBy("block").applyInArrow(lambda key, rows: run(key, rows, []), schema)
        return self.docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda key, rows, got: run(key, rows, got["data"].to_pylist()), schema)


# ---- which hashes occur more than once


def _order(lanes: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(lanes[::-1]) if len(lanes) > 1 else np.argsort(lanes[0], kind="stable")


def distinct(*lanes: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes, as columns; the lowest bit of the first then says whether there was more than one."""
    lanes = [lanes[0] & ~U64(1), *lanes[1:]]
    by = _order(lanes)
    lanes = [x[by] for x in lanes]
    first = equal_runs(*lanes)
    out = [x[first] for x in lanes]
    out[0] |= (np.diff(np.r_[first, len(by)]) > 1).astype(U64)
    return out


def again(k: int):
    """A judge of hashes of k columns: to each block, those of its hashes that occur again anywhere."""

    def judge(owners: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
        parts = [unblob(b, k) for b in blobs]
        owner, h = np.repeat(np.array(owners), [x.shape[1] for x in parts]), np.concatenate(parts, axis=1)
        many, lanes = h[0] & U64(1), [h[0] & ~U64(1), *h[1:]]
        by = _order(lanes)
        owner, many, lanes = owner[by], many[by], [x[by] for x in lanes]
        first = equal_runs(*lanes)
        size = np.diff(np.r_[first, len(by)])
        more = np.repeat((size > 1) | (many[first] > 0), size)
        return list(bucketed(owner[more], [x[more] for x in lanes]))

    return judge


def among(lanes: list[np.ndarray], got: list[bytes]) -> np.ndarray:
    """Whether each hash is one of those that came back."""
    known = np.concatenate([unblob(b, len(lanes)) for b in got], axis=1) if got else np.zeros((len(lanes), 0), U64)
    hit = np.zeros(len(lanes[0]), bool)
    if not known.shape[1]:
        return hit
    known = known[:, _order(list(known))]
    known = known[:, equal_runs(*known)]
    h = lanes[0] & ~U64(1)
    at = np.searchsorted(known[0], h)
    for more in range(int(np.diff(np.r_[equal_runs(known[0]), known.shape[1]]).max())):
        i = np.minimum(at + more, known.shape[1] - 1)
        hit |= np.logical_and.reduce([known[0][i] == h, *(k[i] == x for k, x in zip(known[1:], lanes[1:], strict=True))])
    return hit
