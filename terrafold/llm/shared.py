"""Tables, shared storage and streaming over sorted partitions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that hold whole texts go to Python in batches of fewer rows than Spark's default, which
    would be tens of MB each. A setting that the session was given stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. It is the cluster's spark.checkpoint.dir; only where
    that is unset a local session, as in tests, gets a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="terrafold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def free_name(columns, name: str) -> str:
    """name, with underscores before it until no column bears it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor
    costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and share an
    executor's limit with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches, column: int = 0, most: int = 1 << 22):
    """Batches cut so that the strings of a column take at most so many bytes, or one row."""
    for batch in batches:
        at = 0
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def grouped(batches, keys: list[str]):
    """Yield one pyarrow Table per run of equal keys from batches sorted by keys.

    Only the run at hand is held, never the partition.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= ~pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) & ~pc.and_(c[1:].is_null(), c[:-1].is_null()).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    give_back()
