"""The shared folder, tables that cut lineage, and Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that carries whole texts: long documents then stay within a worker's memory.
TEXT_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; on one machine, as in tests, a temporary
    folder is made and set where that is unset. On a cluster that is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="postmill-shared-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/postmill/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan is cut, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the rows of Arrow batches; a smaller bound of the session stays.

    It is the session's setting, as batches are cut when a result is asked for, and it stays lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def strings(col: pa.Array) -> pa.Array:
    """A string column without nulls; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def groups(batches, key: str):
    """Yield ``(key, table)`` for batches that arrive sorted by ``key``; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)
