"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

__all__ = ["checkpointed", "dropped", "fresh", "fresh_names", "give_back", "read", "rows_udf", "shared_folder", "stored", "to_bytes"]


PART_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    return [fresh(df, n) for n in names]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    It is what `spark.checkpoint.dir` names. Only a local master (tests) may leave it unset: there a temporary folder is
    chosen; on a cluster that would be another disk on every node."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "aerolith-checkpoints"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, keep: list[str] | None = None, compression: str | None = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: as a checkpoint cuts the lineage, but compressed, and by
    columns. The folder's path is added to `keep`, so that `dropped` can remove it once nothing reads it any more.
    Without a compression it is the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that `stored` has written."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def to_bytes(array: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string array, without a copy."""
    return array.view(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary())


def give_back() -> None:
    """Return what a task has freed to the system, as its worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def rows_udf(start: Callable[[], Callable[..., tuple]], ddl: str, *, text_as_bytes: bool = False) -> Callable[..., Column]:
    """An Arrow UDF that maps each row to one struct.

    `start()` runs once a task and returns the row function, so models are
    prepared once. Rows are taken one at a time from the Arrow batch, so only
    one text is held as a Python object, and results are handed on for about every
    `PART_BYTES` of text, not a batch at a time. With `text_as_bytes` string columns
    arrive as UTF-8 bytes. The function counts as non-deterministic for the
    optimizer only so that it is never evaluated twice.
    """
    schema = T.StructType.fromDDL(ddl)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def struct(out: list[tuple]) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        row = start()
        for columns in batches:
            columns = (columns,) if isinstance(columns, pa.Array) else columns
            if text_as_bytes:
                columns = tuple(to_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in columns)
            out, held = [], 0
            for cells in zip(*columns, strict=True):
                values = [v.as_py() for v in cells]
                out.append(row(*values))
                held += sum(len(v) for v in values if isinstance(v, str | bytes)) + 64
                if held > PART_BYTES:
                    yield struct(out)
                    out, held = [], 0
            if out:
                yield struct(out)
        give_back()

    udf = F.arrow_udf(run, schema)
    udf = udf.asNondeterministic()
    return lambda *columns: udf(*columns)
