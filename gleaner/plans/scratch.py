"""Intermediate tables in the folder that driver and executors share: written, read back, and removed when nothing reads them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_root: str | None = None
_folders: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset (tests in local mode), one below a temporary folder."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _local_root = _local_root or "file://" + tempfile.mkdtemp(prefix="gleaner-")
        root = _local_root
    folder = f"{root.rstrip('/')}/gleaner-{uuid.uuid4().hex}"
    if _folders:
        _folders[-1].append(folder)
    return folder


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write the rows to the shared scratch folder and read them back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    df.write.parquet(f"{folder}/{name}")
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.scratch_folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        remove_folder(t.sparkSession, t.scratch_folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch folders that were made inside, at the end: results that leave must be `kept`."""
    _folders.append([])
    try:
        yield
    finally:
        for folder in _folders.pop():
            remove_folder(spark, folder)


def kept(df: DataFrame, name: str = "result") -> DataFrame:
    """Like stored, in a folder that outlives the innermost `scratch`; whoever owns spark.checkpoint.dir empties it."""
    own = _folders.pop() if _folders else None
    try:
        return stored(df, name)
    finally:
        if own is not None:
            _folders.append(own)


def materialised(df: DataFrame, read_as: StructType | None = None) -> DataFrame:
    """`stored`, so that several uses compute the rows once. read_as: the schema to read them with, if it isn't that of the rows."""
    out = stored(df)
    if read_as is None:
        return out
    again = df.sparkSession.read.schema(read_as).parquet(f"{out.scratch_folder}/t")
    again.scratch_folder = out.scratch_folder
    return again
