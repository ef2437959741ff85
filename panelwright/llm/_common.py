"""Shared helpers: the cluster's shared folder, written stages, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that separate words: space and 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a temporary one, but
    only if driver and executors are one process (tests): a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='panelwright-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(at)
    # with its scheme, so that no reader takes another file system for the default one
    path = store.makeQualified(at).toString()
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the
    lineage, and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 1 << 23) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of two-column batches, in groups of at most about
    `most` bytes (one longer text makes a group of its own). Null text: empty."""
    for batch in batches:
        ids, col = batch.column(1 - text), batch.column(text)
        sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield _group(ids, col, start, i)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield _group(ids, col, start, len(sizes))


def _group(ids: pa.Array, col: pa.Array, a: int, z: int) -> tuple[list, list[bytes]]:
    raw = col.slice(a, z - a).cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
    return ids.slice(a, z - a).to_pylist(), [x or b"" for x in raw.to_pylist()]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
