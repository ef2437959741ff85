"""Documents in blocks: rows of a few megabytes of packed text, in a bucketed
table, so that later passes bring small answers to the texts and not the texts
to the answers. Blocks are written once, and so keep their numbers whatever
happens to an executor; reading them by number needs no shuffle of text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete_path, new_path, partitions, texts

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20

SCHEMA = "block long, ids binary, known binary, sizes binary, text binary, extra binary"


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, extra: Callable[[bytes, np.ndarray], bytes] | None = None) -> str:
    """The name of a table with docs (doc_id, text) as blocks: a number; the ids as int64, and whether
    they are known (not null) as bytes; the texts' sizes as int64; the texts,
    compressed; and what extra makes of the joined texts and their sizes. Bucketed by number over as many buckets as shuffles have
    partitions, in the shared folder; the caller drops it (see dropped)."""
    spark = docs.sparkSession

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=3)
        ids: list = []
        held: list[bytes] = []
        total = 0

        def row() -> pa.RecordBatch:
            sizes, joined = np.fromiter(map(len, held), np.int64, len(held)), b"".join(held)
            values = [
                number,
                np.array([0 if k is None else k for k in ids], np.int64).tobytes(),
                np.array([k is not None for k in ids], bool).tobytes(),
                sizes.tobytes(),
                packer.compress(joined),
                extra(joined, sizes) if extra else None,
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(values)], [x.split()[0] for x in SCHEMA.split(", ")])

        for keys, found in texts(batches, most=block_bytes // 4):
            size = sum(map(len, found))
            if held and total + size > block_bytes:
                yield row()
                number, ids, held, total = number + 1, [], [], 0
            ids += keys
            held += found
            total += size
        if held:
            yield row()

    name = f"blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, SCHEMA)
    rows.write.bucketBy(partitions(spark), "block").format("parquet").option("path", new_path(spark, name)).saveAsTable(name)
    return name


@contextmanager
def dropped(spark: SparkSession, name: str) -> Iterator[DataFrame]:
    """The table, dropped with its files in the end, whatever happens."""
    blocks = spark.table(name)
    files = blocks.inputFiles()
    try:
        yield blocks
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for folder in {path.rsplit("/", 1)[0] for path in files}:
            delete_path(spark, folder)


def unpack(sizes: bytes, text: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(text)
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [raw[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def ids_of(ids: bytes, known: bytes) -> list[int | None]:
    return [k if ok else None for k, ok in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(known, bool).tolist(), strict=True)]
