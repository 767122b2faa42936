"""Documents dealt into blocks, and the exchange of hashes between blocks and hash buckets.

A block holds about ``BLOCK_BYTES`` of text. Operators that ask a global question about hashes (how often does it occur,
who has it first) send each block's distinct hashes, packed as arrays, to the bucket that owns them, and get an answer
for each block. A frequent hash is sent once per block, so no bucket depends on how often a hash occurs in documents.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.words import grouped

BLOCK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names. Only a local session without that setting gets a temporary one."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="pitrank-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return top


def cut(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint: lineage ends there, and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in the shared folder: compressed, and read by column, unlike a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(table: DataFrame) -> None:
    """Removes a table that ``written`` made, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """As many blocks as the text needs, and one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size / block_bytes))


def block_of(doc_id: str, text: str, blocks: int) -> Column:
    """A row's block; the text takes part, so that a frequent or null id doesn't fill one block."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int")


def blocked(docs: DataFrame, doc_id: str, text: str, blocks: int, *more: Column) -> DataFrame:
    """doc_id, text and block of every row, under these names, and more columns."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), block_of(doc_id, text, blocks).alias("block"), *more)


def by_bucket(block: int, keys: np.ndarray, buckets: int, schema: pa.Schema, **columns: np.ndarray) -> pa.Table:
    """A row for each bucket that gets any of the keys: bucket, block, and each column packed. Buckets go by the key's
    low digits."""
    order, found, edge = grouped(keys % np.uint64(buckets))
    parts = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    data = {"bucket": pa.array(found.astype(np.int32)), "block": pa.array(np.full(len(found), block, np.int32))}
    data |= {name: pa.array([np.ascontiguousarray(v[p]).tobytes() for p in parts], pa.binary()) for name, v in columns.items()}
    return pa.table(data).select(schema.names).cast(schema)


def unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and the number of the row each came with."""
    rows = [np.frombuffer(x or b"", kind) for x in column.to_pylist()]
    values = np.concatenate(rows) if rows else np.zeros(0, kind)
    return values, np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def answered(table: pa.Table, keep: np.ndarray, row: np.ndarray, schema: pa.Schema, **columns: np.ndarray) -> pa.Table:
    """For each row of a bucket's table those values that ``keep`` marks, packed; rows without any go."""
    at = np.flatnonzero(keep)
    edge = np.searchsorted(row[at], np.arange(table.num_rows + 1))
    rows = np.flatnonzero(edge[1:] > edge[:-1])
    data = {"block": table["block"].combine_chunks().take(pa.array(rows)), "bucket": table["bucket"].combine_chunks().take(pa.array(rows))}
    data |= {name: pa.array([v[at[edge[r] : edge[r + 1]]].tobytes() for r in rows], pa.binary()) for name, v in columns.items()}
    return pa.table(data).select(schema.names).cast(schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow with one result for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)
