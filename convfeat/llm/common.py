"""What the corpus operators share: Arrow texts as numpy bytes, rows in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convfeat.session import scratch_path

#: Bytes of text that one numpy step handles, so that its temporaries stay small.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offset of each row; a null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts: column ``text``, or that field of the struct ``row``."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def text_blocks(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``limit`` bytes of text each (one longer row stands alone)."""
    _, offsets = text_bytes(text_of(batch))
    start = 0
    while start < batch.num_rows:
        end = max(int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1, start + 1)
        yield batch.slice(start, end - start)
        start = end


def table_blocks(batch: pa.RecordBatch, key: str | None = None) -> Iterator[pa.RecordBatch]:
    """``text_blocks`` that also end where the value of column ``key`` changes."""
    bounds = [0, batch.num_rows]
    if key is not None and batch.num_rows:
        bounds[1:1] = (np.flatnonzero(np.diff(batch.column(key).to_numpy())) + 1).tolist()
    for start, end in zip(bounds, bounds[1:]):
        yield from text_blocks(batch.slice(start, end - start))


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``fn`` over every block of rows; a partition streams through one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                out = fn(block)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a 0/1 byte array over each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder; later jobs read it instead of computing it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_row(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that an operator's own columns clash with none of them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def row_schema(df: DataFrame, more: str) -> T.StructType:
    """Schema of ``row`` and further columns."""
    return T.StructType([df.schema["row"], *T._parse_datatype_string(more).fields])
