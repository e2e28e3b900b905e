"""Feature conversion as a stream of files. The conversion is stateless, so it is the batch one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from convfeat.layout import FeatureLayout
from convfeat.operators.features import convert
from convfeat.operators.selection import filter_time


def sample_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Samples of a folder as they arrive, with ``file_path`` and ``row_index``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")


def feature_stream(
    samples: DataFrame,
    layout: FeatureLayout,
    tmin: int | None = None,
    tmax: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Converted features of a sample stream inside the time bounds."""
    return convert(filter_time(samples, tmin, tmax), layout, "label_type" in samples.columns, keep=keep)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into parquet files, exactly once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
