"""Scoring a sample stream, one current prediction per user."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convfeat.plans.scoring import score_samples
from convfeat.sources.runs import Run

ORDER = ("file_path", "row_index")


#: Versions kept whole besides the newest; older ones are emptied, so the sink follows the users.
KEEP_VERSIONS = 2


def _committed(spark: SparkSession, sink: str, below: int | None = None) -> list[int]:
    """Committed versions of ``sink``, newest first (those below ``below`` only)."""
    try:
        marks = spark.read.parquet(f"{sink}/committed")
    except AnalysisException:  # nothing committed yet
        return []
    if below is not None:
        marks = marks.where(F.col("version") < below)
    return [r.version for r in marks.select("version").distinct().orderBy(F.desc("version")).limit(KEEP_VERSIONS + 1).collect()]


def latest_rows(df: DataFrame) -> DataFrame:
    """Each user's last row by (file, row), its prediction with it."""
    last = F.max_by(F.struct(*ORDER, "prob"), F.struct(*ORDER)).alias("last")
    return df.groupBy("user_id").agg(last).select("user_id", "last.*")


def upsert_batch(batch: DataFrame, sink: str, batch_id: int) -> None:
    """Merge a batch's rows (user_id, file_path, row_index, prob) into the sink as version ``batch_id``.

    The new version is the last row per user of the last committed version before ``batch_id``
    and the batch. It is written first and committed after by a marker, so a reader never sees
    a half-written version; a repeated batch recomputes the same version from the same base, and
    batches in any order keep each user's last row by (file, row).
    """
    spark = batch.sparkSession
    base = _committed(spark, sink, batch_id)
    rows = batch.select("user_id", *ORDER, "prob")
    if base:
        rows = spark.read.parquet(f"{sink}/v={base[0]}").unionByName(rows)
    latest_rows(rows).write.mode("overwrite").parquet(f"{sink}/v={batch_id}")
    spark.createDataFrame([(batch_id,)], "version long").write.mode("overwrite").parquet(f"{sink}/committed/version={batch_id}")
    for old in _committed(spark, sink)[KEEP_VERSIONS:]:
        spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{sink}/v={old}")


def score_stream(samples: DataFrame, run: Run, sink: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and upsert each user's last prediction into ``sink``.

    The sink holds versions of one row per user; :func:`current_predictions` reads the newest
    committed one. A batch may be a few files of one row group each, so its rows are dealt anew
    before they are scored.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(score_samples(batch.repartition(*ORDER), run), sink, batch_id)

    query = (
        samples.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def current_predictions(spark: SparkSession, sink: str) -> DataFrame:
    """Each user's prediction from the last of their rows seen so far (the newest committed version)."""
    versions = _committed(spark, sink)
    if not versions:
        return spark.createDataFrame([], "user_id long, prob double")
    return spark.read.parquet(f"{sink}/v={versions[0]}").select("user_id", "prob")
