"""File stream source and an idempotent micro-batch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ordersight.schemas import EVENT_SCHEMA

COUNTS_SCHEMA = "batch_id long, records long"

TRIGGER = "2 seconds"


def stream_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType = EVENT_SCHEMA,
    max_files: int | None = 1,
    max_bytes: str | None = None,
) -> DataFrame:
    """Unbounded Parquet input; each micro-batch takes at most ``max_files`` files or ``max_bytes``."""
    reader = spark.readStream.schema(schema)
    if max_bytes is not None:
        return reader.option("maxBytesPerTrigger", max_bytes).parquet(path)
    return reader.option("maxFilesPerTrigger", max_files).parquet(path)


def stream_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    name: str | None = None,
    available_now: bool = False,
    trigger: str = TRIGGER,
) -> StreamingQuery:
    """Append each micro-batch to its own folder; a repeated batch replaces itself, so no row is doubled.

    A failing batch fails the query and is retried from the checkpoint on restart. The rows of a batch are counted
    while it is written; ``batch_counts`` reads the counts back.
    """
    spark = stream.sparkSession

    def note(folder: str, rows: list) -> None:
        spark.createDataFrame(rows, COUNTS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}.counts/{folder}")

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        note(str(batch_id), [(batch_id, seen.get["n"])])

    note("start", [])  # the table exists before the first batch does

    writer = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    timed = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return timed.start()


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, records`` of every batch that stands in the sink; a repeated batch counts once."""
    return spark.read.schema(COUNTS_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}.counts")


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """Everything the sink has written, with the ``batch_id`` of each row."""
    return spark.read.option("basePath", path).parquet(path)
