"""File and database scans, fallback loading, views and validated ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.schemas import CC_SCHEMA, TX_SCHEMA

REQUIRED_COLUMNS = ("amount", "time_diff")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = TX_SCHEMA) -> DataFrame:
    """Header CSV with a declared schema; malformed fields become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def scan_card_csv(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, CC_SCHEMA)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: str | int | None = None,
    upper: str | int | None = None,
    partitions: int = 1,
    columns: Iterable[str] = tuple(TX_SCHEMA.names),
    **options: str,
) -> DataFrame:
    """Named columns of a database table, read in parallel ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column is not None:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load().select(*columns)


# a missing or unreadable source; mistakes in a loader's own code are not among them
LOAD_PROBLEMS = (PySparkException, Py4JError, OSError, ValueError)


def load_first_available(loaders: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """First source that loads and has a row; raises when none does."""
    problems = []
    for loader in loaders:
        try:
            df = loader()
            if not df.isEmpty():
                return df
            problems.append(ValueError("source is empty"))
        except LOAD_PROBLEMS as problem:  # a source that fails to load is skipped, and reported if all fail
            problems.append(problem)
    raise ExceptionGroup("no source has data", problems or [ValueError("no sources given")])


def register_view(spark: SparkSession, name: str, df: DataFrame, keep: bool = True) -> DataFrame:
    """Register ``df`` as a temp view, persisted unless ``keep`` is off."""
    if keep:
        df.persist()
    df.createOrReplaceTempView(name)
    return spark.table(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    """Forget a view and release its cached data; False when it does not exist."""
    if not spark.catalog.tableExists(name):
        return False
    spark.catalog.uncacheTable(name)
    return spark.catalog.dropTempView(name)


def ingest_dataset(df: DataFrame, path: str, required: Iterable[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Check the required columns, overwrite the dataset and return (rows, columns)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.agg(F.count("*").alias("total_rows")).withColumn("total_columns", F.lit(len(written.columns)))
