"""Operators for preparing training data. Nothing else in the library imports this package."""

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def modest_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Let batches of whole texts stay small, unless the session has a size of its own.

    Ten thousand texts in a batch, Spark's default, take more memory in the JVM and in Python than all the
    operators do. So do the 4096 that a task's reader of Parquet keeps side by side on the heap.
    """
    if spark.conf.get(BATCH_ROWS, None) in (None, "10000"):
        spark.conf.set(BATCH_ROWS, str(rows))
    if spark.conf.get(READ_ROWS, None) in (None, "4096"):
        spark.conf.set(READ_ROWS, "512")
    return spark
