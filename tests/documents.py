"""Reading written documents back, for those that fit in a driver's memory."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The text of a written document, one row; for documents that fit in a driver's memory."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    text = F.decode("content", "UTF-8")
    one = F.sort_array(F.collect_list(F.struct("path", text.alias("text"))))
    return parts.agg(F.array_join(F.transform(one, lambda p: p["text"]), "").alias("document"))
