"""Tiles scored as they arrive: a stream of feature tables against given centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tilewright.operators.cluster import nearest


def arriving(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Feature tables written to a folder, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def score(stream: DataFrame, centroids: DataFrame, path: str, checkpoint: str, k: int = 3) -> StreamingQuery:
    """Each tile with its nearest centroids, appended to a table. Scoring keeps no state, and the file sink's log names the files of each batch, so a batch that is tried again counts once; a stream's result is that of all its files at once."""
    return nearest(stream, centroids, k).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
