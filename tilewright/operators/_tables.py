"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table under spark.checkpoint.dir: it cuts the lineage and survives the loss of executors. Where that is unset and driver and executors are one process (as in tests), it is under the warehouse; on a cluster that is an error."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = top or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    path = f"{top.rstrip('/')}/library/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
