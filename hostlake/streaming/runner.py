"""Running a stream to the end of its present input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Only a local session may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="hostlake-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Processes everything that is there now, into Parquet, and returns what was written."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint")
        .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
