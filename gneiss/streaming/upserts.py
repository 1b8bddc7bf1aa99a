"""Assets that arrive in files, kept as a log of changes and merged as they are read. This goes beyond the batch operators and uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.stores import latest


def asset_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def log_changes(stream: DataFrame, log: str, checkpoint: str):
    """Starts a query that appends each micro-batch to the table ``log``; a batch writes only its own rows, and one that is repeated after a failure counts once."""
    return stream.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, log: str, key: str = "asset_title", order: str = "ingested_at") -> DataFrame:
    """The last row of each key of a log of changes; rows without a key have none."""
    return latest(spark.read.parquet(log).filter(F.col(key).isNotNull()), [key], [order])


def arrivals(stream: DataFrame, time: str = "ingested_at", late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Rows that arrive in each window of ``time``; rows later than ``late`` do not count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
