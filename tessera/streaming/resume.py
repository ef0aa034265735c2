"""The result log as a stream: new rows arrive as files, late and repeated rows are dropped, keys keep their latest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def distinct_rows(stream: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """First row per key within the watermark; state older than it is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_accuracy(stream: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Accuracy per event-time window and group; rows later than the watermark are left out."""
    window = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count("correct").alias("scored"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes everything that is there and stops; a second run continues where the first ended."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
