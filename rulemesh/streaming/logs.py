"""Streaming forms of the append-only logs, each with a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, width: str = "1 hour", late: str | None = None, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events of each kind in each window; ``late`` is how much later than the latest an event of a stream may come."""
    if late is not None:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = events.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def latest_per_key(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The batch twin of ``keep_latest``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_latest(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """A query that keeps the latest row of each key of a stream as a table.

    Each batch is reduced first and then joined with the table so far; versions
    of the table are written side by side and the last complete one counts, so a
    batch that is run again after a failure gives the same table.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest_per_key(batch, keys, order)
        if number > 0:
            fresh = latest_per_key(spark.read.parquet(f"{path}/{number - 1}").unionByName(fresh), keys, order)
        fresh.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_content(stream: DataFrame, columns: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose content hasn't been seen within ``late``."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    hashed = timed.withColumn("content_hash", F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16))
    return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through a memory table; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
