"""Catalogue ingestion as a stream: new files of episodes, first version of each id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def episode_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def insert_stream(episodes: DataFrame, target: str, checkpoint: str):
    """Append what is new by id.  The state is the table itself: each batch is
    anti-joined with it, so a batch that is replayed adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["id"])
        try:
            fresh = fresh.join(spark.read.schema(df.schema).parquet(target).select("id"), "id", "left_anti")
        except Exception as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.select(df.columns).write.mode("append").parquet(target)

    return episodes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Tumbling counts of events by type, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
