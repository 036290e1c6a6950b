"""Sources and sinks of the episode catalogue."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import round_even

ITEM = """guid string, title string, pubDate string, `itunes:duration` string, `content:encoded` string, description string,
 `itunes:explicit` string, `itunes:image` struct<_href: string>, enclosure struct<_url: string, _length: string>"""


def parse_item(xml: Column) -> Column:
    """An RSS item: the content wins over the summary, the duration is 0 where it is no
    number, ``explicit`` is 'no' where it is missing; without an enclosure the audio url
    is null."""
    return entry(F.from_xml(xml, ITEM))


def entry(item: Column) -> Column:
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        item["guid"].alias("id"), item["title"].alias("title"), item["pubDate"].alias("published_at"),
        F.coalesce(item["itunes:duration"].try_cast("int"), F.lit(0)).alias("duration_seconds"),
        F.coalesce(text(item["content:encoded"]), text(item["description"]), F.lit("")).alias("description"),
        item["enclosure"]["_url"].alias("audio_url"), F.coalesce(item["itunes:image"]["_href"], F.lit("")).alias("image_url"),
        F.coalesce(text(item["itunes:explicit"]), F.lit("no")).alias("explicit"),
    )


def _items(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{ITEM}, _corrupt_record string"
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(schema).load(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Episodes of RSS files; broken items are left out, see :func:`broken_items`."""
    # Spark reads no file for the corrupt column alone, so the test names another, too.
    any_guid = F.coalesce(F.length("guid") >= 0, F.lit(True))
    items = _items(spark, path).filter(F.col("_corrupt_record").isNull() & any_guid).drop("_corrupt_record")
    return items.select(F.struct("*").alias("i")).select(entry(F.col("i")).alias("e")).select("e.*")


def broken_items(spark: SparkSession, path: str) -> DataFrame:
    """``guid, item``: every item of RSS files that cannot be parsed, its text and its
    guid where that could be read."""
    return _items(spark, path).filter("_corrupt_record is not null").select("guid", F.col("_corrupt_record").alias("item"))


def published_ts(published_at: Column) -> Column:
    """RFC-2822 text as a timestamp; the day name is not looked at."""
    return F.try_to_timestamp(F.regexp_replace(published_at, "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


#: Episodes of one part of a written catalogue.
PART_EPISODES = 10_000


def catalog_parts(episodes: DataFrame, podcast: str, generated_at: str | None = None, part_episodes: int = PART_EPISODES) -> DataFrame:
    """``part, document``: JSON documents of the podcast, the number of all its episodes,
    the time given and the episodes in id order.  A catalogue of up to ``part_episodes``
    is one document; a larger one is cut into ranges of ids of about that size, so that
    no task holds it whole."""
    total = episodes.count()
    parts = max(1, -(-total // part_episodes))
    ranged = episodes.coalesce(1) if parts == 1 else episodes.repartitionByRange(parts, "id")
    listed = F.array_sort(F.collect_list(F.struct("id", *[c for c in episodes.columns if c != "id"])))
    head = [F.lit(podcast).alias("podcast"), F.lit(total).alias("total_episodes"), *([F.lit(generated_at).alias("generated_at")] if generated_at else [])]
    return ranged.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.to_json(F.struct(*head, listed.alias("episodes"))).alias("document"))


def parsed_catalog(parts: DataFrame, schema: str) -> DataFrame:
    """``podcast, total_episodes`` and the columns of ``schema``, one row an episode."""
    doc = parts.select(F.from_json("document", f"podcast string, total_episodes long, episodes array<struct<{schema}>>").alias("d"))
    return doc.select("d.podcast", "d.total_episodes", F.inline("d.episodes"))


def save_catalog(episodes: DataFrame, path: str, podcast: str, generated_at: str | None = None) -> None:
    catalog_parts(episodes, podcast, generated_at).select("document").write.mode("overwrite").text(path)


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parsed_catalog(spark.read.text(path).withColumnRenamed("value", "document"), schema).drop("total_episodes")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``existing`` and those rows of ``incoming`` whose key it lacks, the first of each
    key by ``order``; what is there is never overwritten."""
    first = Window.partitionBy(key).orderBy(order or key)
    fresh = incoming.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def audio_report(files: DataFrame, catalogued: DataFrame) -> DataFrame:
    """``files`` (``path, length``, as of ``binaryFile``) against downloaded episodes."""
    both = files.select(F.col("length").cast("long").alias("length"), F.lit(True).alias("file"), F.lit(False).alias("downloaded"))
    both = both.unionByName(catalogued.select(F.lit(None).cast("long").alias("length"), F.lit(False).alias("file"), "downloaded"))
    counted = both.agg(
        F.count_if("file").alias("files"), F.count_if(F.col("length") == 0).alias("empty_files"), round_even(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 2).alias("total_mb"),
        F.count_if("downloaded").alias("downloaded"),
    )
    return counted.withColumn("matches", F.col("files") == F.col("downloaded"))


def empty_audio(files: DataFrame) -> DataFrame:
    """``file_name`` of the audio files without content, in order."""
    return files.filter("length = 0").select(F.element_at(F.split("path", "/"), -1).alias("file_name")).orderBy("file_name")


def list_audio(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the audio files of a folder.  The file system is asked, as
    Spark's readers pass over empty files, which the report counts."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    rows = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName().endswith(".mp3")]
    return spark.createDataFrame(rows, "path string, length long")


def write_windows(windows: DataFrame, path: str) -> None:
    """Add partial results (``episode_id, window_index, ...``), a folder an episode."""
    windows.write.mode("append").partitionBy("episode_id").json(path)


def read_windows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Partial results, one JSON line a window, the first of each window where a task
    wrote it twice; broken lines are left out.  ``schema`` names all columns."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter("_corrupt_record is null").drop("_corrupt_record").dropDuplicates(["episode_id", "window_index"])


def missing_windows(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned windows without a partial result, to resume from."""
    return planned.join(done.select("episode_id", "window_index").distinct(), ["episode_id", "window_index"], "left_anti")


def resume_windows(spark: SparkSession, planned: DataFrame, path: str, schema: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all planned windows: those at ``path`` are reused, ``compute`` makes the
    missing ones, which are written there first."""
    spark.createDataFrame([], schema).write.mode("ignore").json(path)
    write_windows(compute(missing_windows(planned, read_windows(spark, path, schema))), path)
    return read_windows(spark, path, schema).join(planned.select("episode_id", "window_index"), ["episode_id", "window_index"], "left_semi")


def clear_windows(spark: SparkSession, path: str, episode_ids: Sequence) -> None:
    """Delete the partial results of finished episodes, whose ids a caller names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i in episode_ids:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/episode_id={i}")
        target.getFileSystem(conf).delete(target, True)


def write_report(report: DataFrame, path: str, per_query: DataFrame | None = None, timestamp: str | None = None) -> None:
    """A report of one row as JSON at ``path``, with the time given, and the rows that it
    averages as JSON lines beside it."""
    if timestamp:
        report = report.select(F.lit(timestamp).alias("timestamp"), "*")
    report.coalesce(1).write.mode("overwrite").json(path)
    if per_query is not None:
        per_query.write.mode("overwrite").json(f"{path}-per-query")
