"""Relations of the engine derived from the test tables, as DataFrames and as SQL.

``CTES`` holds the same relations for the SQL twins.  All arithmetic is exact in both
engines (integers, divisions by powers of two)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: one per conversation turn, 16 characters a second."""
    c = load(spark, sf_dir, "conversations")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(upto)
    return c.select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("segment_index"), "text",
        ((end - F.length("text")) / 16.0).alias("start_time"), (end / 16.0).alias("end_time"), F.col("role").alias("speaker"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization turns: 28 of every 32 seconds, three speakers in rotation; a few have no
    label, null or empty."""
    ends = segments(spark, sf_dir).groupBy("episode_id").agg(F.max("end_time").alias("top"))
    t = ends.select("episode_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / 32))).alias("chunk_index"))
    start = (F.col("chunk_index") * 32 + F.col("episode_id") % 4).cast("double")
    mark = (F.col("episode_id") + F.col("chunk_index")) % 11
    return t.select(
        "episode_id", "chunk_index", start.alias("start_time"), (start + 28).alias("end_time"),
        F.when(mark == 3, F.lit(None)).when(mark == 7, F.lit("")).otherwise(F.concat(F.lit("SPEAKER_0"), (F.col("chunk_index") % 3).cast("string"))).alias("speaker"), F.lit(None).cast("string").alias("text"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with nested phase flags."""
    d, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    df = d.select(
        i.alias("id"), F.substring("text", 1, 60).alias("title"), ((i * 37) % 9000).alias("duration_seconds"), "lang", "source",
        F.when(i % 11 != 0, F.concat(F.lit("https://audio.example/"), i.cast("string"), F.lit(".mp3"))).alias("audio_url"),
        F.when(i % 13 != 0, F.substring("text", 1, 200)).otherwise("").alias("description"),
        F.when(i % 17 != 0, F.concat(F.lit("https://img.example/"), i.cast("string"))).otherwise("").alias("image_url"),
    )
    done = F.lit(True)
    i = F.col("id")
    for name, own in (("downloaded", i % 10 != 0), ("transcribed", i % 7 != 0), ("diarized", i % 5 != 0), ("chunked", i % 3 != 0), ("indexed", i % 2 == 0)):
        done = done & own
        df = df.withColumn(name, done)
    return df


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per transcribed episode, with its model and mean log-probability."""
    d, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        i.alias("episode_id"), F.col("text").alias("full_text"), F.col("lang").alias("language"), F.col("source").alias("model_used"),
        ((-(i % 100)).cast("double") / 100).alias("avg_logprob"), ((i * 37) % 9000).alias("duration_seconds"),
    )


CTES = {
    "v_segments": """v_segments AS (SELECT conv_id AS episode_id, turn AS segment_index, text,
  CAST(sum(length(text)) OVER w - length(text) AS DOUBLE) / 16 AS start_time, CAST(sum(length(text)) OVER w AS DOUBLE) / 16 AS end_time, role AS speaker
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "v_turns": """v_turns AS (SELECT episode_id, k AS chunk_index, CAST(32 * k + episode_id % 4 AS DOUBLE) AS start_time,
  CAST(32 * k + episode_id % 4 + 28 AS DOUBLE) AS end_time, CASE (episode_id + k) % 11 WHEN 3 THEN NULL WHEN 7 THEN '' ELSE 'SPEAKER_0' || CAST(k % 3 AS VARCHAR) END AS speaker
  FROM (SELECT episode_id, max(end_time) AS top FROM v_segments GROUP BY 1) e, unnest(range(0, CAST(floor(top / 32) AS BIGINT) + 1)) u(k))""",
    "v_episodes": """v_episodes AS (SELECT *, diarized AND id % 3 <> 0 AS chunked, diarized AND id % 3 <> 0 AND id % 2 = 0 AS indexed FROM (
  SELECT doc_id AS id, substring(text, 1, 60) AS title, (doc_id * 37) % 9000 AS duration_seconds, lang, source,
  CASE WHEN doc_id % 11 <> 0 THEN 'https://audio.example/' || doc_id || '.mp3' END AS audio_url,
  CASE WHEN doc_id % 13 <> 0 THEN substring(text, 1, 200) ELSE '' END AS description,
  CASE WHEN doc_id % 17 <> 0 THEN 'https://img.example/' || doc_id ELSE '' END AS image_url,
  doc_id % 10 <> 0 AS downloaded, doc_id % 10 <> 0 AND doc_id % 7 <> 0 AS transcribed, doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS diarized FROM documents))""",
    "v_transcripts": """v_transcripts AS (SELECT doc_id AS episode_id, text AS full_text, lang AS language, source AS model_used,
  CAST(-(doc_id % 100) AS DOUBLE) / 100 AS avg_logprob, (doc_id * 37) % 9000 AS duration_seconds FROM documents)""",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named relations in front; ``body`` may go on with further CTEs."""
    order = [n for n in CTES if n in names or (n == "v_segments" and "v_turns" in names)]
    head = ",\n".join(CTES[n] for n in order)
    return f"WITH {head}{',' if body.lstrip()[:6].upper() != 'SELECT' else ''}\n{body}"
