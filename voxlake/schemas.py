"""Tables of the engine, and a store of them in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "episodes": """id string, title string, published_at string, duration_seconds int, description string, audio_url string, image_url string, explicit string,
        downloaded boolean, transcribed boolean, chunked boolean, diarized boolean, indexed boolean, created_at timestamp, updated_at timestamp""",
    "transcriptions": """id int, episode_id string, full_text string, language string, model_used string, created_at timestamp, total_segments int, total_chars int,
        estimated_words int, avg_logprob double, repetition_rate double, chars_per_minute double, language_confidence double, hallucination_flag boolean""",
    "transcription_segments": "episode_id string, transcription_id int, segment_index int, text string, start_time double, end_time double, avg_logprob double, created_at timestamp",
    "turns": "episode_id string, transcription_id int, chunk_index int, text string, start_time double, end_time double, speaker string, embedding_id string, created_at timestamp",
    "rag_chunks": "episode_id string, chunk_index int, text string, token_count int, start_time double, end_time double, speakers array<string>, embedding_id string, created_at timestamp",
    "speakers": """id int, name string, role string, is_host boolean, voice_embedding array<double>, embedding_count int, avg_confidence double, confidence_threshold double,
        first_seen_episode string, last_seen_episode string, total_appearances int, enrollment_episodes array<string>, created_at timestamp, updated_at timestamp""",
    "speaker_embeddings": "id int, speaker_id int, episode_id string, embedding array<double>, confidence double, source string, created_at timestamp",
    "vectors": """id string, embedding array<float>, document string, metadata struct<episode_id: string, episode_title: string, published_at: string,
        duration_seconds: int, chunk_index: int, start_time: double, end_time: double, speakers: string, token_count: int>""",
    "flags": "episode_id string, flag string, set_at timestamp",
}
#: Flags of an episode that ``Store.mark`` sets.
FLAGS = ("downloaded", "transcribed", "diarized", "chunked", "indexed")


class Store:
    """Parquet tables of one folder; columns added later read as null in older files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self) -> Store:
        """Create the tables that do not exist; those that do are left as they are."""
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")
        return self

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).option("mergeSchema", True).parquet(f"{self.path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(self.read(name).columns).write.mode("append").parquet(f"{self.path}/{name}")

    def mark(self, flag: str, episode_ids: DataFrame) -> None:
        """Set a flag of episodes (their ids are the first column).  Flags are rows that
        are only ever added, so setting one twice changes nothing and no table is
        rewritten."""
        if flag not in FLAGS:
            raise ValueError(flag)
        ids = episode_ids.select(F.col(episode_ids.columns[0]).cast("string").alias("episode_id")).distinct()
        self.append("flags", ids.withColumn("flag", F.lit(flag)).withColumn("set_at", F.current_timestamp()))

    def episodes(self) -> DataFrame:
        """The episodes with the flags that their row or a mark sets."""
        set_by = self.read("flags").groupBy(F.col("episode_id").alias("id")).agg(*[F.max(F.when(F.col("flag") == f, F.lit(True))).alias(f"_{f}") for f in FLAGS])
        joined = self.read("episodes").join(set_by, "id", "left")
        return joined.withColumns({f: F.coalesce(f"_{f}", f, F.lit(False)) for f in FLAGS}).drop(*[f"_{f}" for f in FLAGS])

    def views(self) -> None:
        """Temporary views of all tables, for ``spark.sql``."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)
