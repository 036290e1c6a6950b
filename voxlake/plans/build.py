"""The batch build over a store: what each phase reads, computes, writes and marks.

Downloads and models come in as functions; alignment, chunking and indexing are plans.
Every phase takes what is pending, so running one again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_memory_error
from ..operators import chunking, intervals, rag, reports, sequence, vectors
from ..schemas import Store
from ..sources import audio
from .phases import PHASES, Phase, Settings, pending


def with_transcription(turns: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """``turns`` with the ``transcription_id`` of their episode, the least where it has
    several, null where it has none."""
    first = transcriptions.groupBy("episode_id").agg(F.min("id").alias("transcription_id"))
    return turns.drop("transcription_id").join(first, "episode_id", "left")


def whole_or_windows(items: DataFrame, whole: Callable[[DataFrame], DataFrame], windowed: Callable[[DataFrame], DataFrame], limit: float | None = None) -> DataFrame:
    """Results (``episode_id, output, error``) of ``items`` (``episode_id, duration, ...``).

    Items of up to ``limit`` seconds (None: all) are handled whole, the others in
    windows; an item that fails whole for want of memory is tried in windows too.  Other
    errors stay in ``error``.  ``whole`` is called once and its result is kept, as a
    model's run is not for free."""
    long = F.lit(False) if limit is None else sequence.needs_windows(F.col("duration"), limit)
    first = whole(items.filter(~F.coalesce(long, F.lit(False)))).select("episode_id", "output", "error").persist()
    short_of_memory = F.coalesce(is_memory_error(F.col("error")), F.lit(False))
    again = items.join(first.filter(short_of_memory).select("episode_id"), "episode_id", "left_semi")
    rest = windowed(items.filter(F.coalesce(long, F.lit(False))).unionByName(again)).select("episode_id", "output", "error")
    return first.filter(~short_of_memory).unionByName(rest)


def align(store: Store, ratio: float = 0.5) -> DataFrame:
    """Turns of the store with the text of their segments."""
    return intervals.align_turns(store.read("transcription_segments"), store.read("turns"), ratio).drop("aligned")


def chunk(store: Store, settings: Settings = Settings()) -> int:
    """Chunk the episodes that wait for it; the number of chunks written.  An episode
    without segments gets none and stays pending."""
    ids = pending(store.episodes(), "chunk").select(F.col("id").alias("episode_id"))
    segments, turns = (store.read(t).join(ids, "episode_id", "left_semi") for t in ("transcription_segments", "turns"))
    chunks = chunking.chunk_episodes(segments, turns, settings.chunk_size, settings.chunk_overlap)
    name = F.concat_ws("_", "episode_id", "chunk_index")
    chunks = chunks.withColumn("chunk_index", F.col("chunk_index").cast("int")).withColumn("embedding_id", name).withColumn("created_at", F.current_timestamp())
    return _added(store, "rag_chunks", chunks, "chunked", ids)


def index(store: Store, encoder: Callable | None = None) -> int:
    """Encode the chunks of the episodes that wait for it and add them to the vectors;
    the number of vectors written."""
    episodes = store.episodes()
    ids = pending(episodes, "index").select(F.col("id").alias("episode_id"))
    chunks = store.read("rag_chunks").drop("embedding_id").join(ids, "episode_id", "left_semi")
    encoded = vectors.encode_index(vectors.with_metadata(chunks, episodes), encoder or (lambda: vectors.hashed_bag))
    return _added(store, "vectors", vectors.vector_rows(encoded), "indexed", ids, F.col("metadata.episode_id"))


def _added(store: Store, table: str, rows: DataFrame, flag: str, ids: DataFrame, key=None) -> int:
    """Append rows and mark their episodes.  Rows that a broken run left behind without a
    mark are not added again: the mark is set for them first."""
    key = F.col("episode_id") if key is None else key
    done = store.read(table).select(key.alias("episode_id")).distinct().join(ids, "episode_id", "left_semi")
    store.mark(flag, done)
    before = store.read(table).count()
    fresh = rows.withColumn("_key", key).join(store.read(table).select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")
    store.append(table, fresh)
    store.mark(flag, store.read(table).select(key.alias("episode_id")).distinct().join(ids, "episode_id", "left_semi"))
    return store.read(table).count() - before


def evaluate_answers(asked: DataFrame, judge: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``query_id, type`` and the judge's scores, reasoning and error for answers (``query_id,
    type, query, context_chunks, answer, reference``); queries without a reference answer
    are not judged.  A judge that fails is an error of its row.
    :func:`metrics.by_type` averages the scores."""
    prompts = asked.filter("reference is not null").select("query_id", "type", rag.judge_prompt(F.col("query"), F.col("context_chunks"), F.col("answer"), F.col("reference")).alias("prompt"))
    replies = audio.apply_model(prompts, "query_id", "prompt", judge)
    parsed = replies.select("query_id", rag.parse_judge(F.col("output")).alias("j"), F.col("error").alias("failed")).select("query_id", "j.*", "failed")
    parsed = parsed.withColumn("error", F.coalesce("failed", "error")).drop("failed")
    return prompts.select("query_id", "type").join(parsed, "query_id")


def phases(store: Store, settings: Settings = Settings(), hooks: dict[str, Callable[[], object]] = {}, encoder: Callable | None = None) -> tuple[Phase, ...]:
    """The registry with something to run in every phase that has it: ``hooks`` by name
    for ingestion, transcription and diarization, the plans for the others."""
    own = {"chunking": lambda: chunk(store, settings), "indexing": lambda: index(store, encoder)}
    return tuple(replace(p, run=hooks.get(p.name, own.get(p.name))) for p in PHASES)


def status(store: Store) -> DataFrame:
    return reports.coverage(store.episodes())


def ask(store: Store, questions: DataFrame, settings: Settings = Settings(), encoder: Callable | None = None, episode_id=None, speaker: str | None = None, model: str = "extractive", **more) -> DataFrame:
    """``query_id, answer, sources, chunks_used, context_chunks, model`` for questions
    (``query_id, query``) over the vectors of the store; ``more`` goes to
    :func:`rag.answers` (``generate``, ``refusal``, ``language``)."""
    found = vectors.search_text(store.read("vectors"), questions, encoder, settings.n_chunks, episode_id, speaker)
    return rag.answers(questions, found, settings.min_similarity, **more).withColumn("model", F.lit(model))
