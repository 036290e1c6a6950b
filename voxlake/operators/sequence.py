"""Ordered operators within an episode: windows planned, merged and relabelled, text
offsets, order checks, first-wins mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INTRO_PATTERNS, extract_name, round_even
from .intervals import speaker_of_segments


def needs_windows(duration, limit: float = 7200):
    """Whether a recording is longer than ``limit`` seconds."""
    return duration > limit


def plan_windows(episodes: DataFrame, size: float = 1800, overlap: float = 5) -> DataFrame:
    """``episode_id, window_index, start_time, end_time``: windows of ``size`` seconds,
    ``overlap`` shared, the last clipped to ``duration``; none without a duration."""
    stride, d = size - overlap, F.col("duration").cast("double")
    n = F.greatest(F.lit(1), F.ceil((d - size) / stride).cast("int") + 1)
    k = episodes.filter(d > 0).select("episode_id", d.alias("duration"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window_index"))
    start = (F.col("window_index") * stride).cast("double")
    return k.select("episode_id", "window_index", start.alias("start_time"), F.least(start + size, F.col("duration")).alias("end_time"))


def merge_windows(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments of all windows on the episode's clock: shifted by their window's start,
    dropped where they begin at or after the next window, rounded to 2 places and
    ordered by start, window and position."""
    after = Window.partitionBy("episode_id").orderBy("window_index")
    w = windows.select("episode_id", "window_index", F.col("start_time").alias("offset"), F.lead("start_time").over(after).alias("next"))
    s = segments.select("episode_id", "window_index", "position", "start_time", "end_time", "text").join(w, ["episode_id", "window_index"])
    s = s.withColumn("g_start", F.col("start_time") + F.col("offset")).withColumn("g_end", F.col("end_time") + F.col("offset"))
    s = s.filter(F.col("next").isNull() | (F.col("g_start") < F.col("next")))
    s = s.select("episode_id", "window_index", "position", round_even("g_start", 2).alias("start_time"), round_even("g_end", 2).alias("end_time"), "text")
    order = Window.partitionBy("episode_id").orderBy("start_time", "window_index", "position")
    return s.withColumn("segment_index", F.row_number().over(order) - 1)


def relabel_speakers(turns: DataFrame) -> DataFrame:
    """Window-local labels made global: labels sorted within their window, numbered on
    from those of all earlier windows.  Adds ``global_speaker`` and episode times."""
    local = Window.partitionBy("episode_id", "window_index").orderBy("speaker")
    t = turns.withColumn("local", F.dense_rank().over(local) - 1)
    counts = t.groupBy("episode_id", "window_index").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("episode_id").orderBy("window_index").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("episode_id", "window_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    t = t.join(counts, ["episode_id", "window_index"])
    label = F.format_string("SPEAKER_%02d", (F.col("base") + F.col("local")).cast("int"))
    return t.withColumn("global_speaker", label).withColumn("start_time", F.col("start_time") + F.col("offset")).withColumn("end_time", F.col("end_time") + F.col("offset")).drop("local", "base")


def text_offsets(segments: DataFrame) -> DataFrame:
    """Segments with their ``[start_char, end_char)`` in the episode's text: stripped,
    empty ones left out, joined by one space."""
    s = segments.withColumn("text", F.trim("text")).filter("text <> ''")
    order = Window.partitionBy("episode_id").orderBy("start_time", "segment_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
    return s.withColumn("start_char", start.cast("long")).withColumn("end_char", (F.col("start_char") + F.length("text")).cast("long"))


def order_violations(chunks: DataFrame) -> DataFrame:
    """``episode_id, violated``: whether some chunk starts before the one before it."""
    order = Window.partitionBy("episode_id").orderBy("chunk_index")
    back = F.coalesce(F.col("start_time") < F.lag("start_time").over(order), F.lit(False))
    return chunks.withColumn("back", back).groupBy("episode_id").agg(F.max("back").alias("violated"))


def first_names(named: DataFrame) -> DataFrame:
    """``episode_id, speaker, name, collisions``: the name of a speaker's first named
    segment, and how many later ones differ."""
    by = F.struct("start_time", "segment_index")
    first = named.groupBy("episode_id", "speaker").agg(F.min_by("name", by).alias("first"))
    both = named.join(first, ["episode_id", "speaker"])
    return both.groupBy("episode_id", "speaker", F.col("first").alias("name")).agg(F.count_if(F.col("name") != F.col("first")).alias("collisions"))


def enroll(segments: DataFrame, turns: DataFrame, aliases: Mapping[str, str] = {}, patterns: Sequence[str] = INTRO_PATTERNS["en"], intro: float = 300) -> DataFrame:
    """``episode_id, speaker, name, collisions`` from the introductions of an episode:
    segments and turns that start within its first ``intro`` seconds, each named segment
    given to its speaker, the first name of a speaker kept."""
    said = segments.filter(F.col("start_time") <= intro).withColumn("name", extract_name(F.col("text"), aliases, patterns)).filter("name is not null")
    named = speaker_of_segments(said.drop("speaker"), turns.filter(F.col("start_time") <= intro))
    return first_names(named.filter("matched_speaker is not null").withColumnRenamed("matched_speaker", "speaker"))


def speaker_rollup(enrolled: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Speakers over all episodes, computed anew so that a rerun changes nothing:
    appearances, first and last episode, role."""
    host = F.col("name").isin(*hosts) if hosts else F.lit(False)
    return enrolled.groupBy("name").agg(F.count("*").alias("total_appearances"), F.min("episode_id").alias("first_seen_episode"), F.max("episode_id").alias("last_seen_episode")).select(
        "name", host.alias("is_host"), F.when(host, "host").otherwise("guest").alias("role"), "total_appearances", "first_seen_episode", "last_seen_episode"
    )
