"""Aggregates and one-row quality reports, each in one pass over its input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import repetition_rate, round_even, words

PHASES = (("downloaded", ()), ("transcribed", ("downloaded",)), ("diarized", ("transcribed",)), ("chunked", ("transcribed", "diarized")), ("indexed", ("chunked",)))


def share(part: Column, whole: Column, places: int = 1) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return round_even(F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0)), places)


def catalog_report(episodes: DataFrame) -> DataFrame:
    """Episodes, downloads and missing fields; null, empty and zero are different
    things to miss, and the feed's own test takes null and empty alike."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return episodes.agg(
        F.count("*").alias("total"), F.count_if("downloaded").alias("downloaded"), F.count_if(~F.col("downloaded")).alias("pending"),
        F.count_if(F.col("audio_url").isNull()).alias("no_audio_url"), F.count_if(F.col("description") == "").alias("no_description"),
        F.count_if(F.col("image_url") == "").alias("no_image"), F.count_if(F.col("duration_seconds") == 0).alias("no_duration"),
        F.count_if(blank("audio_url")).alias("feed_no_audio"), F.count_if(blank("title")).alias("feed_no_title"),
    )


def duration_stats(episodes: DataFrame) -> DataFrame:
    """Hours in total, minutes on average, at least and at most, of episodes that have a
    duration; nulls where none has."""
    d = F.col("duration_seconds").cast("double")
    return episodes.filter(d > 0).agg(
        round_even(F.sum(d) / 3600, 1).alias("total_hours"), round_even(F.avg(d) / 60, 1).alias("avg_minutes"),
        round_even(F.min(d) / 60, 1).alias("min_minutes"), round_even(F.max(d) / 60, 1).alias("max_minutes"),
    )


def coverage(episodes: DataFrame) -> DataFrame:
    """``phase, eligible, done, pending, percent, status``: episodes whose required flags
    are all set, split by the phase's own flag, from one scan."""
    rows = []
    for k, (flag, needs) in enumerate(PHASES):
        eligible = reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit(False)) for n in needs], F.lit(True))
        rows.append(F.struct(F.lit(k + 1).alias("phase_id"), F.lit(flag).alias("phase"), eligible.alias("eligible"), F.coalesce(F.col(flag), F.lit(False)).alias("done")))
    long = episodes.select(F.inline(F.array(*rows)))
    counted = long.groupBy("phase_id", "phase").agg(F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("done")).alias("done"), F.count_if(F.col("eligible") & ~F.col("done")).alias("pending"))
    return counted.withColumn("percent", share(F.col("done"), F.col("eligible"))).withColumn("status", F.when(F.col("pending") == 0, "Complete").otherwise("Pending"))


def transcript_metrics(transcripts: DataFrame) -> DataFrame:
    """Per transcript: characters, estimated words, characters a minute, repetition rate
    and the flag for rates below one half, tested before rounding."""
    n = F.length("full_text").cast("long")
    rate = F.col("rate")
    minutes = F.col("duration_seconds").cast("double") / 60
    return transcripts.withColumn("rate", repetition_rate(words(F.col("full_text")))).select(
        "episode_id", "language", "model_used", n.alias("total_chars"), F.floor(n / 5).cast("long").alias("estimated_words"),
        round_even(F.coalesce(F.try_divide(n.cast("double"), minutes), F.lit(0.0)), 1).alias("chars_per_minute"),
        round_even("avg_logprob", 4).alias("avg_logprob"), round_even(rate, 4).alias("repetition_rate"), (rate < 0.5).alias("hallucination_flag"),
    )


def segment_metrics(segments: DataFrame) -> DataFrame:
    """Per episode, from its segments: their number, the characters of their joined
    text, and the mean log-probability, a missing one counting 0."""
    return segments.groupBy("episode_id").agg(
        F.count("*").alias("total_segments"), (F.sum(F.length(F.trim("text"))) + F.count("*") - 1).alias("total_chars"), F.max("end_time").alias("duration"),
        round_even(F.avg(F.coalesce("avg_logprob", F.lit(0.0))), 4).alias("avg_logprob"),
    )


def quality_report(metrics: DataFrame) -> DataFrame:
    """Totals, counts of weak transcripts and averages of non-zero values."""
    some = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    return metrics.agg(
        F.count("*").alias("total"), F.count_if(F.col("total_chars") < 100).alias("short_text"), F.count_if("hallucination_flag").alias("hallucinations"),
        F.count_if(F.col("avg_logprob") < -0.7).alias("low_confidence"), F.count_if(F.col("chars_per_minute") < 300).alias("slow"),
        F.count_if(F.col("repetition_rate") < 0.8).alias("repetitive"), F.round(some("avg_logprob"), 4).alias("avg_logprob"),
        F.round(some("chars_per_minute"), 2).alias("avg_cpm"), F.round(some("repetition_rate"), 4).alias("avg_repetition"),
        F.round(F.sum("total_chars") / 5).cast("long").alias("words"),
    )


def flagged_episodes(metrics: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row per episode and issue, from one scan and one join."""
    issues = F.array(
        F.when(F.col("hallucination_flag"), F.lit("hallucination")),
        F.when(F.col("avg_logprob") < -0.7, F.lit("low_confidence")),
        F.when(F.col("chars_per_minute") < 300, F.lit("low_density")),
    )
    return metrics.join(episodes.select(F.col("id").alias("episode_id"), "title"), "episode_id").select("episode_id", "title", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


def model_usage(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("model_used").agg(F.count("*").alias("n"))


def diarization_report(turns: DataFrame) -> DataFrame:
    """Speakers and turns per episode with turns, then over all; a missing label is a
    speaker of its own."""
    per = turns.groupBy("episode_id").agg(F.size(F.collect_set(F.coalesce("speaker", F.lit("<null>")))).alias("speakers"), F.count("*").alias("turns"), F.count("text").alias("with_text"))
    return per.agg(
        F.count("*").alias("episodes"), round_even(F.avg("speakers"), 1).alias("avg_speakers"), F.min("speakers").cast("long").alias("min_speakers"), F.max("speakers").cast("long").alias("max_speakers"),
        round_even(F.avg("turns"), 0).alias("avg_turns"), F.sum("turns").alias("total_turns"), F.sum("with_text").alias("turns_with_text"),
        F.count_if(F.col("with_text") > 0).alias("aligned_episodes"), share(F.sum("with_text"), F.sum("turns")).alias("alignment_rate"),
    )


def speaker_report(speakers: DataFrame) -> DataFrame:
    pick = lambda host: F.array_sort(F.collect_list(F.when(F.col("is_host") == host, F.col("name"))))
    return speakers.agg(F.count("*").alias("total"), F.count_if("is_host").alias("hosts"), F.count_if(~F.col("is_host")).alias("guests"), F.array_join(pick(True), ",").alias("host_names"), F.array_join(pick(False), ",").alias("guest_names"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """Sizes, durations and defects of retrieval chunks."""
    tokens = F.when(F.col("token_count") != 0, F.col("token_count"))
    length = F.col("end_time") - F.col("start_time")
    return chunks.agg(
        F.count("*").alias("chunks"), round_even(F.avg(tokens), 0).alias("avg_tokens"), F.min(tokens).cast("long").alias("min_tokens"), F.max(tokens).cast("long").alias("max_tokens"),
        round_even(F.avg(F.when(length > 0, length)), 1).alias("avg_duration"), F.count_if(length <= 0).alias("invalid_times"),
        F.count_if(tokens > 512).alias("oversized"), F.count_if(tokens < 50).alias("undersized"), F.count_if(F.col("speakers").isNull()).alias("no_speakers"),
    )


def chunks_per_episode(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Over chunked episodes, those without any chunk included."""
    counts = chunks.groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return episodes.filter("chunked").join(counts, "id", "left").agg(round_even(F.avg(n), 0).alias("avg_chunks"), F.min(n).cast("long").alias("min_chunks"), F.max(n).cast("long").alias("max_chunks"))


def language_vote(votes: DataFrame, key: str, label: str, probability: str) -> DataFrame:
    """The most frequent label per key, ties to the first in order, and the mean
    probability."""
    counted = votes.groupBy(key, label).agg(F.count("*").alias("n"), F.sum(probability).alias("p"))
    return counted.groupBy(key).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("language"), F.round(F.sum("p") / F.sum("n"), 6).alias("confidence"))


def has_issues(report: DataFrame, *counters: str) -> DataFrame:
    """The report with ``issues``: whether any of the named counters is above 0."""
    return report.withColumn("issues", reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) > 0 for c in counters]))
