"""Joins over time and character intervals: an equality on the episode plus a residual.

Spark plans them as hash or sort-merge joins on the key.  ``bucket`` splits both sides by
time as well, so that a long episode is many keys and a row meets its neighbours only: a
pair is kept in the bucket where the later of the two begins, so none is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of an episode that are one key of a join.
BUCKET = 1800.0


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def interval_join(left: DataFrame, right: DataFrame, key: str, reach: float = 0.0, how: str = "inner", bucket: float | None = None) -> DataFrame:
    """Pairs of one ``key`` whose ``[start_time, end_time]`` lie at most ``reach`` apart
    (overlap of at least ``-reach``).  Columns are prefixed ``l_`` and ``r_``."""
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    near = overlap(F.col("l_start_time"), F.col("l_end_time"), F.col("r_start_time"), F.col("r_end_time")) >= -reach
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & near
    if bucket is None:
        return a.join(b, on, how)
    if how != "inner":
        raise ValueError("a bucketed interval join is an inner join")
    cell = lambda c: F.floor(c / bucket).cast("long")
    a = a.withColumn("l_cell", F.explode(F.sequence(cell(F.col("l_start_time") - reach), cell(F.col("l_end_time") + reach))))
    b = b.withColumn("r_cell", F.explode(F.sequence(cell(F.col("r_start_time")), cell(F.col("r_end_time")))))
    first = F.greatest(cell(F.col("l_start_time") - reach), cell(F.col("r_start_time")))
    pairs = a.join(b, on & (F.col("l_cell") == F.col("r_cell")) & (F.col("l_cell") == first))
    return pairs.drop("l_cell", "r_cell")


def segments_in_turns(segments: DataFrame, turns: DataFrame, min_ratio: float = 0.5, bucket: float | None = BUCKET) -> DataFrame:
    """``episode_id, chunk_index, segment_index, ratio``: segments of which at least
    ``min_ratio`` lies in a turn.  A segment split in half belongs to both turns."""
    pairs = interval_join(turns, segments, "episode_id", bucket=bucket)
    shared = overlap(F.col("l_start_time"), F.col("l_end_time"), F.col("r_start_time"), F.col("r_end_time"))
    length = F.col("r_end_time") - F.col("r_start_time")
    ratio = F.try_divide(shared, length)
    return pairs.filter((shared > 0) & (length > 0) & (ratio >= min_ratio)).select(
        F.col("l_episode_id").alias("episode_id"), F.col("l_chunk_index").alias("chunk_index"), F.col("r_segment_index").alias("segment_index"),
        F.col("r_start_time").alias("segment_start"), F.col("r_text").alias("segment_text"), ratio.alias("ratio"),
    )


def align_turns(segments: DataFrame, turns: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """Turns with the text of their segments, in start order; turns without a match
    keep the text they had.  ``aligned`` tells which were updated."""
    matched = segments_in_turns(segments, turns, min_ratio).groupBy("episode_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("segment_start", "segment_index", F.trim("segment_text").alias("t")))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    joined = turns.join(matched, ["episode_id", "chunk_index"], "left")
    return joined.withColumn("aligned", F.col("parts").isNotNull()).withColumn("text", F.coalesce(text, F.col("text"))).drop("parts")


def speaker_of_segments(segments: DataFrame, turns: DataFrame, tolerance: float = 2.0, bucket: float | None = BUCKET) -> DataFrame:
    """Segments with the speaker of the turn they overlap most (ties to the earliest
    turn).  Where none overlaps, or that turn has no label, it is the speaker of the
    nearest turn at most ``tolerance`` away (overlapping turns are at distance 0, ties
    to the earliest); null where that has no label either, or there is none."""
    pairs = interval_join(segments.select("episode_id", "segment_index", "start_time", "end_time"), turns.select("episode_id", "chunk_index", "start_time", "end_time", "speaker"), "episode_id", reach=tolerance, bucket=bucket)
    shared = overlap(F.col("l_start_time"), F.col("l_end_time"), F.col("r_start_time"), F.col("r_end_time"))
    place = (F.col("r_start_time"), F.col("r_chunk_index"))
    most = F.min_by("r_speaker", F.when(shared > 0, F.struct(-shared, *place)))
    nearest = F.min_by("r_speaker", F.struct(F.greatest(-shared, F.lit(0.0)), *place))
    label = lambda c: F.nullif(c, F.lit(""))
    best = pairs.groupBy(F.col("l_episode_id").alias("episode_id"), F.col("l_segment_index").alias("segment_index")).agg(F.coalesce(label(most), label(nearest)).alias("matched_speaker"))
    return segments.join(best, ["episode_id", "segment_index"], "left")


def speakers_in_ranges(ranges: DataFrame, turns: DataFrame, bucket: float | None = BUCKET) -> DataFrame:
    """Ranges (``episode_id, chunk_index, start_time, end_time``) with the sorted labels
    of the turns that overlap them; none is null."""
    labelled = turns.filter(F.coalesce("speaker", F.lit("")) != "")
    pairs = interval_join(ranges.select("episode_id", "chunk_index", "start_time", "end_time"), labelled.select("episode_id", "start_time", "end_time", "speaker"), "episode_id", bucket=bucket)
    strict = (F.col("r_start_time") < F.col("l_end_time")) & (F.col("r_end_time") > F.col("l_start_time"))
    found = pairs.filter(strict).groupBy(F.col("l_episode_id").alias("episode_id"), F.col("l_chunk_index").alias("chunk_index")).agg(F.array_sort(F.collect_set("r_speaker")).alias("speakers"))
    return ranges.join(found, ["episode_id", "chunk_index"], "left")


def times_at_offsets(ranges: DataFrame, offsets: DataFrame) -> DataFrame:
    """Times of character ranges: the start of the first segment that ends at or after
    the range's start, and the end of the last that starts at or before its end; 0.0
    where there is none.  ``ranges``: ``episode_id, chunk_index, start_char, end_char``;
    ``offsets``: ``episode_id, start_char, end_char, start_time, end_time``, where no two
    of an episode overlap.

    Both sides are put in one order, and each range takes what stands next to it: no
    range meets more than its neighbours."""
    none = F.lit(None).cast("double")
    r = ranges.select("episode_id", "chunk_index", F.lit(1).alias("kind"), F.col("start_char").alias("from_char"), F.col("end_char").alias("to_char"), none.alias("start_time"), none.alias("end_time"))
    o = offsets.select("episode_id", F.lit(None).cast(ranges.schema["chunk_index"].dataType).alias("chunk_index"), F.lit(0).alias("kind"), F.col("end_char").alias("from_char"), F.col("start_char").alias("to_char"), "start_time", "end_time")
    so_far = lambda *order: Window.partitionBy("episode_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = lambda column, order: F.coalesce(F.last(F.when(F.col("kind") == 0, F.struct(column)), ignorenulls=True).over(order)[column], F.lit(0.0))
    both = o.unionByName(r)
    both = both.withColumn("first", near("start_time", so_far(F.desc("from_char"), "kind"))).withColumn("last", near("end_time", so_far("to_char", "kind")))
    return both.filter("kind = 1").select("episode_id", "chunk_index", "from_char", "to_char", F.col("first").alias("start_time"), F.col("last").alias("end_time"))
