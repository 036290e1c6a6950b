"""Catalogue of the engine's queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, intervals, metrics, rag, reports, sequence, vectors
from ..sources import catalog as sources
from ..views import episodes, load, segments, transcripts, turns, with_views
from . import build, phases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


# --- Time alignment ---------------------------------------------------------------

_PAIRS = """pairs AS (SELECT t.episode_id, t.chunk_index, s.segment_index, s.start_time AS segment_start, s.text AS segment_text,
  (least(t.end_time, s.end_time) - greatest(t.start_time, s.start_time)) / (s.end_time - s.start_time) AS ratio
  FROM v_turns t JOIN v_segments s USING (episode_id)
  WHERE s.end_time > s.start_time AND least(t.end_time, s.end_time) > greatest(t.start_time, s.start_time)
    AND (least(t.end_time, s.end_time) - greatest(t.start_time, s.start_time)) / (s.end_time - s.start_time) >= 0.5)"""


@query(_PAIRS + "\nSELECT episode_id, chunk_index, segment_index, round(ratio, 6) AS ratio FROM pairs", "v_segments", "v_turns")
def align_overlap_pairs(spark, sf_dir):
    pairs = intervals.segments_in_turns(segments(spark, sf_dir), turns(spark, sf_dir))
    return pairs.select("episode_id", "chunk_index", "segment_index", F.round("ratio", 6).alias("ratio"))


@query(_PAIRS + """, m AS (SELECT episode_id, chunk_index, string_agg(trim(segment_text, ' '), ' ' ORDER BY segment_start, segment_index) AS text FROM pairs GROUP BY ALL)
SELECT t.episode_id, t.chunk_index, m.text, m.episode_id IS NOT NULL AS aligned FROM v_turns t LEFT JOIN m USING (episode_id, chunk_index)""", "v_segments", "v_turns")  # fmt: skip
def align_turns(spark, sf_dir):
    return intervals.align_turns(segments(spark, sf_dir), turns(spark, sf_dir)).select("episode_id", "chunk_index", "text", "aligned")


def _nearest(segs: str = "v_segments", turns: str = "v_turns") -> str:
    """CTEs ``p`` and ``n``: the speaker of every segment that has a turn within reach."""
    first = "(arg_min(struct_pack(s := speaker), row({}, start_time, chunk_index)){}).s"
    most, near = first.format("-shared", " FILTER (WHERE shared > 0)"), first.format("greatest(-shared, 0.0)", "")
    return f"""p AS (SELECT s.episode_id, s.segment_index, t.speaker, t.start_time, t.chunk_index,
  least(t.end_time, s.end_time) - greatest(t.start_time, s.start_time) AS shared FROM {segs} s JOIN {turns} t USING (episode_id)),
n AS (SELECT episode_id, segment_index, coalesce(nullif({most}, ''), nullif({near}, '')) AS speaker FROM p WHERE shared >= -2.0 GROUP BY ALL)"""


@query(_nearest() + """
SELECT s.episode_id, s.segment_index, n.speaker AS matched_speaker FROM v_segments s LEFT JOIN n USING (episode_id, segment_index)""", "v_segments", "v_turns")  # fmt: skip
def speaker_for_segment(spark, sf_dir):
    return intervals.speaker_of_segments(segments(spark, sf_dir), turns(spark, sf_dir)).select("episode_id", "segment_index", "matched_speaker")


@query("""r AS (SELECT s.episode_id, s.segment_index, array_to_string(list_sort(list(DISTINCT t.speaker)), ',') AS speakers
  FROM v_segments s JOIN v_turns t ON s.episode_id = t.episode_id AND t.start_time < s.end_time AND t.end_time > s.start_time WHERE t.speaker <> '' GROUP BY ALL)
SELECT s.episode_id, s.segment_index, r.speakers FROM v_segments s LEFT JOIN r USING (episode_id, segment_index)""", "v_segments", "v_turns")  # fmt: skip
def speakers_in_range(spark, sf_dir):
    ranges = segments(spark, sf_dir).withColumnRenamed("segment_index", "chunk_index").drop("speaker")
    found = intervals.speakers_in_ranges(ranges, turns(spark, sf_dir))
    return found.select("episode_id", F.col("chunk_index").alias("segment_index"), F.array_join("speakers", ",").alias("speakers"))


_OFFSETS = """offs AS (SELECT *, start_char + length(trimmed) AS end_char FROM (SELECT *,
  CAST(coalesce(sum(length(trimmed) + 1) OVER (PARTITION BY episode_id ORDER BY start_time, segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
  FROM (SELECT *, trim(text, ' ') AS trimmed FROM v_segments) WHERE trimmed <> ''))"""


@query(_OFFSETS + "\nSELECT episode_id, segment_index, start_char, end_char FROM offs", "v_segments")
def offsets_text(spark, sf_dir):
    return sequence.text_offsets(segments(spark, sf_dir)).select("episode_id", "segment_index", "start_char", "end_char")


@query(_OFFSETS + """, ranges AS (SELECT DISTINCT episode_id, start_char // 400 AS chunk_index, (start_char // 400) * 400 + 100 AS from_char, (start_char // 400) * 400 + 300 AS to_char FROM offs)
SELECT r.episode_id, r.chunk_index,
  coalesce(arg_min(o.start_time, o.start_char) FILTER (WHERE o.end_char >= from_char), 0.0) AS start_time,
  coalesce(arg_max(o.end_time, o.start_char) FILTER (WHERE o.start_char <= to_char), 0.0) AS end_time
FROM ranges r JOIN offs o USING (episode_id) GROUP BY ALL""", "v_segments")  # fmt: skip
def offset_time_lookup(spark, sf_dir):
    offsets = sequence.text_offsets(segments(spark, sf_dir))
    k = F.floor(F.col("start_char") / 400)
    ranges = offsets.select("episode_id", k.alias("chunk_index"), (k * 400 + 100).alias("start_char"), (k * 400 + 300).alias("end_char")).distinct()
    return intervals.times_at_offsets(ranges, offsets).select("episode_id", "chunk_index", "start_time", "end_time")


@query("""c AS (SELECT episode_id, chunk_index, CASE WHEN (episode_id + chunk_index) % 7 = 0 THEN start_time - 40 ELSE start_time END AS start_time FROM v_turns),
l AS (SELECT episode_id, coalesce(start_time < lag(start_time) OVER (PARTITION BY episode_id ORDER BY chunk_index), false) AS back FROM c)
SELECT episode_id, bool_or(back) AS violated FROM l GROUP BY 1""", "v_segments", "v_turns")  # fmt: skip
def chunk_order_violations(spark, sf_dir):
    early = F.when((F.col("episode_id") + F.col("chunk_index")) % 7 == 0, F.col("start_time") - 40).otherwise(F.col("start_time"))
    return sequence.order_violations(turns(spark, sf_dir).withColumn("start_time", early))


# --- Windows, speakers, names -----------------------------------------------------


@query("""w AS (SELECT id AS episode_id, CAST(duration_seconds AS DOUBLE) AS d, unnest(range(0, greatest(1, CAST(ceil((duration_seconds - 1800) / 1795.0) AS BIGINT) + 1))) AS k FROM v_episodes WHERE duration_seconds > 0)
SELECT episode_id, CAST(k AS INT) AS window_index, CAST(k * 1795 AS DOUBLE) AS start_time, least(CAST(k * 1795 + 1800 AS DOUBLE), d) AS end_time, d > 7200 AS windowed FROM w""", "v_episodes")  # fmt: skip
def window_plan(spark, sf_dir):
    e = episodes(spark, sf_dir).select(F.col("id").alias("episode_id"), F.col("duration_seconds").alias("duration"))
    planned = sequence.plan_windows(e)
    return planned.join(e.select("episode_id", sequence.needs_windows(F.col("duration")).alias("windowed")), "episode_id")


_WINDOWED = """local AS (SELECT episode_id, CAST(segment_index // 2 AS BIGINT) AS window_index, segment_index % 2 AS position, (segment_index // 2) * 20.0 AS off, start_time / 2 AS start_time, end_time / 2 AS end_time, text, speaker FROM v_segments)"""


def _windowed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    k = F.floor(F.col("segment_index") / 2)
    s = s.select("episode_id", k.alias("window_index"), (F.col("segment_index") % 2).alias("position"), (k * 20.0).alias("offset"), (F.col("start_time") / 2).alias("start_time"), (F.col("end_time") / 2).alias("end_time"), "text", "speaker")
    return s.select("episode_id", "window_index", F.col("offset").alias("start_time")).distinct(), s


@query(_WINDOWED + """, w AS (SELECT *, lead(off) OVER (PARTITION BY episode_id ORDER BY window_index) AS nxt FROM (SELECT DISTINCT episode_id, window_index, CAST(off AS DOUBLE) AS off FROM local)),
g AS (SELECT l.episode_id, l.window_index, l.position, round_even(l.start_time + w.off, 2) AS start_time, round_even(l.end_time + w.off, 2) AS end_time
  FROM local l JOIN w USING (episode_id, window_index) WHERE nxt IS NULL OR l.start_time + w.off < nxt)
SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY start_time, window_index, position) - 1 AS INT) AS segment_index FROM g""", "v_segments")  # fmt: skip
def merge_windows(spark, sf_dir):
    windows, parts = _windowed(spark, sf_dir)
    return sequence.merge_windows(windows, parts).drop("text")


@query(_WINDOWED + """, d AS (SELECT *, dense_rank() OVER (PARTITION BY episode_id, window_index ORDER BY speaker) - 1 AS loc FROM local),
c AS (SELECT episode_id, window_index, coalesce(sum(n) OVER (PARTITION BY episode_id ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM (SELECT episode_id, window_index, max(loc) + 1 AS n FROM d GROUP BY ALL))
SELECT episode_id, window_index, position, printf('SPEAKER_%02d', CAST(base + loc AS BIGINT)) AS global_speaker, d.start_time + CAST(off AS DOUBLE) AS start_time FROM d JOIN c USING (episode_id, window_index)""", "v_segments")  # fmt: skip
def relabel_speakers(spark, sf_dir):
    return sequence.relabel_speakers(_windowed(spark, sf_dir)[1]).select("episode_id", "window_index", "position", "global_speaker", "start_time")


_HOSTS = {"captain anders": "Anders Holm", "anders": "Anders Holm", "bea": "Bea Lindt"}
_INTRO = r"""spoken AS (SELECT *, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda w: w <> '') AS w FROM v_segments),
intro AS (SELECT * EXCLUDE (text), CASE segment_index % 5 WHEN 0 THEN 'Hello, this is ' || w[1] || ' ' || w[2] || ' ' || w[3] || ', welcome' WHEN 1 THEN 'hi i''m ' || w[1] || ' and more'
  WHEN 2 THEN 'my name is Li and so on' WHEN 3 THEN 'here is Captain Anders, said ' || w[1] ELSE w[1] || ' bea ' || w[2] || ' this is' END AS text FROM spoken)"""
_NAME = r"""low AS (SELECT *, lower(text) AS l FROM intro),
ways AS (SELECT *, [regexp_extract(l, 'this is ([^,]+?)(?:,|\s+from\s|\s+and\s|$)', 1), regexp_extract(l, 'i''?m ([^,]+?)(?:,|\s+from\s|\s+and\s|$)', 1), regexp_extract(l, 'my name is ([^,]+?)(?:,|\s+from\s|\s+and\s|$)', 1)] AS found FROM low),
cut AS (SELECT *, list_filter(list_transform(found, lambda f: array_to_string(list_transform(list_filter(regexp_split_to_array(trim(f), '\s+'), lambda x: x <> '')[1:2], lambda x: upper(x[1:1]) || x[2:]), ' ')), lambda f: length(f) > 2) AS names FROM ways),
named AS (SELECT *, CASE WHEN regexp_matches(l, '\banders\b') THEN 'Anders Holm' WHEN regexp_matches(l, '\bbea\b') THEN 'Bea Lindt' ELSE names[1] END AS name FROM cut)"""


def _intros(spark, sf_dir) -> DataFrame:
    """Segments that say something else: introductions made of their own words."""
    s = segments(spark, sf_dir)
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda w: w != "")
    k, w = F.col("segment_index") % 5, [F.get(words, F.lit(j)) for j in range(3)]
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    said = F.when(k == 0, join("Hello, this is ", w[0], " ", w[1], " ", w[2], ", welcome")).when(k == 1, join("hi i'm ", w[0], " and more")).when(k == 2, "my name is Li and so on")
    said = said.when(k == 3, join("here is Captain Anders, said ", w[0])).otherwise(join(w[0], " bea ", w[1], " this is"))
    return s.withColumn("text", said)


@query(_INTRO + ", " + _NAME + "\nSELECT episode_id, segment_index, name FROM named", "v_segments")
def name_extraction(spark, sf_dir):
    return _intros(spark, sf_dir).select("episode_id", "segment_index", tx.extract_name(F.col("text"), _HOSTS).alias("name"))


_FIRST = _INTRO + ", " + _NAME + ", early AS (SELECT * FROM named WHERE start_time <= 300), early_turns AS (SELECT * FROM v_turns WHERE start_time <= 300), " + _nearest("early", "early_turns") + """,
m AS (SELECT d.episode_id, n.speaker, d.name, d.start_time, d.segment_index FROM early d JOIN n USING (episode_id, segment_index) WHERE d.name IS NOT NULL AND n.speaker IS NOT NULL),
f AS (SELECT episode_id, speaker, arg_min(name, row(start_time, segment_index)) AS first FROM m GROUP BY ALL),
e AS (SELECT m.episode_id, m.speaker, f.first AS name, count(*) FILTER (WHERE m.name <> f.first) AS collisions FROM m JOIN f USING (episode_id, speaker) GROUP BY ALL)"""


def _enrolled(spark, sf_dir) -> DataFrame:
    return sequence.enroll(_intros(spark, sf_dir), turns(spark, sf_dir), _HOSTS)


@query(_FIRST + "\nSELECT * FROM e", "v_segments", "v_turns")
def enroll_first_wins(spark, sf_dir):
    return _enrolled(spark, sf_dir)


@query(_FIRST + """
SELECT name, name IN ('Anders Holm', 'Bea Lindt') AS is_host, CASE WHEN name IN ('Anders Holm', 'Bea Lindt') THEN 'host' ELSE 'guest' END AS role, count(*) AS total_appearances,
  min(episode_id) AS first_seen_episode, max(episode_id) AS last_seen_episode FROM e GROUP BY 1""", "v_segments", "v_turns")  # fmt: skip
def speaker_rollup(spark, sf_dir):
    return sequence.speaker_rollup(_enrolled(spark, sf_dir), ("Anders Holm", "Bea Lindt"))


@query(_FIRST + """, s AS (SELECT DISTINCT name, name IN ('Anders Holm', 'Bea Lindt') AS is_host FROM e)
SELECT count(*) AS total, count(*) FILTER (WHERE is_host) AS hosts, count(*) FILTER (WHERE NOT is_host) AS guests,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE is_host), '') AS host_names, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT is_host), '') AS guest_names FROM s""", "v_segments", "v_turns")  # fmt: skip
def speaker_report(spark, sf_dir):
    return reports.speaker_report(sequence.speaker_rollup(_enrolled(spark, sf_dir), ("Anders Holm", "Bea Lindt")))


# --- Quality reports --------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array({}, '[\\s\\x{{00A0}}]+'), lambda w: w <> '')"
_RATE = """CASE WHEN len(ws) > 50 THEN len(list_distinct(list_transform(range(0, len(ws) - 50, 50), lambda k: array_to_string(ws[k + 1:k + 50], ' ')))) / len(range(0, len(ws) - 50, 50)) ELSE 1.0 END"""
_METRICS = f"""words AS (SELECT *, {_WORDS.format("full_text")} AS ws FROM v_transcripts), rated AS (SELECT *, CAST({_RATE} AS DOUBLE) AS rate FROM words),
metrics AS (SELECT episode_id, language, model_used, CAST(length(full_text) AS BIGINT) AS total_chars, CAST(length(full_text) // 5 AS BIGINT) AS estimated_words,
  round_even(CASE WHEN duration_seconds = 0 THEN 0.0 ELSE CAST(length(full_text) AS DOUBLE) / (CAST(duration_seconds AS DOUBLE) / 60) END, 1) AS chars_per_minute,
  round_even(avg_logprob, 4) AS avg_logprob, round_even(rate, 4) AS repetition_rate, rate < 0.5 AS hallucination_flag FROM rated)"""


@query(_METRICS + "\nSELECT * FROM metrics", "v_transcripts")
def transcript_metrics(spark, sf_dir):
    return reports.transcript_metrics(transcripts(spark, sf_dir))


@query(f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents)\nSELECT doc_id, CAST(len(ws) AS INT) AS n_words, round(CAST({_RATE} AS DOUBLE), 6) AS repetition_rate FROM w")
def repetition_rate(spark, sf_dir):
    measured = tx.let(tx.words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.round(tx.repetition_rate(w), 6).alias("repetition_rate")))
    return load(spark, sf_dir, "documents").select("doc_id", measured.alias("m")).select("doc_id", "m.n_words", "m.repetition_rate")


@query("""SELECT episode_id, count(*) AS total_segments, CAST(sum(length(trim(text, ' '))) + count(*) - 1 AS BIGINT) AS total_chars, max(end_time) AS duration,
  round_even(avg(CASE WHEN segment_index % 7 <> 0 THEN -CAST(segment_index % 50 AS DOUBLE) / 64 ELSE 0.0 END), 4) AS avg_logprob FROM v_segments GROUP BY 1""", "v_segments")  # fmt: skip
def segment_metrics(spark, sf_dir):
    k = F.col("segment_index")
    return reports.segment_metrics(segments(spark, sf_dir).withColumn("avg_logprob", F.when(k % 7 != 0, -(k % 50).cast("double") / 64)))


@query(_METRICS + """
SELECT count(*) AS total, count(*) FILTER (WHERE total_chars < 100) AS short_text, count(*) FILTER (WHERE hallucination_flag) AS hallucinations,
  count(*) FILTER (WHERE avg_logprob < -0.7) AS low_confidence, count(*) FILTER (WHERE chars_per_minute < 300) AS slow, count(*) FILTER (WHERE repetition_rate < 0.8) AS repetitive,
  round(avg(nullif(avg_logprob, 0)), 4) AS avg_logprob, round(avg(nullif(chars_per_minute, 0)), 2) AS avg_cpm, round(avg(nullif(repetition_rate, 0)), 4) AS avg_repetition,
  CAST(round(sum(total_chars) / 5) AS BIGINT) AS words, count(*) FILTER (WHERE hallucination_flag OR total_chars < 100) > 0 AS issues FROM metrics""", "v_transcripts")  # fmt: skip
def quality_report(spark, sf_dir):
    return reports.has_issues(reports.quality_report(reports.transcript_metrics(transcripts(spark, sf_dir))), "short_text", "hallucinations")


@query(_METRICS + """, j AS (SELECT m.*, e.title FROM metrics m JOIN v_episodes e ON e.id = m.episode_id)
SELECT episode_id, title, 'hallucination' AS issue FROM j WHERE hallucination_flag UNION ALL SELECT episode_id, title, 'low_confidence' FROM j WHERE avg_logprob < -0.7
UNION ALL SELECT episode_id, title, 'low_density' FROM j WHERE chars_per_minute < 300""", "v_transcripts", "v_episodes")  # fmt: skip
def flagged_episodes(spark, sf_dir):
    return reports.flagged_episodes(reports.transcript_metrics(transcripts(spark, sf_dir)), episodes(spark, sf_dir))


@query("SELECT source AS model_used, count(*) AS n FROM documents GROUP BY 1")
def model_usage(spark, sf_dir):
    return reports.model_usage(transcripts(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE downloaded) AS downloaded, count(*) FILTER (WHERE NOT downloaded) AS pending, count(*) FILTER (WHERE audio_url IS NULL) AS no_audio_url,
  count(*) FILTER (WHERE description = '') AS no_description, count(*) FILTER (WHERE image_url = '') AS no_image, count(*) FILTER (WHERE duration_seconds = 0) AS no_duration,
  count(*) FILTER (WHERE coalesce(audio_url, '') = '') AS feed_no_audio, count(*) FILTER (WHERE coalesce(title, '') = '') AS feed_no_title FROM v_episodes""", "v_episodes")  # fmt: skip
def catalog_report(spark, sf_dir):
    return reports.catalog_report(episodes(spark, sf_dir))


@query("""SELECT round_even(sum(CAST(duration_seconds AS DOUBLE)) / 3600, 1) AS total_hours, round_even(avg(CAST(duration_seconds AS DOUBLE)) / 60, 1) AS avg_minutes,
  round_even(min(CAST(duration_seconds AS DOUBLE)) / 60, 1) AS min_minutes, round_even(max(CAST(duration_seconds AS DOUBLE)) / 60, 1) AS max_minutes FROM v_episodes WHERE duration_seconds > 0""", "v_episodes")  # fmt: skip
def duration_stats(spark, sf_dir):
    return reports.duration_stats(episodes(spark, sf_dir))


_COVERAGE = """long AS (SELECT 1 AS phase_id, 'downloaded' AS phase, true AS eligible, downloaded AS done FROM v_episodes UNION ALL SELECT 2, 'transcribed', downloaded, transcribed FROM v_episodes
  UNION ALL SELECT 3, 'diarized', transcribed, diarized FROM v_episodes UNION ALL SELECT 4, 'chunked', transcribed AND diarized, chunked FROM v_episodes UNION ALL SELECT 5, 'indexed', chunked, indexed FROM v_episodes),
c AS (SELECT phase_id, phase, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE eligible AND done) AS done, count(*) FILTER (WHERE eligible AND NOT done) AS pending FROM long GROUP BY ALL)"""


@query(_COVERAGE + """
SELECT *, round_even(coalesce(CAST(done AS DOUBLE) * 100 / nullif(eligible, 0), 0.0), 1) AS percent, CASE WHEN pending = 0 THEN 'Complete' ELSE 'Pending' END AS status FROM c""", "v_episodes")  # fmt: skip
def coverage_by_phase(spark, sf_dir):
    return reports.coverage(episodes(spark, sf_dir))


@query(_COVERAGE + """
SELECT phase_id, CAST(phase_id AS VARCHAR) || '. ' || phase AS label, CAST(pending AS VARCHAR) || '/' || CAST(eligible AS VARCHAR) AS pending_of, done, CASE WHEN pending = 0 THEN 'Complete' WHEN phase_id = 3 THEN 'Running' ELSE 'Pending' END AS status FROM c""", "v_episodes")  # fmt: skip
def pipeline_dashboard(spark, sf_dir):
    c = reports.coverage(episodes(spark, sf_dir))
    status = F.when(F.col("pending") == 0, "Complete").when(F.col("phase_id") == 3, "Running").otherwise("Pending")
    return c.select("phase_id", F.format_string("%d. %s", "phase_id", "phase").alias("label"), F.format_string("%d/%d", "pending", "eligible").alias("pending_of"), "done", status.alias("status"))


@query(_PAIRS + """, a AS (SELECT t.*, m.text FROM v_turns t LEFT JOIN (SELECT episode_id, chunk_index, min(segment_text) AS text FROM pairs GROUP BY ALL) m USING (episode_id, chunk_index)),
p AS (SELECT episode_id, count(DISTINCT coalesce(speaker, '<null>')) AS speakers, count(*) AS turns, count(text) AS with_text FROM a GROUP BY 1)
SELECT count(*) AS episodes, round_even(avg(speakers), 1) AS avg_speakers, min(speakers) AS min_speakers, max(speakers) AS max_speakers, round_even(avg(turns), 0) AS avg_turns,
  CAST(sum(turns) AS BIGINT) AS total_turns, CAST(sum(with_text) AS BIGINT) AS turns_with_text, count(*) FILTER (WHERE with_text > 0) AS aligned_episodes,
  round_even(CAST(sum(with_text) AS DOUBLE) * 100 / CAST(sum(turns) AS DOUBLE), 1) AS alignment_rate FROM p""", "v_segments", "v_turns")  # fmt: skip
def diarization_report(spark, sf_dir):
    return reports.diarization_report(intervals.align_turns(segments(spark, sf_dir), turns(spark, sf_dir)))


_CHUNKS = """chunks AS (SELECT t.episode_id, t.chunk_index, t.start_time, CASE WHEN t.chunk_index % 6 = 5 THEN t.start_time ELSE t.end_time END AS end_time,
  CAST((t.episode_id * 31 + t.chunk_index * 97) % 600 AS INT) AS token_count, CASE WHEN t.chunk_index % 4 <> 3 THEN t.speaker END AS speakers FROM v_turns t)"""


def _chunks(spark, sf_dir) -> DataFrame:
    k = F.col("chunk_index")
    return turns(spark, sf_dir).select(
        "episode_id", k, "start_time", F.when(k % 6 == 5, F.col("start_time")).otherwise(F.col("end_time")).alias("end_time"),
        ((F.col("episode_id") * 31 + k * 97) % 600).cast("int").alias("token_count"), F.when(k % 4 != 3, F.col("speaker")).alias("speakers"),
    )


@query(_CHUNKS + """
SELECT count(*) AS chunks, round_even(avg(nullif(token_count, 0)), 0) AS avg_tokens, CAST(min(nullif(token_count, 0)) AS BIGINT) AS min_tokens, CAST(max(nullif(token_count, 0)) AS BIGINT) AS max_tokens,
  round_even(avg(end_time - start_time) FILTER (WHERE end_time > start_time), 1) AS avg_duration, count(*) FILTER (WHERE end_time <= start_time) AS invalid_times,
  count(*) FILTER (WHERE token_count > 512) AS oversized, count(*) FILTER (WHERE token_count < 50 AND token_count <> 0) AS undersized, count(*) FILTER (WHERE speakers IS NULL) AS no_speakers FROM chunks""", "v_segments", "v_turns")  # fmt: skip
def chunk_quality(spark, sf_dir):
    return reports.chunk_report(_chunks(spark, sf_dir))


@query(_CHUNKS + """, n AS (SELECT coalesce(c.n, 0) AS n FROM v_episodes e LEFT JOIN (SELECT episode_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.episode_id = e.id WHERE e.chunked)
SELECT round_even(avg(n), 0) AS avg_chunks, CAST(min(n) AS BIGINT) AS min_chunks, CAST(max(n) AS BIGINT) AS max_chunks FROM n""", "v_segments", "v_turns", "v_episodes")  # fmt: skip
def chunks_per_episode(spark, sf_dir):
    return reports.chunks_per_episode(episodes(spark, sf_dir), _chunks(spark, sf_dir))


@query("""WITH n AS (SELECT source, lang, count(*) AS n, sum(CAST(doc_id % 64 AS DOUBLE) / 64) AS p FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM n)
SELECT source, max(lang) FILTER (WHERE k = 1) AS language, round(sum(p) / sum(n), 6) AS confidence FROM r GROUP BY 1""")
def language_vote(spark, sf_dir):
    d = load(spark, sf_dir, "documents").withColumn("p", (F.col("doc_id") % 64).cast("double") / 64)
    return reports.language_vote(d, "source", "lang", "p")


@query("""WITH p AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id AS id, lang, 'old' AS version FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE doc_id NOT IN (FROM p)""")
def insert_if_absent(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    old, new = d.filter("id % 3 = 0").withColumn("version", F.lit("old")), d.withColumn("version", F.lit("new"))
    return sources.insert_if_absent(old, new.unionAll(new), order="version")


@query("SELECT id, trim(substring(regexp_replace(title, '[^\\p{L}\\p{N} _-]', '_', 'g'), 1, 80), ' ') || '.mp3' AS file_name FROM v_episodes", "v_episodes")
def safe_filename(spark, sf_dir):
    return episodes(spark, sf_dir).select("id", tx.audio_file_name(F.col("title")).alias("file_name"))


@query("SELECT 'demo' AS podcast, (SELECT count(*) FROM v_episodes) AS total_episodes, id, title, duration_seconds, image_url FROM v_episodes", "v_episodes")
def catalog_json(spark, sf_dir):
    e = episodes(spark, sf_dir).select("id", "title", "duration_seconds", "image_url")
    return sources.parsed_catalog(sources.catalog_parts(e, "demo"), e._jdf.schema().toDDL())


@query("""SELECT 'ep-' || doc_id AS id, 'Episode ' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(doc_id % 5000 AS INT) END AS duration_seconds,
  CASE WHEN doc_id % 3 = 0 THEN 'summary ' || lang ELSE 'content ' || lang END AS description, CASE WHEN doc_id % 5 <> 0 THEN 'https://a.example/' || doc_id || '.mp3' END AS audio_url,
  CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS explicit FROM documents""")
def rss_parse(spark, sf_dir):
    i = F.col("doc_id")
    t = i.cast("string")
    part = lambda keep, *xs: F.when(keep, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise("")
    xml = F.concat(
        F.lit("<item><guid>ep-"), t, F.lit("</guid><title>Episode "), t, F.lit("</title><description>summary "), "lang", F.lit("</description>"),
        part(i % 3 != 0, "<content:encoded>content ", F.col("lang"), "</content:encoded>"), part(i % 4 != 0, "<itunes:duration>", (i % 5000).cast("string"), "</itunes:duration>"),
        part(i % 5 != 0, '<enclosure url="https://a.example/', t, '.mp3" length="1"/>'), part(i % 2 == 0, "<itunes:explicit>yes</itunes:explicit>"), F.lit("</item>"),
    )
    parsed = load(spark, sf_dir, "documents").select(sources.parse_item(xml).alias("e"))
    return parsed.select("e.id", "e.title", "e.duration_seconds", "e.description", "e.audio_url", "e.explicit")


@query("""w AS (SELECT 'download' AS work, id FROM v_episodes WHERE NOT downloaded UNION ALL SELECT 'transcribe', id FROM v_episodes WHERE downloaded AND NOT transcribed
  UNION ALL SELECT 'diarize', id FROM v_episodes WHERE downloaded AND transcribed AND NOT diarized UNION ALL SELECT 'diarize_any', id FROM v_episodes WHERE downloaded AND NOT diarized
  UNION ALL SELECT 'align', id FROM v_episodes WHERE transcribed AND diarized UNION ALL SELECT 'chunk', id FROM v_episodes WHERE transcribed AND NOT chunked UNION ALL SELECT 'index', id FROM v_episodes WHERE chunked AND NOT indexed)
SELECT * FROM w UNION ALL (SELECT 'first_20', id FROM w WHERE work = 'index' ORDER BY id LIMIT 20)""", "v_episodes")  # fmt: skip
def pending_work(spark, sf_dir):
    e = episodes(spark, sf_dir)
    out = phases.pending(e, "index", limit=20).select(F.lit("first_20").alias("work"), "id")
    for work in phases.PENDING:
        out = out.unionByName(phases.pending(e, work).select(F.lit(work).alias("work"), "id"))
    return out


@query("""tr AS (SELECT id * 10 + k AS id, id AS episode_id FROM v_episodes, unnest(range(0, id % 3)) u(k))
SELECT t.episode_id, t.chunk_index, min(tr.id) AS transcription_id FROM v_turns t LEFT JOIN tr USING (episode_id) GROUP BY ALL""", "v_segments", "v_turns", "v_episodes")  # fmt: skip
def turns_transcription(spark, sf_dir):
    """Turns with their episode's transcription: none, one or two an episode."""
    e = episodes(spark, sf_dir).filter("id % 3 > 0").select(F.col("id").alias("episode_id"), F.explode(F.sequence(F.lit(0), (F.col("id") % 3 - 1).cast("int"))).alias("k"))
    tr = e.select((F.col("episode_id") * 10 + F.col("k")).alias("id"), "episode_id")
    return build.with_transcription(turns(spark, sf_dir), tr).select("episode_id", "chunk_index", "transcription_id")


# --- Vectors and retrieval --------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))))"
_TOPK = f"""n AS (SELECT *, {_NORM} AS norm FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS query_label, b.label, round({_DOT} / (a.norm * b.norm), 6) AS similarity FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM s)"""


def _ranked(spark, sf_dir, n=10) -> DataFrame:
    """The stated queries, every 20th vector, against all vectors."""
    v = load(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    return vectors.batch_search(v, q, n)


@query(f"WITH {_TOPK}\nSELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10")
def retrieval_topk_batch(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "vec_id", "similarity", "rank")


@query(f"WITH {_TOPK}\nSELECT query_id, vec_id, rank FROM r WHERE rank <= greatest(10, query_label * 3)")
def retrieval_topk_adaptive(spark, sf_dir):
    return _ranked(spark, sf_dir, F.greatest(F.lit(10), F.col("query_label") * 3)).select("query_id", "vec_id", "rank")


def _query_vector(spark, sf_dir) -> list[float]:
    """The stated query: the vector with id 0."""
    return load(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding


@query(f"WITH {_TOPK}, own AS (SELECT vec_id, similarity FROM s WHERE query_id = 0 UNION ALL SELECT 0, 1.0)\nSELECT vec_id, CAST(similarity AS DOUBLE) AS similarity FROM own ORDER BY similarity DESC, vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    return vectors.search(load(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 5).select("vec_id", "similarity")


@query(f"WITH {_TOPK}, t AS (SELECT vec_id, similarity FROM s WHERE query_id = 0 AND label = 3 ORDER BY similarity DESC, vec_id LIMIT 20)\nSELECT * FROM t WHERE similarity >= 0.1")
def vector_topk_filtered(spark, sf_dir):
    return vectors.search(load(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, (F.col("label") == 3) & (F.col("vec_id") != 0), 0.1).select("vec_id", "similarity")


_EVAL = _TOPK + """, e AS (SELECT query_id, count(*) FILTER (WHERE rank <= 10 AND label = query_label) AS hits, min(rank) FILTER (WHERE rank <= 10 AND label = query_label) AS first,
  count(*) FILTER (WHERE label = query_label) AS expected FROM r GROUP BY 1),
p AS (SELECT e.*, count(*) FILTER (WHERE r.rank <= least(10, e.expected) AND label = query_label) AS r_hits FROM e JOIN r USING (query_id) GROUP BY ALL),
m AS (SELECT query_id, round_even(hits / 10, 4) AS precision, round_even(hits / expected, 4) AS recall, round_even(coalesce(1 / first, 0.0), 4) AS mrr, round_even(r_hits / expected, 4) AS r_precision FROM p WHERE expected > 0)"""


def _scores(spark, sf_dir) -> DataFrame:
    """Relevant are the other vectors with the query's label."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _ranked(spark, sf_dir).join(v, "vec_id").select("query_id", "rank", (F.col("label") == F.col("query_label")).alias("relevant"))
    counts = v.groupBy("label").agg((F.count("*") - 1).alias("expected"))
    return metrics.evaluate_found(found, v.filter("vec_id % 20 = 0").join(counts, "label").select(F.col("vec_id").alias("query_id"), "expected"))


@query(f"WITH {_EVAL}\nSELECT * FROM m")
def retrieval_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"WITH {_EVAL}\nSELECT count(*) AS queries, round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall, round(avg(mrr), 6) AS avg_mrr, round(avg(r_precision), 6) AS avg_r_precision FROM m")
def retrieval_eval(spark, sf_dir):
    return metrics.averages(_scores(spark, sf_dir))


@query(f"WITH {_TOPK}\nSELECT CASE WHEN similarity >= 0.65 THEN 'green' WHEN similarity >= 0.55 THEN 'yellow' ELSE 'red' END AS band, count(*) AS n FROM r WHERE rank <= 10 GROUP BY 1")
def similarity_bands(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy(tx.similarity_band(F.col("similarity")).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT count(a.id) AS in_rows, count(b.id) AS in_vectors, count(*) FILTER (WHERE b.id IS NULL) AS only_rows, count(*) FILTER (WHERE a.id IS NULL) AS only_vectors, count(a.id) = count(b.id) AS consistent
FROM (SELECT doc_id AS id FROM labels) a FULL JOIN (SELECT vec_id AS id FROM embeddings) b USING (id)""")
def vector_consistency(spark, sf_dir):
    return vectors.consistency(load(spark, sf_dir, "labels"), load(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


# --- Text, prompts, answers -------------------------------------------------------


@query("""SELECT episode_id, segment_index, printf('%02d:%02d', CAST(floor(start_time * 40 / 60) AS BIGINT), CAST(floor(start_time * 40) AS BIGINT) % 60) AS mmss,
  printf('%02d:%02d:%02d', CAST(floor(start_time * 40) AS BIGINT) // 3600, CAST(floor(start_time * 40) AS BIGINT) % 3600 // 60, CAST(floor(start_time * 40) AS BIGINT) % 60) AS hhmmss FROM v_segments""", "v_segments")  # fmt: skip
def mmss_format(spark, sf_dir):
    s = F.col("start_time") * 40
    return segments(spark, sf_dir).select("episode_id", "segment_index", tx.mmss(s).alias("mmss"), tx.hhmmss(s).alias("hhmmss"))


_CHUNK_OF = """got AS (SELECT r.query_id, r.rank, r.similarity, r.vec_id AS episode_id, r.vec_id % 3 AS chunk_index, 'Episode ' || r.vec_id AS episode_title, CAST(r.vec_id * 7 AS DOUBLE) AS start_time, d.text AS text
  FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE rank <= 5),
blocks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, printf('%02d:%02d', CAST(floor(start_time / 60) AS BIGINT), CAST(start_time AS BIGINT) % 60) AS clock FROM got)"""
_CONTEXT = "string_agg('[Excerpt ' || place || ']' || chr(10) || 'Episode: ' || episode_title || chr(10) || 'Time: ' || clock || chr(10) || 'Content: ' || text || chr(10), chr(10) || '---' || chr(10) ORDER BY rank)"


def _chunks_found(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    i = F.col("vec_id")
    return _ranked(spark, sf_dir, 5).join(d, "vec_id").select("query_id", "rank", "similarity", i.alias("episode_id"), (i % 3).alias("chunk_index"), F.concat(F.lit("Episode "), i.cast("string")).alias("episode_title"), (i * 7).cast("double").alias("start_time"), "text")


@query(f"WITH {_TOPK}, {_CHUNK_OF}\nSELECT query_id, 'Available excerpts:' || chr(10) || chr(10) || {_CONTEXT} || chr(10) || chr(10) || 'Question: What is ' || query_id || '?' AS prompt FROM blocks GROUP BY query_id")
def rag_context(spark, sf_dir):
    c = rag.contexts(_chunks_found(spark, sf_dir))
    return c.select("query_id", rag.user_prompt(F.col("context"), F.concat(F.lit("What is "), F.col("query_id").cast("string"), F.lit("?"))).alias("prompt"))


@query(f"""WITH {_TOPK}, {_CHUNK_OF}, k AS (SELECT * FROM blocks WHERE similarity >= 0.35), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, episode_id, chunk_index ORDER BY rank) AS seen FROM k),
l AS (SELECT query_id, string_agg(episode_title || '|' || clock || '|' || printf('%.3f', round_even(similarity, 3)), '; ' ORDER BY rank) AS sources FROM u WHERE seen = 1 GROUP BY 1),
g AS (SELECT query_id, count(*) AS chunks_used, arg_min(text, rank) AS first_text FROM k GROUP BY 1), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)
SELECT q.query_id, CASE WHEN g.query_id IS NULL THEN 'No relevant excerpts were found.' ELSE substring(first_text, 1, 200) || ' [Excerpt 1]' END AS answer, coalesce(sources, '') AS sources, coalesce(chunks_used, 0) AS chunks_used
FROM q LEFT JOIN g USING (query_id) LEFT JOIN l USING (query_id)""")
def rag_answer(spark, sf_dir):
    q = load(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("What is "), F.col("vec_id").cast("string"), F.lit("?")).alias("query"))
    return rag.answers(q, _chunks_found(spark, sf_dir), min_similarity=0.35).drop("context_chunks")


@query(f"""WITH {_TOPK}, {_CHUNK_OF}, c AS (SELECT query_id, string_agg('[' || k || '] ' || text, chr(10) || chr(10) ORDER BY k) AS context FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM got) GROUP BY 1)
SELECT vec_id AS query_id, 'QUESTION:' || chr(10) || 'q' || vec_id || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || coalesce(context, '(no context retrieved)') || chr(10) || chr(10) || 'ANSWER:' || chr(10) || 'a' || chr(10) || chr(10) || 'REFERENCE_ANSWER:' || chr(10) || 'r' AS prompt
FROM embeddings e LEFT JOIN c ON c.query_id = e.vec_id WHERE vec_id % 20 = 0""")
def judge_prompts(spark, sf_dir):
    c = _chunks_found(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l")).select("query_id", F.transform("l", lambda x: x["text"]).alias("texts"))
    q = load(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")).join(c, "query_id", "left")
    none = F.array().cast("array<string>")
    return q.select("query_id", rag.judge_prompt(F.concat(F.lit("q"), F.col("query_id").cast("string")), F.coalesce("texts", none), F.lit("a"), F.lit("r")).alias("prompt"))


@query("""SELECT event_id, CASE k WHEN 0 THEN CAST(a AS INT) WHEN 1 THEN CAST(a AS INT) WHEN 5 THEN CAST(a AS INT) END AS faithfulness, CASE WHEN k IN (0, 1, 5) THEN 3 END AS answer_relevancy,
  CASE WHEN k IN (0, 1, 5) THEN 5 END AS answer_correctness, CASE k WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 5 THEN '' END AS reasoning,
  CASE k WHEN 2 THEN 'invalid json' WHEN 3 THEN 'missing answer_relevancy' WHEN 4 THEN 'answer_correctness out of range' END AS error
FROM (SELECT event_id, event_type, event_id % 6 AS k, event_id % 5 + 1 AS a FROM events)""")
def judge_parse(spark, sf_dir):
    k = F.col("event_id") % 6
    body = lambda rel, cor, why: F.concat(F.lit('{"faithfulness": '), (F.col("event_id") % 5 + 1).cast("string"), F.lit(rel), F.lit(f', "answer_correctness": {cor}'), why, F.lit("}"))
    why = F.concat(F.lit(', "reasoning": "'), "event_type", F.lit('"'))
    rel = ', "answer_relevancy": 3'
    raw = F.when(k == 0, body(rel, 5, why)).when(k == 1, F.concat(F.lit("```json\n"), body(rel, 5, why), F.lit("\n```"))).when(k == 2, F.concat(body(rel, 5, why), F.lit("}{")))
    raw = raw.when(k == 3, body("", 5, why)).when(k == 4, body(rel, 9, why)).otherwise(body(rel, 5, F.lit("")))
    return load(spark, sf_dir, "events").select("event_id", rag.parse_judge(raw).alias("j")).select("event_id", "j.*")


@query("SELECT type, round(avg(s), 6) AS avg_score FROM (SELECT event_type AS type, unnest([event_id % 5 + 1, event_id % 3 + 1, event_id % 4 + 1]) AS s FROM events) GROUP BY 1")
def eval_by_type(spark, sf_dir):
    i = F.col("event_id")
    return metrics.by_type(load(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (i % 5 + 1).alias("a"), (i % 3 + 1).alias("b"), (i % 4 + 1).alias("c")), ["a", "b", "c"])


@query("""SELECT count(*) AS questions, CAST(sum(coalesce(CASE WHEN event_id % 9 <> 0 THEN event_id % 700 END, 0)) AS BIGINT) AS total_tokens,
  CAST(sum(coalesce(CASE WHEN event_id % 9 <> 0 THEN event_id % 700 END, 0)) // count(*) AS BIGINT) AS avg_tokens,
  round(sum(CAST(event_id % 256 AS DOUBLE) / 16), 4) AS total_elapsed, round(sum(CAST(event_id % 256 AS DOUBLE) / 16) / count(*), 4) AS avg_elapsed FROM events""")
def session_metrics(spark, sf_dir):
    i = F.col("event_id")
    return metrics.run_totals(load(spark, sf_dir, "events").select(F.when(i % 9 != 0, i % 700).alias("tokens_used"), ((i % 256).cast("double") / 16).alias("elapsed")))


_MESSAGES = (
    "CUDA error: Out of Memory while running", "GET was Unable to find an engine", "CUDA out of memory.", "It is OUT OF MEMORY",
    "Unable to find an engine to execute", "CUBLAS_STATUS_ALLOC_FAILED when calling", "out of  memory", "disk full",
)


@query(f"""WITH m AS (SELECT event_id, {list(_MESSAGES)}[event_id % 8 + 1] || ' ' || event_type AS message FROM events)
SELECT event_id, len(list_filter(['out of memory', 'cuda error: out of memory', 'get was unable to find an engine', 'cuda out of memory'], lambda s: contains(lower(message), s))) > 0 AS memory_error FROM m""")
def memory_errors(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 8).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", tx.is_memory_error(F.concat(said, F.lit(" "), F.col("event_type"))).alias("memory_error"))


@query()
def sentence_chunks(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("full_text"))
    return chunking.chunk_texts(t).drop("text")


@query()
def episode_chunks(spark, sf_dir):
    c = chunking.chunk_episodes(segments(spark, sf_dir), turns(spark, sf_dir), size=120, overlap=20)
    return c.select("episode_id", "chunk_index", "token_count", "start_time", "end_time", tx.json_list(F.col("speakers")).alias("speakers"))


@query()
def encode_index(spark, sf_dir):
    """Every chunk of every document, its whole text encoded; 16 characters a second, as in ``segments``."""
    t = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("full_text"))
    c = chunking.chunk_texts(t).select(
        "episode_id", "chunk_index", (F.col("start_char") / 16.0).alias("start_time"), (F.col("end_char") / 16.0).alias("end_time"), F.array(F.lit("SPEAKER_00")).alias("speakers"), "token_count", "text",
    )
    return vectors.encode_index(vectors.with_metadata(c, episodes(spark, sf_dir)))


@query("""SELECT doc_id, 0 AS first_char, CAST(length(text) AS BIGINT) AS last_char, true AS small, true AS in_order, true AS whole FROM documents WHERE regexp_matches(text, '[^\\s\\x{0085}\\x{00A0}]')""")
def chunk_coverage(spark, sf_dir):
    """What holds for the chunks of every document: they begin and end with the text, leave
    nothing out, have at most 500 tokens, and begin later than the ones before."""
    t = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("full_text"))
    c = chunking.chunk_texts(t)
    before = Window.partitionBy("episode_id").orderBy("chunk_index")
    c = c.withColumn("since", F.lag("start_char").over(before)).withColumn("upto", F.lag("end_char").over(before))
    return c.groupBy(F.col("episode_id").alias("doc_id")).agg(
        F.min("start_char").cast("int").alias("first_char"), F.max("end_char").alias("last_char"), (F.max("token_count") <= 500).alias("small"),
        F.every(F.coalesce(F.col("since") < F.col("start_char"), F.lit(True))).alias("in_order"), F.every(F.coalesce(F.col("upto") >= F.col("start_char"), F.lit(True))).alias("whole"),
    )


@query("""s AS (SELECT *, trim(text, ' ') AS said FROM v_segments), t AS (SELECT episode_id, sum(length(said) + 1) - 1 AS n, min(start_time) AS start_time, max(end_time) AS end_time FROM s WHERE said <> '' GROUP BY 1)
SELECT episode_id, CAST(n AS BIGINT) AS last_char, start_time, end_time, true AS small FROM t""", "v_segments")  # fmt: skip
def episode_chunk_coverage(spark, sf_dir):
    """The chunks of an episode end with its text and span the times of its segments."""
    c = chunking.chunk_episodes(segments(spark, sf_dir), turns(spark, sf_dir), size=120, overlap=20)
    return c.groupBy("episode_id").agg(F.max("end_char").alias("last_char"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), (F.max("token_count") <= 120).alias("small"))


@query("""SELECT CAST(id AS VARCHAR) AS episode_id, title AS episode_title, duration_seconds, true AS named, true AS unit_length FROM v_episodes e JOIN documents d ON d.doc_id = e.id WHERE regexp_matches(d.text, '[^\\s\\x{0085}\\x{00A0}]')""", "v_episodes")
def index_coverage(spark, sf_dir):
    """Every document with text is in the index, its rows named by chunk, with the
    episode's metadata and vectors of length 1 (0 where a chunk has no word)."""
    v = encode_index(spark, sf_dir)
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    name = F.concat_ws("_", F.col("episode_id").cast("string"), F.col("chunk_index").cast("string"))
    return v.groupBy("metadata.episode_id", "metadata.episode_title", "metadata.duration_seconds").agg(
        F.every(F.col("embedding_id") == name).alias("named"), F.every((F.abs(length - 1) < 1e-9) | (length == 0)).alias("unit_length")
    )


_PT_INTRO = r"""w AS (SELECT episode_id, segment_index, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda w: w <> '') AS w FROM v_segments),
said AS (SELECT *, CASE segment_index % 4 WHEN 0 THEN 'Olá, aqui é o ' || w[1] || ' ' || w[2] || ' ' || w[3] || ', bem-vindos' WHEN 1 THEN 'eu sou a ' || w[1] || ' e hoje' WHEN 2 THEN 'aqui quem vos fala e a ' || w[1] ELSE 'nada, ' || w[1] END AS l FROM w),
ways AS (SELECT *, [regexp_extract(lower(l), 'aqui [eé] [oa] ([^,]+?)(?:,|\s+e\s|$)', 1), regexp_extract(lower(l), 'eu sou [oa]? ?([^,]+?)(?:,|\s+e\s|$)', 1), regexp_extract(lower(l), 'aqui quem vos fala [eé] [oa] ([^,]+?)(?:,|\s+e\s|$)', 1)] AS found FROM said),
cut AS (SELECT *, list_filter(list_transform(found, lambda f: array_to_string(list_transform(list_filter(regexp_split_to_array(trim(f), '\s+'), lambda x: x <> '')[1:2], lambda x: upper(x[1:1]) || x[2:]), ' ')), lambda f: length(f) > 2) AS names FROM ways)"""


@query(_PT_INTRO + "\nSELECT episode_id, segment_index, names[1] AS name FROM cut", "v_segments")
def name_extraction_pt(spark, sf_dir):
    """Introductions in Portuguese, made of the segments' own words."""
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda w: w != "")
    k, w = F.col("segment_index") % 4, [F.get(words, F.lit(j)) for j in range(3)]
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    said = F.when(k == 0, join("Olá, aqui é o ", w[0], " ", w[1], " ", w[2], ", bem-vindos")).when(k == 1, join("eu sou a ", w[0], " e hoje")).when(k == 2, join("aqui quem vos fala e a ", w[0])).otherwise(join("nada, ", w[0]))
    return segments(spark, sf_dir).select("episode_id", "segment_index", tx.extract_name(said, patterns=tx.INTRO_PATTERNS["pt_br"]).alias("name"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\x{0B}\\p{L}\\p{N}]')) AS INT) AS n_tokens FROM documents")
def plain_token_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("n_tokens"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '["' || lang || '"' || CASE WHEN doc_id % 3 > 1 THEN ',"' || source || '"' ELSE '' END || ']' END AS json, CAST(doc_id % 3 AS INT) AS n FROM documents""")
def json_lists(spark, sf_dir):
    """Lists written as JSON, null for none, and read back."""
    values = F.slice(F.array("lang", "source"), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", tx.json_list(values).alias("json")).withColumn("n", F.size(tx.json_to_list(F.col("json"))))


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE length(text) * 1000 END AS length, doc_id % 10 <> 0 AS downloaded FROM documents)
SELECT count(*) AS files, count(*) FILTER (WHERE length = 0) AS empty_files, round_even(sum(length) / 1048576, 2) AS total_mb, count(*) FILTER (WHERE downloaded) AS downloaded, count(*) = count(*) FILTER (WHERE downloaded) AS matches FROM f""")
def audio_file_report(spark, sf_dir):
    d, i = load(spark, sf_dir, "documents"), F.col("doc_id")
    files = d.select(F.concat(i.cast("string"), F.lit(".mp3")).alias("path"), F.when(i % 9 == 0, 0).otherwise(F.length("text") * 1000).cast("long").alias("length"))
    return sources.audio_report(files, d.select((i % 10 != 0).alias("downloaded")))


@query("""w AS (SELECT id AS episode_id, unnest(range(0, greatest(1, CAST(ceil((duration_seconds - 1800) / 1795.0) AS BIGINT) + 1))) AS k FROM v_episodes WHERE duration_seconds > 0)
SELECT episode_id, CAST(k AS INT) AS window_index FROM w WHERE (episode_id + k) % 3 <> 0""", "v_episodes")  # fmt: skip
def windows_to_resume(spark, sf_dir):
    """Windows that are left to do where a third has a partial result already."""
    planned = sequence.plan_windows(episodes(spark, sf_dir).select(F.col("id").alias("episode_id"), F.col("duration_seconds").alias("duration")))
    done = planned.filter((F.col("episode_id") + F.col("window_index")) % 3 == 0).select("episode_id", "window_index")
    return sources.missing_windows(planned, done.unionAll(done)).select("episode_id", "window_index")


@query(f"""WITH {_TOPK}, {_CHUNK_OF}
SELECT query_id, rank, '[' || rank || '] ' || episode_title || ' @ ' || clock || ' (similarity: ' || printf('%.3f', similarity) || ')' || chr(10) || '    ' || substring(text, 1, 300) AS line FROM blocks""")
def result_lines(spark, sf_dir):
    line = rag.result_line(F.col("rank"), F.col("episode_title"), F.col("start_time"), F.col("similarity"), F.col("text"))
    return _chunks_found(spark, sf_dir).select("query_id", "rank", line.alias("line"))


@query("""WITH s AS (SELECT event_id, event_type, 'QUESTION:' || chr(10) || 'q' || event_id || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || '[1] ' || event_type || chr(10) || chr(10) || 'ANSWER:' || chr(10) || 'a' || chr(10) || chr(10) || 'REFERENCE_ANSWER:' || chr(10) || 'r' AS prompt
  FROM events WHERE event_id % 4 <> 0), j AS (SELECT event_id, event_type, CAST(length(prompt) % 5 + 1 AS INT) AS score FROM s)
SELECT event_id AS query_id, event_type AS type, CASE WHEN event_id % 7 <> 0 THEN score END AS faithfulness, CASE WHEN event_id % 7 <> 0 THEN 4 END AS answer_relevancy, CASE WHEN event_id % 7 <> 0 THEN 2 END AS answer_correctness,
  CASE WHEN event_id % 7 <> 0 THEN '' END AS reasoning, CASE WHEN event_id % 7 = 0 THEN 'no reply' END AS error FROM j""")
def generation_eval(spark, sf_dir):
    """A judge that scores by the length of its prompt, and fails for every 7th query."""

    def judge():
        def reply(prompt: str) -> str:
            if int(prompt.split("\n")[1][1:]) % 7 == 0:
                raise RuntimeError("no reply")
            return f'{{"faithfulness": {len(prompt) % 5 + 1}, "answer_relevancy": 4, "answer_correctness": 2}}'

        return reply

    i = F.col("event_id")
    asked = load(spark, sf_dir, "events").select(
        i.alias("query_id"), F.col("event_type").alias("type"), F.concat(F.lit("q"), i.cast("string")).alias("query"), F.array("event_type").alias("context_chunks"),
        F.lit("a").alias("answer"), F.when(i % 4 != 0, "r").alias("reference"),
    )
    return build.evaluate_answers(asked, judge)


@query()
def episode_overview(spark, sf_dir):
    """Alignment, text volume and repetition per conversation: joins, windows, arrays
    and aggregates in one plan."""
    s = segments(spark, sf_dir)
    aligned = intervals.align_turns(s, turns(spark, sf_dir)).groupBy("episode_id").agg(F.count("*").alias("turns"), F.count_if("aligned").alias("aligned_turns"))
    parts = F.array_sort(F.collect_list(F.struct("segment_index", "text")))
    text = s.groupBy("episode_id").agg(F.count("*").alias("segments"), F.max("end_time").alias("duration"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("full_text"))
    n = F.length("full_text").cast("long")
    rate = F.col("rate")
    return text.join(aligned, "episode_id").withColumn("rate", tx.repetition_rate(tx.words(F.col("full_text")))).select(
        "episode_id", "segments", "turns", "aligned_turns", reports.share(F.col("aligned_turns"), F.col("turns")).alias("aligned_share"), n.alias("total_chars"),
        F.round(n / F.col("duration") * 60, 4).alias("chars_per_minute"), F.round(rate, 6).alias("repetition_rate"), (rate < 0.5).alias("hallucination_flag"),
    )


SQL["episode_overview"] = with_views(_PAIRS + f""", a AS (SELECT t.episode_id, count(*) AS turns, count(m.episode_id) AS aligned_turns FROM v_turns t LEFT JOIN (SELECT DISTINCT episode_id, chunk_index FROM pairs) m USING (episode_id, chunk_index) GROUP BY 1),
x AS (SELECT episode_id, count(*) AS segments, max(end_time) AS duration, string_agg(text, ' ' ORDER BY segment_index) AS full_text FROM v_segments GROUP BY 1),
w AS (SELECT *, {_WORDS.format("full_text")} AS ws FROM x), z AS (SELECT *, CAST({_RATE} AS DOUBLE) AS rate FROM w)
SELECT episode_id, segments, turns, aligned_turns, round_even(CAST(aligned_turns AS DOUBLE) * 100 / turns, 1) AS aligned_share, CAST(length(full_text) AS BIGINT) AS total_chars,
  round(length(full_text) / duration * 60, 4) AS chars_per_minute, round(rate, 6) AS repetition_rate, rate < 0.5 AS hallucination_flag FROM z JOIN a USING (episode_id)""", "v_segments", "v_turns")  # fmt: skip
