"""Fixtures with known results, and plain-Python twins of the ordered operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import text as tx
from voxlake.operators import chunking, intervals, metrics, rag, reports, sequence, vectors
from voxlake.plans import phases
from voxlake.sources import catalog as sources

SEG = "episode_id string, segment_index int, text string, start_time double, end_time double"
TURN = "episode_id string, chunk_index int, text string, start_time double, end_time double, speaker string"


def test_turns_take_the_text_of_their_segments(spark):
    s = spark.createDataFrame([("e", 0, "Rain again today,", 0.5, 3.5), ("e", 1, "so we stay in. ", 3.5, 6.0), ("e", 2, "Bring the lamp over", 7.0, 12.0), ("e", 3, "and close the door.", 12.0, 14.0)], SEG)
    t = spark.createDataFrame([("e", 0, None, 0.0, 6.5, "X"), ("e", 1, "kept", 6.5, 7.0, "Z"), ("e", 2, None, 7.0, 15.0, "Y")], TURN)
    rows = intervals.align_turns(s, t).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["Rain again today, so we stay in.", "kept", "Bring the lamp over and close the door."]
    c = chunking.chunk_episodes(s, t).first()
    assert c.text == "Rain again today, so we stay in. Bring the lamp over and close the door."
    assert (c.start_time, c.end_time, c.speakers) == (0.5, 14.0, ["X", "Y", "Z"])


def test_too_little_overlap(spark):
    s = spark.createDataFrame([("e", 0, "Some text.", 0.0, 10.0)], SEG)
    t = spark.createDataFrame([("e", 0, "old", 7.0, 10.0, "A")], TURN)
    assert [(r.text, r.aligned) for r in intervals.align_turns(s, t).collect()] == [("old", False)]


def test_nearest_speaker(spark):
    s = spark.createDataFrame([("e", 0, "a", 10.0, 12.0), ("e", 1, "b", 20.0, 21.0), ("e", 2, "c", 30.0, 31.0), ("e", 3, "d", 40.0, 42.0)], SEG)
    t = spark.createDataFrame([("e", 0, None, 9.0, 11.0, "A"), ("e", 1, None, 11.0, 13.0, "B"), ("e", 2, None, 23.0, 24.0, "C"), ("e", 3, None, 33.01, 34.0, "D"), ("e", 4, None, 40.0, 42.0, None), ("e", 5, None, 43.0, 44.0, "F")], TURN)
    got = {r.segment_index: r.matched_speaker for r in intervals.speaker_of_segments(s, t).collect()}
    assert got == {0: "A", 1: "C", 2: None, 3: None}


def test_speaker_of_segments_equals_loop(spark):
    rng = random.Random(8)
    turns, segs = [], []
    for e in range(12):
        turns += [(f"e{e}", k, None, float(a := rng.randrange(60)), a + rng.randrange(1, 9) / 2, rng.choice(["A", "B", None, ""])) for k in range(12)]
        segs += [(f"e{e}", k, "t", float(a := rng.randrange(60)), a + rng.randrange(1, 9) / 2) for k in range(20)]
    got = {(r.episode_id, r.segment_index): r.matched_speaker for r in intervals.speaker_of_segments(spark.createDataFrame(segs, SEG), spark.createDataFrame(turns, TURN)).collect()}
    for e, k, _, start, end in segs:
        own = sorted((t for t in turns if t[0] == e), key=lambda t: (t[3], t[1]))
        by_overlap = sorted(((-(min(end, t[4]) - max(start, t[3])), n) for n, t in enumerate(own) if min(end, t[4]) > max(start, t[3])))
        name = own[by_overlap[0][1]][5] if by_overlap else None
        if not name:
            near = sorted((max(0.0, t[3] - end, start - t[4]), n) for n, t in enumerate(own))
            name = own[near[0][1]][5] if near and near[0][0] <= 2.0 else None
        assert got[e, k] == (name or None)


def test_times_at_offsets_equal_loop(spark):
    rng = random.Random(3)
    offs, ranges = [], []
    for e in range(6):
        at = 0
        for k in range(rng.randrange(0, 15)):
            n = rng.randrange(1, 30)
            offs.append((f"e{e}", at, at + n, float(k), k + 0.5))
            at += n + 1
        ranges += [(f"e{e}", k, a := rng.randrange(at + 20), a + rng.randrange(40)) for k in range(10)]
    r = spark.createDataFrame(ranges, "episode_id string, chunk_index int, start_char int, end_char int")
    o = spark.createDataFrame(offs, "episode_id string, start_char int, end_char int, start_time double, end_time double")
    got = {(x.episode_id, x.chunk_index): (x.start_time, x.end_time) for x in intervals.times_at_offsets(r, o).collect()}
    assert len(got) == len(ranges)
    for e, k, a, z in ranges:
        own = [x for x in offs if x[0] == e]
        assert got[e, k] == (next((x[3] for x in own if x[2] >= a), 0.0), next((x[4] for x in reversed(own) if x[1] <= z), 0.0))


def test_enrolment_looks_at_the_beginning_only(spark):
    s = spark.createDataFrame([("e", 0, "this is Ana, hello", 299.0, 301.0), ("e", 1, "i'm Bob, hello", 300.5, 302.0)], SEG)
    t = spark.createDataFrame([("e", 0, None, 290.0, 299.5, "A"), ("e", 1, None, 300.2, 310.0, "B")], TURN)
    assert [(r.speaker, r.name) for r in sequence.enroll(s, t).collect()] == [("A", "Ana")]


def test_bucketed_interval_join_equals_plain(spark):
    rng = random.Random(1)
    make = lambda n, name: spark.createDataFrame([("e%d" % (k % 2), k, float(a := rng.randrange(200)), float(a + rng.randrange(1, 90))) for k in range(n)], f"episode_id string, {name} int, start_time double, end_time double")
    a, b = make(40, "x"), make(40, "y")
    pairs = lambda df: sorted((r.l_x, r.r_y) for r in df.collect())
    plain = pairs(intervals.interval_join(a, b, "episode_id", 2.0))
    assert plain == pairs(intervals.interval_join(a, b, "episode_id", 2.0, bucket=32.0)) and plain


@pytest.mark.parametrize("size,overlap", [(1800, 5), (1800, 30)])
def test_window_plan(spark, size, overlap):
    durations = [0.0, 10.0, 1799.0, 1800.0, 1801.0, 3595.0, 3596.0, 9000.5]
    df = spark.createDataFrame([(str(d), d) for d in durations], "episode_id string, duration double")
    got = {}
    for r in sequence.plan_windows(df, size, overlap).orderBy("window_index").collect():
        got.setdefault(r.episode_id, []).append((r.start_time, r.end_time))
    for d in durations:
        want, start = [], 0.0
        while d > 0:
            want.append((start, min(start + size, d)))
            if want[-1][1] == d:
                break
            start += size - overlap
        assert got.get(str(d), []) == want


def test_merge_keeps_straddlers_and_drops_late_starts(spark):
    w = spark.createDataFrame([("e", 0, 0.0), ("e", 1, 95.0)], "episode_id string, window_index int, start_time double")
    s = spark.createDataFrame([("e", 0, 0, 90.0, 99.0, "a"), ("e", 0, 1, 95.0, 100.0, "b"), ("e", 1, 0, 0.0, 5.0, "c")], "episode_id string, window_index int, position int, start_time double, end_time double, text string")
    got = [(r.text, r.start_time, r.segment_index) for r in sequence.merge_windows(w, s).orderBy("segment_index").collect()]
    assert got == [("a", 90.0, 0), ("c", 95.0, 1)]


@pytest.mark.parametrize("n", [0, 49, 50, 51, 100, 101, 149, 150, 151])
@pytest.mark.parametrize("period", [1, 50, 1000])
def test_repetition_rate(spark, n, period):
    words = [f"w{k % period}" for k in range(n)]
    chunks = [" ".join(words[k : k + 50]) for k in range(0, n - 50, 50)] if n >= 50 else []
    want = len(set(chunks)) / len(chunks) if chunks else 1.0
    df = spark.createDataFrame([(" ".join(words),)], "t string")
    assert df.select(tx.repetition_rate(tx.words(F.col("t"))).alias("r")).first().r == want


def test_text_offsets(spark):
    s = spark.createDataFrame([("e", 0, "Hello", 0.0, 1.0), ("e", 1, "   ", 1.0, 2.0), ("e", 2, "world", 2.0, 3.0)], SEG)
    assert [(r.start_char, r.end_char) for r in sequence.text_offsets(s).orderBy("start_char").collect()] == [(0, 5), (6, 11)]


def test_located_chunks(spark):
    rng = random.Random(6)
    full = " ".join(rng.choice(["red", "green", "blue", "grey", "pink"]) + str(rng.randrange(50)) for _ in range(900))
    spans = [(k, min(k + 240, len(full))) for k in range(0, len(full), 200)]
    rows = [("e", k, full[a:z]) for k, (a, z) in enumerate(spans)] + [("e", 99, "short"), ("e", 100, "nowhere to be found, although it is long"), ("f", 0, "x")]
    c = spark.createDataFrame(rows, "episode_id string, chunk_index int, text string")
    got = {(r.episode_id, r.chunk_index): (r.start_char, r.end_char) for r in chunking.located_chunks(c, spark.createDataFrame([("e", full), ("f", "")], "episode_id string, full_text string")).collect()}
    assert all(got["e", k] == s for k, s in enumerate(spans))
    end = len(full)
    assert got["e", 99] == (end, end + 5) and got["e", 100] == (end + 5, end + 45) and got["f", 0] == (0, 1)


@given(st.text(alphabet="ab .,!?\n", max_size=400), st.integers(3, 20))
@settings(max_examples=80, deadline=None)
def test_chunks_cover_text_in_order(text, size):
    chunks = chunking.split(text, size, overlap=2)
    for a, z, n in chunks:
        assert n == len(chunking.simple_tokens(text[a:z])) <= size
    if text.strip():
        assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
        assert all(x[1] >= y[0] and x[1] < y[1] for x, y in zip(chunks, chunks[1:]))


def test_chunks_by_a_vocabulary_file(spark):
    import public_tokenizers

    tokenize = chunking.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Unbelievably longwinded sentences, antidisestablishmentarianism. " * 20 + "x" * 300
    df = spark.createDataFrame([("e", text), ("f", None), ("g", "short")], "episode_id string, full_text string")
    got = chunking.chunk_texts(df, 40, 8, tokenize).orderBy("episode_id", "chunk_index").collect()
    own = [r for r in got if r.episode_id == "e"]
    assert len(own) > 5 and all(r.token_count == len(tokenize(r.text)) <= 40 and r.text == text[r.start_char : r.end_char] for r in own)
    assert own[0].start_char == 0 and own[-1].end_char == len(text) and [r.text for r in got if r.episode_id != "e"] == ["short"]


def test_retrieval_metrics_equal_sets(spark):
    rng = random.Random(12)
    cases = [(k, rng.sample("abcdefghij", rng.randrange(8)), rng.sample("abcdefghijklm", rng.randrange(6)), rng.randrange(7)) for k in range(80)]
    df = spark.createDataFrame(cases, "i int, r array<string>, e array<string>, k int")
    a, b, n = F.col("r"), F.col("e"), F.col("k")
    rows = df.select("i", metrics.precision_at(a, b, n), metrics.recall_at(a, b, n), metrics.reciprocal_rank(a, b), metrics.r_precision(a, b)).orderBy("i").collect()
    safe = lambda x, y: x / y if y else 0.0
    for (i, found, wanted, k), row in zip(cases, rows):
        hits = [x in wanted for x in found]
        first = hits.index(True) + 1 if any(hits) else 0
        assert list(row)[1:] == pytest.approx([safe(sum(hits[:k]), k), safe(sum(hits[:k]), len(wanted)), safe(1, first), safe(sum(hits[: len(wanted)]), len(wanted))])
    found = spark.createDataFrame([(i, n + 1, x in e) for i, r, e, _ in cases for n, x in enumerate(r)], "query_id int, rank int, relevant boolean")
    counts = spark.createDataFrame([(i, len(e)) for i, _, e, _ in cases], "query_id int, expected int")
    lists = spark.createDataFrame([(i, r, e) for i, r, e, _ in cases if r], "query_id int, retrieved array<string>, expected array<string>")
    assert sorted(map(tuple, metrics.evaluate_found(found, counts, 5).collect())) == sorted(map(tuple, metrics.evaluate(lists, 5).collect()))


def test_context_is_numbered_by_place(spark):
    c = spark.createDataFrame([(1, 2, "T", 61.0, "b"), (1, 5, "U", 0.0, "c")], "query_id int, rank int, episode_title string, start_time double, text string")
    text = rag.contexts(c).first().context
    assert text == "[Excerpt 1]\nEpisode: T\nTime: 01:01\nContent: b\n\n---\n[Excerpt 2]\nEpisode: U\nTime: 00:00\nContent: c\n"
    prompt = spark.range(1).select(rag.user_prompt(F.lit(None), F.lit("por quê?"), "pt_br").alias("p"), rag.judge_prompt(F.lit("q"), F.array().cast("array<string>"), F.lit("a"), F.lit("r")).alias("j")).first()
    assert prompt.p == "Trechos disponíveis:\n\nNenhum trecho relevante encontrado.\n\nPergunta: por quê?" and "(no context retrieved)" in prompt.j


def test_vote_ties_go_to_the_first_label(spark):
    v = spark.createDataFrame([("s", "é", 1.0), ("s", "z", 0.5), ("t", "B", 1.0), ("t", "_", 1.0), ("t", "B", 1.0)], "k string, l string, p double")
    assert {r.k: r.language for r in reports.language_vote(v, "k", "l", "p").collect()} == {"s": "z", "t": "B"}


def test_template_without_its_values():
    assert tx.translate({"a": "{n} sources"}, "a", n=2) == "2 sources" and tx.translate({"a": "{n} sources"}, "a") == "{n} sources"
    with pytest.raises(KeyError):
        tx.translate({}, "a")


def test_result_line(spark):
    line = spark.range(1).select(rag.result_line(F.lit(1), F.lit("T"), F.lit(65.0), F.lit(0.51234), F.lit("x" * 400)).alias("l")).first().l
    assert line == "[1] T @ 01:05 (similarity: 0.512)\n    " + "x" * 300


def test_judge(spark):
    ok = '{"faithfulness": 5, "answer_relevancy": 4, "answer_correctness": 3, "reasoning": "fine"}'
    raws = [ok, f"```json\n{ok}\n```", ok.replace(', "reasoning": "fine"', ""), ok.replace("5", "9"), ok.replace("5", "0"), ok.replace('"answer_relevancy": 4, ', ""), "not json", ok + "{"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string")
    got = [r.j for r in df.select("k", rag.parse_judge(F.col("raw")).alias("j")).orderBy("k").collect()]
    assert [g.error is None for g in got] == [True, True, True, False, False, False, False, False]
    assert got[0].reasoning == "fine" and got[2].reasoning == "" and got[1].answer_correctness == 3


def test_names(spark):
    texts = ["this is ANA maria souza, hi", "here is Ânders again", "nothing", "my name is Al, i'm Bob from x", "this is d'ávila, yes"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.n for r in df.select("k", tx.extract_name(F.col("t"), {"ânders": "Anders Holm"}).alias("n")).orderBy("k").collect()]
    assert got == ["Ana Maria", "Anders Holm", None, "Bob", "D'Ávila"]


def test_relabel(spark):
    t = spark.createDataFrame([("e", 0, 0.0, 1.0, 2.0, "B"), ("e", 0, 0.0, 3.0, 4.0, "A"), ("e", 2, 50.0, 1.0, 2.0, "A")], "episode_id string, window_index int, offset double, start_time double, end_time double, speaker string")
    got = [(r.global_speaker, r.start_time) for r in sequence.relabel_speakers(t).orderBy("start_time").collect()]
    assert got == [("SPEAKER_01", 1.0), ("SPEAKER_00", 3.0), ("SPEAKER_02", 51.0)]


def test_feed_and_catalog(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        '<rss><channel><item><guid>1</guid><title>A</title><description>s</description><content:encoded>c</content:encoded><enclosure url="u" length="3"/></item>'
        "<item><guid>2</guid><title>B</title><description>s</description><itunes:duration>61</itunes:duration></item></channel></rss>"
    )
    e = sources.read_feed(spark, str(tmp_path / "feed.xml"))
    got = {r.id: (r.description, r.audio_url, r.duration_seconds, r.explicit) for r in e.collect()}
    assert got == {"1": ("c", "u", 0, "no"), "2": ("s", None, 61, "no")}
    (tmp_path / "bad.xml").write_text("<rss><item><guid>1</guid><title>A</title></item><item><guid>2</guid><title>B</item></rss>")
    assert sources.read_feed(spark, str(tmp_path / "bad.xml")).count() == 1 and "<guid>2" in sources.broken_items(spark, str(tmp_path / "bad.xml")).first().item
    again = sources.insert_if_absent(e, e.withColumn("title", F.lit("changed")))
    assert sorted(r.title for r in again.collect()) == ["A", "B"]
    sources.save_catalog(e.select("id", "title"), str(tmp_path / "cat"), "p")
    assert sources.read_catalog(spark, str(tmp_path / "cat"), "id string, title string").count() == 2
    many = spark.range(1000).select(F.col("id"), F.lit("t").alias("title"))
    parts = sources.catalog_parts(many, "p", "2024-01-01", part_episodes=100).collect()
    assert len(parts) > 5 and all('"total_episodes":1000,"generated_at":"2024-01-01"' in p.document for p in parts)
    assert sorted(r.id for r in sources.parsed_catalog(sources.catalog_parts(many, "p", part_episodes=100), "id long, title string").collect()) == list(range(1000))


def test_partial_windows(spark, tmp_path):
    schema, at = "window_index int, text string, episode_id string", str(tmp_path / "w")
    planned = spark.createDataFrame([("e", 0), ("e", 1), ("f", 0)], "episode_id string, window_index int")
    asked = []

    def compute(missing):
        asked.append(sorted(map(tuple, missing.collect())))
        return missing.withColumn("text", F.concat("episode_id", F.col("window_index").cast("string")))

    assert sources.resume_windows(spark, planned.filter("episode_id = 'e' and window_index = 0"), at, schema, compute).count() == 1
    (tmp_path / "w" / "episode_id=e" / "broken.json").write_text('{"window_index": 1, ')
    got = sources.resume_windows(spark, planned, at, schema, compute)
    assert sorted((r.episode_id, r.window_index, r.text) for r in got.collect()) == [("e", 0, "e0"), ("e", 1, "e1"), ("f", 0, "f0")]
    assert asked == [[("e", 0)], [("e", 1), ("f", 0)]]
    sources.clear_windows(spark, at, ["e"])
    assert [r.episode_id for r in sources.read_windows(spark, at, schema).collect()] == ["f"]


def test_audio_report(spark, tmp_path):
    for name, n in (("a", 10), ("b", 0)):
        (tmp_path / f"{name}.mp3").write_bytes(b"x" * n)
    (tmp_path / "note.txt").write_text("no audio")
    e = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "id string, downloaded boolean")
    r = sources.audio_report(sources.list_audio(spark, str(tmp_path)), e).first()
    assert (r.files, r.empty_files, r.downloaded, r.matches) == (2, 1, 2, True)
    assert [r.file_name for r in sources.empty_audio(sources.list_audio(spark, str(tmp_path))).collect()] == ["b.mp3"]
    sources.write_report(spark.createDataFrame([(1, "x")], "n int, s string"), str(tmp_path / "report"), spark.range(3), "2024-05-06")
    report = spark.read.json(str(tmp_path / "report")).first()
    assert (report.n, report.timestamp) == (1, "2024-05-06") and spark.read.json(str(tmp_path / "report-per-query")).count() == 3


def test_audio_windows(spark, tmp_path):
    import wave

    import numpy as np

    from voxlake.sources import audio

    rate, x = 100, (np.arange(2 * 1050).reshape(-1, 2) % 1000 * 16).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = audio.audio_windows(files, size=4, overlap=1).orderBy("path", "window_index").collect()
    assert [(r.start_time, r.end_time) for r in rows[:3]] == [(0.0, 4.0), (3.0, 7.0), (6.0, 10.0)] and rows[3].end_time == 10.5
    mono = (x.astype(float) / 32768).mean(1)
    for r in rows[:4]:
        assert r.rate == rate and np.allclose(r.samples, mono[round(r.start_time * rate) : round(r.end_time * rate)], atol=1e-6)
    assert len(rows) == 5 and rows[4].error and rows[4].samples is None


def test_phases(spark):
    flags = "id string, downloaded boolean, transcribed boolean, diarized boolean, chunked boolean, indexed boolean"
    e = spark.createDataFrame([("a", True, True, None, None, None), ("b", True, False, False, False, False)], flags)
    assert [r.id for r in phases.pending(e, "diarize").collect()] == ["a"]
    assert "2. Transcription" in phases.dashboard(reports.coverage(e), "demo", running=2)
    broken = phases.Phase(1, "x", "X", "downloaded", run=lambda: 1 / 0)
    assert [r["status"] for r in phases.run_pipeline([broken, phases.Phase(2, "y", "Y", "transcribed")])] == ["failed", "completed"]
    assert phases.settings().chunk_size == 500
    with pytest.raises(AttributeError):
        phases.settings().nothing


def test_index(spark):
    c = spark.createDataFrame([("e", 0, "a b"), ("e", 1, "c")], "episode_id string, chunk_index int, text string")
    got = vectors.encode_index(c, lambda: lambda t: [0.0] * 4).orderBy("chunk_index").collect()
    assert [r.embedding_id for r in got] == ["e_0", "e_1"] and got[0].embedding == [0.0] * 4
    assert vectors.search(got and spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id int, embedding array<double>"), [1.0, 0.0], 2, min_similarity=0.5).count() == 1


def test_stream_insert_is_idempotent(spark, tmp_path):
    from voxlake.streaming import ingest

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        s = ingest.episode_stream(spark, str(tmp_path / "in"), "id string, v int")
        ingest.insert_stream(s, str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_store(spark, tmp_path):
    from voxlake.schemas import Store

    store = Store(spark, str(tmp_path)).create().create()
    row = spark.createDataFrame([("a",)], "id string")
    for c in store.read("episodes").schema:
        if c.name != "id":
            row = row.withColumn(c.name, F.lit(None).cast(c.dataType))
    store.append("episodes", row)
    store.views()
    assert spark.sql("SELECT count(*) FROM episodes").first()[0] == 1 and store.read("vectors").count() == 0


def test_hooks(spark):
    from voxlake.sources import audio

    e = spark.createDataFrame([("1", "A", "u"), ("2", "B", None), ("3", "C", "bad"), ("4", "D", "u")], "id string, title string, audio_url string")

    def fetch(url, name):
        if url == "bad":
            raise OSError("gone")
        return 1

    there = spark.createDataFrame([("/x/D.mp3",)], "path string")
    got = {r.id: (r.ok, r.error) for r in audio.download(e, fetch, there).collect()}
    assert got == {"1": (True, None), "2": (False, "no url"), "3": (False, "gone")}
    out = audio.apply_model(e, "id", "title", lambda: str.lower).collect()
    assert sorted(r.output for r in out) == ["a", "b", "c", "d"]


def test_whole_then_windows(spark):
    from voxlake.plans import build

    items = spark.createDataFrame([("short", 10.0), ("long", 9000.0), ("heavy", 20.0), ("broken", 20.0), ("null", None)], "episode_id string, duration double")
    error = F.when(F.col("episode_id") == "heavy", "CUDA out of memory. Tried").when(F.col("episode_id") == "broken", "no such file")
    whole = lambda df: df.select("episode_id", F.when(error.isNull(), "whole").alias("output"), error.alias("error"))
    windowed = lambda df: df.select("episode_id", F.lit("windows").alias("output"), F.lit(None).cast("string").alias("error"))
    got = {r.episode_id: r.output for r in build.whole_or_windows(items, whole, windowed, 7200).collect()}
    assert got == {"short": "whole", "long": "windows", "heavy": "windows", "broken": None, "null": "whole"}


def test_build_and_ask(spark, tmp_path):
    """Segments and turns in, answers out; a second run of a phase adds nothing."""
    from voxlake.plans import build
    from voxlake.schemas import Store

    store = Store(spark, str(tmp_path)).create()

    def add(name, rows, columns):
        df = spark.createDataFrame(rows, columns)
        for c in store.read(name).schema:
            if c.name not in df.columns:
                df = df.withColumn(c.name, F.lit(None).cast(c.dataType))
        store.append(name, df)

    add("episodes", [("e", "On lamps", True, True), ("f", "On doors", True, True), ("g", "No words", True, True)], "id string, title string, downloaded boolean, transcribed boolean")
    add("transcription_segments", [("e", 0, "brass lamps shine at night", 0.0, 5.0), ("f", 0, "oak doors creak in winter", 0.0, 6.0)], "episode_id string, segment_index int, text string, start_time double, end_time double")
    add("turns", [("e", 0, 0.0, 5.0, "Ana"), ("f", 0, 0.0, 6.0, "Bob")], "episode_id string, chunk_index int, start_time double, end_time double, speaker string")
    assert [r.text for r in build.align(store).orderBy("episode_id").collect()] == ["brass lamps shine at night", "oak doors creak in winter"]
    ran = {p.name: p for p in build.phases(store)}
    assert ran["ingestion"].run is None and phases.run_phase(ran["chunking"])["status"] == "completed"
    assert store.read("rag_chunks").count() == 2 and build.chunk(store) == 0
    assert phases.run_phase(ran["indexing"])["status"] == "completed" and build.index(store) == 0
    assert {r.id: (r.chunked, r.indexed) for r in store.episodes().collect()} == {"e": (True, True), "f": (True, True), "g": (False, False)}
    p = vectors.probe(store.read("vectors")).first()
    assert p.vectors == p.with_document == p.with_embedding == p.with_metadata == 2
    q = spark.createDataFrame([(1, "oak doors in winter"), (2, "nothing alike")], "query_id int, query string")
    got = {r.query_id: r for r in build.ask(store, q).collect()}
    assert got[1].chunks_used == 1 and got[1].context_chunks == ["oak doors creak in winter"] and got[1].sources.startswith("On doors|00:00|0.")
    assert got[2].chunks_used == 0 and got[2].answer == "No relevant excerpts were found."
    assert {r.query_id: r.chunks_used for r in build.ask(store, q, speaker="Ana").collect()} == {1: 0, 2: 0}
    assert {r.query_id: r.chunks_used for r in build.ask(store, q, episode_id="f").collect()}[1] == 1
    with pytest.raises(ValueError):
        store.mark("nothing", q)
