"""Long texts, hot keys and parts: what bounds a task's work must not change results."""

import random

import numpy as np
import pyarrow as pa
import pytest

from voxlake.llm import common, jaccard_join


def sets_of(rng, n):
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    return [np.unique(np.concatenate([rng.choice(base, rng.integers(0, 300)), rng.integers(0, 2**64, 5, dtype=np.uint64)])) for _ in range(n)]


@pytest.mark.parametrize("postings", [50, 10**6])
def test_overlaps_equal_sets(monkeypatch, postings):
    monkeypatch.setattr(jaccard_join, "POSTINGS", postings)
    sets = sets_of(np.random.default_rng(postings), 30) + [np.zeros(0, np.uint64)]
    a, b = np.triu_indices(len(sets), 1)
    for pick in (slice(None), slice(0, 7)):
        got = jaccard_join._overlaps(sets, a[pick], b[pick])
        assert got.tolist() == [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(a[pick], b[pick])]


@pytest.mark.parametrize("sides", [1, 2])
def test_parts_hold_every_pair_once(monkeypatch, sides):
    monkeypatch.setattr(jaccard_join, "SHINGLES", 100)
    rng = np.random.default_rng(sides)
    size, side = rng.integers(1, 60, 40), rng.integers(0, sides, 40)
    a, b = np.triu_indices(40, 1)
    ok = (rng.random(len(a)) < 0.3) & ((side[a] != side[b]) if sides == 2 else True)
    a, b = a[ok], b[ok]
    if sides == 2:
        a, b = np.where(side[a] == 0, a, b), np.where(side[a] == 0, b, a)
    seen = []
    for _, who, own in jaccard_join._parted(side, size, a, b):
        here = set(zip(a.tolist(), b.tolist())) | set(zip(b.tolist(), a.tolist()))
        one, two = (who[own == 0], who[own == 1]) if own.any() else (who, who)
        seen += [tuple(sorted((x, y))) for k, x in enumerate(one.tolist()) for m, y in enumerate(two.tolist()) if (own.any() or k < m) and (x, y) in here]
        assert all(size[who[own == s]].sum() <= 100 + size.max() for s in (0, 1))
    assert sorted(seen) == sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist()))


def test_heavy_join_equals_join(spark, monkeypatch):
    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(4000)], "key int, v int")
    right = left.groupBy("key").count().withColumnRenamed("count", "n")
    want = sorted(map(tuple, left.join(right, "key").collect()))
    assert sorted(map(tuple, common.heavy_join(left, right, ["key"], "n", 4000).collect())) == want
    assert sorted(map(tuple, common.heavy_join(left, right.filter("key > 2"), ["key"], "n", 4000).collect())) == [r for r in want if r[0] > 2]


def test_ids_to_verify_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(999)}" for _ in range(80)]
    rows = [(k, " ".join([*words[:40], f"x{k}", *words[41:]])) for k in range(20)] + [(99, "something else that is not alike")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.join_classes(df).collect()))
    assert [r[1] for r in want] == [0] * 20 + [99] and want[0][3] == 19
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, jaccard_join.join_classes(df).collect())) == want


def test_links_equal_brute_force_on_documents(spark):
    """All links of the documents of sf0.01, whatever finds the candidates."""
    import collections

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = jaccard_join.join_classes(docs).collect()
    nodes = collections.defaultdict(list)
    for r in docs.collect():
        nodes[tuple(jaccard_join.WORD.findall((r.text or "").lower()))].append(r.doc_id)
    keys = [w for w in nodes if w]
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in keys]
    have, both = collections.defaultdict(list), collections.Counter()
    for n, s in enumerate(sets):
        for x in s:
            for m in have[x]:
                both[m, n] += 1
            have[x].append(n)
    links = collections.Counter(n for (a, b), k in both.items() if k >= 0.8 * (len(sets[a]) + len(sets[b]) - k) for n in (a, b))
    got = {r.doc_id: r.n_links for r in rows}
    assert len(rows) == docs.count() and all(got[i] == links[n] for n, w in enumerate(keys) for i in nodes[w])


def test_text_of_any_length_is_searched_in_little_memory(spark):
    """A leak at the end of a text of 300,000 words is found, bounded a few stretches at a time."""
    import tracemalloc

    from voxlake.llm import decontaminate

    rng = random.Random(3)
    words = [f"v{k}" for k in range(2000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(12)) + ". The answer is " + rng.choice(words) + " " + rng.choice(words)) for k in range(1500)]
    df = {}
    for _, t in items:
        for w in set(decontaminate.item_words(t)):
            df[w] = df.get(w, 0) + 1
    ix = decontaminate.Index(items, df, len(items), 16.0)
    text = " ".join(["word", "w2", "v3"] * 100_000) + " " + items[77][1]
    text_words = len(decontaminate.item_words(text))
    tracemalloc.start()
    found = decontaminate._found(ix, text, 0.5, 0.8, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == {77} and -found[77][2] > text_words - 64 and peak < 90 << 20


def test_files_of_the_join_follow_its_rows(spark, monkeypatch):
    """Not the shuffle partitions: an executor starts a process for each file."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files, write = {}, jaccard_join.shared_table

    def spy(df, name, *more):
        table = write(df, name, *more)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(jaccard_join, "shared_table", spy)
    try:
        texts = [" ".join(f"w{k % 30}x{j}" for j in range(60)) + f" end{k}" for k in range(300)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        out = jaccard_join.one_per_class(docs)
        assert sorted(r.doc_id for r in out.collect()) == list(range(30))
        assert out.rdd.getNumPartitions() == 1 and {"jaccard-left", "jaccard-found"} <= set(files)
        assert all(n <= 2 for n in files.values()), files
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_texts_reach_python_in_bounded_batches(spark):
    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "x" * 20_000
    df = spark.range(0, 3000, 1, 1).selectExpr("id", f"concat('{text}', id) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    given = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        got = common.map_texts(df, sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 2 * common.BATCH_BYTES
        spark.conf.set(key, "1m")
        common.map_texts(df, sizes, "n long, size long")
        assert spark.conf.get(key) == "1m"
        spark.conf.unset(key)
        jaccard_join.join_classes(df.selectExpr("id AS doc_id", "'a b c' AS text"))
        assert spark.conf.get(key) == str(common.BATCH_BYTES)
    finally:
        spark.conf.set(key, given)


@pytest.mark.parametrize("sizes", [[], [0], [3, 0, 4], [7], [14], [1] * 20, [30, 1]])
def test_regrouped_batches(sizes):
    batches, at = [], 0
    for n in sizes:
        batches.append(pa.record_batch([pa.array(range(at, at + n), pa.int64()), pa.array([[k] * (k % 3) for k in range(at, at + n)], pa.list_(pa.int64()))], ["a", "b"]))
        at += n
    got = list(common.regrouped(batches, 7))
    assert [b.num_rows for b in got] == [7] * (at // 7) + [at % 7] * (at % 7 > 0)
    assert [r for b in got for r in b.to_pylist()] == [{"a": k, "b": [k] * (k % 3)} for k in range(at)]


def test_a_worker_keeps_few_word_hashes():
    shingler = jaccard_join.Shingler()
    shingler.shingles([f"w{k}" for k in range(jaccard_join.WORDS + 100)])
    assert len(shingler._word) == jaccard_join.WORDS <= 100_000
