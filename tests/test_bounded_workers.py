"""What a Python worker holds does not grow with the rows that pass through it."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from voxlake import session
from voxlake.operators import chunking, vectors

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])


def _vectors(rng, first, n, size):
    x = rng.integers(-2, 3, (n, size)).astype(np.float32)  # many ties, some zero vectors
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + n)), pa.array(list(x), pa.list_(pa.float32()))], names=["vec_id", "embedding"]), x


def test_search_equals_brute_force_and_keeps_n_rows_a_query():
    rng = np.random.default_rng(5)
    made = [_vectors(rng, at, 4000, 3) for at in range(0, 12_000, 4000)]
    every = np.concatenate([x for _, x in made]).astype(np.float64)
    n = [k % 4 * 5 for k in range(600)]
    held = vectors._held(pa.table({"query_id": pa.array(range(600)), "query": made[0][0]["embedding"][:600], "n": pa.array(n, pa.int32())}))
    tracemalloc.start()
    got = pa.Table.from_batches(vectors._nearest(held, (b for b, _ in made), FOUND), FOUND).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    with np.errstate(invalid="ignore"):
        s = every[:600] @ every.T / (np.sqrt((every[:600] ** 2).sum(1))[:, None] * np.sqrt((every**2).sum(1)))
    rank = np.where(np.isfinite(s), np.round(s, 6), -np.inf)
    want = {(q, v) for q in range(600) for v in [k for k in np.lexsort((np.arange(len(every)), -rank[q])) if k != q][: n[q]]}
    assert {(r["query_id"], r["vec_id"]) for r in got} == want and len(got) == len(want)
    assert all((r["similarity"] is None) == np.isneginf(rank[r["query_id"], r["vec_id"]]) for r in got)


def test_search_leaves_out_rows_without_an_id(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    for cell in (1, 1 << 20):
        got = vectors.batch_search(v, v.withColumnsRenamed({"vec_id": "query_id", "embedding": "query"}), 5, cell_bytes=cell).collect()
        assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1), (1, 0)]


def test_search_by_names(spark):
    v = spark.createDataFrame([(f"id{k:02}", [1.0, float(k % 3)]) for k in range(20)], "vec_id string, embedding array<float>")
    q = spark.createDataFrame([("id00", [1.0, 0.0]), ("other", [1.0, 2.0])], "query_id string, query array<float>")
    for cell in (1, 1 << 20):
        got = vectors.batch_search(v, q, 3, cell_bytes=cell).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [("id00", 1, "id03"), ("id00", 2, "id06"), ("id00", 3, "id09"), ("other", 1, "id02"), ("other", 2, "id05"), ("other", 3, "id08")]


def test_chunks_leave_in_bounded_batches(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "One two three four. " * 200) for k in range(30)] + [(30, None), (31, " ")], "episode_id long, full_text string")
    want = sorted((k, n, text_of[a:z]) for k, text_of in ((r.episode_id, r.full_text) for r in texts.collect() if r.full_text) for n, (a, z, _) in enumerate(chunking.split(text_of, 50, 5)))
    given, key = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(key)
        got = chunking.chunk_texts(texts, 50, 5)
        assert sorted((r.episode_id, r.chunk_index, r.text) for r in got.collect()) == want
        assert int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) == session.BATCH_BYTES
    finally:
        spark.conf.set(key, given)
    monkeypatch.setattr(chunking, "OUT_CHARS", 10_000)
    arrow = to_arrow_schema(got.schema)
    sent = list(chunking._chunks([pa.RecordBatch.from_pydict({"episode_id": [1, 2], "full_text": ["One two three four. " * 5000] * 2})], arrow, 50, 5, chunking.simple_tokens))
    assert len(sent) > 10 and max(sum(map(len, b["text"].to_pylist())) for b in sent) < 11_000


def test_texts_are_encoded_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given, df = spark.conf.get(key), spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('word ', 4000) AS text")

    @F.pandas_udf("long")
    def sizes(batch: pd.Series) -> pd.Series:
        return pd.Series([len(batch)] * len(batch))

    try:
        spark.conf.unset(key)
        got = vectors.with_embedding(df, "text", "v", lambda: lambda t: [float(len(t))])
        assert {tuple(r.v) for r in got.select("v").distinct().collect()} == {(20_000.0,)} and got.count() == 1500
        assert df.select(sizes("text").alias("n")).agg(F.max("n")).first()[0] < 2 * session.BATCH_BYTES / 20_000
    finally:
        spark.conf.set(key, given)
