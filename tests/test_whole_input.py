"""Queries that once ran over a part of their input run over all of it."""

from pyspark.sql import functions as F

from voxlake.operators import chunking, vectors
from voxlake.plans import catalog


def test_index_holds_every_chunk(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {(r.doc_id, k): r.text[a:z] for r in docs.filter("text is not null").collect() for k, (a, z, _) in enumerate(chunking.split(r.text))}
    got = catalog.QUERIES["encode_index"](spark, small).collect()
    assert {(r.episode_id, r.chunk_index): r.text for r in got} == want and len(got) == len(want)
    assert all(r.embedding_id == f"{r.episode_id}_{r.chunk_index}" and len(r.embedding) == 64 for r in got)


def test_search_of_every_20th_vector(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet")
    got = sorted(map(tuple, catalog.QUERIES["retrieval_topk_batch"](spark, small).collect()))
    assert len(got) == 10 * v.filter("vec_id % 20 = 0").count()
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    grid = vectors.batch_search(v, q, 10, cell_bytes=2000).select("query_id", "vec_id", "similarity", "rank")
    assert sorted(map(tuple, grid.collect())) == got


def test_search_with_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id in (0, 5)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for cell in (1, 1 << 20):
        got = sorted((r.rank, r.vec_id, r.similarity) for r in vectors.batch_search(v, q, 9, cell_bytes=cell).collect())
        assert got == [(1, 2, 0.707107), (2, 3, 0.707107), (3, 6, -1.0), (4, 1, None)]
        assert vectors.batch_search(v, q.filter("false"), 9, cell_bytes=cell).count() == vectors.batch_search(v.filter("false"), q, 9, cell_bytes=cell).count() == 0
