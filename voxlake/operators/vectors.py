"""Vector index and exact cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import bounded_batches


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, query: Sequence[float], n: int = 5, where: Column | None = None, min_similarity: float | None = None) -> DataFrame:
    """The ``n`` nearest vectors of those that pass ``where``; the similarity floor
    applies after the cut."""
    base = vectors if where is None else vectors.filter(where)
    scored = base.withColumn("similarity", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6))
    top = scored.orderBy(F.desc("similarity"), "vec_id").limit(n)
    return top if min_similarity is None else top.filter(F.col("similarity") >= min_similarity)


#: Bytes of vectors, as doubles, that are broadcast or make one cell of the grid.
CELL_BYTES = 64 << 20


#: Similarities that are held at once, as doubles.
TILE = 1 << 20


def _by_length(lists: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, matrix)`` of the lists of each length but 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, values.reshape(-1, size) if len(rows) == len(sizes) else values[starts[rows][:, None] + np.arange(size)]


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


class _Block:
    """Queries of one length, and the ``n`` nearest vectors of each so far, itself left out."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray):
        self.ids, self.x, self.n = ids, x, n
        self.floor = np.where(n > 0, -np.inf, np.inf)  # a vector below it is none of the n nearest
        self.found: tuple[np.ndarray, ...] | None = None  # query, id, rounded similarity, similarity

    def add(self, ids: np.ndarray, m: np.ndarray, m_norm: np.ndarray) -> None:
        x = self.x.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = x @ m.T
            s /= np.sqrt((x * x).sum(1))[:, None] * m_norm
        s[~np.isfinite(s)] = -np.inf
        floor, most = self.floor, int(self.n.max()) + 1
        if np.isneginf(floor).any() and most < s.shape[1]:  # itself may be among them
            floor = np.maximum(floor, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most])
        query, at = np.nonzero(s >= (floor - 1e-6)[:, None])
        if self.ids.dtype.kind == ids.dtype.kind:
            other = self.ids[query] != ids[at]
            query, at = query[other], at[other]
        raw = s[query, at]
        rank = np.round(raw, 6)
        new = rank >= self.floor[query]
        if not new.any():
            return
        new = [query[new].astype(np.int32), ids[at[new]], rank[new], raw[new]]
        query, ids, rank, raw = map(np.concatenate, zip(self.found, new)) if self.found else new
        order = np.lexsort((ids, -rank, query))
        place = query[order]
        order = order[np.arange(len(place)) - np.searchsorted(place, place) < self.n[place]]
        self.found = query[order], ids[order], rank[order], raw[order]
        have = np.bincount(self.found[0], minlength=len(self.n))
        full = (have >= self.n) & (self.n > 0)
        self.floor[full] = self.found[2][np.cumsum(have)[full] - 1]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.found:
            query, ids, _, raw = self.found
            names = [pa.array(x.tolist() if x.dtype.kind == "U" else x) for x in (self.ids[query], ids)]
            columns = *names, pa.array(raw, mask=np.isneginf(raw))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _held(queries: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(length, ids, matrix, n)`` of the queries of each length."""
    ids, n = _ids(queries["query_id"]), pc.fill_null(queries["n"], 0).to_numpy()
    return [(size, ids[rows], m, n[rows]) for size, rows, m in _by_length(queries["query"])] if len(queries) else []


def _nearest(held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``query_id, vec_id, similarity``: for each query its ``n`` nearest of all ``batches``,
    by products of ``TILE`` values; of the rest nothing is kept."""
    blocks = {size: [_Block(ids[k : k + 256], x[k : k + 256], n[k : k + 256]) for k in range(0, len(ids), 256)] for size, ids, x, n in held}
    for b in batches:
        names = _ids(b["vec_id"])
        for size, rows, m in _by_length(b["embedding"]) if b.num_rows and blocks else ():
            step = max(1, TILE // max(256, size))
            for at in range(0, len(rows) if size in blocks else 0, step):
                part = m[at : at + step].astype(np.float64)
                norm = np.sqrt((part * part).sum(1))
                for block in blocks[size]:
                    block.add(names[rows[at : at + step]], part, norm)
    for own in blocks.values():
        for block in own:
            yield from block.rows(schema)


def batch_search(vectors: DataFrame, queries: DataFrame, n: Column | int = 10, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``query_id, vec_id, similarity, rank`` and the other columns of ``queries``: the
    ``n`` nearest other vectors per query, ties to the smaller id.

    ``queries``: ``query_id, query`` and whatever ``n`` names; vectors of another length
    than the query's do not match it, a similarity with a zero vector is null and last.
    Queries whose bytes fit one cell are broadcast, and each task keeps its best ``n`` of
    each.  More of them are cut into blocks and the vectors into shards of that size; a
    task holds one of either."""
    keep = F.lit(n) if isinstance(n, int) else n
    q = queries.withColumn("n", keep.cast("int"))
    others = [c for c in queries.columns if c != "query"]
    slim = q.select("query_id", "query", "n").filter("query_id is not null and query is not null")
    v = vectors.select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double"
    weight = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c).cast("long") * 8), F.lit(0))).first()[0]
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    q_bytes = weight(slim, "query")
    if q_bytes <= cell_bytes:
        held = vectors.sparkSession.sparkContext.broadcast(_held(slim.toArrow()))
        found = bounded_batches(v).mapInArrow(lambda batches: _nearest(held.value, batches, arrow), schema)
    else:
        blocks, shards = -(-q_bytes // cell_bytes), max(1, -(-weight(v, "embedding") // cell_bytes))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
        left = slim.withColumn("block", part("query_id", blocks)).withColumn("shard", every(shards))
        right = v.withColumn("shard", part("vec_id", shards)).withColumn("block", every(blocks))
        cell = lambda q, v: pa.Table.from_batches(_nearest(_held(q), v.to_batches(), arrow), arrow)
        found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(cell, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "vec_id")
    ranked = found.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.row_number().over(order))
    return ranked.join(q.select(*others, F.col("n").alias("_n")), "query_id").filter(F.col("rank") <= F.col("_n")).drop("_n")


def search_text(vectors: DataFrame, questions: DataFrame, encoder: Callable[[], Callable[[str], Sequence[float]]] | None = None, n: int = 5, episode_id=None, speaker: str | None = None) -> DataFrame:
    """The ``n`` nearest rows of the ``vectors`` table for every question (``query_id,
    query``), those of one episode or with one speaker if asked for: ``query_id, rank,
    similarity, id, text, episode_id, chunk_index, episode_title, start_time``."""
    base = vectors
    if episode_id is not None:
        base = base.filter(F.col("metadata.episode_id") == episode_id)
    if speaker is not None:
        base = base.filter(F.array_contains(F.split("metadata.speakers", ","), speaker))
    q = with_embedding(questions, "query", "embedding", encoder or (lambda: hashed_bag)).select("query_id", F.col("embedding").alias("query"))
    found = batch_search(base.select(F.col("id").alias("vec_id"), "embedding"), q, n).withColumnRenamed("vec_id", "id")
    about = base.select("id", F.col("document").alias("text"), "metadata.episode_id", "metadata.chunk_index", "metadata.episode_title", "metadata.start_time")
    return found.join(about, "id")


def hashed_bag(text: str, size: int = 64) -> list[float]:
    """Default encoder: words hashed into ``size`` counters, unit length."""
    import math
    import zlib

    v = [0.0] * size
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % size] += 1.0 if h & 0x80000000 else -1.0
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def with_embedding(rows: DataFrame, text: str, name: str, encoder: Callable[[], Callable[[str], Sequence[float]]]) -> DataFrame:
    """``rows`` with the vector of a text column; ``encoder`` builds the model once a task."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield batch.fillna("").map(lambda t: list(model(t)))

    return bounded_batches(rows).withColumn(name, encode(text))


def encode_index(chunks: DataFrame, encoder: Callable[[], Callable[[str], Sequence[float]]] = lambda: hashed_bag) -> DataFrame:
    """Chunks (``episode_id, chunk_index, text, ...``) with ``embedding_id`` and
    ``embedding``."""
    named = chunks.withColumn("embedding_id", F.concat_ws("_", F.col("episode_id").cast("string"), F.col("chunk_index").cast("string")))
    return with_embedding(named, "text", "embedding", encoder)


def vector_rows(encoded: DataFrame) -> DataFrame:
    """Rows of the ``vectors`` table from chunks of :func:`with_metadata` that
    :func:`encode_index` has encoded."""
    return encoded.select(F.col("embedding_id").alias("id"), F.col("embedding").cast("array<float>"), F.col("text").alias("document"), "metadata")


def probe(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors there are, and of those how many have a document, an
    embedding and metadata."""
    return vectors.agg(F.count("*").alias("vectors"), F.count("document").alias("with_document"), F.count("embedding").alias("with_embedding"), F.count("metadata").alias("with_metadata"))


def with_metadata(chunks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Chunks with their episode's metadata, '' and 0 where it is missing."""
    published = F.col("published_at") if "published_at" in episodes.columns else F.lit(None).cast("string")
    e = episodes.select(F.col("id").alias("episode_id"), "title", "duration_seconds", published.alias("published_at"))
    j = chunks.join(e, "episode_id", "left")
    return j.withColumn("metadata", F.struct(
        F.col("episode_id").cast("string").alias("episode_id"), F.coalesce("title", F.lit("")).alias("episode_title"), F.coalesce("published_at", F.lit("")).alias("published_at"),
        F.coalesce("duration_seconds", F.lit(0)).cast("int").alias("duration_seconds"), F.col("chunk_index").cast("int").alias("chunk_index"), "start_time", "end_time", F.coalesce(F.array_join("speakers", ","), F.lit("")).alias("speakers"), F.coalesce("token_count", F.lit(0)).alias("token_count"),
    )).drop("title", "duration_seconds", "published_at")


def consistency(rows: DataFrame, vectors: DataFrame, row_id: str, vector_id: str) -> DataFrame:
    """Counts of ids on both sides, and of those only one side has."""
    a = rows.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.lit(1).alias("a"))
    b = vectors.select(F.col(vector_id).alias("id"), F.lit(1).alias("b"))
    return a.join(b, "id", "full_outer").agg(
        F.count("a").alias("in_rows"), F.count("b").alias("in_vectors"), F.count_if(F.col("b").isNull()).alias("only_rows"), F.count_if(F.col("a").isNull()).alias("only_vectors"),
        (F.count("a") == F.count("b")).alias("consistent"),
    )
