"""Exact top-k inner products with MaxScore over quantised vectors.

A component of a vector is a posting of its dimension, in the list of its sign; a query's
terms are its non-zero components.  A posting of the query's sign adds to a score, one of
the other sign takes away, so a term's bound is its largest product with a posting of its
own sign.  The postings of a shard lie in blocks of ``ROWS`` vectors, sorted so that
vectors of like signs stand together, and each list has the largest impact of every block.

Terms are sorted by bound and split: those whose bounds sum to less than the k-th best
score so far cannot lift a vector into the result alone and are non-essential.  Blocks are
visited by falling bound, until no block's bound reaches that score.  In a block the
essential postings are added up first; the others are probed, largest bound first, only
for vectors whose partial score plus the bounds still to come stays competitive.

A task goes through its vectors in shards and keeps the ``k`` best of every query from one
shard to the next, so later shards start with a high score to beat.  Queries that fit
``QUERY_BYTES`` are broadcast and vectors do not move; more queries are cut into blocks of
that size, and every shard meets every block.  The tasks' results are merged per query.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

#: Bytes of queries that are broadcast, vectors in a shard, vectors in a block of postings,
#: blocks scored at once.
QUERY_BYTES, SHARD, ROWS, BLOCKS = 32 << 20, 8192, 32, 32


def quantised(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """``row, vec_id, v`` with ``v = floor(scale * x)`` per component and a key per row,
    as a stored table, so that a row has the same key whenever it is read; vectors that
    are null, or hold null or non-finite components, are left out, as are null ids."""
    x = F.col(column)
    clean = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    kept = vectors.filter(x.isNotNull() & clean & F.col(id_col).isNotNull())
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return shared_table(kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), whole.alias("v")), "topk-vectors")


class Shard:
    """Postings of vectors of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        weight = np.argsort(-np.abs(values).sum(0), kind="stable")[:16]
        order = np.lexsort((values[:, weight] > 0).T[::-1]) if len(weight) else np.arange(len(ids))
        self.rows, self.ids = rows[order], ids[order]
        # A column is a dimension's list of postings of both signs, in block order.
        self.lists = np.ascontiguousarray(values[order])
        starts = np.arange(0, len(ids), ROWS)
        self.high = np.maximum(np.maximum.reduceat(self.lists, starts, axis=0), 0).T
        self.low = np.minimum(np.minimum.reduceat(self.lists, starts, axis=0), 0).T


def maxscore(query: np.ndarray, own_row: int, shard: Shard, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The ``k`` best ``(-score, id)`` of ``best`` and a shard, in order."""
    terms = np.flatnonzero(query)
    q = query[terms]
    impact = np.where((q > 0)[:, None], shard.high[terms], shard.low[terms]) * q[:, None]
    bound = impact.max(1)
    order = np.argsort(-bound, kind="stable")
    terms, q = terms[order], q[order]
    # to_come[j]: the most that the terms from place j on can add.
    to_come = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
    reach = impact.sum(0)
    visit = np.argsort(-reach, kind="stable")
    for at in range(0, len(visit), BLOCKS):
        blocks = visit[at : at + BLOCKS]
        theta = -best[k - 1][0] if len(best) >= k else None
        if theta is not None:
            blocks = blocks[reach[blocks] >= theta]
            if not len(blocks):
                break
        rows = (blocks[:, None] * ROWS + np.arange(ROWS)).ravel()
        rows = rows[rows < len(shard.ids)]
        rows = rows[shard.rows[rows] != own_row]
        split = len(terms) if theta is None else min(len(terms), int(np.searchsorted(-to_come, -theta, side="right")))
        essential = np.zeros_like(query)
        essential[terms[:split]] = q[:split]
        partial = shard.lists[rows] @ essential
        j = split
        while j < len(terms) and len(rows):
            competitive = partial + to_come[j] >= theta
            rows, partial = rows[competitive], partial[competitive]
            partial = partial + shard.lists[rows[:, None], terms[j : j + 8]] @ q[j : j + 8]
            j += 8
        if theta is not None:
            keep = partial >= theta
            rows, partial = rows[keep], partial[keep]
        if len(rows) > k:
            keep = partial >= np.partition(partial, len(rows) - k)[len(rows) - k]
            rows, partial = rows[keep], partial[keep]
        if len(rows):
            best = sorted(best + [(-int(s), int(i)) for s, i in zip(partial, shard.ids[rows])])[:k]
    return best


def _exact(queries: np.ndarray, values: np.ndarray) -> bool:
    """Whether doubles hold every score of the two exactly."""
    most = lambda x: int(np.abs(x).max(initial=0))
    return most(queries) * most(values) * max(1, values.shape[1]) < 1 << 53


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray]], best: dict[int, list], rows: np.ndarray, ids: np.ndarray, values: list, k: int) -> None:
    """Bring ``best`` up to date with one shard of vectors."""
    by_length = defaultdict(list)
    for n, v in enumerate(values):
        by_length[len(v)].append(n)
    for length, those in by_length.items():
        keys, wanted = queries.get(length, ((), None))
        if not len(keys):
            continue
        m = np.stack([values[n] for n in those]).astype(np.int64) if length else np.zeros((len(those), 0), np.int64)
        kind = np.float64 if _exact(wanted, m) else np.int64
        shard, q = Shard(rows[those], ids[those], m.astype(kind)), wanted.astype(kind)
        for n, key in enumerate(keys.tolist()):
            best[key] = maxscore(q[n], key, shard, best.get(key, []), k)


def _by_length(rows: np.ndarray, values: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    return {int(n): (rows[lengths == n], np.array([v for v in values if len(v) == n], np.int64).reshape(int((lengths == n).sum()), n)) for n in np.unique(lengths)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` best rows of
    ``vectors`` but itself by inner product, ties to the smaller id, fewer if there are
    fewer.  Both have ``row, vec_id, v`` (see :func:`quantised`); other columns, whatever
    their names, are not looked at.

    A row is left out of its own result by its key, not its id: where several rows have
    one id, each is a query with its own ``k`` results, and a candidate of the others.
    Vectors of another length than the query's do not match it.  An empty side gives an
    empty result."""
    q = queries.select("row", "vec_id", "v")
    n_bytes = q.agg(F.coalesce(F.sum(F.size("v").cast("long") * 8 + 16), F.lit(0))).first()[0]
    v = vectors.select("row", "vec_id", "v")
    schema = "row long, vec_id long, score long"

    def found(best: dict[int, list]) -> pd.DataFrame:
        return pd.DataFrame([(key, i, -s) for key, top in best.items() for s, i in top], columns=["row", "vec_id", "score"])

    if n_bytes <= query_bytes:
        held = q.toPandas()
        sent = vectors.sparkSession.sparkContext.broadcast(_by_length(held["row"].to_numpy(np.int64), held["v"].tolist()))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, list] = {}
            for b in batches:
                for at in range(0, len(b), SHARD):
                    part = b.iloc[at : at + SHARD]
                    _search(sent.value, best, part["row"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), part["v"].tolist(), k)
            yield found(best)

        merged = v.mapInPandas(scan, schema)
    else:
        n_blocks, n_shards = -(-n_bytes // query_bytes), max(1, -(-vectors.count() // SHARD))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

        def score(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
            best: dict[int, list] = {}
            if len(qs) and len(vs):
                _search(_by_length(qs["row"].to_numpy(np.int64), qs["v"].tolist()), best, vs["row"].to_numpy(np.int64), vs["vec_id"].to_numpy(np.int64), vs["v"].tolist(), k)
            return found(best)

        left = q.withColumn("block", part(n_blocks)).withColumn("shard", every(n_shards))
        right = v.withColumn("shard", part(n_shards)).withColumn("block", every(n_blocks))
        merged = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(score, schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    top = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(q.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")
