"""MaxScore against brute force: repeated and conflicting rows, ties, both ways of dealing."""

import numpy as np
import pytest

from voxlake.llm import topk


def brute(rows, wanted, k):
    """``rows``: (id, values); ``wanted``: places of the query rows."""
    out = []
    for n in wanted:
        i, q = rows[n]
        scored = sorted((-int(np.dot(np.array(q, object), np.array(v, object))), j) for m, (j, v) in enumerate(rows) if m != n and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread,query_bytes", [(3, 1 << 20), (300, 1 << 20), (3, 1500), (1 << 28, 1 << 20)])
def test_equals_brute_force(spark, monkeypatch, spread, query_bytes):
    rng = np.random.default_rng(7)
    x = rng.integers(-spread, spread, (420, 12))
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    rows += [(50, x[50].tolist()), (50, x[50].tolist()), (100, x[3].tolist()), (7, x[50].tolist()), (150, x[0, :5].tolist()), (8, x[1, :5].tolist()), (200, []), (9, []), (250, [0] * 12)]
    df = spark.createDataFrame([(i, [e / 256 for e in v], 1, "s") for i, v in rows], "vec_id long, embedding array<double>, score int, query_id string").repartition(3)
    v = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 50 = 0"), 5, query_bytes).collect()))
    assert got == brute(rows, [n for n, (i, _) in enumerate(rows) if i % 50 == 0], 5)


def test_blocks_are_skipped(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (12, 32))
    x = centres[rng.integers(0, 12, 5000)] + rng.integers(-20, 20, (5000, 32))
    shard, ids = topk.Shard(np.arange(5000), np.arange(5000), x.astype(float)), np.arange(5000)
    scored = []
    monkeypatch.setattr(topk.np, "partition", lambda a, n: scored.append(len(a)) or np.sort(a))
    best = topk.maxscore(x[0].astype(float), 0, shard, [], 5)
    s = x @ x[0]
    assert best == sorted((-int(s[i]), int(i)) for i in ids if i != 0)[:5]
    assert sum(scored) < 3000


def test_nothing(spark):
    v = topk.quantised(spark.createDataFrame([(0, [1.0]), (1, None), (2, [None]), (3, [float("nan")]), (4, [float("-inf")]), (None, [1.0]), (5, [0.5])], "vec_id long, embedding array<double>"))
    assert sorted(r.vec_id for r in v.collect()) == [0, 5]
    assert list(map(tuple, topk.top_k(v, v.filter("vec_id = 0")).collect())) == [(0, 1, 5, 32768)]
    assert topk.top_k(v, v.filter("false")).count() == topk.top_k(v.filter("false"), v).count() == 0
    assert topk.top_k(v, v, 5, 1).count() == 2
