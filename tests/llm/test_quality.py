"""The fitted model against one computed in one piece."""

import zlib

import numpy as np
import pytest

from voxlake.llm import quality


def test_model_equals_direct_computation(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = [(r.doc_id, float(r.quality)) for r in labels.filter("quality is not null").collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 5]
    stats = np.stack([quality.statistics(text[i]) for i, _ in rows]).astype(np.float64)
    y, fold = np.array([v for _, v in rows]), np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in rows])
    want = quality.Model(stats.mean(0), stats.std(0))
    train = fold != quality.CALIBRATION
    p = want.phi(stats[train])
    want.weights = np.linalg.solve(p.T @ p + np.eye(p.shape[1]), p.T @ y[train])
    for limit in (quality.BROADCAST_LABELS, 0):
        quality.BROADCAST_LABELS, kept = limit, quality.BROADCAST_LABELS
        got = quality.fit(docs.repartition(5), labels)
        quality.BROADCAST_LABELS = kept
        assert np.allclose(got.mean, want.mean) and np.allclose(got.std, want.std) and np.allclose(got.weights, want.weights, atol=1e-6)
        held = want.raw(stats[~train])
        assert (np.diff(got.knots[0]) > 0).all() and (np.diff(got.knots[1]) >= -1e-12).all()
        assert got.knots[0][0] >= held.min() - 1e-6 and got.knots[0][-1] <= held.max() + 1e-6


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_equals_min_max(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 40)
    x, y, w = np.sort(rng.random(n)), rng.integers(0, 2, n).astype(float), rng.integers(1, 9, n).astype(float)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    level = [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
    knots, values = quality._isotonic(x, y, w)
    pools, at = [], 0
    while at < n:
        end = at
        while end + 1 < n and abs(level[end + 1] - level[at]) < 1e-12:
            end += 1
        total = w[at : end + 1].sum()
        pools.append(((x[at : end + 1] * w[at : end + 1]).sum() / total, (level[at] * total + 0.5) / (total + 1)))
        at = end + 1
    assert np.allclose(knots, [p[0] for p in pools]) and np.allclose(values, [p[1] for p in pools])


def test_odd_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 5 + 1), "q", 1.0) for k in range(40)] + [(None, "no id", "q", 1.0), (3, "again", "q", 1.0), (41, None, "q", 1.0)], "doc_id long, text string, y string, fold double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (None, 1), (999, 1), (2, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 43 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert {r.score for r in quality.score(docs, quality.fit(docs.filter("false"), labels)).collect()} == {0.5}
