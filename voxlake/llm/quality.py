"""Quality scores: random Fourier features of document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

Whole texts become a few statistics (character classes, word and line shape,
repetition).  Random Fourier features of the standardised statistics approximate a
Gaussian kernel; every partition of the labelled rows sums its own part of the normal
equations, so what travels has the size of the feature space and not of the data.  The
raw scores of a calibration fold are pooled into ``BINS`` bins and fitted by isotonic
regression, which turns scores into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, id_text, map_texts, pieces, shared_table

#: Labelled documents up to which their ids (about 15 MB) are broadcast, so that no other is
#: measured; beyond, all are measured and joined by shuffle.
BROADCAST_LABELS = 200_000
#: Random features, bins of the calibration, tasks that sum partial equations.
FEATURES, BINS, SUMMERS = 256, 1024, 8
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
LIMIT = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,),
    "stop": (46, 63), "loud": (33,), "comma": (44, 59, 58), "bar": (124,), "hash": (35, 36, 37, 38, 42, 64, 94, 126),
    "bracket": (40, 41, 60, 62, 91, 93, 123, 125), "quote": (34, 39, 96), "dash": (45, 95, 47, 92, 61, 43), "high": range(128, 256),
}


def _table() -> np.ndarray:
    t = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES.values()):
        t[list(members), k] = 1
    return t


_OF = _table()
STATISTICS = len(_CLASSES) + 12


def statistics(text: str) -> np.ndarray:
    """The statistics of one text; an empty text has zeros throughout."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return np.zeros(STATISTICS, np.float32)
    shares = np.bincount(raw, minlength=256) @ _OF / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    seen, rows = Counter(words), Counter(lines)
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    capital = sum(c for w, c in seen.items() if w.isupper() and len(w) > 1)
    plain = sum(c for w, c in seen.items() if w[-1].isalpha())
    more = [
        np.log1p(len(raw)), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), np.sqrt(len(seen) / n), max(seen.values()) / n,
        1 - len(rows) / len(lines), np.log1p(n / len(lines)), np.log1p(len(lines)), capital / n, plain / n,
    ]
    return np.concatenate([np.sqrt(shares), more]).astype(np.float32)


def fold(doc_id) -> F.Column:
    """crc32 of the id's text, modulo ``FOLDS``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` (float32 bytes) of every whole text: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [statistics(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "stats"])

    df = id_text(docs)
    return map_texts(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, stats binary")


class Model:
    """Everything that scoring needs; a few hundred kilobytes."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-6, std, 1.0)
        self.turn = draw.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES))
        self.shift = draw.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + STATISTICS + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def phi(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        waves = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / FEATURES)
        return np.concatenate([waves, x * 0.1, np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.phi(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, STATISTICS).astype(np.float64)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the weighted centres of the pools."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    # One pseudo-count of each label keeps scores off 0 and 1 and so in order.
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def fit(docs: DataFrame, labels: DataFrame, ridge: float = 1.0) -> Model:
    """Fit on all labelled rows outside the held-out fold.

    Null labels and labels of unknown documents are ignored; several labels of one
    document are averaged; repeated rows of a document count each, and rows without a
    doc_id have no label.  Without any label, or any document, every score is 0.5.  Texts
    are measured as :func:`statistics` does: null and empty ones have zeros, long ones are
    read whole."""
    y = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    y = y.withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT)
    few = y.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    if few:
        # So few that only labelled documents need to be measured.
        y = F.broadcast(y)
        docs = docs.join(F.broadcast(y.select("doc_id")), "doc_id", "left_semi")
    known = measured(docs).join(y, "doc_id").select("stats", "y", "fold")
    known = shared_table(known.repartition(SUMMERS) if few else known, "quality-fit")
    schema = "sums binary"

    def partial(part) -> Iterator:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in pieces(batches, 4096):
                if b.num_rows:
                    now = part(b)
                    total = now if total is None else total + now
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        return run

    def summed(df: DataFrame, part, size: int) -> np.ndarray:
        add = partial(lambda b: np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(b.num_rows, -1).sum(0))
        rows = df.mapInArrow(partial(part), schema).repartition(SUMMERS).mapInArrow(add, schema).collect()
        return sum((np.frombuffer(r.sums) for r in rows), np.zeros(size))

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    n, *rest = summed(known.select("stats"), moments, 1 + 2 * STATISTICS)
    rest = np.array(rest).reshape(2, -1) / max(n, 1)
    model = Model(rest[0], np.sqrt(np.maximum(rest[1] - rest[0] ** 2, 0)))
    if not n:
        drop_table(known)
        return model
    d = len(model.weights)

    def equations(b: pa.RecordBatch) -> np.ndarray:
        p = model.phi(_matrix(b.column(0)))
        return np.concatenate([(p.T @ p).ravel(), p.T @ b.column(1).to_numpy(zero_copy_only=False)])

    train = known.filter(F.col("fold") != CALIBRATION)
    sums = summed(train.select("stats", "y"), equations, d * d + d)
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + ridge * np.eye(d), sums[d * d :])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            raw = model.raw(_matrix(b.column(0)))
            at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw), b.column(1)], names=["bin", "raw", "y"])

    bins = known.filter(F.col("fold") == CALIBRATION).select("stats", "y").mapInArrow(binned, "bin int, raw double, y double")
    rows = sorted(bins.groupBy("bin").agg(F.avg("raw"), F.avg("y"), F.count("*")).collect())
    if rows:
        _, x, t, w = (np.array(c, float) for c in zip(*rows))
        model.knots = _isotonic(x, t, w)
    drop_table(known)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Null texts count as empty, and an empty text is scored like any other; a null
    doc_id is not held out; repeated rows come back each; an empty table gives an empty
    result.  Ids, labels, languages and sources are no inputs of a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            stats = np.stack([statistics(t) for t in b.column(1).to_pylist()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(stats))], names=["doc_id", "score"])

    df = id_text(docs)
    scored = map_texts(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept, whatever
    their names.  Each row is judged by its own text, null and empty ones like any other;
    repeated rows and null ids are kept or dropped alike; an empty table stays empty."""
    model = fit(docs, labels)
    # By place: what the columns are called, dots included, does not matter here.
    text = docs.columns.index("text")
    placed = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            stats = np.stack([statistics(t or "") for t in b.column(text).to_pylist()]).astype(np.float64)
            yield b.filter(pa.array(model.score(stats) >= LIMIT))

    return map_texts(placed, run, placed.schema).toDF(*docs.columns)
