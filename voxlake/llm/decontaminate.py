"""Benchmark decontamination: BM25 with block-max WAND over an index of test items.

The items are indexed, ``SHARD`` of them at a time; every passage of every document is
a query.  BM25 weights are divided by the item's own total, so a score is the share of
the item's weight that the passage holds and one threshold serves all items.

Passages are windows of two neighbouring stretches of a document, each as long as the
longest item, so that some window holds any copied item whole.  For each window the
block maxima of its distinct terms bound its score in every block of the index; blocks
below the threshold are skipped.  Within the others WAND moves through the postings:
cursors are sorted by item, and the pivot is the first item that the bounds of the
cursors before it can lift to the threshold.

Retrieved items are then verified: the shares of five-word shingles of the item's
question and answer that the window holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts, pieces

#: Items of an index shard, which bounds what is sent to the executors at once.
SHARD = 5_000
#: Items in a block of postings.
ITEMS = 4
K1, B = 1.2, 0.75
SHINGLE = 5
#: Stretches of a text that are bounded at once.
STRETCHES = 64
WORD = re.compile(r"\w+")


def item_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer, the rest the question; an item of one
    sentence is cut after two thirds of its words."""
    parts = [w for w in (item_words(p) for p in re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = item_words(text)
    cut = -(-2 * len(words) // 3)
    return words[:cut], words[cut:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Five-word shingles; fewer words are one shingle, no words none."""
    return {tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Index:
    """BM25 postings of a shard of items."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n_items: int, mean_length: float):
        self.items = [(i, t) for i, t in items if item_words(t)]
        self.ids = [i for i, _ in self.items]
        words = [item_words(t) for _, t in self.items]
        self.longest = max(map(len, words), default=0)
        self.terms: dict[str, int] = {}
        self.postings: list[dict[int, float]] = []
        for k, w in enumerate(words):
            tf: dict[str, int] = {}
            for x in w:
                tf[x] = tf.get(x, 0) + 1
            raw = {}
            for x, f in tf.items():
                idf = np.log(1 + (n_items - df[x] + 0.5) / (df[x] + 0.5))
                raw[x] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean_length))
            total = sum(raw.values())
            for x, v in raw.items():
                term = self.terms.setdefault(x, len(self.terms))
                if term == len(self.postings):
                    self.postings.append({})
                self.postings[term][k] = float(v / total)
        blocks = max(1, -(-len(self.items) // ITEMS))
        # The last row is that of a word the index does not have.
        self.maxima = np.zeros((len(self.terms) + 1, blocks), np.float32)
        self.of: list[dict[int, list[tuple[int, float]]]] = []
        for term, post in enumerate(self.postings):
            split: dict[int, list[tuple[int, float]]] = {}
            for k, v in sorted(post.items()):
                split.setdefault(k // ITEMS, []).append((k, v))
                self.maxima[term, k // ITEMS] = max(self.maxima[term, k // ITEMS], v)
            self.of.append(split)
        self.parts = [tuple(shingles(p) for p in question_answer(t)) + (shingles(w),) for (_, t), w in zip(self.items, words)]

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of ``block`` that score ``threshold`` or more, with their scores."""
        cursors = [[split[0][0], 0, split, self.maxima[t, block]] for t in terms if (split := self.of[t].get(block))]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                value = 0.0
                for c in cursors:
                    if c[0] != item:
                        break
                    value += c[2][c[1]][1]
                if value >= threshold - 1e-9:
                    found.append((item, value))
                item += 1
            for c in cursors:
                while c[1] < len(c[2]) and c[2][c[1]][0] < item:
                    c[1] += 1
                c[0] = c[2][c[1]][0] if c[1] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def search(self, text: str, threshold: float) -> Iterator[tuple[int, float, int, list[str]]]:
        """``item, score, first word, words`` of every window and item that match."""
        words = item_words(text)
        if not words or not self.items:
            return
        n, step = len(words), self.longest
        missing = len(self.terms)
        known = np.fromiter(map(self.terms.get, words, repeat(missing)), np.int64, n)
        at = np.flatnonzero(known != missing)
        if not len(at):
            return
        stretches = -(-n // step)
        keys = np.unique((at // step) * (missing + 1) + known[at])
        stretch, term = keys // (missing + 1), keys % (missing + 1)
        first = np.searchsorted(stretch, np.arange(stretches + 2))
        # A few stretches at a time, and the one after them: the bounds never grow with
        # the text.
        for lo in range(0, max(1, stretches - 1), STRETCHES):
            hi = min(lo + STRETCHES, max(1, stretches - 1))
            a, z = first[lo], first[min(hi + 1, stretches)]
            bounds = np.zeros((hi - lo + 1, self.maxima.shape[1]), np.float32)
            if z > a:
                begin = np.flatnonzero(np.concatenate([[True], stretch[a + 1 : z] != stretch[a : z - 1]]))
                bounds[stretch[a:z][begin] - lo] = np.add.reduceat(self.maxima[term[a:z]], begin, axis=0)
            for k, block in np.argwhere(bounds[:-1] + bounds[1:] >= threshold - 1e-4):
                w = lo + int(k)
                terms = sorted(set(term[first[w] : first[min(w + 2, stretches)]].tolist()))
                for item, value in self.wand(terms, int(block), threshold):
                    yield item, value, w * step, words[w * step : (w + 2) * step]


def _overlap(part: set, inside: set, words: list[str]) -> float:
    if not part:
        return 1.0
    if len(next(iter(part))) < SHINGLE:
        short = next(iter(part))
        return float(any(tuple(words[k : k + len(short)]) == short for k in range(len(words) - len(short) + 1)))
    return len(part & inside) / len(part)


def _found(ix: Index, text: str, threshold: float, overlap: float, part_overlap: float) -> dict[int, tuple]:
    """For every item that ``text`` leaks: item overlap, score, negative first word,
    question and answer overlap at its best window."""
    best: dict[int, tuple] = {}
    for item, value, start, words in ix.search(text, threshold):
        question, answer, whole = ix.parts[item]
        inside = shingles(words)
        found = [_overlap(p, inside, words) for p in (whole, question, answer)]
        if found[0] >= overlap and min(found) >= part_overlap:
            row = (found[0], value, -start, found[1], found[2])
            best[item] = max(best.get(item, row), row)
    return best


def _indexes(benchmark: DataFrame) -> Iterator:
    """A broadcast index for every shard of the items.  Document frequencies and lengths
    are counted over all items."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = [item_words(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array(map(len, words), pa.int64())], names=["words", "n"])

    counted = items.select("text").mapInArrow(split, "words array<string>, n long")
    n_items, total = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-n_items // SHARD))
    frequencies = counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows = [(r.item_id, r.text) for r in own.sort("item_id", "text").collect()]
        terms = own.select("text").mapInArrow(split, "words array<string>, n long").select(F.explode("words").alias("word")).distinct()
        df_of = {r.word: r.df for r in frequencies.join(terms, "word").collect()}
        yield spark.sparkContext.broadcast(Index(rows, df_of, n_items, total / max(n_items, 1)))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part_overlap: float = 0.5) -> DataFrame:
    """``doc_id, item_id, score, item_overlap, question_overlap, answer_overlap,
    start_word`` per document and item it leaks, at its best window.

    A pair is a leak where the window scores ``threshold``, holds ``overlap`` of the
    item's shingles and ``part_overlap`` of those of the question and of the answer.
    Null and empty texts, and items without words, match nothing; repeated rows come
    back each; an empty side gives an empty result; columns beside ``doc_id, text`` and
    ``item_id, text`` are not looked at.

    The index is sent a shard at a time, so its size on an executor is bounded however
    many items there are."""
    df = id_text(docs)
    kind = df.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, item_overlap double, question_overlap double, answer_overlap double, start_word long"
    result = None
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in pieces(batches):
                out = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    best = _found(ix, text, threshold, overlap, part_overlap)
                    out += [(doc, ix.ids[k], r[1], r[0], r[3], r[4], -r[2]) for k, r in sorted(best.items())]
                if out:
                    types = [b.schema.field(0).type, None, *[pa.float64()] * 4, pa.int64()]
                    names = ["doc_id", "item_id", "score", "item_overlap", "question_overlap", "answer_overlap", "start_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        found = map_texts(df, run, schema)
        result = found if result is None else result.unionByName(found)
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part_overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item, whatever their doc_id, each judged by
    itself where it is read; all columns are kept, whatever their names.  Null and empty
    texts leak nothing; an empty table, or no items, leaves ``docs`` as it is."""
    at = docs.columns.index("text")
    kept = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = kept.schema
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in pieces(batches):
                yield b.filter(pa.array([not _found(ix, t or "", threshold, overlap, part_overlap) for t in b.column(at).to_pylist()], pa.bool_()))

        kept = map_texts(kept, run, schema)
    return kept.toDF(*docs.columns)
