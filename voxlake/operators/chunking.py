"""Sentence- and token-bounded chunks with exact character offsets.

Texts are split at paragraphs, then sentences, phrases, words and characters, as far as
a piece is too long; pieces are packed greedily, and whole pieces at the end of a chunk,
up to the overlap, begin the next one.  The splitter is a function of one text, so it
runs in a narrow pass over Arrow batches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import bounded_batches

_LEVELS = (r"\n\s*\n+", r"(?<=[.!?])\s+", r"(?<=[,;:])\s+", r"\s+")
_TOKEN = re.compile(r"\w+|[^\s\w]")
#: Characters of chunks that a worker gathers before it sends them on.
OUT_CHARS = 1 << 20


def simple_tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


@lru_cache(4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class FileTokenizer:
    """Token ids by a vocabulary file of the tokenizers library, loaded once a process;
    to be given as ``tokenize``."""

    path: str

    def __call__(self, text: str) -> list[int]:
        return _library(self.path).encode(text, add_special_tokens=False).ids


def pieces(text: str, size: int, tokenize: Callable[[str], Sequence] = simple_tokens) -> list[tuple[int, int]]:
    """``[start, end)`` spans of at most ``size`` tokens that cover ``text`` in order."""

    def cut(start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        if len(tokenize(text[start:end])) <= size or end - start <= 1:
            yield start, end
        elif level < len(_LEVELS):
            at = start
            for m in re.finditer(_LEVELS[level], text[start:end]):
                if start + m.end() > at and start + m.end() < end:
                    yield from cut(at, start + m.end(), level + 1)
                    at = start + m.end()
            yield from cut(at, end, level + 1)
        else:
            middle = (start + end) // 2
            yield from cut(start, middle, level)
            yield from cut(middle, end, level)

    return list(cut(0, len(text), 0)) if text else []


def split(text: str, size: int = 500, overlap: int = 50, tokenize: Callable[[str], Sequence] = simple_tokens) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of each chunk; a text that fits is one chunk."""
    if not text.strip():
        return []
    if len(tokenize(text)) <= size:
        return [(0, len(text), len(tokenize(text)))]
    spans = [s for p in pieces(text, size, tokenize) for s in _sentences(text, p)]
    counts = [len(tokenize(text[a:b])) for a, b in spans]
    out, first, total = [], 0, 0
    for k in range(len(spans) + 1):
        if k == len(spans) or total + counts[k] > size:
            if k > first:
                out.append((spans[first][0], spans[k - 1][1], len(tokenize(text[spans[first][0] : spans[k - 1][1]]))))
            if k == len(spans):
                break
            back, kept = k, 0
            while back > first + 1 and kept + counts[back - 1] <= overlap and kept + counts[back - 1] + counts[k] <= size:
                back -= 1
                kept += counts[back]
            first, total = back, kept
        total += counts[k]
    return out


def _sentences(text: str, span: tuple[int, int]) -> Iterator[tuple[int, int]]:
    at = span[0]
    for m in re.finditer(_LEVELS[1], text[span[0] : span[1]]):
        if span[0] + m.end() < span[1]:
            yield at, span[0] + m.end()
            at = span[0] + m.end()
    yield at, span[1]


def chunk_texts(texts: DataFrame, size: int = 500, overlap: int = 50, tokenize: Callable[[str], Sequence] = simple_tokens) -> DataFrame:
    """``episode_id, chunk_index, start_char, end_char, token_count, text`` from
    ``episode_id, full_text``; null and blank texts have no chunks."""

    kind = texts.schema["episode_id"].dataType.simpleString()
    schema = f"episode_id {kind}, chunk_index long, start_char long, end_char long, token_count int, text string"
    run = partial(_chunks, arrow=to_arrow_schema(StructType.fromDDL(schema)), size=size, overlap=overlap, tokenize=tokenize)
    return bounded_batches(texts.select("episode_id", "full_text")).mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, size: int, overlap: int, tokenize: Callable[[str], Sequence]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`chunk_texts`, in batches of about ``OUT_CHARS``; texts are taken
    from Arrow one at a time."""
    rows, held = [], 0
    for b in batches:
        for e, text in zip(b["episode_id"], b["full_text"]):
            e, text = e.as_py(), text.as_py() or ""
            for k, (a, z, n) in enumerate(split(text, size, overlap, tokenize)):
                rows.append((e, k, a, z, n, text[a:z]))
                held += z - a
                if held >= OUT_CHARS:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
    if rows:
        yield _batch(rows, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


#: Beginnings that are looked for, longest first, and how far before the
#: end of the chunk before.
BEGINNINGS, LOOK_BACK = (200, 100, 50, 30), 500


def located_chunks(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """``episode_id, chunk_index, start_char, end_char`` of chunks (``episode_id,
    chunk_index, text``) of a splitter that gives no offsets, by looking for their
    beginnings in ``texts`` (``episode_id, full_text``).

    The chunks of an episode are taken in order.  Each is looked for from ``LOOK_BACK``
    characters before the end of the last one on, by the longest of ``BEGINNINGS`` that
    it has and that is found; one that is not found begins where the last one ended.
    :func:`times_at_offsets` turns the places into times."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c)
    row = chunks.groupBy("episode_id").agg(listed.alias("c")).join(texts.select("episode_id", "full_text"), "episode_id")
    kind = f"array<struct<chunk_index:{chunks.schema['chunk_index'].dataType.simpleString()},start_char:int,end_char:int>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, c):
        since = F.greatest(acc["at"] - LOOK_BACK, F.lit(0)) + 1
        found = [F.when(F.length(c["text"]) >= n, F.nullif(F.position(F.substring(c["text"], 1, n), F.col("full_text"), since), F.lit(0))) for n in BEGINNINGS]
        start = F.coalesce(*[f - 1 for f in found], acc["at"])
        end = start + F.length(c["text"])
        place = F.struct(c["chunk_index"].alias("chunk_index"), start.alias("start_char"), end.alias("end_char"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    return row.select("episode_id", F.inline(F.aggregate("c", none, step, lambda acc: acc["out"])))


def chunk_episodes(segments: DataFrame, turns: DataFrame, size: int = 500, overlap: int = 50, tokenize: Callable[[str], Sequence] = simple_tokens) -> DataFrame:
    """Chunks of whole episodes with times and speakers, from their segments and turns;
    an episode without segments has none."""
    from .intervals import speakers_in_ranges, times_at_offsets
    from .sequence import text_offsets

    offsets = text_offsets(segments)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "text"))), lambda x: x["text"]), " ")
    chunks = chunk_texts(offsets.groupBy("episode_id").agg(joined.alias("full_text")), size, overlap, tokenize)
    timed = times_at_offsets(chunks, offsets.select("episode_id", "start_char", "end_char", "start_time", "end_time"))
    ready = chunks.join(timed.select("episode_id", "chunk_index", "start_time", "end_time"), ["episode_id", "chunk_index"])
    return speakers_in_ranges(ready, turns)
