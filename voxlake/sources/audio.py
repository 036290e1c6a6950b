"""Audio, and hooks for what models and the network do: download, transcription, judging.

Each hook takes a function that handles one item.  An error stays with its row, as text, and
the row is pending again in the next run.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def download(episodes: DataFrame, fetch: Callable[[str, str], int], existing: DataFrame | None = None) -> DataFrame:
    """``id, file_name, ok, error`` per episode that has no file yet.  ``fetch(url,
    file_name)`` stores the audio and returns its size; it removes what it has written
    if it fails.  An episode without a url is not downloaded."""
    from ..functions.text import audio_file_name

    wanted = episodes.select("id", "audio_url", audio_file_name(F.col("title")).alias("file_name"))
    if existing is not None:
        wanted = wanted.join(existing.select(F.element_at(F.split("path", "/"), -1).alias("file_name")), "file_name", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, url, name in zip(b["id"], b["audio_url"], b["file_name"]):
                error = None if url else "no url"
                if url:
                    try:
                        fetch(url, name)
                    except Exception as e:
                        error = str(e)
                rows.append((i, name, error is None, error))
            yield pd.DataFrame(rows, columns=["id", "file_name", "ok", "error"])

    kind = episodes.schema["id"].dataType.simpleString()
    return wanted.select("id", "audio_url", "file_name").mapInPandas(run, f"id {kind}, file_name string, ok boolean, error string")


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """``(samples x channels, rate)`` of PCM audio, scaled to -1 to 1."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << 8 * width - 1)
    else:
        raise ValueError(f"samples of {width} bytes")
    return x.reshape(-1, channels), rate


def audio_windows(files: DataFrame, size: float = 1800, overlap: float = 5, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """``path, window_index, start_time, end_time, rate, samples, error`` of audio files
    (``path, content``, as of ``binaryFile``): mono by the mean of the channels, cut into
    windows as :func:`sequence.plan_windows` plans them.

    One window is held as floats at a time beside the decoded file.  ``decode`` knows the
    format; a file that it refuses is one row with the error and no samples."""
    stride = size - overlap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "window_index", "start_time", "end_time", "rate", "samples", "error"]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    x, rate = decode(content)
                except Exception as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, str(e))], columns=columns)
                    continue
                seconds, k = len(x) / rate, 0
                while seconds and (k == 0 or (k - 1) * stride + size < seconds):
                    start, end = k * stride, min(k * stride + size, seconds)
                    mono = x[round(start * rate) : round(end * rate)].mean(1).astype(np.float32)
                    yield pd.DataFrame([(path, k, float(start), float(end), rate, mono, None)], columns=columns)
                    k += 1

    return files.select("path", "content").mapInPandas(run, "path string, window_index int, start_time double, end_time double, rate int, samples array<float>, error string")


def apply_model(rows: DataFrame, key: str, column: str, model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``key, output, error``: a text model over ``column``; ``model`` builds it once a
    task.  For transcription windows, answers and judgements alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for b in batches:
            out = []
            for k, x in zip(b[key], b[column]):
                try:
                    out.append((k, call(x), None))
                except Exception as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "output", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, column).mapInPandas(run, f"{key} {kind}, output string, error string")
