"""Scalar functions as column expressions, and the injectable models' defaults."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Self-introduction patterns by language; group 1 is the name.
INTRO_PATTERNS = {
    "pt_br": (
        r"aqui [eé] [oa] ([^,]+?)(?:,|\s+e\s|$)",
        r"eu sou [oa]? ?([^,]+?)(?:,|\s+e\s|$)",
        r"aqui quem vos fala [eé] [oa] ([^,]+?)(?:,|\s+e\s|$)",
    ),
    "en": (
        r"this is ([^,]+?)(?:,|\s+from\s|\s+and\s|$)",
        r"i'?m ([^,]+?)(?:,|\s+from\s|\s+and\s|$)",
        r"my name is ([^,]+?)(?:,|\s+from\s|\s+and\s|$)",
    ),
}
#: What marks an error message as one of memory.
OOM_SIGNATURES = ("out of memory", "cuda error: out of memory", "get was unable to find an engine", "cuda out of memory")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a column that is computed once a row.  A column named inside the
    lambda of an array function would be computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def round_even(value: Column | str, places: int) -> Column:
    """A double at ``places``, ties to even after scaling, as ``round_even`` of the SQL
    twins; ``bround`` rounds the shortest decimal that stands for the double instead."""
    scale = F.lit(10.0**places)
    return F.rint((F.col(value) if isinstance(value, str) else value) * scale) / scale


def fixed(value: Column, places: int) -> Column:
    """``%.nf`` of the exact binary value, exact ties to even, as ``printf`` of the SQL
    twins; Java rounds the shortest decimal that stands for the double, ties up."""
    scale, plain = 10.0**places, f"%.{places}f"

    def exact(x: Column) -> Column:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # 26 bits of x, so that its products and the rest's are exact
        low = F.floor(x * scale).cast("double")
        beyond = (high * scale - low - 0.5) + (x - high) * scale
        return low + F.when((beyond > 0) | ((beyond == 0) & (low % 2 == 1)), 1.0).otherwise(0.0)

    sign = F.when(value < 0, "-").otherwise("")
    return F.when(F.abs(value) < 1e9, F.concat(sign, F.format_string(plain, let(F.abs(value), exact) / scale))).otherwise(F.format_string(plain, value))


def mmss(seconds: Column) -> Column:
    """``MM:SS``; minutes are not wrapped at 60."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("int"))


def hhmmss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)


def title_case(text: Column) -> Column:
    """Capitals after every non-letter, the rest lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def extract_name(text: Column, aliases: Mapping[str, str] = {}, patterns: Sequence[str] = INTRO_PATTERNS["en"]) -> Column:
    """A known host by alias, else the first introduction whose name, cut to two words,
    has more than two letters; null if there is none."""
    low = F.lower(text)
    known = [F.when(low.rlike(rf"(?U)\b\Q{alias}\E\b"), F.lit(name)) for alias, name in aliases.items()]
    found = []
    for p in patterns:
        words = F.slice(F.filter(F.split(F.trim(F.regexp_extract(low, p, 1)), r"(?U)\s+"), lambda w: w != ""), 1, 2)
        name = title_case(F.array_join(words, " "))
        found.append(F.when(F.length(name) > 2, name))
    return F.coalesce(*known, *found, F.lit(None).cast("string"))


def audio_file_name(title: Column) -> Column:
    """Letters, digits, space, ``-`` and ``_`` kept, others ``_``; 80 characters."""
    return F.concat(F.trim(F.substring(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "_"), 1, 80)), F.lit(".mp3"))


def similarity_band(similarity: Column) -> Column:
    return F.when(similarity >= 0.65, "green").when(similarity >= 0.55, "yellow").otherwise("red")


def is_memory_error(message: Column) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in OOM_SIGNATURES]), lambda s: F.contains(F.lower(message), s))


def words(text: Column) -> Column:
    """Words between Unicode white space; none for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def repetition_rate(word_list: Column, size: int = 50) -> Column:
    """Share of distinct ones among whole windows of ``size`` words that start before
    the last ``size`` words; 1.0 where there is no window."""

    def rate(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - size - 1, F.lit(0)), F.lit(size))
        windows = F.transform(starts, lambda k: F.array_join(F.slice(w, k + 1, size), " "))
        return F.when(n > size, F.size(F.array_distinct(windows)) / F.size(starts)).otherwise(1.0)

    return let(word_list, rate)


def json_list(values: Column) -> Column:
    """A JSON list, or null for an empty or missing one."""
    return F.when(F.size(values) > 0, F.to_json(values))


def json_to_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def count_tokens(text: Column, tokenize: Callable[[str], Sequence] | None = None) -> Column:
    """Length in tokens: of words and punctuation marks, or of a tokenizer given as a
    function, run over Arrow batches."""
    if tokenize is None:
        return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), F.lit(1)))
    def measure(batch: pd.Series) -> pd.Series:
        return batch.fillna("").map(lambda t: len(tokenize(t)))

    return F.pandas_udf(measure, "int")(text)


def translate(templates: Mapping[str, str], key: str, **values) -> str:
    """A template filled in; as it is where a placeholder has no value."""
    try:
        return templates[key].format(**values)
    except (KeyError, IndexError):
        if key not in templates:
            raise
        return templates[key]
