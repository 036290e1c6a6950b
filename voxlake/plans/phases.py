"""Phases of the batch build: settings, registry, pending work, runs and dashboard."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Defaults, over which a profile's values are laid."""

    window_size: float = 1800
    transcription_overlap: float = 5
    diarization_overlap: float = 30
    window_threshold: float = 7200
    chunk_size: int = 500
    chunk_overlap: int = 50
    min_overlap_ratio: float = 0.5
    speaker_tolerance: float = 2.0
    intro_seconds: float = 300
    n_chunks: int = 5
    min_similarity: float = 0.5
    extra: Mapping[str, object] = field(default_factory=dict)

    def __getattr__(self, name: str):
        extra = object.__getattribute__(self, "extra")
        if name in extra:
            return extra[name]
        raise AttributeError(name)


PROFILES: dict[str, dict] = {"default": {}}


def settings(profile: str | None = None) -> Settings:
    """The profile named, or that of the environment variable ``PODCAST_PROFILE``."""
    values = PROFILES[profile or os.environ.get("PODCAST_PROFILE", "default")]
    own = {k: v for k, v in values.items() if k in Settings.__dataclass_fields__}
    return Settings(**own, extra={k: v for k, v in values.items() if k not in own})


@dataclass(frozen=True)
class Phase:
    id: int
    name: str
    display_name: str
    flag: str
    requires: tuple[str, ...] = ()
    uses_gpu: bool = False
    run: Callable[[], object] | None = None


#: Names of the phases, as shown.
PHASES = (
    Phase(1, "ingestion", "Data Collection", "downloaded"),
    Phase(2, "transcription", "Transcription", "transcribed", ("downloaded",), True),
    Phase(3, "diarization", "Diarization & Enrollment", "diarized", ("transcribed",), True),
    Phase(4, "chunking", "Chunking", "chunked", ("transcribed", "diarized")),
    Phase(5, "indexing", "Vector Indexing", "indexed", ("chunked",), True),
)
#: What each kind of work waits for: flags that must be set, and one that must not.
PENDING = {
    "download": ((), "downloaded"), "transcribe": (("downloaded",), "transcribed"), "diarize": (("downloaded", "transcribed"), "diarized"),
    "diarize_any": (("downloaded",), "diarized"), "align": (("transcribed", "diarized"), None), "chunk": (("transcribed",), "chunked"), "index": (("chunked",), "indexed"),
}


def pending(episodes: DataFrame, work: str, limit: int = 0) -> DataFrame:
    """Episodes that wait for ``work``, the first ``limit`` by id (0: all).  A flag that
    is null counts as not set."""
    needs, done = PENDING[work]
    found = episodes
    for flag in needs:
        found = found.filter(F.coalesce(F.col(flag), F.lit(False)))
    if done:
        found = found.filter(~F.coalesce(F.col(done), F.lit(False)))
    return found.orderBy("id").limit(limit) if limit else found


def pending_by_output(upstream: DataFrame, output: DataFrame, key: str = "episode_id") -> DataFrame:
    """Work that has no output yet, without any flag."""
    return upstream.join(output.select(key).distinct(), key, "left_anti")


def run_phase(phase: Phase) -> dict:
    """Run a phase; an error ends it, not its successors."""
    start = time.time()
    try:
        if phase.run:
            phase.run()
        return {"phase": phase.name, "status": "completed", "error": None, "start": start, "end": time.time()}
    except Exception as e:  # a phase's failure is a result
        return {"phase": phase.name, "status": "failed", "error": str(e), "start": start, "end": time.time()}


def run_pipeline(phases=PHASES) -> list[dict]:
    return [run_phase(p) for p in phases]


def dashboard(coverage: DataFrame, podcast: str, elapsed: str = "00:00:00", running: int | None = None, failed: Mapping[int, int] = {}) -> str:
    """A table of the phases; ``coverage`` has one row a phase."""
    rows = {r.phase_id: r for r in coverage.collect()}
    lines = [f"{podcast} - elapsed {elapsed}", f"{'Phase':<28}{'Pending':>12}{'Done':>8}{'Failed':>8}  Status"]
    for p in PHASES:
        r = rows[p.id]
        status = "Complete" if not r.pending else "Running" if p.id == running else "Pending"
        lines.append(f"{f'{p.id}. {p.display_name}':<28}{f'{r.pending}/{r.eligible}':>12}{r.done:>8}{failed.get(p.id, 0):>8}  {status}")
    return "\n".join(lines)
