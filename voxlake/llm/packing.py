"""Hierarchical multi-length packing of documents into training sequences.

Every partition of the input is packed on its own, in pools of bounded size, so the
operator needs no shuffle.  Within a pool documents are routed to context tiers
(powers of two up to the longest window): a document longer than the window is cut
into full windows and its rest is routed like any other document.  Each tier is packed
into windows of its own size, first fit over falling lengths; gaps of longer windows
are filled with whole documents of shorter tiers, and what then remains is closed with
the head of a shorter document, whose tail stays in its tier.  A window of a tier is
full, and so a power of two, except for the last ones of a partition, which are merged
into one sequence.

Sequences are trained on in step groups of equal size: one longest window, two of half
its size, and so on.  A group is numbered when it is full; what the tiers still have at
the end of a partition is put together, longest first, so that one group at most is not
full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_texts, pieces
from .tokens import Encoder

#: Ids that a task gathers before it packs them.
POOL_IDS = 2_000_000


class Packer:
    """Packs pools of ``(key, ids)`` documents; ids are little-endian unsigned 32-bit."""

    def __init__(self, window: int = 4096, shortest: int = 512):
        self.window = window
        self.tiers = [t for t in (window >> k for k in range(12)) if t >= min(shortest, window)]
        self.sequence = self.groups = 0
        self.waiting: dict[int, list] = defaultdict(list)
        self.open: dict[int, list] = {t: [[], 0] for t in self.tiers}

    def _emit(self, parts: list, tier: int) -> Iterator[tuple]:
        """Number a sequence, and give the rows of its step group if that is full now."""
        at, rows = 0, []
        for doc, start, length, crc, total in parts:
            rows.append((doc, start, length, crc, total, self.sequence, at, tier))
            at += length
        self.sequence += 1
        self.waiting[tier].append(rows)
        if len(self.waiting[tier]) * tier == self.window:
            yield from self._group(self.waiting.pop(tier))

    def _group(self, sequences: list) -> Iterator[tuple]:
        for rows in sequences:
            for row in rows:
                yield (*row, self.groups)
        self.groups += 1

    def pool(self, docs: list[tuple[object, bytes]]) -> Iterator[tuple]:
        """Rows of all full windows of this pool; what is left stays for the next."""
        bins: dict[int, list] = {t: [] for t in self.tiers}
        for doc, raw in docs:
            total, start = len(raw) // 4, 0
            while total - start >= self.window:
                yield from self._emit([self._piece(doc, raw, start, self.window)], self.window)
                start += self.window
            if start < total:
                rest = total - start
                tier = min(t for t in self.tiers if t >= rest)
                bins[tier].append([doc, raw, start, rest])
        queues = {t: deque(sorted(bins[t], key=lambda x: -x[3])) for t in self.tiers}
        for rank, tier in enumerate(self.tiers):
            shorter = self.tiers[rank:]
            while True:
                parts, used = self.open[tier]
                gap = tier - used
                if not gap:
                    yield from self._emit(parts, tier)
                    self.open[tier] = [[], 0]
                    continue
                took = None
                if not parts:
                    took = queues[tier].popleft() if queues[tier] else None
                    if took is None:
                        break
                else:
                    for t in shorter:
                        queue = queues[t]
                        if queue and queue[-1][3] <= gap:
                            # The queue falls in length: the first that fits, from its longest.
                            took = self._fitting(queue, gap)
                            break
                    if took is None:
                        source = next((queues[t] for t in reversed(shorter) if queues[t]), None)
                        if source is None:
                            break
                        took = source.popleft()
                doc, raw, start, rest = took
                n = min(rest, gap)
                parts.append(self._piece(doc, raw, start, n))
                self.open[tier][1] += n
                if n < rest:
                    tail = [doc, raw, start + n, rest - n]
                    home = min(t for t in self.tiers if t >= rest - n)
                    self._insert(queues[home], tail) if home in shorter else queues[home].append(tail)

    @staticmethod
    def _fitting(queue: deque, gap: int):
        lo, hi = 0, len(queue) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if queue[mid][3] <= gap:
                hi = mid
            else:
                lo = mid + 1
        took = queue[lo]
        del queue[lo]
        return took

    @staticmethod
    def _insert(queue: deque, item) -> None:
        lo, hi = 0, len(queue)
        while lo < hi:
            mid = (lo + hi) // 2
            if queue[mid][3] <= item[3]:
                hi = mid
            else:
                lo = mid + 1
        queue.insert(lo, item)

    @staticmethod
    def _piece(doc, raw: bytes, start: int, n: int) -> tuple:
        return doc, start, n, zlib.crc32(memoryview(raw)[4 * start : 4 * (start + n)]), len(raw) // 4

    def close(self) -> Iterator[tuple]:
        """Rows of the windows that stayed open, merged while they fit the longest."""
        left = sorted((x for x in self.open.values() if x[1]), key=lambda x: -x[1])
        sequences: list[list] = []
        for parts, used in left:
            home = next((s for s in sequences if s[1] + used <= self.window), None)
            if home is None:
                sequences.append([list(parts), used])
            else:
                home[0].extend(parts)
                home[1] += used
        for parts, used in sequences:
            # One that is no power of two is padded to the longest window.
            yield from self._emit(parts, self.window if used & (used - 1) else used)
        group, room = [], self.window
        for tier in sorted(self.waiting, reverse=True):
            for rows in self.waiting.pop(tier):
                group.append(rows)
                room -= tier
                if not room:
                    yield from self._group(group)
                    group, room = [], self.window
        if group:
            yield from self._group(group)
        self.open = {t: [[], 0] for t in self.tiers}


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group`` per piece of every document.

    A null or empty text is one piece holding just ``end_id``; null doc_ids and repeated
    rows are packed like any other; an empty table packs into nothing.  ``sequence_id``
    is the partition number times 2^32 plus a running number, ``step_group`` likewise;
    ``tier`` is the length that a sequence is padded to.  A task holds one pool of ``POOL_IDS`` ids, or one
    document if that is longer."""
    df = id_text(docs)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = Encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        packer, base = Packer(window), TaskContext.get().partitionId() << 32
        pool, size, doc_type = [], 0, None

        def batch(rows):
            rows = list(rows)
            cols = list(zip(*rows)) or [()] * 9
            cols[5] = [base + x for x in cols[5]]
            cols[8] = [base + x for x in cols[8]]
            types = [doc_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in pieces(batches):
            doc_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + end
                pool.append((doc, ids))
                size += len(ids) // 4
                if size >= POOL_IDS:
                    yield batch(packer.pool(pool))
                    pool, size = [], 0
        if doc_type is not None:
            yield batch(packer.pool(pool))
            yield batch(packer.close())

    return map_texts(df, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long")
