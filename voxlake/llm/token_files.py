"""Token-id files: an adaptive context-mixing range coder over independent blocks.

A block holds up to ``BLOCK`` ids and is coded from a fresh model, so any block can be
decoded alone; each carries the crc32 of its ids.  Within a block an id is predicted by
three adaptive models:

* order 2 and order 1: an id seen after the same two ids, or the same id (hashed tables,
  learnt after every round of ``_ROUND`` ids);
* order 0: the frequencies of all ids of the block so far, taken anew at growing
  distances.  A new id has the share that ids seen once have.

Adaptive weights, kept per level of confidence of the order-2 and order-1 predictions,
mix them: where both name the same id their shares add up, and order 0 has what they
leave.  The shares drive a 48-bit range coder that emits 16-bit words, one step an id; new
ids stand uncoded behind the words.  Carries are resolved when a block is closed.

Blocks are coded in lockstep, one numpy lane per block, which makes the cost of Python
a cost per step instead of per id.  What does not depend on the last id, all of it when
encoding but for the range itself, is computed for a round at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, filled, id_text, map_texts, pieces, regrouped, shared_dir, shared_table
from .tokens import Encoder, vocabulary_size

BLOCK = 4096
LANES = 2048
#: Ids below this can be coded.
IDS = 1 << 16
#: Rows of eight predictions that a block has, and where in a row an id before stands.
_ROWS = 256
_SLOT = ((np.arange(IDS, dtype=np.int32) * 31153 >> 5 & 1023) * 7 >> 10) + np.int32(1)
#: Steps between which the order-2 and order-1 models learn.
_ROUND = 64
#: Steps of the lanes that are turned into rows at once.
_TILE = 256
#: Steps at which order 0 is taken from all ids of the block so far.
_PAST = (64, 128, 256, 512, 1024, 1536, 2048, 3072)
#: A range is kept above the least and below the full size, so that all its arithmetic on
#: float64 is exact: quotients of such integers are never rounded up to an integer.
_LEAST, _FULL = float(1 << 32), float(1 << 48)


class _Model:
    """The adaptive state of ``n`` lanes; encoder and decoder make the same calls."""

    def __init__(self, n: int):
        lane = np.arange(n, dtype=np.int32)
        self.base, self.bw = lane * (_ROWS * 8), lane * 16
        # An entry holds an id and, above bit 16, how far it is trusted.
        # A row is order 1 of an id and order 2 of it after others, side by side in memory.
        self.rows = np.zeros(n * _ROWS * 8, np.int32)
        # By level of trust: predictions made, and those that order 2 and order 1 alone got right.
        self.made, self.hit2, self.hit1 = (np.zeros(n * 16) for _ in range(3))
        # Rows of ids are a little longer than blocks: columns of rows whose distance is a power
        # of two contend for the same lines of a cache.
        self.held, self.past, self.new = np.zeros((n, BLOCK + 32), np.uint16), 0, np.ones(n)

    def remember(self, k: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Order 0 from the first ``steps`` ids of ``k`` lanes: every different id of a lane,
        in order, as id, first place among the sorted ids (above bit 16) and count (above bit
        32); and where the lanes' ids end in that list."""
        self.past = steps
        held = np.sort(self.held[:k, :steps], axis=1)
        other = np.ones((k, steps), bool)
        np.not_equal(held[:, 1:], held[:, :-1], out=other[:, 1:])
        at = np.flatnonzero(other)
        counts = np.diff(at, append=held.size)
        lane = at // steps
        # As likely as a new id is one that was seen once.
        self.new[:k] = np.bincount(lane[counts == 1], minlength=k) + 1
        return held.ravel()[at] | (at - lane * steps) << 16 | counts << 32, np.cumsum(np.bincount(lane, minlength=k))

    def weigh(self, k: int) -> None:
        """Shares of the predictions, in units of a remembered id."""
        made, right2, right1 = self.made[: k * 16] + 2.0, self.hit2[: k * 16] + 0.3, self.hit1[: k * 16] + 0.2
        # Order 0 always keeps an eighth, so all shares are less than 65,536 units.
        self.known = self.past + self.new[:k]
        unit = np.repeat(self.known, 16) / np.maximum(made - right2 - right1, made / 8)
        self.upto2 = np.floor(right2 * unit) + 1
        self.upto1 = self.upto2 + np.floor(right1 * unit) + 1

    def predict(self, p1: np.ndarray, p2: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Put into ``out`` where the predictions after ``p2, p1`` are held, what is there, and
        its level of trust."""
        i1, i2, e1, e2, level = out
        k = p1.shape[-1]
        np.add(self.base[:k], p1 * 20261 & (_ROWS - 1 << 3), out=i1)
        np.add(i1, _SLOT.take(p2, mode="clip"), out=i2)
        self.rows.take(i1, mode="clip", out=e1)
        self.rows.take(i2, mode="clip", out=e2)
        np.add(self.bw[:k], (e2 >> 16) * 4 + (e1 >> 16), out=level)
        return out

    def shares(self, x1: np.ndarray, x2: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the shares of order 2, order 1 and all end; two that agree are one."""
        upto1 = self.upto1.take(level, mode="clip")
        return np.where(x1 == x2, upto1, self.upto2.take(level, mode="clip")), upto1, upto1 + self.known[: x1.shape[-1]]

    def learn(self, ids: np.ndarray, found: np.ndarray) -> None:
        """Learn the ``ids`` of a round, of what :meth:`predict` gave for them."""
        i1, i2, e1, e2, level = found
        h1, h2 = ids == (e1 & 0xFFFF), ids == (e2 & 0xFFFF)
        self.rows[i1], self.rows[i2] = _trusted(e1, h1, ids), _trusted(e2, h2, ids)
        k = ids.shape[1]
        size = np.int32(k * 16)
        none, by1, by2 = np.bincount((level + h2 * (2 * size) + (h1 > h2) * size).ravel(), minlength=3 * size).reshape(3, -1)
        for kept, more in ((self.made, none + by1 + by2), (self.hit2, by2), (self.hit1, by1)):
            kept[: k * 16] = kept[: k * 16] * 0.96875 + more


def _trusted(entry: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Entries after ``ids``: trust, of 0 to 3, grows by a hit, falls to 1 by a miss from 2 or 3,
    and below that a miss replaces the id."""
    grown = np.minimum(entry, (2 << 16) + ids) + (1 << 16)
    return np.where(hit, grown, np.where(entry < 2 << 16, ids, entry & 0xFFFF | 1 << 16))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block, of at most ``BLOCK`` ids below ``IDS`` each."""
    if any(len(b) and (b.max() >= IDS or b.min() < 0) for b in blocks):
        raise ValueError(f"ids from {IDS} on cannot be coded")
    if any(len(b) > BLOCK for b in blocks):
        raise ValueError(f"a block of more than {BLOCK} ids")
    step = _even(len(blocks))
    return [x for at in range(0, len(blocks), step) for x in _encode(blocks[at : at + step])]


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    step = _even(len(payloads))
    return [x for at in range(0, len(payloads), step) for x in _decode(payloads[at : at + step], sizes[at : at + step])]


def _even(n: int) -> int:
    return max(1, -(-n // max(1, -(-n // LANES))))


def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling size, and the number of lanes that reach each step."""
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    return order, np.searchsorted(-sizes[order], -np.arange(steps), side="left")


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    order, active = _order(sizes)
    n, steps = len(blocks), len(active)
    model = _Model(n)
    # Two ids of 0 stand before a block; lanes that end within a round learn zeros.
    ids = np.zeros((2, n), np.int32)
    for lane, k in enumerate(order):
        model.held[lane, : sizes[k]] = blocks[k]
    width = steps + 4
    words, at = np.zeros(n * width, np.int32), np.arange(n) * width
    low, rng = np.zeros(n), np.full(n, _FULL)
    known, since, upto = np.zeros((n, _PAST[0]), np.int32), 0, _PAST[0]
    cells, apart = np.zeros(IDS, np.int32), np.zeros((n, steps), bool)

    def put(start, freq, total, low, rng, at):
        """Narrow ranges. A word may exceed 16 bits by a carry, which is resolved at the end."""
        r = np.floor(rng / total)
        low, rng = low + r * start, r * freq
        out = rng < _LEAST
        word = np.floor(low * (1 / _LEAST))
        words[at] = word
        grow = out * 65535.0 + 1
        return (low - word * out * _LEAST) * grow, rng * grow, at + out

    for t in range(0, steps, _ROUND):
        k, end = int(active[t]), min(t + _ROUND, steps)
        if t in _PAST:
            entries, ends = model.remember(k, t)
            since, upto = t, next((x for x in _PAST if x > t), BLOCK)
            known, a = np.zeros((k, upto - t + 16), np.int32)[:, : upto - t], 0
            places, values = (entries & 0xFFFF), (entries >> 16 & 0xFFFF | entries >> 32 << 16).astype(np.int32)
            for lane, b in enumerate(ends.tolist()):
                where = places[a:b]
                cells[where] = values[a:b]
                known[lane] = cells.take(model.held[lane, t:upto])
                cells[where] = 0
                a = b
        model.weigh(k)
        if (t - since) % _TILE == 0:
            # A tile at once: turning lanes into rows costs the more, the less is turned.
            to = min(t + _TILE, upto)
            ids = np.concatenate([ids[-2:, :k], model.held[:k, t:to].T.astype(np.int32, order="C")])
            tile = np.ascontiguousarray(known[:k, t - since : to - since].T)
        at_tile = (t - since) % _TILE
        x = ids[at_tile + 2 : at_tile + 2 + _ROUND, :k]
        found = model.predict(ids[at_tile + 1 : at_tile + 1 + _ROUND, :k], ids[at_tile : at_tile + _ROUND, :k], np.empty((5, _ROUND, k), np.int32))
        x1, x2, level = (found[2] & 0xFFFF)[: end - t], (found[3] & 0xFFFF)[: end - t], found[4][: end - t]
        upto2, upto1, total = model.shares(x1, x2, level)
        now, entry = x[: end - t], tile[at_tile : at_tile + end - t, :k]
        by2, start, freq = now == x2, upto1 + (entry & 0xFFFF), (entry >> 16).astype(np.float64)
        hit = by2 | (now == x1)
        rare = (entry == 0) & ~hit
        apart[:k, t:end] = rare.T
        at_hit, at_rare = np.flatnonzero(hit), np.flatnonzero(rare)
        first, ends2, ends1 = by2.ravel()[at_hit], upto2.ravel()[at_hit], upto1.ravel()[at_hit]
        start.reshape(-1)[at_hit], freq.reshape(-1)[at_hit] = ends2 * ~first, np.where(first, ends2, ends1 - ends2)
        start.reshape(-1)[at_rare] += model.past
        freq.reshape(-1)[at_rare] = model.new[at_rare % k]
        for j in range(end - t):
            k = int(active[t + j])
            low[:k], rng[:k], at[:k] = put(start[j, :k], freq[j, :k], total[j, :k], low[:k], rng[:k], at[:k])
        model.learn(x, found)
    # The least point of a range that has two words of zeros after its first one.
    words[at] = np.ceil(low * (1 / _LEAST))
    over = np.flatnonzero(words > 0xFFFF)
    while len(over):
        carry = words[over] >> 16
        words[over] &= 0xFFFF
        words[over - 1] += carry
        over = (over - 1)[words[over - 1] > 0xFFFF]
    grid = words.reshape(n, width)
    lengths = at - np.arange(n) * width + 3
    result: list[bytes] = [b""] * n
    for lane, k in enumerate(order):
        # The ids that are not coded stand behind the words, the first one last.
        raw = model.held[lane, : sizes[k]][apart[lane, : sizes[k]]][::-1]
        result[k] = np.concatenate([grid[lane, : lengths[lane]].astype("<u2"), raw.astype("<u2")]).tobytes()
    return result


def _decode(payloads: list[bytes], counts: list[int]) -> list[np.ndarray]:
    sizes = np.array(counts, np.int64)
    order, active = _order(sizes)
    n, steps = len(payloads), len(active)
    width = max((len(p) // 2 for p in payloads), default=0) + 4
    grid = np.zeros((n, width), np.uint16)
    for lane, k in enumerate(order):
        grid[lane, : len(payloads[k]) // 2] = np.frombuffer(payloads[k], "<u2", len(payloads[k]) // 2)
    words, at = grid.ravel(), np.arange(n) * width + 3
    raw = np.arange(n) * width + np.array([len(payloads[k]) // 2 - 1 for k in order], np.int64)
    v = grid[:, :3] @ np.array([_LEAST, 65536.0, 1.0])
    rng = np.full(n, _FULL)
    model = _Model(n)
    ids = np.zeros((_ROUND + 2, n), np.int32)
    table, first = np.zeros(1, np.int64), np.zeros(n, np.int64)

    def take(start, freq, r, v, rng, at):
        v, rng = v - r * start, r * freq
        out = rng < _LEAST
        grow = out * 65535.0 + 1
        return v * grow + words.take(at, mode="clip") * out, rng * grow, at + out

    for t in range(0, steps, _ROUND):
        most, end = int(active[t]), min(t + _ROUND, steps)
        if t in _PAST:
            entries, _ = model.remember(most, t)
            table, first = np.repeat(entries, entries >> 32), np.arange(most) * t
        model.weigh(most)
        ids[:2], ids[2:] = ids[_ROUND:], 0
        rows = np.empty((5, _ROUND, most), np.int32)
        for j in range(_ROUND):
            found = model.predict(ids[j + 1, :most], ids[j, :most], rows[:, j])
            if t + j >= end:
                continue
            k = int(active[t + j])
            x1, x2 = found[2][:k] & 0xFFFF, found[3][:k] & 0xFFFF
            upto2, upto1, total = model.shares(x1, x2, found[4][:k])
            r = np.floor(rng[:k] / total)
            # Only damaged payloads lead beyond the range.
            here = np.minimum(v[:k], r * total - 1)
            goal = np.floor(here / r)
            place = (goal - upto1).astype(np.int64)
            entry = table.take(first[:k] + place, mode="clip")
            start, freq, x = upto1 + (entry >> 16 & 0xFFFF), (entry >> 32).astype(np.float64), entry & 0xFFFF
            who = np.flatnonzero(place < 0)
            if len(who):
                ends2, ends1 = upto2[who], upto1[who]
                by2 = goal[who] < ends2
                start[who], freq[who] = ends2 * ~by2, np.where(by2, ends2, ends1 - ends2)
                x[who] = np.where(by2, x2[who], x1[who])
            who = np.flatnonzero(place >= model.past)
            if len(who):
                start[who], freq[who] = upto1[who] + model.past, model.new[who]
                x[who] = words.take(raw[who], mode="clip")
                raw[who] -= 1
            v[:k], rng[:k], at[:k] = take(start, freq, r, here, rng[:k], at[:k])
            ids[j + 2, :k] = x
        model.held[:most, t : t + _ROUND] = ids[2:, :most].T
        model.learn(ids[2:, :most], rows)
    result: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    for lane, k in enumerate(order):
        result[k] = model.held[lane, : sizes[k]].astype(np.int32)
    return result


def block_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


#: Ids of a file, about: as many blocks as are coded in lockstep.
FILE_IDS = LANES * BLOCK
#: Bytes of texts, about, that are split at once: the larger, the fewer words are met again.
TEXT_BYTES = 24 << 20
#: Bytes of stored texts, about, that a task splits, where that leaves two tasks a core.
TASK_BYTES = 64 << 20
#: Characters of a text by which rows of one doc_id are ordered.
HEAD = 64
_FILE = "file_no int, block_no int, n_ids int, crc32 long, payload binary, doc_ids array<{kind}>, doc_parts array<int>, closed boolean"


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """``doc_id, head, n, ids, place`` per row of ``docs``, as a stored table: the first
    ``HEAD`` characters of its text, its ids and ``end_id`` as little-endian unsigned 16-bit
    integers, and a hash of these."""
    df = id_text(docs)
    if vocabulary_size(vocabulary) > IDS or not 0 <= end_id < IDS:
        raise ValueError(f"{vocabulary}: ids from {IDS} on cannot be coded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, encode, end = None, Encoder(vocabulary, "<u2"), np.array([end_id], "<u2").tobytes()
        for b in filled(batches, TEXT_BYTES):
            ids = encode.column(b.column(1), end)
            n = pa.array(np.diff(np.frombuffer(ids.buffers()[1], np.int64)) // 2)
            done = pa.RecordBatch.from_arrays([b.column(0), b.column(2), n, ids.cast(pa.binary())], names=["doc_id", "head", "n", "ids"])
            del b, ids, n
            yield from pieces([done])
        # What a worker keeps stays with it in later stages.
        del done, encode
        pa.default_memory_pool().release_unused()

    # A task's words are kept while it runs, so fewer tasks meet fewer new ones.
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df = df.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), IDS)))
    df = df.withColumn("head", F.substring("text", 1, HEAD))
    found = map_texts(df, run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, head string, n long, ids binary")
    return shared_table(found.withColumn("place", F.xxhash64("ids")), "token-ids")


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, file_ids: int = FILE_IDS) -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending doc_id
    order as Parquet files at ``path``, one row per coded block.

    ``file_no`` numbers the files in doc_id order and ``block_no`` the blocks of a file.
    ``doc_ids`` and ``doc_parts`` say which documents a block holds, in order, and how
    many of its ids each has; a document may run over several blocks, and ``closed`` says
    whether the last one ends with the block.  Null texts are
    empty (just ``end_id``), null doc_ids come first, and rows of one doc_id are ordered
    by the first ``HEAD`` characters of their text, then by their ids, so that equal rows
    are interchangeable.  An empty table writes no blocks.
    A vocabulary with ids of 65,536 or more is refused.

    Texts are tokenised where they are read.  What is put in order, by a range shuffle
    over the doc_id, these characters and a hash of the ids, are their 16-bit ids, in as many ranges as
    there are ``file_ids``, so that many rows of one doc_id are spread too."""
    ids = tokenised(docs, vocabulary, end_id)
    kind = ids.schema["doc_id"].dataType.simpleString()
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(1, -(-total // file_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, number, held, owners = TaskContext.get().partitionId(), 0, [], []
        size = 0

        def flush(last: bool):
            nonlocal number, held, owners, size
            ids = np.frombuffer(b"".join(held), "<u2")
            keep = len(ids) if last else len(ids) // BLOCK * BLOCK
            blocks = [ids[at : min(at + BLOCK, keep)] for at in range(0, keep, BLOCK)]
            payloads = encode_blocks(blocks)
            rows, k, left = [], 0, owners[0][1] if owners else 0
            for block, payload in zip(blocks, payloads):
                names, counts, need = [], [], len(block)
                while need:
                    part = min(need, left)
                    names.append(owners[k][0])
                    counts.append(part)
                    need, left = need - part, left - part
                    if not left:
                        k += 1
                        left = owners[k][1] if k < len(owners) else 0
                closed = k >= len(owners) or left == owners[k][1]
                rows.append((file_no, number, len(block), block_crc(block), payload, names, counts, closed))
                number += 1
            held, size = [ids[keep:].tobytes()], len(ids) - keep
            owners = [[owners[k][0], left], *owners[k + 1 :]] if k < len(owners) else []
            return rows

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(8)], names=["file_no", "block_no", "n_ids", "crc32", "payload", "doc_ids", "doc_parts", "closed"])

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), None, pa.list_(pa.int32()), pa.bool_()]
        for b in pieces(batches):
            kinds[5] = pa.list_(b.schema.field(0).type)
            held += b.column(3).to_pylist()
            counts = b.column(2).to_pylist()
            owners += [list(x) for x in zip(b.column(0).to_pylist(), counts)]
            size += sum(counts)
            if size >= LANES * BLOCK:
                yield batch(flush(False))
        if owners:
            yield batch(flush(True))

    ordered = ids.repartitionByRange(files, "doc_id", "head", "place").sortWithinPartitions("doc_id", "head", "place", "ids")
    ordered.mapInArrow(run, _FILE.format(kind=kind)).write.parquet(path)
    drop_table(ids)


def read_token_files(spark, path: str, kind: str = "bigint") -> DataFrame:
    """Decode the files at ``path``: ``doc_id, start, n_tokens, ids_crc32`` per document,
    where ``start`` counts the ids of all documents before it.

    Every block is checked against its crc32; a damaged block fails the read.  The
    blocks of a file meet in one task, in order, and are decoded in bounded groups."""
    blocks = spark.read.schema(_FILE.format(kind=kind)).parquet(path)
    parts = blocks.select("file_no").distinct().count() or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_no", "doc_id", "at", "n_tokens", "ids_crc32"]
        at_file, at, open_doc = None, 0, None
        for b in regrouped(batches, LANES):
            rows, out = b.to_pydict(), []
            decoded = decode_blocks(rows["payload"], rows["n_ids"])
            for file_no, ids, crc, docs, counts, closed in zip(rows["file_no"], decoded, rows["crc32"], rows["doc_ids"], rows["doc_parts"], rows["closed"]):
                raw = memoryview(ids.astype("<u4").tobytes())
                if zlib.crc32(raw) != crc:
                    raise ValueError(f"file {file_no}: a block does not match its checksum")
                if file_no != at_file:
                    at_file, at = file_no, 0
                p = 0
                for k, (doc, n) in enumerate(zip(docs, counts)):
                    doc_at, seen, sofar = open_doc or (at, 0, 0)
                    open_doc = (doc_at, seen + n, zlib.crc32(raw[4 * p : 4 * (p + n)], sofar))
                    p, at = p + n, at + n
                    if k < len(docs) - 1 or closed:
                        out.append((file_no, doc, *open_doc))
                        open_doc = None
            if out:
                types = [pa.int32(), b.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, of FILE_IDS ids or more.
    files = files.select("file_no", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    read = blocks.repartitionById(parts, F.col("file_no")).sortWithinPartitions("file_no", "block_no")
    found = read.mapInArrow(run, f"file_no int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(files), "file_no").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as token files and return what reading them back gives."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, path, end_id)
    return read_token_files(spark, path, docs.schema["doc_id"].dataType.simpleString())
