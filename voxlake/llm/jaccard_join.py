"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Every text becomes its set of five-word shingles (64-bit hashes) and ``VALUES``
   MinHash values; texts with the same words are one node, whatever their number.
2. Nodes that agree in all rows of a band are candidates.  A bucket of any size is cut
   into blocks, and pairs of blocks are compared in tasks of bounded size: a bucket of
   ``m`` nodes is shipped ``m / BLOCK`` times, and no pair is ever emitted as a row.
3. The MinHash values of a pair are compared ``STEP`` at a time, and the pair is dropped
   as soon as the posterior probability that its similarity reaches the threshold falls
   below the tolerance (uniform prior).  A pair is treated in the first band it shares.
4. What is left is verified exactly on the shingle sets, which are built again only for
   the nodes concerned.  A group whose sets have more than ``SHINGLES`` shingles is cut
   into parts, and each pair of parts is a group of its own, so that what a task holds is
   bounded by shingles and not by texts.

A pair of similarity 0.8 misses all 24 bands with a probability of 3e-6.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, all_columns, drop_table, gathered, heavy_join, id_text, map_texts, pieces, shared_table
from .tokens import _Cache

ROWS, BANDS, STEP = 4, 24, 16
VALUES = ROWS * BANDS
BLOCK = 256
#: Shingles of one part of a group to verify (a longer text is a part by itself), and
#: postings that are intersected at once.
SHINGLES, POSTINGS = 2_000_000, 500_000
#: Ids up to which the nodes to verify are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 500_000

#: Words whose hash a worker keeps.
WORDS = 65_536
WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _multipliers() -> np.ndarray:
    out, x = [], 88172645463325252
    for _ in range(VALUES):
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        out.append((x >> 32) | 1)
    return np.array(out, np.uint32)


class Shingler:
    """Words, shingle hashes and MinHash values of texts."""

    def __init__(self, size: int = 5):
        import xxhash

        self.size = size
        # More entries cost memory and gain no time: hashing is about as fast.
        self._word = _Cache(xxhash.xxh3_64_intdigest, WORDS)
        self._mult = _multipliers()[:, None]

    def words(self, text: str) -> list[str]:
        return WORD.findall(text.lower())

    def shingles(self, words: list[str]) -> np.ndarray:
        """Sorted distinct shingle hashes; a text of fewer words is one shingle."""
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self._word.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.size, len(h))):
            part = h[k : k + n] * _MIX[k]
            out += part ^ (part >> np.uint64(29))
        out ^= out >> np.uint64(32)
        out *= _MIX[4]
        return np.unique(out ^ (out >> np.uint64(29)))

    def values(self, shingles: np.ndarray) -> bytes:
        """The low 16 bits of each MinHash value."""
        least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 4096):
            x = short[None, at : at + 4096] * self._mult
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(least, x.min(1), out=least)
        return least.astype("<u2").tobytes()

    @staticmethod
    def node(words: list[str]) -> bytes:
        return hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def keep_from(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of values compared, the least number of matches at which the
    posterior probability of reaching ``threshold`` is not below ``tolerance``.  With a
    uniform prior it is the chance of at most ``m`` successes in ``n + 1`` trials."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def candidate_pairs(values: np.ndarray, side: np.ndarray, band: np.ndarray, keep: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group that meet here first and survive the pruning.

    ``values`` has a row per node; nodes of side 0 are compared with those of side 1, or
    with each other where there is no side 1."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(second):
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    else:
        a, b = np.triu_indices(len(first), 1)
        a, b = first[a], first[b]
    if not len(a):
        return a, b
    keys = np.ascontiguousarray(values).view("<u8")
    own = band[a]
    ok = (keys[a, own] == keys[b, own]) & (own == band[b])
    for k in range(int(own.max())):
        ok &= (k >= own) | (keys[a, k] != keys[b, k])
    a, b = a[ok], b[ok]
    same = np.zeros(len(a), np.int32)
    for n in range(STEP, VALUES + 1, STEP):
        if not len(a):
            break
        same += (values[a, n - STEP : n] == values[b, n - STEP : n]).sum(1, dtype=np.int32)
        alive = same >= keep[n]
        a, b, same = a[alive], b[alive], same[alive]
    return a, b


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``g``, which sorting has put together, over batch borders."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        if held and held[0].column(0)[0].as_py() != g[0]:
            yield pa.Table.from_batches(held)
            held = []
        for at, to in zip(cuts, cuts[1:]):
            part = b.slice(at, to - at)
            if to < len(g):
                if held:
                    yield pa.Table.from_batches([*held, part])
                    held = []
                else:
                    yield pa.Table.from_batches([part])
            else:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs.

    A few pairs are intersected one by one.  Many are counted by products of 0/1 matrices
    over the shingles that at least two sets have; as the sets are sorted, a range of hash
    values is a slice of each, and one range is held at a time."""
    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
    ranges = -(-sum(map(len, sets)) // POSTINGS)
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(ranges):
        parts = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        names = np.concatenate(parts)
        order = np.argsort(names)
        owner = np.repeat(np.arange(len(sets)), list(map(len, parts)))[order]
        names = names[order]
        fresh = np.concatenate([[True], names[1:] != names[:-1]]) if len(names) else np.zeros(0, bool)
        column = np.cumsum(fresh) - 1
        often = np.bincount(column) > 1
        use = often[column]
        owner, column = owner[use], (np.cumsum(often) - 1)[column[use]]
        width = int(column[-1]) + 1 if len(column) else 0
        for at in range(0, width, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            total += m @ m.T
    return total[a, b].astype(np.int64)


def _parted(side: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``number, nodes, side`` of the groups in which the pairs ``a, b`` of one group are
    verified: its nodes, in parts of ``SHINGLES`` shingles, pair of parts by pair."""
    part = np.zeros(len(side), np.int64)
    for own in (0, 1):
        of = np.flatnonzero(side == own)
        part[of] = np.cumsum(size[of]) // SHINGLES * 2 + own
    p, q = np.minimum(part[a], part[b]), np.maximum(part[a], part[b])
    low, high = np.where(part[a] <= part[b], a, b), np.where(part[a] <= part[b], b, a)
    for number, pair in enumerate(sorted(set(zip(p.tolist(), q.tolist())))):
        here = (p == pair[0]) & (q == pair[1])
        if pair[0] == pair[1]:
            nodes = np.unique(np.concatenate([low[here], high[here]]))
            yield number, nodes, np.zeros(len(nodes), np.int32)
        else:
            one, two = np.unique(low[here]), np.unique(high[here])
            yield number, np.concatenate([one, two]), np.repeat(np.array([0, 1], np.int32), [len(one), len(two)])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def links(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """``(members, found)``: ``members`` has ``doc_id, node`` per row, ``found`` has
    ``node, n_links, root`` rows: links counted in one block, and a node of the same
    block that is connected with it."""
    keep = keep_from(threshold, tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in pieces(batches):
            nodes, sizes, values = [], [], []
            for text in b.column(1).to_pylist():
                words = shingler.words(text)
                sets = shingler.shingles(words)
                nodes.append(shingler.node(words))
                sizes.append(len(sets))
                values.append(shingler.values(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())], names=["doc_id", "node", "size", "vals"])

    df = id_text(docs)
    kind = df.schema["doc_id"].dataType.simpleString()
    signed = shared_table(map_texts(df, sign, f"doc_id {kind}, node binary, size int, vals binary"), "jaccard-signed")
    members = signed.select("doc_id", "node")
    nodes = signed.filter("size > 0").groupBy("node").agg(F.first("vals").alias("vals"), F.first("size").alias("size"), F.min("doc_id").alias("first_id"))
    nodes = shared_table(nodes, "jaccard-nodes", signed.count())
    n_nodes = nodes.count()

    bands = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.expr("vals").substr(k * 8 + 1, F.lit(8)))).alias("band", "key"))
    bands = bands.select("node", "band", "key")
    sizes = bands.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meet = (
        heavy_join(bands, sizes, ["band", "key"], "m", n_nodes * BANDS)
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
            F.col("band").cast("int").alias("band"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "node",
        )
    )
    meet = meet.join(nodes.select("node", "size", "vals"), "node").select("g", "band", "side", "node", "size", "vals")

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            side, size = t.column("side").to_numpy(), t.column("size").to_numpy()
            a, b = candidate_pairs(_matrix(t.column("vals")), side, t.column("band").to_numpy(), keep)
            for number, who, own in _parted(side, size, a, b):
                took = t.take(who)
                took = took.append_column("part", pa.array(np.full(len(who), number, np.int32))).set_column(2, "side", pa.array(own))
                yield from took.select(["g", "part", "band", "side", "node", "vals"]).to_batches()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "g long, part int, band int, side int, node binary, vals binary"
    left = meet.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(survive, schema)
    left = shared_table(gathered(left, n_nodes), "jaccard-left")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in pieces(batches):
            words = [shingler.words(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([shingler.node(x) for x in words], pa.binary()), pa.array([shingler.shingles(x).tobytes() for x in words], pa.binary())], names=["node", "shingles"])

    wanted = left.select("node").distinct().join(nodes, "node").select(F.col("first_id").alias("doc_id"), "node")
    wanted = shared_table(wanted, "jaccard-wanted", n_nodes)
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = map_texts(df.join(ids, "doc_id", "left_semi").select("doc_id", "text"), again, "node binary, shingles binary")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            a, b = candidate_pairs(_matrix(t.column("vals")), t.column("side").to_numpy(), t.column("band").to_numpy(), keep)
            if not len(a):
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            sizes = np.array([len(s) for s in sets])
            both = _overlaps(sets, a, b)
            ok = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            count = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
            # The root is the least node by name, so that edges hang many nodes on one
            # smaller node, and never one node on many smaller ones.
            names = t.column("node").to_pylist()
            order = sorted(range(len(names)), key=names.__getitem__)
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            least = _roots(len(names), place[a], place[b])
            root = [order[least[place[k]]] for k in range(len(names))]
            who = np.flatnonzero(count).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in who], pa.binary()), pa.array(count[who], pa.int64()), pa.array([names[root[k]] for k in who], pa.binary())], names=["node", "n_links", "root"])

    ready = left.join(sets, "node").select(F.xxhash64("g", "part").alias("g"), "band", "side", "node", "vals", "shingles")
    found = ready.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(verify, "node binary, n_links long, root binary")
    found = shared_table(gathered(found, n_nodes), "jaccard-found")
    for used in (left, wanted, nodes):
        drop_table(used)
    return members, found


def components(edges: DataFrame) -> DataFrame:
    """``node, top`` for every node of ``edges (node, root)``, where ``top`` is the least
    node connected with it.  Alternating star contraction: nodes above a node, then
    nodes below it, are hung on the least of its neighbours until nothing changes."""
    edges = shared_table(edges.filter("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct(), "components", edges.count())
    size = edges.count()
    while size:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = heavy_join(both, least, ["u"], "n", 2 * size).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = heavy_join(large, least, ["u"], "n", 2 * size).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = shared_table(small.select("e.u", "e.v").filter("u <> v").distinct(), "components", 2 * size)
        n = small.count()
        changed = n != size or small.join(edges, ["u", "v"], "left_anti").limit(1).count()
        drop_table(edges)
        edges, size = small, n
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("top"))


def join_classes(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` per row of ``docs``.

    ``copy_of`` is the least doc_id with the same words in the same order, ``n_links``
    the number of other such texts whose shingle sets have a Jaccard similarity of
    ``threshold`` or more, and ``class_id`` the least doc_id connected by copies and
    links.  Texts without words (null, empty) are copies of each other and have no
    links; texts of one to four words are one shingle; rows with a null doc_id belong to
    their copies' class, and a text without any doc_id has null ids and no links; repeated
    rows come back each; an empty table gives
    an empty result."""
    members, found = links(docs, threshold, tolerance)
    tops = components(found.select("node", "root"))
    per_node = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    rows = members.count()
    copies = members.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"))
    nodes = copies.join(per_node, "node", "left").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    nodes = shared_table(nodes, "jaccard-copies", rows)
    classes = nodes.groupBy("top").agg(F.min("copy_of").alias("class_id"), F.count("*").alias("k"))
    nodes = heavy_join(nodes, classes, ["top"], "k", rows).select("node", "class_id", "copy_of", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nodes = shared_table(nodes, "jaccard-classes", rows)
    return heavy_join(members, nodes, ["node"], "n", rows).select("doc_id", "class_id", "copy_of", "n_links")


def one_per_class(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id, null ids last, and
    the first of its rows where it has several.  Classes are of rows, so other texts of
    the same doc_id, or of none, are judged by themselves.  All columns are kept."""
    keyed = shared_table(docs.select(F.struct(*all_columns(docs)).alias("own"), F.monotonically_increasing_id().alias("row")), "jaccard-rows")
    rows = keyed.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text"))
    classes = join_classes(rows, threshold).select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col("own.doc_id").isNull().alias("unnamed"), F.col("own.doc_id").alias("doc_id"), F.col("row").alias("row"))
    best = keyed.select("row", order.alias("o")).join(classes, "row").groupBy("class_id").agg(F.min("o").alias("o")).select(F.col("o.row").alias("row"))
    tasks = max(1, -(-keyed.count() // TEXT_ROWS))
    return keyed.join(best, "row", "left_semi").select([F.col("own").getField(c).alias(c) for c in docs.columns]).coalesce(tasks)
