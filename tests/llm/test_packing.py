"""Step groups of the packed sequences."""

import collections
import random

import numpy as np
import public_tokenizers

from voxlake.llm import packing


def check_groups(rows, window, partitions):
    seqs, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        seqs[r[5]].append(r)
        groups[r[8]].add(r[5])
    padded = {}
    for s, parts in seqs.items():
        (tier,) = {r[7] for r in parts}
        assert len({r[8] for r in parts}) == 1
        used = sum(r[2] for r in parts)
        assert used == tier or tier == window and used & (used - 1)
        padded[s] = tier
    assert sum(map(len, groups.values())) == len(seqs)
    sizes = [sum(padded[s] for s in g) for g in groups.values()]
    assert max(sizes) <= window and sum(x != window for x in sizes) <= partitions


def test_groups_are_equal():
    rng = random.Random(4)
    for window, shortest in ((4096, 512), (64, 8), (16, 16)):
        for _ in range(20):
            packer, rows = packing.Packer(window, shortest), []
            for _ in range(3):
                docs = [(k, np.zeros(rng.choice([1, 3, window // 4, rng.randrange(1, 3 * window)]), "<u4").tobytes()) for k in range(rng.randrange(60))]
                rows += packer.pool(docs)
            rows += packer.close()
            check_groups(rows, window, 1)


def test_groups_of_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    check_groups(list(map(tuple, packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect())), 4096, 3)
