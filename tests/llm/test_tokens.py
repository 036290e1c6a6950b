"""Files of coded ids: ranges, hot ids, refused ids; piece counts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import token_files, tokens

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_many_files_and_one_hot_id(spark, tmp_path):
    lib = Tokenizer.from_file(VOCAB)
    rows = [(None, f"text {k} of no id, repeated {k % 7}") for k in range(300)] + [(k // 2, f"Text of document {k}, " * (k % 9)) for k in range(200)]
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n int, head string").repartition(4)
    path = str(tmp_path / "f")
    token_files.write_token_files(df, VOCAB, path, file_ids=500)
    blocks = spark.read.parquet(path)
    per_file = [r.n for r in blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(per_file) > 5 and max(per_file) < 0.4 * sum(per_file)
    at = 0
    for r in token_files.read_token_files(spark, path).orderBy("start").collect():
        assert r.start == at
        at += r.n_tokens
    ids = lambda t: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
    want = sorted((i is not None, i or 0, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    got = token_files.read_token_files(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_ids_too_large_are_refused():
    with pytest.raises(ValueError, match="cannot be coded"):
        token_files.encode_blocks([np.array([1, 65536])])


def test_ids_of_16_bits():
    assert tokens.vocabulary_size(VOCAB) == 49408
    assert np.frombuffer(tokens.Encoder(VOCAB, "<u2")("some words"), "<u2").tolist() == np.frombuffer(tokens.Encoder(VOCAB)("some words"), "<u4").tolist()


def test_pieces_equal_sentencepiece(small):
    import random

    import duckdb
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = tokens.single_piece_words(path)
    assert len(whole) > 1000 and all(len(model.encode(w)) == 1 for w in list(whole)[:500])
    count = tokens.PieceCounter(path, whole)
    rng = random.Random(3)
    some = sorted(whole)[::40]
    texts = [" ".join(rng.choice([rng.choice(some), "unwörthy", "x9-2", "<s>", "</s>", "É.", "don't", "é"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["", " ", " a", "a ", "a  b", "a\nb c", "a\n b", "\ta", "日本 a", "a ▁ b", "½ a", "ﬁ b", "a b\x7f c"]
    texts += [r[0] for r in duckdb.connect().execute(f"SELECT text FROM '{small}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    cut = [t for t in texts if "" not in t.split(" ") and tokens._PLAIN.issuperset(t)]
    assert len(cut) > 250
    assert [count(t) for t in texts] == [len(model.encode(t)) for t in texts]


def test_columns_equal_the_library():
    lib = Tokenizer.from_file(VOCAB)
    safe = [c for c in map(chr, range(0x3000)) if not tokens.UNSAFE.search(c)]
    texts = ["", " ", " a  b ", "*. 1a 12 a1 x's 's' don't. (word), word) ...", "<|endoftext|> x", "日本 a", "İ x", "a\0b", "É.É", *(f"aB{c}Cd {c}{c} {c}e, {c}" for c in safe), "".join(safe), "long" * 200, "x" * 70 + "."] * 2
    want = [np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    encode = tokens.Encoder(VOCAB, "<u2")
    column = pa.array(texts)
    assert encode.column(column, b"\2\0").to_pylist() == want
    assert encode.column(column.slice(5, 9), b"\2\0").to_pylist() == want[5:14]
    assert encode.column(column.slice(0, 0)).to_pylist() == [] and encode.column(pa.array([""])).to_pylist() == [b""]


def test_work_of_coding_is_a_round_for_many_ids(monkeypatch):
    rounds = []
    learn = token_files._Model.learn
    monkeypatch.setattr(token_files._Model, "learn", lambda *a: rounds.append(1) or learn(*a))
    rng = np.random.default_rng(1)
    sizes = [4096, 4095, 3073, 1, 65, 64, 0, 4096]
    blocks = [(rng.zipf(1.3, n) % 49408).astype(np.int64) for n in sizes]
    coded = token_files.encode_blocks(blocks)
    assert len(rounds) == 4096 // 64
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded, sizes), strict=True))
    assert sum(map(len, coded)) < 2 * sum(sizes)
    alone = token_files.decode_blocks([coded[2]], [sizes[2]])[0]
    assert (alone == blocks[2]).all()
    with pytest.raises(ValueError, match="more than"):
        token_files.encode_blocks([np.zeros(4097, np.int64)])


def test_damaged_blocks_decode_to_something():
    rng = np.random.default_rng(2)
    damaged = [rng.bytes(n) for n in (0, 1, 2, 7, 800, 9001)] + [b"\xff" * 5000, b"\0" * 100]
    found = token_files.decode_blocks(damaged, [4096] * len(damaged))
    assert all(len(ids) == 4096 and ids.min() >= 0 and ids.max() < token_files.IDS for ids in found)
