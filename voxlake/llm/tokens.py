"""Token ids and token counts that equal the libraries', without running them on every
word.

The vocabulary file splits text on white space and into letters, digits and runs of
other characters before any merge, so the ids of a text are the ids of its words.
Word results are kept in bounded caches; words that miss go to the library.  Texts
with characters whose normalisation could differ between Unicode versions, or with
special strings, go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_texts, pieces

#: Entries that a worker keeps per cache.
CACHE_ENTRIES = 500_000

#: Any character outside this set sends the whole text to the library.
UNSAFE = re.compile("[^\t\n\r -~\xa0\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ňŊ-ž–—‘’“”…]|<\\|")
#: The same for Arrow's expressions, which know no escapes of code points.
_UNSAFE_ARROW = UNSAFE.pattern.replace("\\|", "[|]")
#: The split of the vocabulary file, for lower-cased text of the safe set.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ž]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-ž]+")


class _Cache(dict):
    """A dict that computes what it misses, and keeps it while there is room."""

    def __init__(self, compute, room: int = CACHE_ENTRIES):
        super().__init__()
        self._compute, self._room = compute, room

    def __missing__(self, key):
        value = self._compute(key)
        if len(self) < self._room and len(key) < 64:
            self[key] = value
        return value


def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for
    the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


class _Words:
    """Ids of single pre-tokens by the library's merge model, without the normaliser and
    splitter around it, which the caller has applied."""

    def __init__(self, library):
        self._model = library.model
        self._letter = {x: c for c, x in _byte_letters().items()}

    def __call__(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(map(self._letter.__getitem__, word.encode()))
        return [t.id for t in self._model.tokenize(word)]


class Encoder:
    """Ids of texts as bytes, little-endian unsigned 32-bit if not asked for others."""

    def __init__(self, path: str, kind: str = "<u4"):
        self.library, self._kind = _load(path), kind
        merge, code = _Words(self.library), {"<u2": "H", "<u4": "I"}[kind]

        def packed(word: str) -> bytes:
            ids = merge(word)
            return pack(f"<{len(ids)}{code}", *ids)

        self._word = parts = _Cache(packed)
        self._chunk = _Cache(lambda chunk: b"".join(map(parts.__getitem__, WORDS.findall(chunk))))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self._kind).tobytes()

    def __call__(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self._whole(text)
        return b"".join(map(self._chunk.__getitem__, text.lower().split()))

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The same for a column of texts without nulls, with ``end`` after each: Arrow splits
        the texts, and only their different chunks reach Python."""
        unsafe = pc.match_substring_regex(texts, _UNSAFE_ARROW)
        whole = np.flatnonzero(unsafe)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(unsafe, "", texts) if len(whole) else texts))
        ends, chunks = np.cumsum(lists.value_lengths().to_numpy()), lists.flatten().dictionary_encode()
        del lists
        word, parts = self._word, []
        for chunk in chunks.dictionary.to_numpy(zero_copy_only=False).tolist():
            # Letters only are one word, and one other character after them is another.
            if chunk.isalpha():
                parts.append(word[chunk])
            elif chunk[:-1].isalpha():
                parts.append(word[chunk[:-1]] + word[chunk[-1]])
            else:
                parts.append(b"".join(map(word.__getitem__, WORDS.findall(chunk))))
        # What follows the chunks of a text; the ids of a text that is encoded whole are there.
        tails = np.full(len(texts), len(parts))
        tails[whole] += 1 + np.arange(len(whole))
        parts += [end] + [self._whole(texts[int(k)].as_py()) + end for k in whole]
        order = np.insert(chunks.indices.to_numpy(), ends, tails)
        joined = pa.array(parts, pa.large_binary()).take(pa.array(order))
        offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
        offsets = offsets[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), joined.buffers()[2]])


def vocabulary_size(path: str) -> int:
    """Ids of the vocabulary, those of added tokens with them."""
    return max(_load(path).get_vocab(with_added_tokens=True).values(), default=-1) + 1


@lru_cache(1)
def single_token_words(path: str) -> frozenset[str]:
    """The vocabulary's strings that, as a whole pre-token, encode to exactly one
    token: each is run through the library alone and kept only if its own id comes
    back.  At most one entry per vocabulary entry."""
    library, letters = _load(path), _byte_letters()
    found = []
    for token, ident in library.get_vocab(with_added_tokens=False).items():
        raw = bytes(letters[c] for c in token.removesuffix("</w>") if c in letters)
        text = raw.decode("utf-8", "ignore")
        if text and not UNSAFE.search(text) and WORDS.fullmatch(text):
            found.append((text, ident))
    encoded = library.encode_batch([x for x, _ in found], add_special_tokens=False)
    return frozenset(x for (x, ident), e in zip(found, encoded) if e.ids == [ident])


class Counter:
    """Token counts: words proven to be one token count directly, the rest is merged."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.library = _load(path)
        merge = _Words(self.library)
        rest = _Cache(lambda word: len(merge(word)))
        self._chunk = _Cache(lambda chunk: sum(1 if w in whole else rest[w] for w in WORDS.findall(chunk)))

    def _merge(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if UNSAFE.search(text):
            return self._merge(text)
        return sum(map(self._chunk.__getitem__, text.lower().split()))


def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


#: Characters of a text that is cut at spaces for a sentencepiece model: printable, and
#: the same in every Unicode normal form.
_PLAIN = frozenset(c for c in map(chr, range(32, 0x180)) if c.isprintable() and all(normalize(f, c) == c for f in ("NFC", "NFKC")))
_MARK = "\u2581"


@lru_cache(1)
def single_piece_words(path: str) -> frozenset[str] | None:
    """The strings that a sentencepiece model encodes as one piece where a space or the
    beginning of the text comes before them; None if its texts cannot be cut at spaces.

    They can where no piece holds a word's end and the space after it, so that no merge
    crosses a space, and a word alone has the mark of a space in front."""
    model = _pieces(path)
    listed = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    if any(a != _MARK and b == _MARK for p in listed for a, b in zip(p, p[1:])) or model.encode("a b") != model.encode("a") + model.encode("b"):
        return None
    words = [(p[1:], k) for k, p in enumerate(listed) if len(p) > 1 and p[0] == _MARK and _PLAIN.issuperset(p[1:]) and " " not in p]
    return frozenset(w for (w, k), found in zip(words, model.encode([w for w, _ in words])) if found == [k])


class PieceCounter:
    """Piece counts: words proven to be one piece count directly, other words are encoded
    alone and kept.  A text with other white space than single spaces between words, or
    with characters that a normaliser could change, is encoded whole."""

    def __init__(self, path: str, whole: frozenset[str] | None):
        self._model, self._cut = _pieces(path), whole is not None
        rest = _Cache(lambda word: len(self._model.encode(word)))
        self._word = _Cache(lambda word: 1 if word in (whole or ()) else rest[word])

    def __call__(self, text: str) -> int:
        words = text.split(" ")
        if not self._cut or "" in words or not _PLAIN.issuperset(text):
            return len(self._model.encode(text))
        return sum(map(self._word.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows come
    back as they are; an empty table gives an empty result.  One narrow pass, no
    shuffle; the shipped word set is bounded by the vocabulary."""
    sentence = vocabulary.endswith(".model")
    whole = docs.sparkSession.sparkContext.broadcast(single_piece_words(vocabulary) if sentence else single_token_words(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounter(vocabulary, whole.value) if sentence else Counter(vocabulary, whole.value)
        for b in pieces(batches, 2048):
            yield pa.record_batch([b.column(0), b.column(2), pa.array(map(count, b.column(1).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    df = id_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return map_texts(df, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
