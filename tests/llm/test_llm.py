"""The operators against brute force, libraries and round trips."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import oracle
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxlake.llm import decontaminate, jaccard_join, licences, packing, pii, quality, queries, token_files, tokens, topk, url_filter

VOCAB = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(VOCAB)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, band int, start int, words string, base string, row string, spans string, `od.d` int"


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "é", "ß", "re"]) for _ in range(rng.randint(1, 4)))
    long = " ".join(word() for _ in range(30_000))
    base = [word() for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    far = base[:60] + [word() for _ in range(60)]
    return [
        None, "", "   \n", "one two", "One, two!", "don't you're ''s _x_ 12³ ½ ΣΑΣ İstanbul <|endoftext|> x", "日本語 😀 ǅ ª", "x" * 3000, long, " ".join(base), " ".join(near), " ".join(far), " ".join(base).upper(),
        "mail a.b@c-d.example.org, +49 (30) 123-4567; 1.2.3.4 and 999.1.1.1; 4111 1111 1111 1111 and 4111111111111112", "a@b.c_x@y.zz 1.2.3.4.5.6.7.8 +1 ()", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(odd_texts())]
    rows += [rows[9], rows[0], (4, "another text with the id 4 here"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "n", 1, 2, "w", "b", "r", "p", 3) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def tables(spark, small):
    return {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark", "embeddings", "pages")}


def plain(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


# --- Tokens -----------------------------------------------------------------------


def test_encoder_equals_library():
    encode, count = tokens.Encoder(VOCAB), tokens.Counter(VOCAB, tokens.single_token_words(VOCAB))
    for t in odd_texts():
        assert np.frombuffer(encode(t or ""), "<u4").tolist() == ids_of(t)
        assert count(t or "") == len(ids_of(t))


@given(st.text(alphabet=st.one_of(st.sampled_from("aAé'’sß1² \n\t_!-<|>İſĸ"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library_on_any_text(text):
    if not hasattr(test_encoder_equals_library_on_any_text, "e"):
        test_encoder_equals_library_on_any_text.e = tokens.Encoder(VOCAB)
    assert np.frombuffer(test_encoder_equals_library_on_any_text.e(text), "<u4").tolist() == ids_of(text)


def test_token_counts(odd, none):
    got = sorted(map(tuple, tokens.count_tokens(odd, VOCAB, limit=100).collect()), key=repr)
    want = sorted(((i, len(t.encode()), len(ids_of(t)), len(ids_of(t)) > 100) for i, t in plain(odd)), key=repr)
    assert got == want and tokens.count_tokens(none, VOCAB).count() == 0
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = tokens.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_tokens for r in pieces) == sorted(len(model.encode(t)) for _, t in plain(odd))


@given(st.lists(st.lists(st.integers(0, 65535), max_size=300), min_size=1, max_size=5), st.booleans())
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(blocks, repeat):
    blocks = [np.array(b * (8 if repeat else 1), np.int64) for b in blocks]
    coded = token_files.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, token_files.decode_blocks(coded, [len(b) for b in blocks])))


def test_coding_is_smaller_on_repetition():
    ids = np.tile(np.arange(1000, 1100), 40)
    assert len(token_files.encode_blocks([ids])[0]) < len(ids) / 2


def test_token_files(spark, odd, none, tmp_path):
    got = sorted(map(tuple, token_files.token_digest(odd, VOCAB, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    at, want = 0, []
    for i, t in plain(odd):
        ids = np.array([*ids_of(t), 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.token_digest(none, VOCAB).count() == 0
    blocks = spark.read.parquet(str(tmp_path / "f"))
    blocks.withColumn("crc32", F.col("crc32") + 1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="checksum"):
        token_files.read_token_files(spark, str(tmp_path / "bad")).collect()


def check_pack(rows, docs, window=4096):
    seqs, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    padding = total = 0
    for parts in seqs.values():
        used = 0
        for offset, n in sorted(parts):
            assert offset == used and n > 0
            used += n
        assert used <= window
        total, padding = total + used, padding + (0 if used & (used - 1) == 0 else window - used)
    for i, t in docs:
        ids, at = np.array([*ids_of(t), 2], "<u4"), 0
        for start, n, crc, whole in sorted(pieces.pop(i)):
            assert start == at and whole == len(ids) and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids)
    assert not pieces
    return padding, total


def test_packing(odd, none, tables):
    unique = odd.filter("doc_id is not null and doc_id <> 4").dropDuplicates(["doc_id"])
    check_pack(packing.pack(unique, VOCAB).collect(), plain(unique))
    assert packing.pack(odd, VOCAB).filter("start = 0").count() == odd.count() and packing.pack(none, VOCAB).count() == 0
    docs = tables["documents"].coalesce(1)
    padding, total = check_pack(packing.pack(docs, VOCAB).collect(), plain(docs))
    assert padding <= 4096 and padding < 0.05 * total


# --- Licences, leaks, quality -----------------------------------------------------


def test_licences(spark, odd, none, tables, small):
    assert oracle.differences(oracle.connect(small), queries.SQL["op1_licences"], licences.scan(tables["documents"])) == ""
    assert sorted((r.template, r.start_word, r.containment) for r in licences.scan(odd).collect()) == [("cc-by-nc-line", 5, 1.0), ("mit-line", 0, 1.0)]
    assert licences.scan(none).count() == 0
    text = dict((t, x) for t, _, x in licences.TEMPLATES)["mit-grant"]
    cut = " ".join(text.split()[4:])
    found = licences.scan(spark.createDataFrame([(1, f"Some words before {cut} and after it"), (2, " ".join(text.split()[9:]))], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.template) for r in found] == [(1, "mit-grant")]


def test_leaks_equal_brute_force(spark, odd, none, tables):
    docs, items = tables["documents"], tables["benchmark"]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    parts = {r.item_id: decontaminate.shingles(decontaminate.item_words(r.text)) for r in items.collect()}
    want = set()
    for i, t in plain(docs):
        own = decontaminate.shingles(decontaminate.item_words(t))
        want |= {(i, k) for k, s in parts.items() if len(s & own) >= 0.8 * len(s)}
    assert got == want and got
    assert decontaminate.leaks(odd, items).count() == 0
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.filter("false")).count() == 0
    assert decontaminate.drop_leaks(docs, items).count() == docs.count() - len({i for i, _ in got})


def test_wand_equals_full_scores(tables):
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    df = collections.Counter(w for _, t in items for w in set(decontaminate.item_words(t)))
    ix = decontaminate.Index(items, df, len(items), 30.0)
    rng = random.Random(2)
    for _ in range(40):
        terms = sorted({rng.randrange(len(ix.terms)) for _ in range(60)} | set(rng.sample(sorted(ix.terms.values()), 40)))
        full = collections.Counter()
        for t in terms:
            for k, v in ix.postings[t].items():
                full[k] += v
        got = [x for b in range(ix.maxima.shape[1]) for x in ix.wand(terms, b, 0.15)]
        assert {k for k, _ in got} == {k for k, v in full.items() if v >= 0.15 - 1e-9}
        assert all(abs(full[k] - v) < 1e-6 for k, v in got)


def test_quality(spark, odd, none, tables):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(odd, quality.fit(docs, labels.filter("false"))).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


# --- URLs, vectors, personal data, joins ------------------------------------------


def test_urls(spark, tables):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "http://example.com/fr", "http://b.net/es/", "http://b.net/de/", "nothing", None, "x://com", "ftp://WWW.x.com?y/", "http://a.net/fr/#/", "http://xcom/"]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(df.unionByName(df.filter("page_id = 0"))).collect()}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups()
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda r: len(r[0]), default=(None, None))
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule[0])
        assert got[k].verdict == (rule[1] or got[k].verdict) and got[k].verdict in ("allow", "block")
    assert url_filter.judge_urls(df.filter("false")).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df.filter("rule is null or page_id in (5, 6)")).collect()} == {"allow"}
    assert url_filter.judge_urls(tables["pages"]).count() == tables["pages"].count()


@pytest.mark.parametrize("spread", [3, 300])
def test_top_k(spark, spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (700, 16)) / 256
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (650, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.quantised(df)
    got = sorted(map(tuple, topk.top_k(v, v.filter("vec_id % 50 = 0 and vec_id <> 650")).collect()))
    q, ids = np.vstack([x, x[1:2]]), np.array([*range(700), 650])
    q = np.floor(q * 256).astype(int)
    want = []
    for i in range(0, 650, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        want += [(i, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(v.filter("false"), v).count() == 0 and topk.top_k(v.filter("vec_id < 3"), v.filter("vec_id = 0")).count() == 2


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(k, m[0])] for k, p in PATTERNS.items()}


def pii_fixture():
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab1.@+-( )é_😀2%") for _ in range(60)) for _ in range(150)]
    noise += ["".join(rng.choice(["1", "23", ".", " ", "-", "+4", "4111111111111111", "a@b.c", "(0)"]) for _ in range(30)) for _ in range(150)]
    return [*odd_texts(), "1" * 20000, "a" * 20000, "1." * 5000, *noise]


def test_personal_data(spark, odd, none):
    rows = [(k, t) for k, t in enumerate(pii_fixture())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for k, t in rows:
        base = base_of(t or "")
        flat = [s for kind in PATTERNS for s in base[kind]]
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[x]) for x in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r.spans.split(",")) | {""}
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    text = clean.filter("doc_id = 13").first().text
    assert text.startswith("mail <EMAIL>, <PHONE>; <IP> and 999.1.1.1; <CARD> and")


def near_fixture():
    rng = random.Random(9)
    make = lambda n: ["w%d" % rng.randrange(4000) for _ in range(n)]
    docs = []
    for _ in range(6):
        base = make(rng.choice([20, 90, 200]))
        for _ in range(14):
            d = base.copy()
            for _ in range(rng.randrange(4)):
                d[rng.randrange(len(d))] = "x%d" % rng.randrange(9999)
            docs.append(" ".join(d))
    passage = make(55)
    docs += [" ".join(make(40) + passage + make(40)) for _ in range(30)] + ["", None, "one", "One!", "two words"]
    return docs + docs[:9]


def test_join_equals_brute_force(spark, monkeypatch, odd, none):
    docs = near_fixture()
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    df = spark.createDataFrame([(k + 1, t) for k, t in enumerate(docs)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in jaccard_join.join_classes(df).collect()}
    nodes = collections.defaultdict(list)
    for k, t in enumerate(docs):
        nodes[tuple(re.findall(r"\w+", (t or "").lower()))].append(k + 1)
    keys = list(nodes)
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for w in keys]
    top, n_links = list(range(len(keys))), collections.Counter()

    def find(x):
        return x if top[x] == x else find(top[x])

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                n_links[a] += 1
                n_links[b] += 1
                top[find(a)] = find(b)
    least = collections.defaultdict(lambda: 10**9)
    for a, k in enumerate(keys):
        least[find(a)] = min(least[find(a)], *nodes[k])
    for a, k in enumerate(keys):
        for i in nodes[k]:
            assert (got[i].class_id, got[i].copy_of, got[i].n_links) == (least[find(a)], min(nodes[k]), n_links[a])
    assert sum(n_links.values()) == 190
    kept = jaccard_join.one_per_class(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()}) and kept.columns == df.columns
    assert jaccard_join.join_classes(odd).count() == odd.count() and jaccard_join.join_classes(none).count() == 0


def test_pruning_bounds():
    keep = jaccard_join.keep_from(0.8, 1e-6)
    assert sorted(keep) == list(range(16, 97, 16)) and all(0 <= keep[n] < n for n in keep)


def test_components(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("z1", "z2"), ("z3", "z2")]
    df = spark.createDataFrame(edges, "node string, root string")
    got = dict(map(tuple, jaccard_join.components(df).collect()))
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {got["z2"], got["z3"]} == {"z1"}


# --- Pipeline ---------------------------------------------------------------------


def stages(spark, docs, sf_dir, folder):
    """The result of each stage, written and read again."""
    out = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        out.append(docs)
    return out


def test_pipeline(spark, small, tables, tmp_path):
    seen = stages(spark, tables["documents"], small, tmp_path)
    assert len(corpus_pipeline.STAGES) == 5 and all(d.columns == tables["documents"].columns for d in seen[:-1])
    counts = [tables["documents"].count(), *(d.count() for d in seen[:-1])]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    check_pack(seen[-1].collect(), plain(seen[-2]))
    final = "\n".join(t for _, t in plain(seen[3]))
    assert not any(base_of(final)[k] for k in ("email",))


def test_run_leaves_its_result_only(spark, small, tmp_path, monkeypatch):
    from voxlake.llm import common

    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, small).count()
    assert rows > 0 and [p.name[:8] for p in tmp_path.iterdir()] == ["pipeline"]


def test_pipeline_on_odd_rows(spark, small, odd, tmp_path):
    good, unique, clean, redacted, packed = stages(spark, odd, small, tmp_path)
    assert all(d.columns == odd.columns for d in (good, unique, clean, redacted))
    words = lambda t: tuple(re.findall(r"\w+", t.lower()))
    kept = [words(t) for _, t in plain(unique)]
    assert len(set(kept)) == len(kept) == unique.count() and set(kept) <= {words(t) for _, t in plain(good)}
    gone = {words(t) for _, t in plain(good)} - set(kept)
    for w in gone:
        sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in (w, *kept)]
        assert any(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets[1:])
    assert plain(clean) == plain(unique) and redacted.count() == clean.count()
    tokens_of = sorted(len(ids_of(t)) + 1 for _, t in plain(redacted))
    assert sorted(r.doc_tokens for r in packed.filter("start = 0").collect()) == tokens_of and packed.agg(F.sum("length")).first()[0] == sum(tokens_of)


def test_pipeline_on_nothing(spark, small, none, tmp_path):
    assert [d.count() for d in stages(spark, none, small, tmp_path)] == [0] * 5
