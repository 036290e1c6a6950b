"""What the methods once could not do by construction."""

import random

from voxlake.llm import decontaminate, jaccard_join, pii


def test_trees_add_spelt_out_and_national_forms(spark):
    rng = random.Random(2)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts = []
    for k in range(300):
        texts.append(f"some words a{k}.b@host{k}.example and +49 30 {n(3)}-{n(4)} then 10.{k % 200}.3.4 there, on 2023-10-{k % 28 + 1:02d}, of {n(16)} or {n(9)} pieces")
        texts.append(f"please Tel: 030 {n(3)} {n(4)} or mail to jane{k} (at) host{k} (dot) org today")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    planted = [got[k] for k in range(1, 600, 2)]
    assert sum("email" in r.spans for r in planted) > 290 and sum("phone" in r.spans for r in planted) > 290
    assert all(r.n_email == r.n_phone == 0 for r in planted)
    text = pii.redact(df).filter("doc_id = 1").first().text
    assert "jane0" not in text and "<EMAIL>" in text
    for k in range(0, 600, 2):
        at = texts[k].index("2023-10-")
        assert not any(int(s.split(":")[1]) <= at < int(s.split(":")[2]) for s in got[k].spans.split(",") if s)


def test_stages_decide_by_row(spark):
    words = lambda a: " ".join(f"{a}{k}" for k in range(60))
    a, b, c, d = (words(x) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (5, c), (5, d), (None, d), (None, d), (None, words("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard_join.one_per_class(df).collect())
    assert kept == sorted([(1, a), (2, b), (5, c), (5, d), (0, words("e"))])
    item = spark.createDataFrame([("i", b)], "item_id string, text string")
    left = sorted((r.doc_id or 0, r.text) for r in decontaminate.drop_leaks(spark.createDataFrame([(1, a), (2, b), (2, c), (None, b), (None, d)], df.schema), item).collect())
    assert left == sorted([(1, a), (2, c), (0, d)])
