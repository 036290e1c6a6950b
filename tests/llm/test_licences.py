"""Long texts and short notices."""

from voxlake.llm import licences


def test_notices_repeated_in_long_texts(spark):
    text = dict((t, x) for t, _, x in licences.TEMPLATES)["mit-grant"]
    n = 20_000 // len(text.split())
    df = spark.createDataFrame([(k, (text + " ") * n) for k in range(2)] + [(2, text + " " + "word " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: (r.template, r.containment, r.end_word) for r in licences.scan(df).collect()}
    words = len(text.split())
    assert got == {0: ("mit-grant", 1.0, n * words), 1: ("mit-grant", 1.0, n * words), 2: ("mit-grant", 1.0, words)}


def test_notice_of_few_words(spark):
    rows = [(1, "All rights reserved."), (2, "here all RIGHTS, reserved by us"), (3, "all rights are reserved"), (4, "all rights"), (5, "all rights reserved " * 3), (5, "all rights reserved " * 3), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.template, r.start_word, r.end_word) for r in licences.scan(df).collect())
    assert got == [(1, "rights-reserved", 0, 3), (2, "rights-reserved", 1, 4), (5, "rights-reserved", 6, 9)]
