"""What the method adds to the base patterns, and the bound of its sample."""

import random

import pytest

from voxlake.llm import pii


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(["ka", "to", "li", "ren", "mo", "sa"]) for _ in range(rng.randint(1, 4)))
    out = []
    for k in range(400):
        out.append(f"{word()} {word()} a{k}.b@host{k}.example and +49 30 {n(3)}-{n(4)} {word()} 10.{k % 200}.3.4 there, on 2023-10-{k % 28 + 1:02d}, of {n(16)} or {n(9)} {word()}")
    for k in range(100):
        out += [
            f"{word()} jane{k} (at) host{k} (dot) org {word()}", f"{word()} jane{k} [at] mail{k} [dot] example [dot] com {word()}", f"{word()} 10[.]{k}[.]7[.]9 {word()}",
            f"please Tel: 030 {n(3)} {n(4)} {word()}", f'{word()} api_key = "{n(12)}{"".join(rng.choice("abcdef") for _ in range(12))}" {word()}',
        ]
    out += [f"{word()} we met at home. then {word()} looked at {word()} dot {word()} {n(5)} times, {n(3)}.{n(3)} and page {k}" for k in range(200)]
    return out


def test_disguised_spans_are_added_and_others_are_not(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    planted = {"(at)": [], "[at]": [], "[.]": [], "Tel:": [], "api_key": []}
    for k in range(400, 900):
        name = next(x for x in planted if x in texts[k])
        planted[name].append(got[k].n_added > 0)
        assert got[k].n_spans == got[k].n_added == len([s for s in got[k].spans.split(",") if s]) and got[k].n_email == got[k].n_phone == got[k].n_ip == 0
    assert all(sum(v) >= 0.9 * len(v) == 90 for v in planted.values()), {k: sum(v) for k, v in planted.items()}
    for k in range(400):
        at = texts[k].index("2023-10-")
        assert not any(int(s.split(":")[1]) <= at < int(s.split(":")[2]) for s in got[k].spans.split(",") if s)
    assert sum(got[k].n_spans > 0 for k in range(900, 1100)) <= 20
    clean = {r.doc_id: r.text for r in pii.redact(df).filter("doc_id between 400 and 499").collect()}
    assert "<EMAIL>" in clean[400] and "jane0" not in clean[400] and "<SECRET>" in clean[404]


def test_hold_out(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.held_out_scores(df).collect()
    made = [r for r in rows if r.made]
    assert sum(r.added for r in made) >= 0.9 * len(made) > 200
    added = [r for r in rows if r.added]
    assert sum(r.label for r in added) >= 0.95 * len(added)


def test_sample_is_bounded_with_copies(spark):
    text = "write to a.b@c.org, card 4111 1111 1111 1111, id 4111111111111112"
    df = spark.range(5000).selectExpr("id as doc_id", f"'{text}' as text")
    base, wide = pii._mark(df["text"])
    marked = df.select(base.alias("base"), wide.alias("wide"), df["doc_id"].alias("row"))
    sample = pii._sampled(pii._candidates(marked), 600)
    n = sample.count()
    assert 60 < n <= 600 and sample.selectExpr("sum(weight / if(stratum % 3 = 2, 0.5, 1))").first()[0] == pytest.approx(pii._candidates(marked).count(), rel=0.02)


def test_long_addresses_are_proposed(spark):
    local = "a" * 300
    df = spark.createDataFrame([(f"x {local} (at) {'b' * 200} (dot) org y",)], "text string")
    found = df.select(pii.wide_spans(df["text"]).alias("w")).first().w
    assert [(s.kind, s.start, s.value[:300]) for s in found if s.kind == 0] == [(0, 2, local)]


def fitted_on(monkeypatch):
    """What trees are fitted on from here on: rows by label, a dict a fit."""
    fits, model = [], pii._model

    def spy(training):
        fits.append({r.label: r.n for r in training.groupBy("label").agg({"rows": "sum"}).toDF("label", "n").collect()})
        return model(training)

    monkeypatch.setattr(pii, "_model", spy)
    return fits


@pytest.fixture(scope="module")
def many(spark):
    """3,000 addresses, and as many cards of which one digit in ten fits."""
    return spark.range(3000).selectExpr("id as doc_id", "concat('write to a', id, '.b@host', id % 7, '.org or 4111 1111 1111 111', id % 10, ' there') as text")


def test_trees_and_thresholds_come_from_all_candidates(spark, many, monkeypatch):
    base, wide = pii._mark(many["text"])
    candidates = pii._candidates(many.select(base.alias("base"), wide.alias("wide"), many["doc_id"].alias("row"))).cache()
    made = pii._disguised(candidates.filter("is_base")).count()
    fits = fitted_on(monkeypatch)
    assert pii.find(many).count() == 3000
    good = candidates.filter("label = 1").count()
    # A fit on each half for the thresholds, and the last one on all.
    assert fits[-1] == {1.0: good + made, 0.0: candidates.count() - good} and good > 3000
    assert [sum(f[k] for f in fits[:-1]) for k in (0.0, 1.0)] == [fits[-1][0.0], fits[-1][1.0]]
    assert pii.held_out_scores(many).filter("not made").count() == candidates.count()


def test_no_bound_of_a_split_is_drawn(spark, many):
    """Numeric features would have their bounds from about 10,000 rows."""
    base, wide = pii._mark(many["text"])
    candidates = pii._candidates(many.select(base.alias("base"), wide.alias("wide"), many["doc_id"].alias("row")))
    meta = pii._vectors(pii._levelled(candidates)).schema["features"].metadata["ml_attr"]
    assert set(meta["attrs"]) == {"binary"} and len(meta["attrs"]["binary"]) == meta["num_attrs"] == sum(map(len, pii.LEVELS.values()))
    rows = pii._vectors(pii._levelled(candidates.filter("n = 19").limit(1))).first()
    assert sum(rows.features[k - 6 + 4] for k in range(6, 25)) == 14


def test_thresholds_go_through_scores_that_no_row_has(spark):
    rows = [(0, 0.97, 1.0)] * 20 + [(0, 0.3, 0.0)] * 20 + [(1, 0.97, 1.0)] * 20 + [(1, 0.805, 0.0)] * 20
    held = spark.createDataFrame(rows, "kind int, p double, label double").selectExpr("*", "1.0D as weight", "1 as rows", "false as failed")
    assert pii._limits(held) == {0: 0.5, 1: 0.81}


def test_redaction_is_fitted_on_all_candidates(spark, many, monkeypatch):
    base, wide = pii._mark(many["text"])
    candidates = pii._candidates(many.select(base.alias("base"), wide.alias("wide"), many["doc_id"].alias("row")))
    fits = fitted_on(monkeypatch)
    assert pii.redact(many).filter("text like 'write to <EMAIL> or%'").count() == 3000
    assert fits[-1][0.0] == candidates.filter("label = 0").count() > 2667 and fits[-1][1.0] >= candidates.filter("label = 1").count()
