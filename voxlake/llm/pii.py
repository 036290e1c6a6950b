"""Personal data: base patterns, and boosted trees over high-recall candidates.

Built-in functions only.  Base spans are the fixed patterns and their checks; they
always count.  High-recall generators propose further, overlapping spans: spelt-out
addresses, dotted and grouped numbers, and assigned keys, which no base pattern knows.
Trees learn from every candidate what personal data looks like in format and context,
and a threshold per kind that keeps a precision of ``PRECISION`` selects those to add.  It
is set on the scores that each half of the candidates gets from trees fitted on the other
half.  The trees see levels of features whose bounds are fixed (``LEVELS``), so candidates
of equal levels are one weighted row without loss, and no bound of a split is estimated.

Positives are the base spans, the same spans disguised in place (``(at)`` for ``@``, no
``+``, other separators), and other candidates that pass the checks of their kind and
stand after a word for it or are spelt out in brackets.  Negatives fail a check, and are
never added, or, with less weight, pass but have no such context.

Positions come from cutting a text at its matches: the lengths of the parts between and
of the matches add up to code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE_ROWS, all_columns, let, shared_table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans; the last has no base pattern.
ALL_KINDS = (*KINDS, "secret")
PRECISION = 0.98
#: Weight of a negative that is one for want of context only, and the positives of a kind
#: that a hold-out needs.
PRESUMED, LEAST_GOOD = 0.5, 10
#: Tasks that hold the training rows, and more where these fill more files.
FIT_TASKS = 4
_BUCKETS = 1 << 20
CONTEXT = 24

#: The base patterns.  Quantifiers that never need to give back are
#: possessive, and runs are entered at their start (or where the last match ended),
#: which leaves the matches as they are and keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r" ?[(\[{]at[)\]}] ?", r" ?[(\[{]dot[)\]}] ?"
#: The generators: spelt-out addresses, dotted numbers, long and grouped numbers, and long
#: runs that hold a digit.  Runs are entered at their start and never given back.
WIDE = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:(?:{_AT}|@)[a-z0-9-]++(?:(?:{_DOT}| dot |\.)[a-z0-9-]++)++| at [a-z0-9-]++(?: dot [a-z0-9-]++)++)",
    "ip": r"(?i)(?<![0-9])[0-9]{1,3}+(?:(?:[.:]|[(\[](?:\.|dot)[)\]])[0-9]{1,3}+){3,}+",
    "card": r"[0-9](?:[ .-]?[0-9]){11,}+",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
}
_WORDS = {"email": "e?-?mail|contact|write|adress|correo", "ip": r"ip\b|host|server|addr", "card": "card|visa|konto|carte|tarjeta", "phone": "tel|phone|call|fax|mobil", "secret": "token|key|secret|passw|pwd|auth|bearer|credential"}
_SPELT = r"(?i)[(\[{](?:at|dot|\.)[)\]}]"
_ASSIGNED = r"[:=] ?[\"']?$"
_DATE = r"^(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9])"
#: How base spans are disguised: (pattern, replacement) pairs, one after the other.
DISGUISES = {
    "email": ((("@", " (at) "), (r"\.", " (dot) ")), (("@", " [at] "), (r"\.", " [dot] ")), (("@", " at "), (r"\.", " dot ")), (("@", "(at)"),)),
    "ip": (((r"\.", "[.]"),), ((r"\.", ":"),), ((r"\.", "(dot)"),)),
    "card": ((("[ -]", "."),), (("[ -]", ""), (r"([0-9]{4})(?=[0-9])", "$1-")), (("[ -]", ""), (r"([0-9]{4})(?=[0-9])", "$1."))),
    "phone": (((r"^\+", ""),), ((r"^\+", ""), (r"[ ().-]+", ".")), ((r"^\+", ""), (r"[ ().-]+", "/")), ((r"^\+[0-9]{1,2}", "0"),)),
}

_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def located(text: Column, kind: int, pattern: str, gate: Column) -> Column:
    """All matches as ``(kind, start, end, value)``, in code points."""

    def cut(matches: Column) -> Column:
        def place(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

            def step(acc: Column, k: Column) -> Column:
                value, at = F.get(matches, k), acc["at"] + F.length(F.get(parts, k))
                span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(value)).alias("end"), value.alias("value"))
                return F.struct((at + F.length(value)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda acc: acc["out"])

        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), place)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.when(gate, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten; false for more than 32 digits,
    which no card has."""

    def of(digits: Column) -> Column:
        n = F.length(digits)

        def term(k: Column) -> Column:
            d = F.ascii(F.substr(digits, k, F.lit(1))) - 48
            twice = F.when(F.pmod(n - k, F.lit(2)) == 1, d * 2).otherwise(d)
            return F.when(twice > 9, twice - 9).otherwise(twice)

        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, k: acc + term(k))
        return F.when(n.between(1, 32), total % 10 == 0).otherwise(False)

    return let(value, of)


def passes(kind: int, value: Column) -> Column:
    """The checks of a base span."""
    name = ALL_KINDS[kind]
    if name == "ip":
        return ~value.rlike(r"(?:^|\.)0*(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[1-9][0-9]{3,})(?:\.|$)")
    if name == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if name == "secret":
        return value.rlike("[A-Za-z]")
    if name == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _gate(name: str, text: Column) -> Column:
    if name == "email":
        return F.contains(text, F.lit("@"))
    if name == "phone":
        return F.contains(text, F.lit("+"))
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans, by kind and start."""
    return F.concat(*[_passing(located(text, k, BASE[name], _gate(name, text)), k) for k, name in enumerate(KINDS)])


def _passing(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: passes(kind, s["value"]))


def _of_kind(spans, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def wide_spans(text: Column) -> Column:
    found = []
    for k, name in enumerate(ALL_KINDS):
        gate = text.rlike(r"(?i)@|[(\[{]at[)\]}]| at ") if name == "email" else F.lit(True)
        found.append(located(text, k, WIDE[name], gate))
    return F.concat(*found)


def _around(text: Column, span: Column) -> Column:
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return F.struct(
        span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["value"].alias("value"),
        F.lower(F.substr(text, begin + 1, span["start"] - begin)).alias("before"), F.substr(text, span["end"] + 1, F.lit(2)).alias("after"),
    )


FEATURES = ("kind", "n", "n_digits", "groups", "separators", "dots", "plus", "brackets", "luhn", "top_part", "first_group", "last_group", "hint", "glued_before", "glued_after", "colon", "letters")
#: The least values of the levels of each feature, above level 0.
LEVELS = {
    "kind": range(1, 5), "n": (*range(6, 25), 26, 28, 30, 32, 36, 40, 48, 64, 96, 128, 256), "n_digits": (*range(1, 21), 24, 28, 32, 48, 64), "groups": (*range(1, 9), 10, 12, 16),
    "separators": (*range(1, 9), 10, 12, 16), "dots": (*range(1, 9), 12), "plus": (1,), "brackets": (1, 2, 3, 4, 6, 8), "luhn": (1,), "top_part": (*range(1, 13), 14, 16, 17, 20, 24, 32),
    "first_group": (*range(1, 13), 16, 20), "last_group": (*range(1, 13), 16, 20), "hint": (1,), "glued_before": (1,), "glued_after": (1,), "colon": (1,), "letters": (1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128),
}


def _features(df: DataFrame) -> DataFrame:
    v, digits = F.col("value"), _digits(F.col("value"))
    count = lambda c, x: F.length(c) - F.length(F.translate(c, x, ""))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    hint = F.coalesce(*[F.when(F.col("kind") == k, F.col("before").rlike(rf"(?<!\p{{L}})(?:{_WORDS[n]})")) for k, n in enumerate(ALL_KINDS)])
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    parts = {
        "n": F.length(v), "n_digits": F.length(digits), "groups": F.size(groups), "separators": count(v, " -./"), "dots": count(v, "."),
        "plus": v.startswith("+"), "brackets": count(v, "()[]"), "luhn": luhn(digits), "top_part": F.array_max(F.transform(groups, lambda g: F.length(g))),
        "first_group": F.length(F.get(groups, F.lit(0))), "last_group": F.length(F.element_at(F.concat(F.array(F.lit("")), groups), -1)),
        "hint": hint, "glued_before": F.col("before").rlike(r"[\p{L}\p{N}]$"), "glued_after": F.col("after").rlike(r"^[\p{L}\p{N}]"), "colon": F.col("before").rlike(_ASSIGNED), "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")),
    }
    return df.withColumns({k: number(c) for k, c in parts.items()})


def _overlaps(spans: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.exists(spans, lambda s: (s["kind"] == kind) & (s["start"] < end) & (s["end"] > start))


def _failed(base) -> Column:
    """Whether a candidate fails a check: that of its kind, to stand alone, to be no date,
    to be no base span of another kind, or, for a secret, to be assigned to something."""
    value = F.regexp_replace("value", r"(?i):|[(\[](?:\.|dot)[)\]]", ".")
    own = F.coalesce(*[F.when(F.col("kind") == k, passes(k, value)) for k in range(len(ALL_KINDS))])
    glued = F.col("before").rlike(r"[\p{L}\p{N}]$") | F.col("after").rlike(r"^[\p{L}\p{N}]")
    other = F.exists(base, lambda s: (s["kind"] != F.col("kind")) & (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    loose = (F.col("kind") == len(KINDS)) & ~F.col("before").rlike(_ASSIGNED)
    return ~own | glued | F.col("value").rlike(_DATE) | other | loose


def _disguised(base: DataFrame) -> DataFrame:
    """Rows of base spans with their value disguised, one row a disguise."""

    def variants(ways) -> Column:
        out = []
        for way in ways:
            v = F.col("value")
            for pattern, new in way:
                v = F.regexp_replace(v, pattern, new)
            out.append(v)
        return F.array(*out)

    every = F.coalesce(*[F.when(F.col("kind") == k, variants(DISGUISES[n])) for k, n in enumerate(KINDS)])
    return base.withColumn("value", F.explode(F.array_distinct(every)))


def _sampled(candidates: DataFrame, fit_rows: int) -> DataFrame | None:
    """At most ``fit_rows`` candidates, drawn by row and position so that copies are drawn
    one by one, from every kind and label alike, with ``weight`` for the share that was
    drawn, ``label`` and ``half``; None where one label is missing."""
    stratum = F.col("kind") * 3 + F.when(F.col("label") == 1, 0).when(F.col("failed"), 1).otherwise(2)
    marked = candidates.withColumn("stratum", stratum)
    strata = marked.groupBy("stratum").agg(F.count("*").alias("n")).collect()
    if len({r.stratum % 3 == 0 for r in strata}) < 2:
        return None
    quota = fit_rows // (3 * len(ALL_KINDS))
    by = lambda of: F.coalesce(*[F.when(F.col("stratum") == r.stratum, of(r)) for r in strata])
    place = F.xxhash64("row", "kind", "start")
    drawn = marked.withColumn("place", place).filter(F.pmod("place", F.lit(_BUCKETS)) < by(lambda r: math.ceil(_BUCKETS * min(1.0, 1.2 * quota / r.n))))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("stratum").orderBy("place", "row"))).filter(F.col("nth") <= quota)
    presumed = F.when(F.col("stratum") % 3 == 2, PRESUMED).otherwise(1.0)
    return drawn.withColumn("weight", by(lambda r: r.n / min(quota, r.n)) * presumed).withColumn("half", F.pmod(F.xxhash64("place"), F.lit(2)))


def _candidates(marked: DataFrame) -> DataFrame:
    """Every candidate of ``marked`` (``row, base, wide``), labelled."""
    candidates = marked.select("row", "base", F.explode("wide").alias("c")).select("row", "base", "c.*")
    is_base = F.exists("base", lambda s: (s["kind"] == F.col("kind")) & (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")))
    known = _overlaps(F.col("base"), F.col("start"), F.col("end"), F.col("kind"))
    candidates = _features(candidates.withColumns({"is_base": is_base, "known": known, "failed": _failed(F.col("base"))}).drop("base"))
    context = (F.col("hint") == 1) | F.col("value").rlike(_SPELT)
    return candidates.withColumn("label", (F.col("is_base") | (~F.col("known") & ~F.col("failed") & context)).cast("double"))


def _training(candidates: DataFrame, fit_rows: int | None) -> DataFrame | None:
    """Every candidate, or at most ``fit_rows`` of them where a caller asks for so few, and
    its disguises: levels of features, ``label, weight, half, kind, failed, made``."""
    if fit_rows is None:
        presumed = F.when((F.col("label") == 0) & ~F.col("failed"), PRESUMED).otherwise(1.0)
        used = candidates.withColumns({"weight": presumed, "half": F.pmod(F.xxhash64(F.xxhash64("row", "kind", "start")), F.lit(2))})
    else:
        used = _sampled(candidates, fit_rows)
        if used is None:
            return None
        used = shared_table(used.coalesce(FIT_TASKS), "pii-sample")
    kept = [*FEATURES, "failed", "weight", "half", "label"]
    made = _features(_disguised(used.filter("is_base")).withColumns({"failed": F.lit(False), "label": F.lit(1.0)}))
    return _levelled(used.select(*kept).withColumn("made", F.lit(False)).unionByName(made.select(*kept).withColumn("made", F.lit(True))))


def _levelled(df: DataFrame) -> DataFrame:
    """Features replaced by the number of their ``LEVELS`` that they reach."""

    def level(c: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, LEVELS[c])), lambda least: least <= F.col(c)))

    return df.withColumns({c: level(c) for c in FEATURES})


def _grouped(training: DataFrame, rows: int) -> DataFrame:
    """Training rows that the trees and the thresholds cannot tell apart, as one row with
    their ``weight`` and their number ``rows``; ``rows`` is about how many there are."""
    groups = training.groupBy(*FEATURES, "label", "failed", "half").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))
    return shared_table(groups, "pii-training", rows)


def _vectors(df: DataFrame) -> DataFrame:
    """``features``: for every level of a feature whether it is reached, marked as binary.
    Binary features have one split, where Spark would take the bounds of numeric ones from
    some of the rows."""
    from pyspark.ml.functions import array_to_vector

    names = [(c, k) for c in FEATURES for k in range(1, len(LEVELS[c]) + 1)]
    flags = array_to_vector(F.array(*[(F.col(c) >= k).cast("double") for c, k in names]))
    attrs = {"binary": [{"idx": i, "name": f"{c}_{k}"} for i, (c, k) in enumerate(names)]}
    return df.withColumn("features", flags.alias("features", metadata={"ml_attr": {"attrs": attrs, "num_attrs": len(names)}}))


def _model(training: DataFrame):
    """A function that adds the trees' ``p``, fitted on all of ``training``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    tasks = max(FIT_TASKS, -(-training.count() // FILE_ROWS))
    trainer = GBTClassifier(maxIter=10, maxDepth=4, maxBins=32, stepSize=0.3, seed=7, weightCol="weight")
    model = trainer.fit(_vectors(training).select("features", "label", "weight").coalesce(tasks))
    return lambda df: model.transform(_vectors(df)).withColumn("p", vector_to_array("probability")[1])


def _held_out(groups: DataFrame, rows: DataFrame) -> DataFrame | None:
    """``rows`` with the ``p`` of trees fitted on the other half of ``groups``, where that
    half has both labels; None where neither has."""
    labels = {(r.half, r.label) for r in groups.select("half", "label").distinct().collect()}
    held = [_model(groups.filter(f"half = {1 - half}"))(rows.filter(f"half = {half}")) for half in (0, 1) if {(1 - half, 0.0), (1 - half, 1.0)} <= labels]
    return None if not held else held[0] if len(held) == 1 else held[0].unionByName(held[1])


def _limits(held: DataFrame) -> dict[int, float]:
    """For each kind the least score of at least 0.5 from which on ``PRECISION`` of the
    scored hold-out rows that may be added (no failed ones) are positives; kinds of which
    there are too few have none."""
    bins = held.filter("not failed").groupBy("kind", F.floor(F.col("p") * 100).alias("bin")).agg(
        F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all"), F.sum(F.col("label") * F.col("rows")).alias("n")
    ).collect()
    limits = {}
    for kind in {r.kind for r in bins}:
        good = total = n = 0
        found = {r.bin: r for r in bins if r.kind == kind}
        # Through empty bins as well: the last trees score a little off those of the halves.
        for bin in range(100, 49, -1):
            if r := found.get(bin):
                good, total, n = good + r.good, total + r["all"], n + r.n
            if good >= PRECISION * total and n >= LEAST_GOOD:
                limits[int(kind)] = bin / 100
    return limits


def _selected(marked: DataFrame, fit_rows: int | None) -> DataFrame:
    """``row, kind, start, end`` of the candidates to add; ``marked`` has ``row, base,
    wide``."""
    candidates = shared_table(_candidates(marked), "pii-candidates", marked.count())
    empty = candidates.select("row", "kind", "start", "end").filter("false")
    training = _training(candidates, fit_rows)
    if training is None:
        return empty
    groups = _grouped(training, candidates.count())
    held = _held_out(groups, groups)
    limits = {} if held is None else _limits(held)
    if not limits:
        return empty
    limit = F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in limits.items()])
    fresh = candidates.filter("not known and not failed").filter(F.col("kind").isin(*limits))
    return _model(groups)(_levelled(fresh)).filter(F.col("p") >= limit).select("row", F.col("kind").cast("int").alias("kind"), "start", "end")


def held_out_scores(docs: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """``kind, made, failed, label, weight, added`` of every training row, scored by trees
    that have not seen its half: what precision and recall are measured on.  ``made`` rows
    are disguises."""
    base, wide = _mark(F.coalesce(F.col("text"), F.lit("")))
    marked = shared_table(docs.select(base.alias("base"), wide.alias("wide"), F.monotonically_increasing_id().alias("row")), "pii-spans")
    candidates = shared_table(_candidates(marked), "pii-candidates")
    training = _training(candidates, fit_rows).withColumn("rows", F.lit(1))
    held = _held_out(_grouped(training, candidates.count()), training)
    limit = F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in _limits(held).items()], F.lit(2.0))
    return held.select("kind", "made", "failed", "label", "weight", ((F.col("p") >= limit) & ~F.col("failed")).alias("added"))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mark(text: Column) -> tuple[Column, Column]:
    base = F.transform(base_spans(text), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return base, F.transform(wide_spans(text), lambda s: _around(text, s))


def _with_added(marked: DataFrame, fit_rows: int | None) -> DataFrame:
    """``marked`` with ``spans``: base spans and added ones, by kind and start."""
    added = _selected(marked, fit_rows).groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return marked.join(added, "row", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", empty))))


def find(docs: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added`` per
    row of ``docs``; the counts by kind and the digest are those of the base spans,
    ``spans`` and ``n_spans`` are of all spans, and ``n_added`` of those that the trees add,
    among them spans of the kind ``secret``.  Trees and thresholds come from all candidates;
    only a caller who passes ``fit_rows`` has them fitted on a sample of so many.

    Null and empty texts have no spans (digest of the empty string); repeated rows and
    null ids come back each; an empty table gives an empty result.  One pass over the
    texts writes spans and candidates; the rest works on those."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, wide = _mark(text)
    marked = docs.select("doc_id", base.alias("base"), wide.alias("wide"), F.monotonically_increasing_id().alias("row"))
    marked = shared_table(marked, "pii-spans")
    counts = {f"n_{name}": F.size(_of_kind("base", k)).cast("long") for k, name in enumerate(KINDS)}
    n = F.size("spans").cast("long")
    out = _with_added(marked, fit_rows).withColumns({"n_spans": n, "n_added": n - F.size("base")})
    out = out.withColumns(counts | {"base_sha256": F.sha2(_text_of(F.array_sort("base")), 256), "spans": _text_of(F.col("spans"))})
    return out.select("doc_id", *counts, "base_sha256", "spans", "n_spans", "n_added")


def redact(docs: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that
    overlap become one.  Null texts stay null and empty ones empty, all rows and columns
    are kept whatever their ids and names, an empty table stays empty, and ``n_chars``
    follows the text where it is a column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base, wide = _mark(text)
    marked = docs.select(F.struct(*all_columns(docs)).alias("own"), base.alias("base"), wide.alias("wide"), F.monotonically_increasing_id().alias("row"))
    marked = shared_table(marked, "pii-rows")
    body = F.coalesce(F.col("own.text"), F.lit(""))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in ALL_KINDS])
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(body, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["out"], F.array(between, F.get(names, s["kind"])))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(body, acc["at"] + 1)))
    done = _with_added(marked, fit_rows).select("own", F.when(F.size("spans") > 0, clean).otherwise(F.col("own.text")).alias("clean"))
    columns = [F.col("clean").alias("text") if c == "text" else F.length(F.coalesce("clean", F.lit(""))).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("own").getField(c).alias(c) for c in docs.columns]
    return done.select(*columns)
