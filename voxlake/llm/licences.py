"""Licence scans with built-in functions only.

Every text is read as overlapping windows of shingles (five words; a notice of fewer
words is one shingle), as long as the template.  A window and a template are compared by
``BANDS`` MinHash values of one row each: where a window holds 80 % of the template their
similarity is at least 2/3, and they miss each other in all 16 bands with a probability
below 3e-8.  A window that is retrieved is verified exactly: the share of the template's
shingles that it holds.

A band value of a window can equal the template's only if the window holds the very
shingle that gives the template its value.  These shingles, one per template and band,
are looked for first, and windows are only built around them; no other window could
share a band.

A text is scanned where it is read.  Its shingle hashes are kept once, windows are slices
of them, and only the best window of a template leaves the row: work and memory are
linear in the words of a text, however often it repeats a notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, let

SHINGLE, BANDS = 5, 16

#: Public notices, as (template, licence, text).
TEMPLATES = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-terms", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-header", "GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("rights-reserved", "All-Rights-Reserved", "All rights reserved."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)

_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _shingle_text(words: Column, k: Column, width: int) -> Column:
    return F.array_join(F.slice(words, k + 1, width), " ")


def _positions(words: Column, width: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(none)


def _hashes(words: Column, width: int) -> Column:
    return F.transform(_positions(words, width), lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(width)]))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """One row per template: the words of its shingles, its length in shingles, shingle
    texts, and band values with the shingle hash behind each.  As many rows as
    ``templates`` has; one without words is left out."""
    rows = [F.struct(F.lit(t).alias("template"), F.lit(licence).alias("licence"), F.lit(text).alias("text")) for t, licence, text in templates]
    df = spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    by_width = lambda of: F.coalesce(*[F.when((F.col("n") == w) | (F.col("n") >= w) & F.lit(w == SHINGLE), of(w)) for w in range(1, SHINGLE + 1)])
    df = df.filter("n > 0").withColumn("hashes", by_width(lambda w: _hashes(F.col("words"), w)))
    least = lambda j: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit(j)).alias("value"), h.alias("hash"), F.lit(j).alias("band"))))
    return df.select(
        "template", "licence", F.least("n", F.lit(SHINGLE)).alias("width"), F.size("hashes").alias("length"),
        F.array_distinct(by_width(lambda w: F.transform(_positions(F.col("words"), w), lambda k: _shingle_text(F.col("words"), k, w)))).alias("shingles"),
        F.array(*[least(j) for j in range(BANDS)]).alias("bands"),
    )


def _constant(rows) -> Column:
    """Template rows as one constant array."""
    def row(r) -> Column:
        bands = [F.struct(F.lit(b["value"]).alias("value"), F.lit(b["hash"]).alias("hash"), F.lit(b["band"]).alias("band")) for b in r.bands]
        return F.struct(
            F.lit(r.template).alias("template"), F.lit(r.licence).alias("licence"), F.lit(r.length).alias("length"),
            F.array(*map(F.lit, r.shingles)).alias("shingles"), F.array(*bands).alias("bands"),
        )

    return F.array(*map(row, rows))


def _matches(words: Column, width: int, rows, threshold: float, text: Column) -> Column:
    """The best window of every template of ``rows``, all of one shingle width, as
    ``(template, licence, text_id, containment, start, end)``."""
    anchors = sorted({b["hash"] for r in rows for b in r.bands})

    def shares_band(bands: Column, window: Column) -> Column:
        least = lambda b: F.array_min(F.transform(window, lambda h: F.xxhash64(h, b["band"])))
        return F.exists(bands, lambda b: F.array_contains(window, b["hash"]) & (least(b) == b["value"]))

    def of_template(t: Column, hashes: Column, hits: Column) -> Column:
        own = F.filter(hits, lambda k: F.exists(t["bands"], lambda b: b["hash"] == F.get(hashes, k)))
        starts = F.array_distinct(F.flatten(F.transform(own, lambda k: F.sequence(F.greatest(k - t["length"] + 1, F.lit(0)), k))))

        def window(start: Column) -> Column:
            end = F.least(start + t["length"], F.size(hashes)) - 1
            held = F.array_intersect(t["shingles"], F.transform(F.sequence(start, end), lambda k: _shingle_text(words, k, width)))
            found = F.struct((F.size(held) / F.size(t["shingles"])).alias("containment"), start.alias("start"), (end + width).alias("end"))
            return let(F.slice(hashes, start + 1, t["length"]), lambda w: F.when(shares_band(t["bands"], w), found))

        return F.array_max(F.transform(starts, window))

    def of_text(hashes: Column) -> Column:
        def found(hits: Column) -> Column:
            best = F.transform(_constant(rows), lambda t: F.struct(t["template"].alias("template"), t["licence"].alias("licence"), F.md5(text).alias("text_id"), of_template(t, hashes, hits).alias("best")))
            return F.when(F.size(hits) > 0, F.filter(best, lambda m: m["best"]["containment"] >= threshold))

        hits = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda k: F.get(hashes, k).isin(anchors))
        return F.when(F.size(hashes) > 0, let(hits, found))

    return let(_hashes(words, width), of_text)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``doc_id, template, licence, containment, start_word, end_word`` for every
    document and template of which some window holds ``threshold``; the window is the
    last of the best ones.

    Null and empty texts, and texts shorter than a template's shingle, match nothing;
    equal rows are reported once, rows of one doc_id with different texts are scanned
    each; an empty table gives an empty result.  Texts are scanned in one pass; only the
    matches are shuffled, to find equal rows."""
    rows = template_table(docs.sparkSession, templates).collect()
    df, text = id_text(docs), F.col("text")
    none = F.array().cast("array<struct<template:string,licence:string,text_id:string,best:struct<containment:double,start:int,end:int>>>")
    widths = sorted({r.width for r in rows})
    all_widths = lambda words: F.concat(none, *[F.coalesce(_matches(words, w, [r for r in rows if r.width == w], threshold, text), none) for w in widths])
    # The outer form keeps the optimiser from scanning twice, for a filter and for its rows.
    found = df.select("doc_id", F.inline_outer(let(words_of(text), all_widths))).filter("template is not null").distinct()
    return found.select("doc_id", "template", "licence", F.round("best.containment", 6).alias("containment"), F.col("best.start").cast("long").alias("start_word"), F.col("best.end").cast("long").alias("end_word"))


def scan_sql(templates=TEMPLATES, threshold: float = 0.8) -> str:
    """The same result by exact comparison of all windows that start with a shared shingle."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in templates)
    split = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t0 AS (SELECT template, licence, {split.format("notice")} AS words FROM (VALUES {values}) v(template, licence, notice)),
t AS (SELECT *, least(len(words), {SHINGLE}) AS width FROM t0 WHERE len(words) > 0),
ts AS (SELECT template, licence, width, len(words) - width + 1 AS length, array_to_string(words[k:k + width - 1], ' ') AS shingle
       FROM t, unnest(range(1, len(words) - width + 2)) u(k)),
tn AS (SELECT template, count(DISTINCT shingle) AS n FROM ts GROUP BY 1),
d AS (SELECT doc_id, md5(text) AS text_id, {split.format("text")} AS words FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, text_id, len(words) AS n_words, width, k, array_to_string(words[k:k + width - 1], ' ') AS shingle
       FROM d, (SELECT DISTINCT width FROM t) w, unnest(range(1, len(words) - width + 2)) u(k)),
hits AS (SELECT DISTINCT doc_id, text_id, n_words, template, licence, width, length, k, shingle FROM ds JOIN ts USING (width, shingle)),
w AS (SELECT a.doc_id, a.text_id, a.n_words, a.template, a.licence, a.width, a.length, a.k, count(DISTINCT b.shingle) AS held
      FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.text_id = b.text_id AND a.template = b.template AND b.k BETWEEN a.k AND a.k + a.length - 1
      GROUP BY ALL),
c AS (SELECT w.*, held / n AS containment FROM w JOIN tn USING (template) WHERE held / n >= {threshold}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text_id, template ORDER BY containment DESC, k DESC) AS place FROM c)
SELECT doc_id, template, licence, round(containment, 6) AS containment, k - 1 AS start_word,
       least(k - 1 + length, n_words - width + 1) - 1 + width AS end_word
FROM r WHERE place = 1"""
