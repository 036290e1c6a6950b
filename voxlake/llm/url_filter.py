"""URL verdicts: listed rules first, else gradient-boosted trees on lexical features.

Built-in functions only.  Labelled URLs are those of hosts that name a listed kind of
site (blocked), those that a rule decides (its verdict), and, with less weight, all
others, which are presumed allowed: a rule that names some paths of a suffix would
otherwise make the whole suffix look blocked.  The trees see lexical features alone, no
words, so what they learn of a listed host's shape carries over to hosts without one.

Everything is judged by hosts that were not learned from.  Hosts are dealt into folds;
suffix statistics of a URL leave out its own fold and shrink to the share of all; trees
fitted on the other folds score a fold, and isotonic regression over these scores turns
the trees' output into a probability.  A URL is blocked where that is ``BLOCK_AT`` or
more, and allowed where the evidence is thinner.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

#: Bound of the labelled sample that the trees are fitted on, cut exactly.
FIT_ROWS = 50_000
#: Tasks that hold the sample, which is bounded.
FIT_TASKS = 4
#: Hash values by which the sample is drawn.
_BUCKETS = 1 << 20
FOLDS, TREES, DEPTH = 3, 10, 3
#: Pseudo-rows of the suffix statistics, weight of a presumed label, bins of the calibration.
SHRINK, PRESUMED, BINS = 50.0, 0.5, 50
BLOCK_AT = 0.8

#: Words for kinds of sites that are blocked, as parts of a host name.
SITE_WORDS = ("ads", "adult", "bet", "bets", "casino", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")

#: The rules, as (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "params", "hyphens", "has_query", "has_fragment", "secure", "longest_label", "suffix_rate", "suffix_share")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _lexical(df: DataFrame) -> DataFrame:
    """Length, depth, digit, entropy and parameter features of ``url, host, path``."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    ratio = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    count = lambda c, x: F.length(c) - F.length(F.translate(c, x, ""))
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789-./?=&_%#:"
    low = F.lower(url)
    shares = [ratio(count(low, x), n) for x in alphabet]
    entropy = reduce(lambda a, b: a + b, [F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in shares])
    labels = F.split("host", "\\.")
    return df.select(
        "*",
        n.cast("double").alias("n_url"),
        F.length("host").cast("double").alias("n_host"),
        F.length("path").cast("double").alias("n_path"),
        count(F.col("path"), "/").cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        ratio(digits(url), n).alias("digit_ratio"),
        ratio(digits(F.col("host")), F.length("host")).alias("host_digit_ratio"),
        entropy.alias("entropy"),
        (count(url, "=") + count(url, "&")).cast("double").alias("params"),
        count(F.col("host"), "-").cast("double").alias("hyphens"),
        (F.instr(url, "?") > 0).cast("double").alias("has_query"),
        (F.instr(url, "#") > 0).cast("double").alias("has_fragment"),
        url.startswith("https").cast("double").alias("secure"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        F.element_at(labels, -1).alias("suffix"),
    )


def _labelled(df: DataFrame, words=SITE_WORDS) -> DataFrame:
    """``df`` with ``stratum``, ``label``, ``trust`` and ``fold`` of its host."""
    named = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in words]).cast("array<string>")) if words else F.lit(False)
    stratum = F.when(named, 0).when(F.col("listed") == "block", 1).when(F.col("listed") == "allow", 2).otherwise(3)
    return df.withColumns({
        "stratum": stratum, "label": (stratum < 2).cast("double"), "trust": F.when(stratum == 3, PRESUMED).otherwise(1.0), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"),
    })


def _with_suffix_rates(df: DataFrame, counts: DataFrame) -> DataFrame:
    """``df`` with the shrunken share of blocked URLs of its suffix and their (logarithmic)
    number, over the hosts of other folds.  ``counts`` has a row per suffix and fold."""
    each = counts.groupBy("suffix").agg(F.map_from_entries(F.collect_list(F.struct("fold", F.struct("bad", "all")))).alias("by_fold"), F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    prior = counts.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum("all"), F.lit(0.0)) + 2.0)).first()[0]
    own = lambda part: F.coalesce(F.col("by_fold")[F.col("fold")][part], F.lit(0.0))
    rest = lambda part: F.coalesce(part, F.lit(0.0)) - own(part)
    rate = (rest("bad") + SHRINK * prior) / (rest("all") + SHRINK)
    rates = {"suffix_rate": rate, "suffix_share": F.log1p(rest("all"))}
    return df.join(each, "suffix", "left").withColumns(rates).drop("by_fold", "bad", "all")


def _isotonic(rows: list[tuple[int, float, float]]) -> list[float]:
    """For each of ``BINS`` bins the share of ``good`` in ``all`` of ``(bin, good, all)``,
    made to rise with the bin by pooling; a bin without rows has that of the bin below."""
    pools: list[list[float]] = []
    for k, good, all_ in sorted(rows):
        pools.append([k, good, all_])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, good, all_ = pools.pop()
            pools[-1][1] += good
            pools[-1][2] += all_
    out, at = [], -1
    for k in range(BINS):
        while at + 1 < len(pools) and pools[at + 1][0] <= k:
            at += 1
        # One pseudo-row of the other kind: few rows are thin evidence.
        out.append(pools[at][1] / (pools[at][2] + 1) if at >= 0 else 0.0)
    return out


def _learned(df: DataFrame, fit_rows: int):
    """``(score, cross)``: a function that adds the trees' ``p`` to rows of ``df``, and the
    sample scored by trees of other folds; None where there is one class only."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    strata = df.groupBy("stratum").agg(F.count("*").alias("n"), F.first("label").alias("label")).collect()
    if len({r.label for r in strata}) < 2:
        return None
    # Rows are drawn by URL and page, so that copies of a URL are drawn one by one.
    quota = fit_rows // 4
    shares = F.coalesce(*[F.when(F.col("stratum") == r.stratum, math.ceil(_BUCKETS * min(1.0, 1.2 * quota / r.n))) for r in strata])
    place = F.xxhash64("url", "page_id")
    drawn = df.withColumn("place", place).filter(F.pmod("place", F.lit(_BUCKETS)) < shares)
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("place"))).filter(F.col("k") <= quota)
    weight = F.coalesce(*[F.when(F.col("stratum") == r.stratum, r.n / min(quota, r.n)) for r in strata]) * F.col("trust")
    sample = drawn.select("host", "label", "fold", "stratum", weight.alias("weight"), *FEATURES)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sample = shared_table(assembler.transform(sample).select("host", "label", "fold", "stratum", "weight", "features").coalesce(FIT_TASKS), "url-sample")
    trainer = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7, labelCol="label", featuresCol="features", weightCol="weight")

    def scored(model, rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("p", vector_to_array("probability")[1])

    cross = None
    for k in range(FOLDS):
        train, test = sample.filter(F.col("fold") != k), sample.filter(F.col("fold") == k)
        if train.select("label").distinct().count() < 2:
            part = test.withColumn("p", F.lit(0.0))
        else:
            part = scored(trainer.fit(train), test)
        part = part.select("host", "label", "stratum", "weight", "p")
        cross = part if cross is None else cross.unionByName(part)
    model = trainer.fit(sample)
    return lambda rows: scored(model, assembler.transform(rows)), cross


def _prepared(pages: DataFrame, rules, words) -> DataFrame:
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, listed = rule_columns(F.col("host"), F.col("path"), rules)
    df = _labelled(_lexical(df.withColumns({"rule": rule, "listed": listed})), words)
    counts = df.groupBy("suffix", "fold").agg(F.sum(F.col("label") * F.col("trust")).alias("bad"), F.sum("trust").alias("all"))
    return _with_suffix_rates(df, counts)


def _bin(p) -> Column:
    return F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).cast("int")


def cross_scored(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS, words=SITE_WORDS) -> DataFrame:
    """``host, label, stratum, weight, p_block`` of the sample, each row scored by trees
    that have seen no URL of its host: what the operator's precision and recall on new
    hosts are measured on.  Empty where there is one class only."""
    learned = _learned(_prepared(pages, rules, words), fit_rows)
    if learned is None:
        return pages.sparkSession.createDataFrame([], "host string, label double, stratum int, weight double, p_block double")
    cross = shared_table(learned[1], "url-cross")
    return cross.withColumn("p_block", F.get(_curve(cross), _bin("p"))).drop("p")


def _curve(cross: DataFrame) -> Column:
    bins = cross.groupBy(_bin("p").alias("bin")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).collect()
    return F.array(*[F.lit(x) for x in _isotonic([(r.bin, r.good, r["all"]) for r in bins])])


def judge_urls(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS, words=SITE_WORDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and so no rule; it is
    judged by the trees like any other.  Repeated rows come back each, an empty table
    gives an empty result, other columns of ``pages`` are not looked at, and a url of any
    length is read whole.  Where the labelled URLs hold one class only, nothing can be
    learned and the verdict of the method is ``allow``.

    Suffix statistics are taken over all URLs and joined by suffix, one row a suffix; the
    sample has at most ``fit_rows`` rows, whatever is repeated."""
    df = _prepared(pages, rules, words)
    learned = _learned(df, fit_rows)
    if learned is None:
        judged = df.withColumn("p_block", F.lit(0.0))
    else:
        score, cross = learned
        curve = _curve(cross)
        judged = score(df).withColumn("p_block", F.get(curve, _bin("p")))
    verdict = F.coalesce("listed", F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
