"""Ranked-retrieval metrics over arrays, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_even


def _hits(retrieved: Column, expected: Column, k: Column) -> Column:
    return F.when(k > 0, F.size(F.filter(F.slice(retrieved, F.lit(1), F.greatest(k, F.lit(1))), lambda x: F.array_contains(expected, x)))).otherwise(0)


def precision_at(retrieved: Column, expected: Column, k: Column) -> Column:
    """Hits among the first ``k`` over ``k``; 0 for ``k`` of 0."""
    return F.coalesce(F.try_divide(_hits(retrieved, expected, k).cast("double"), k.cast("double")), F.lit(0.0))


def recall_at(retrieved: Column, expected: Column, k: Column) -> Column:
    return F.coalesce(F.try_divide(_hits(retrieved, expected, k).cast("double"), F.size(expected).cast("double")), F.lit(0.0))


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    """1 over the first relevant rank of the whole list, else 0."""
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def r_precision(retrieved: Column, expected: Column) -> Column:
    return precision_at(retrieved, expected, F.size(expected))


def evaluate(runs: DataFrame, k: int = 10) -> DataFrame:
    """``runs`` (``query_id, retrieved, expected``) with the four metrics at 4 places;
    queries that expect nothing are left out."""
    r, e = F.col("retrieved"), F.col("expected")
    scored = runs.filter(F.size("expected") > 0)
    four = {"precision": precision_at(r, e, F.lit(k)), "recall": recall_at(r, e, F.lit(k)), "mrr": reciprocal_rank(r, e), "r_precision": r_precision(r, e)}
    return scored.select("query_id", *[round_even(c, 4).alias(n) for n, c in four.items()])


def evaluate_found(found: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """The same metrics from rows: ``found`` (``query_id, rank, relevant``) and
    ``expected`` (``query_id, expected``, the number of relevant items).  No list of
    relevant items is built; queries that expect nothing, or found nothing, are left
    out."""
    n, hit = F.col("expected"), F.coalesce("relevant", F.lit(False))
    counted = found.join(expected.filter("expected > 0"), "query_id").groupBy("query_id", "expected").agg(
        F.count_if(hit & (F.col("rank") <= k)).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit & (F.col("rank") <= n)).alias("r_hits")
    )
    ratio = lambda a, b: a.cast("double") / b
    four = {"precision": ratio(F.col("hits"), F.lit(k)), "recall": ratio(F.col("hits"), n), "mrr": F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), "r_precision": ratio(F.col("r_hits"), n)}
    return counted.select("query_id", *[round_even(c, 4).alias(name) for name, c in four.items()])


def averages(scores: DataFrame) -> DataFrame:
    """Means of the already rounded scores."""
    return scores.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("precision", "recall", "mrr", "r_precision")])


def by_type(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of all given scores per query type."""
    return scores.select("type", F.explode(F.array(*columns)).alias("s")).groupBy("type").agg(F.round(F.avg("s"), 6).alias("avg_score"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Queries, seconds and tokens in total and on average; missing ones count 0."""
    tokens, seconds = F.sum(F.coalesce("tokens_used", F.lit(0))), F.sum(F.coalesce("elapsed", F.lit(0.0)))
    n = F.count("*")
    return runs.agg(n.alias("questions"), tokens.alias("total_tokens"), F.floor(F.try_divide(tokens, n)).cast("long").alias("avg_tokens"), F.round(seconds, 4).alias("total_elapsed"), F.round(seconds / n, 4).alias("avg_elapsed"))
