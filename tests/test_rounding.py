"""Rounded values and printed decimals equal those of the SQL twins at ties."""

import duckdb
from pyspark.sql import functions as F

from voxlake.functions import text as tx
from voxlake.operators import rag, reports


def test_rates_at_ties_equal_sql(spark):
    pairs = [(373, 400), (418, 800), (28443, 7600), (6349, 400), (106, 800), (0, 0), (29, 1), (1, 32)]
    t = spark.createDataFrame([(k, "x" * n, "en", "m", -k / 100, d) for k, (n, d) in enumerate(pairs)], "episode_id int, full_text string, language string, model_used string, avg_logprob double, duration_seconds int")
    got = [r.chars_per_minute for r in reports.transcript_metrics(t).orderBy("episode_id").collect()]
    sql = "SELECT round_even(CASE WHEN {1} = 0 THEN 0.0 ELSE CAST({0} AS DOUBLE) / (CAST({1} AS DOUBLE) / 60) END, 1)"
    assert got == [duckdb.connect().execute(sql.format(*p)).fetchone()[0] for p in pairs]


def test_rounding_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT s * n / d AS x FROM (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) a(s), range(1, 401) b(n), (VALUES (80), (384), (400), (560), (800), (4000)) c(d) UNION ALL SELECT unnest([1234.0005, 0.0005, 4.35, 8.45, 1e-9])")
    rows = con.execute("SELECT x, round_even(x, 4), round_even(x, 1), printf('%.3f', x) FROM v").fetchall()
    df = spark.createDataFrame([(r[0],) for r in rows], "x double")
    got = df.select("x", tx.round_even("x", 4), tx.round_even("x", 1), tx.fixed(F.col("x"), 3)).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_result_line_at_a_tie(spark):
    rows = [(0.4165, "0.416"), (0.0625, "0.062"), (0.1875, "0.188"), (0.6375, "0.637"), (-0.4165, "-0.416"), (1.0, "1.000")]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(rows)], "k int, s double")
    got = [r.line for r in df.select("k", rag.result_line(F.lit(1), F.lit("t"), F.lit(0.0), F.col("s"), F.lit("x")).alias("line")).orderBy("k").collect()]
    assert got == [f"[1] t @ 00:00 (similarity: {want})\n    x" for _, want in rows]
