"""Compare a query's rows with its SQL twin's, regardless of order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


def differences(con, sql: str, df) -> str:
    result = con.execute(sql)
    names = sorted(c[0] for c in result.description)
    place = {c[0]: k for k, c in enumerate(result.description)}
    want = sorted((tuple(_plain(r[place[n]]) for n in names) for r in result.fetchall()), key=repr)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} and {len(want)} rows; only here {extra}; only there {missing}"
