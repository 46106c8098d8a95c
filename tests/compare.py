"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=repr)


def differences(df, con, sql: str) -> list[str]:
    names, ours = spark_rows(df)
    duck_names, theirs = duck_rows(con, sql)
    if names != duck_names:
        return [f"columns {names} against {duck_names}"]
    found = [] if len(ours) == len(theirs) else [f"{len(ours)} rows against {len(theirs)}"]
    only_ours, only_theirs = set(ours) - set(theirs), set(theirs) - set(ours)
    found += [f"only Spark:  {row}" for row in sorted(only_ours, key=repr)[:5]]
    found += [f"only DuckDB: {row}" for row in sorted(only_theirs, key=repr)[:5]]
    return found
