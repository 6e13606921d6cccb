"""Run registered queries next to their SQL twins in DuckDB and compare rows."""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    import duckdb
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(df, connection, sql: str) -> list[str]:
    """Differences between a DataFrame and a SQL text; empty when they agree in names, types and values."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    expected = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns differ: {sorted(df.columns)} / {sorted(names)}"]
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} / {types[name]}")
    actual = sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    wanted = sorted_rows(names, expected)
    if len(actual) != len(wanted):
        problems.append(f"rows: {len(actual)} / {len(wanted)}")
    differing = [(a, b) for a, b in zip(actual, wanted) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {differing[0]}")
    return problems


def main(folder: str, *wanted: str) -> None:
    import __spark_entry__ as entry
    from tidemark.session import build_session
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = entry.oracle_sql()
    for name, function in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            problems = compare(df, connection, oracles[name]) if name in oracles else [f"rows only: {len(df.collect())}"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{time.time() - start:6.1f}s {name}: {'ok' if not problems else problems}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
