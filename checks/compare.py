"""Run registered queries and their SQL side by side: python -m checks.compare SF_DIR [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import SQL
from checks.queries import QUERIES
from ebbtide.session import local_session


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, repr(float(value)))
    return (3, str(value))


def normal_rows(names: list[str], rows) -> list[tuple]:
    at = [names.index(name) for name in sorted(names)]
    return sorted(tuple(_cell(row[i]) for i in at) for row in rows)


def difference(df, connection: duckdb.DuckDBPyConnection, name: str) -> str | None:
    """What is different between the two results, or None."""
    ours = normal_rows(df.columns, df.collect())
    result = connection.execute(SQL[name])
    names = [column[0] for column in result.description]
    theirs = normal_rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else None


def main(sf_dir: str, wanted: list[str]) -> int:
    spark, connection, failed = local_session(), duck(sf_dir), 0
    for name, run in QUERIES.items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            if name in SQL:
                found = difference(run(spark, sf_dir), connection, name)
                verdict = found or "equal"
                failed += found is not None
            else:
                verdict = f"{len(run(spark, sf_dir).collect())} rows (no SQL)"
        except Exception as error:  # the report goes on with the next query
            verdict, failed = f"ERROR {str(error)[:600]}", failed + 1
        print(f"{name:40s} {time.time() - started:6.1f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
