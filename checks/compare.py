"""Run queries next to their SQL twins: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.base import TABLES
from checks.registry import CHECKS
from tunelake.session import local_session


def twin_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(row) for row in rows), key=repr)


def difference(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when both engines agree, else a short description."""
    item = CHECKS[name]
    frame = item.spark(spark, sf_dir)
    mine = rows_of(frame.collect())
    text = item.oracle()
    if text is None:
        return None if mine else "no rows"
    cursor = connection.execute(text)
    names = [d[0] for d in cursor.description]
    kinds = [str(d[1]) for d in cursor.description]
    theirs = rows_of(cursor.fetchall())
    if names != frame.columns:
        return f"columns {frame.columns} vs {names}"
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}; {mine[:2]} vs {theirs[:2]}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ ({kinds}): {wrong[:2]}"
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(CHECKS)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = twin_connection(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
